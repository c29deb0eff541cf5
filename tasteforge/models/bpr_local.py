"""BPR by sequential steps inside tasks and weighted averages between them.

Users are dealt to blocks; a user with more positives than a slice is dealt to
several.  An epoch is one job: every block gets the factors of its own users
and items (``route``, worked out once), walks its positives in small batches of
stochastic gradient steps, and returns what it changed; a factor that several
blocks changed becomes the mean of theirs, weighted by their numbers of
updates.  What is shuffled are factors, ids x blocks; the positives lie where
they are from the first epoch on.

The negative of a positive is the item of another row of its block, so popular
items are drawn more often; each epoch shifts which row that is.  An item that
the user has rated is no negative: the user's positives lie in the block as one
sorted array that is searched, so nothing is joined.  Of a user cut into slices
each block of theirs holds all of the user's items for that search.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tasteforge.functions.hashing import HEX_DIGITS, uniform
from tasteforge.models import gradient
from tasteforge.operators.skew import SLICE, SLICES, add_slice, pin_hot_keys
from tasteforge.sources.shared import cut_lineage, stage

BLOCK_ROWS = 500_000
BATCH = 64
# Positives of a block whose negatives are drawn at a time.
ROWS_AT_ONCE = 500_000
# 2^32 over the golden ratio: multiples of it spread evenly over the ring.
RING, STEP = 2**32, 2654435769
KEYS = ["kind", "key"]


def start(positives: DataFrame, items: DataFrame, k: int, seed: int, spread: float = 0.1) -> DataFrame:
    """(kind, key, w, v0 ..): kind u or i, key a dense code."""
    users = positives.select(F.lit("u").alias("kind"), F.col("_u").alias("key")).distinct()
    keys = users.unionByName(items.select(F.lit("i").alias("kind"), F.col("_i").alias("key")))
    return keys.select(*KEYS, F.lit(0.0).alias("w"), *[((uniform(f"{seed}-{j}", *KEYS) - 0.5) * (2 * spread)).alias(f"v{j}") for j in range(k)])


def fit(
    positives: DataFrame, items: DataFrame, k: int, epochs: int, rate: float, reg: float, seed: int, rows_per_slice: int, blocks: int | None, batch: int
) -> DataFrame:
    """Parameters after ``epochs`` from stored (_u, _i), without repeats; ``batch`` 0 takes a block's rows at once."""
    spark = positives.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size, *most = positives.agg(F.count(F.lit(1)), F.coalesce(F.max("_u"), F.lit(0)), F.coalesce(F.max("_i"), F.lit(0))).first()
    blocks = blocks or max(tasks, math.ceil(size / BLOCK_ROWS))
    hot = pin_hot_keys(positives, ["_u"], rows_per_slice)
    block = F.floor(uniform("block", "_u", SLICE) * blocks).cast("int").alias("block")
    own = stage(add_slice(positives, ["_u"], hot).select(block, "_u", "_i", (F.col(SLICES) > 1).alias("cut"), F.lit(True).alias("own")), "bpr-blocks")
    cut = own.filter("cut")
    # The rest of a cut user's items, to be searched only; most tables have no such user.
    theirs = positives.join(F.broadcast(hot.select("_u")), "_u").toDF("_u", "_i")
    everywhere = cut.select("block", "_u").distinct().join(theirs, "_u").toDF("_u", "block", "_i")
    rest = everywhere.join(cut.select("block", "_u", "_i").toDF("block", "_u", "_i"), ["block", "_u", "_i"], "left_anti")
    laid = own.select("block", "_u", "_i", "own").unionByName(rest.selectExpr("block", "_u", "_i", "false as own"))
    # A task holds its blocks' codes as they come, so they are as narrow as they can be.
    code = "int" if max(most) < 2**31 else "bigint"
    laid = laid.select("block", F.col("_u").cast(code), F.col("_i").cast(code), "own")
    laid = laid.repartition(blocks, "block").sortWithinPartitions("block", "_u", "_i").persist()
    roles = F.inline(F.array(F.struct(F.lit("u").alias("kind"), F.col("_u").alias("key")), F.struct(F.lit("i").alias("kind"), F.col("_i").alias("key"))))
    route = own.select(F.col("block").alias("at"), roles).distinct().repartition(tasks, *KEYS).persist()
    names = ["w", *gradient.names("v", k)]
    params = cut_lineage(start(positives, items, k, seed))
    schema = f"kind string, key long, n double, {', '.join(f'{c} double' for c in names)}"
    try:
        for epoch in range(epochs):
            sent = params.join(route, KEYS).select("at", *KEYS, *names)
            walk = _walk(k, rate, reg, f"{seed}-{epoch}", batch)
            done = laid.groupBy("block").cogroup(sent.repartition(blocks, "at").groupBy("at")).applyInArrow(walk, schema)
            means = done.groupBy(*KEYS).agg(*[F.expr(f"sum(n * {c}) / sum(n) as {c}_new") for c in names])
            params = cut_lineage(params.join(means, KEYS, "left").select(*KEYS, *[F.coalesce(f"{c}_new", c).alias(c) for c in names]))
    finally:
        laid.unpersist()
        route.unpersist()
    return params


def shift(seed: str, block: int) -> int:
    """Where a block's ring of draws begins in an epoch; the same number as ``uniform`` of the block."""
    digest = hashlib.md5(f"{block}|{seed}".encode()).hexdigest()
    return math.floor(int(digest[:HEX_DIGITS], 16) / 16.0**HEX_DIGITS * RING)


def _walk(k: int, rate: float, reg: float, seed: str, batch: int):
    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        names = ["w", *[f"v{j}" for j in range(k)]]
        key, is_user = sent["key"].to_numpy(), pc.equal(sent["kind"], "u").to_numpy()
        values = np.column_stack([sent[c].to_numpy() for c in names]) if len(sent) else np.empty((0, k + 1))
        users, items = key[is_user], key[~is_user]
        by_user, by_item = np.argsort(users), np.argsort(items)
        users, items = users[by_user], items[by_item]
        factor = _Factors(values[is_user][by_user], values[~is_user][by_item])
        count = lambda t: (np.bincount(t[0], minlength=len(users)), np.bincount(t[1], minlength=len(items)) + np.bincount(t[2], minlength=len(items)))
        counts = (np.zeros(len(users), int), np.zeros(len(items), int))
        del key, values, by_user, by_item
        begun = shift(seed, rows["block"][0].as_py()) if len(rows) else 0
        if batch:
            parts = [*_triples(rows, users, items, begun)]
            triples = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, int)] * 3
            order = np.arange(len(triples[0]))
            np.random.default_rng(begun).shuffle(order)
            counts = count(triples)
            steps = ([c[order[at : at + batch]] for c in triples] for at in range(0, len(order), batch))
        else:
            steps = _triples(rows, users, items, begun)
            # All steps are taken from where the block began.
            factor.hold()
        for part in steps:
            factor.step(*part, rate, reg)
            if not batch:
                counts = tuple(c + more for c, more in zip(counts, count(part)))
        parts = []
        for name, keys, count, weight, vectors in (("u", users, counts[0], np.zeros(len(users)), factor.users), ("i", items, counts[1], factor.weights, factor.items)):
            moved = np.flatnonzero(count)
            columns = [pa.array([name] * len(moved), pa.string()), pa.array(keys[moved], pa.int64()), pa.array(count[moved].astype(np.float64)), pa.array(weight[moved])]
            parts.append(pa.table([*columns, *[pa.array(np.ascontiguousarray(vectors[moved, j])) for j in range(k)]], ["kind", "key", "n", *names]))
        return pa.concat_tables(parts)

    return run


def _triples(rows: pa.Table, users: np.ndarray, items: np.ndarray, begun: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A block's (user, item, other) as places in its sorted codes, some rows at a time; ``rows`` are sorted by user and item.

    A user's items that lie elsewhere (not ``own``) may be no item of this
    block: they are only searched.  All rows of a user lie together, so some
    rows are searched in those of their users only.
    """
    if not len(rows):
        return
    u_all, i_all, own = (rows[c].to_numpy() for c in ("_u", "_i", "own"))
    taken = None if own.all() else np.flatnonzero(own)
    n = len(own) if taken is None else len(taken)
    for begin in range(0, n, ROWS_AT_ONCE):
        place = np.arange(begin, min(begin + ROWS_AT_ONCE, n), dtype=np.uint64)
        ring = (place * np.uint64(STEP) + np.uint64(begun)) % np.uint64(RING)
        drawn = ((ring * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
        at = place.astype(np.int64)
        at, drawn = (at, drawn) if taken is None else (taken[at], taken[drawn])
        low, high = np.searchsorted(u_all, u_all[at[0]]), np.searchsorted(u_all, u_all[at[-1]], side="right")
        known = np.searchsorted(users, u_all[low:high]) * RING + i_all[low:high]
        user = np.searchsorted(users, u_all[at])
        asked = user * RING + i_all[drawn]
        found = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        kept = np.flatnonzero(known[found] != asked)
        yield user[kept], np.searchsorted(items, i_all[at[kept]]), np.searchsorted(items, i_all[drawn[kept]])


class _Factors:
    """One block's parameters: user vectors, item weights and vectors."""

    def __init__(self, users: np.ndarray, items: np.ndarray) -> None:
        self.users, self.weights, self.items = users[:, 1:].copy(), items[:, 0].copy(), items[:, 1:].copy()
        self.seen = (self.users, self.weights, self.items)

    def hold(self) -> None:
        """Take all further steps from the parameters as they are now."""
        self.seen = tuple(values.copy() for values in self.seen)

    def step(self, u: np.ndarray, i: np.ndarray, j: np.ndarray, rate: float, reg: float) -> None:
        """One gradient step up ln sigmoid for a batch; repeats within it add up."""
        users, weights, items = self.seen
        own, liked, other = users[u], items[i], items[j]
        plus, minus = weights[i], weights[j]
        ahead = plus - minus + np.einsum("nk,nk->n", own, liked - other)
        z = 1.0 / (1.0 + np.exp(ahead))
        pull = z[:, None] * own
        np.add.at(self.users, u, rate * (z[:, None] * (liked - other) - reg * own))
        np.add.at(self.weights, i, rate * (z - reg * plus))
        np.add.at(self.weights, j, rate * (-z - reg * minus))
        np.add.at(self.items, i, rate * (pull - reg * liked))
        np.add.at(self.items, j, rate * (-pull - reg * other))
