"""Approximate nearest neighbours: a hierarchical k-means tree, walked best bin first.

1. *Tree.*  Fitted on a sample of at most ``fit_rows`` rows and 64 MB (those of
   least hash).  Its leaves hold about ``leaf_rows`` rows of the table while the
   sample suffices for that; beyond, there are at most ``fit_rows`` /
   ``least_sample`` leaves, which bounds the tree that every task gets.
2. *Index.*  Every row goes to the leaf that it is led to from the root by the
   nearest centre.  Leaves lie together in shards of a 64th of the table, at
   most ``shard_rows`` rows; a larger leaf takes several shards.
3. *Calibration.*  The true neighbours of ``calibrate`` queries (those of least
   hash), found by comparing these with every row, show how many leaves have to
   be visited: visits widen, leaf by leaf, until the share of true neighbours
   in the leaves visited reaches ``recall``.
4. *Search.*  A query walks the tree through a priority queue, best bin first,
   for that number of leaves, and on until they hold enough rows.  Visits widen
   in rounds, each with four times the leaves of the one before.  In a round a
   query is sent once to each shard with a leaf of its list and streams past
   the shard's rows; only rows no worse than its worst of the round before come
   back and are merged.  Better rows get rarer as fast as rounds get larger, so
   what comes back hangs on ``k`` and the rounds, not on rows or shards.

Nearness is the inner product in double precision, summed from the first
component to the last; matrix products only choose whom to sum for, with room
for their rounding.  Ties go to the smaller vec_id, null ids last.

Copies of a vector all score the same, so of each distinct vector the index
keeps the ``k`` + 1 smallest ids, which loses no result, and copies among the
queries are searched once: hot vectors cost no pairs.

Vectors that are null, empty, zero or hold null or non-finite entries take no
part, nor do those of another length than most have.  A row repeated in full
counts once; rows that share an id but not the vector are rows of their own.
A query's own row is left out.  Null ids can be found but do not ask.  Further
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tasteforge.llm.common import tasks
from tasteforge.llm.kmeans_tree import Tree, grow
from tasteforge.llm.vectors import blocks, finite_vector, matrix, usual_length
from tasteforge.operators.skew import join_sliced
from tasteforge.sources.shared import stage

FIT_ROWS, LEAF_ROWS, LEAST_SAMPLE = 65_536, 128, 16
# Long vectors make the sample smaller: the driver holds no more of it than this.
SAMPLE_BYTES = 64 << 20
# A shard holds a 64th of the index, between these bounds: what a query sends and gets hangs on the table, not on the session's partitions.
LEAST_SHARD, SHARD_ROWS, SHARES = 1024, 32_768, 64
CALIBRATE, RECALL = 256, 0.95
QUERIES_AT_ONCE = 512
FIRST_VISITS, WIDER = 2, 4
# Relative room for the rounding of a matrix product.
ROOM = 1e-12
KEY = ["h1", "h2"]
HIT = "h1 long, h2 long, vec_id long, score double, same boolean"


def nearest_neighbours(
    vectors: DataFrame,
    asks: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    fit_rows: int = FIT_ROWS,
    leaf_rows: int = LEAF_ROWS,
    least_sample: int = LEAST_SAMPLE,
    shard_rows: int = SHARD_ROWS,
    calibrate: int = CALIBRATE,
    recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each row for which ``asks``, a condition on the id column, holds."""
    spark = vectors.sparkSession
    usable = finite_vector(vector) & F.exists(vector, lambda c: c != 0)
    chosen = vectors.filter(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    length, n = usual_length(chosen, "vector")
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = chosen.filter(F.size("vector") == length)
    fit_rows = max(least_sample, min(fit_rows, SAMPLE_BYTES // (8 * length)))
    sample = matrix(_least_hashed(chosen, fit_rows, n).select("vector").toArrow()["vector"].combine_chunks())
    tree = grow(sample, max(least_sample, leaf_rows * len(sample) // n))

    smallest = Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last())
    distinct = chosen.select("vec_id", "vector").distinct()
    index = stage(_routed(distinct.withColumn("_place", F.row_number().over(smallest)).filter(F.col("_place") <= k + 1).drop("_place"), tree), "ann-index")
    # One row for each leaf.
    sizes = np.zeros(tree.leaves, np.int64)
    for leaf, rows in index.groupBy("leaf").count().collect():
        sizes[leaf] = rows
    shards = Shards(sizes, min(shard_rows, max(LEAST_SHARD, int(sizes.sum()) // SHARES)))

    hashes = [F.xxhash64("vector").alias("h1"), F.xxhash64(F.reverse("vector")).alias("h2")]
    queries = stage(chosen.filter("asks").select("vec_id", *hashes, "vector").distinct(), "ann-queries")
    visits = _calibrated_visits(index, queries, tree, sample, k, calibrate, recall)
    # Walks cost more than their bytes tell, so queries are spread over a stated number of tasks.
    asking = queries.repartition(tasks(spark), *KEY).groupBy(*KEY).agg(F.first("vector").alias("vector"))
    lists = None
    for passed, upto in rounds(visits):
        known = asking.withColumn("least", F.lit(float("-inf"))) if lists is None else asking.join(lists.select(*KEY, _worst(k)), KEY, "left")
        hits = _searched(index, _sent(known, tree, sizes, shards, passed, upto, upto == visits, k), shards, k)
        if lists is not None:
            hits = hits.unionByName(lists.select(*KEY, F.explode("found").alias("hit")).select(*KEY, "hit.vec_id", "hit.score", "hit.same"))
        lists = stage(_merged(hits, k), "ann-lists")
    found = join_sliced(queries.select(F.col("vec_id").alias("query_id"), *KEY), lists, KEY)
    others = F.filter("found", lambda e: ~(e["same"] & e["vec_id"].eqNullSafe(F.col("query_id"))))
    ranked = found.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def rounds(visits: int) -> list[tuple[int, int]]:
    """[first, end) of the visits of each round."""
    ends = [FIRST_VISITS]
    while ends[-1] < visits:
        ends.append(ends[-1] * WIDER)
    ends = [*[e for e in ends if e < visits], visits]
    return list(zip([0, *ends], ends))


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """(h1, h2, found): the ``k`` + 1 best hits of each query, best first."""
    order = F.struct((-F.col("score")).alias("less"), F.col("vec_id").isNull().alias("unnamed"), "vec_id", "score", "same")
    return hits.groupBy(*KEY).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k + 1).alias("found"))


def _worst(k: int) -> Column:
    """The score that a further hit must reach: none while the list is short."""
    return F.coalesce(F.get("found", F.lit(k))["score"], F.lit(float("-inf"))).alias("least")


def _least_hashed(df: DataFrame, rows: int, total: int) -> DataFrame:
    """At most ``rows`` rows: those of least hash, looked for below a bound that about as many reach."""
    hashed = df.withColumn("_hash", F.xxhash64("vec_id", "vector", F.lit("sample")))
    share = min(1.0, 1.1 * rows / max(total, 1) + 1e-3)
    bound = int(-(2**63) + share * (2**64 - 1024))
    return hashed.filter(F.col("_hash") <= F.lit(min(bound, 2**63 - 1))).orderBy("_hash", "vec_id").limit(rows)


def _routed(rows: DataFrame, tree: Tree) -> DataFrame:
    """(leaf, vec_id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, entries in blocks(batches, 1):
            yield pa.RecordBatch.from_arrays([pa.array(tree.route(entries), pa.int32()), batch.column(0), batch.column(1)], ["leaf", "vec_id", "vector"])

    return rows.select("vec_id", "vector").mapInArrow(run, f"leaf int, vec_id long, vector {rows.schema['vector'].dataType.simpleString()}")


class Shards:
    """Neighbouring leaves together in shards; a leaf too large for one has several of its own."""

    def __init__(self, sizes: np.ndarray, rows: int) -> None:
        self.first, self.parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // rows))
        shard, held = 0, 0
        for leaf, size in enumerate(sizes.tolist()):
            if held and held + size > rows:
                shard, held = shard + 1, 0
            self.first[leaf] = shard
            held += size
            if size > rows:
                shard, held = shard + int(self.parts[leaf]), 0
        self.count = shard + 1

    def of_rows(self) -> Column:
        """The shard of a row: looked up by its leaf, spread over the leaf's shards by a hash."""
        lookup = lambda numbers: F.get(F.lit(numbers.tolist()), F.col("leaf"))
        return (lookup(self.first) + F.pmod(F.xxhash64("vec_id", "vector", F.lit("shard")), lookup(self.parts))).cast("int")


def _calibrated_visits(index: DataFrame, queries: DataFrame, tree: Tree, sample: np.ndarray, k: int, calibrate: int, recall: float) -> int:
    """The number of leaves to visit, best bin first, for ``recall`` of the true neighbours."""
    asked = _least_hashed(queries, calibrate, queries.count()).select("vec_id", "vector").toArrow()
    if not len(asked):
        return 1
    entries, ids = matrix(asked["vector"].combine_chunks()), asked["vec_id"].to_numpy()
    # The k + 1 best of the sample, the query's own row perhaps among them, leave the k best at this score or above.
    scores = entries @ sample.T
    enough = len(sample) > k
    least = np.partition(scores, -k - 1, axis=1)[:, -k - 1] if enough else np.full(len(entries), -np.inf)
    least = least - ROOM * np.linalg.norm(entries, axis=1) * np.linalg.norm(sample, axis=1).max()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)]
        for batch, rows in blocks(batches, 2):
            found = entries @ rows.T
            found[ids[:, None] == np.array(batch.column(1).fill_null(-1))] = -np.inf
            query, row = np.nonzero((found >= least[:, None]) & (found > -np.inf))
            leaf = batch.column(0).to_numpy()
            best = [np.r_[a, b] for a, b in zip(best, (query, found[query, row], leaf[row]))]
            best = _best_of(*best, k)
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2], pa.int32())], ["query", "score", "leaf"])

    best = Window.partitionBy("query").orderBy(F.desc("score"), "leaf")
    near = index.mapInArrow(run, "query long, score double, leaf int").withColumn("_place", F.row_number().over(best)).filter(F.col("_place") <= k)
    leaf_of = near.select("query", "leaf").toArrow()
    truth = np.zeros((len(entries), tree.leaves), np.int64)
    np.add.at(truth, (leaf_of["query"].to_numpy(), leaf_of["leaf"].to_numpy()), 1)
    walks = [list(walk) for walk in tree.visits(entries)]
    reached, total, visits = 0, truth.sum(), 0
    while visits < tree.leaves and (visits == 0 or reached < recall * total):
        reached += sum(truth[query, walk[visits]] for query, walk in enumerate(walks))
        visits += 1
    return visits


def _best_of(query: np.ndarray, score: np.ndarray, leaf: np.ndarray, k: int) -> list[np.ndarray]:
    order = np.lexsort((leaf, -score, query))
    query, score, leaf = query[order], score[order], leaf[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return [query[keep], score[keep], leaf[keep]]


def _sent(queries: DataFrame, tree: Tree, sizes: np.ndarray, shards: Shards, passed: int, upto: int, last: bool, k: int) -> DataFrame:
    """(shard, h1, h2, least, vector, leaves): each query once for each shard that holds some of its leaves, visits ``passed`` to ``upto``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, entries in blocks(batches, 3):
            source, shard, leaves = [], [], []
            for row, walk in enumerate(tree.visits(entries)):
                wanted: dict[int, list[int]] = {}
                held = 0
                for visit, leaf in enumerate(walk):
                    # Own row and k others: the last visits go on until there are so many.
                    if visit >= upto and (held > k or not last):
                        break
                    held += int(sizes[leaf])
                    for part in range(int(shards.parts[leaf]) if visit >= passed else 0):
                        wanted.setdefault(int(shards.first[leaf]) + part, []).append(leaf)
                source += [row] * len(wanted)
                shard += list(wanted)
                leaves += list(wanted.values())
            taken = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *taken.columns, pa.array(leaves, pa.list_(pa.int32()))], ["shard", *KEY, "least", "vector", "leaves"])

    chosen = queries.select(*KEY, F.coalesce("least", F.lit(float("-inf"))).alias("least"), "vector")
    return chosen.mapInArrow(run, f"shard int, h1 long, h2 long, least double, vector {queries.schema['vector'].dataType.simpleString()}, leaves array<int>")


def _searched(index: DataFrame, sent: DataFrame, shards: Shards, k: int) -> DataFrame:
    """The ``k`` + 1 best rows of each query in each shard: rows of a shard come first and are held, queries stream past them."""
    zero = F.lit(0).cast("long")
    rows = index.select(
        shards.of_rows().alias("shard"), F.lit(0).alias("kind"), "leaf", "vec_id", zero.alias("h1"), zero.alias("h2"), F.lit(0.0).alias("least"),
        "vector", F.array().cast("array<int>").alias("leaves"),
    )
    asking = sent.select("shard", F.lit(1).alias("kind"), F.lit(0).alias("leaf"), zero.alias("vec_id"), *KEY, "least", "vector", "leaves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, shelf = None, [], None
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in zip(np.r_[0, cuts], np.r_[cuts, len(number)]):
                if begin == end:
                    continue
                part = batch.slice(begin, end - begin)
                if number[begin] != shard:
                    shard, held, shelf = number[begin], [], None
                if kind[begin] == 0:
                    held.append(part.select(["leaf", "vec_id", "vector"]))
                    continue
                if shelf is None and held:
                    shelf, held = Shelf(held), []
                for at in range(0, part.num_rows if shelf else 0, QUERIES_AT_ONCE):
                    yield shelf.search(part.slice(at, QUERIES_AT_ONCE), k)

    both = rows.unionByName(asking).repartition(max(shards.count, tasks(index.sparkSession)), "shard")
    return both.sortWithinPartitions("shard", "kind").mapInArrow(run, HIT)


class Shelf:
    """The rows of one shard, by leaf."""

    def __init__(self, held: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(held).sort_by("leaf").combine_chunks()
        leaf = table["leaf"].to_numpy()
        self.names = table["vec_id"].combine_chunks()
        self.entries = matrix(table["vector"].combine_chunks())
        starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
        self.ranges = {int(leaf[s]): slice(int(s), int(e)) for s, e in zip(starts, np.r_[starts[1:], len(leaf)])}
        self.longest = float(np.linalg.norm(self.entries, axis=1).max())

    def search(self, asking: pa.RecordBatch, k: int) -> pa.RecordBatch:
        entries = matrix(asking.column("vector"))
        room = ROOM * np.linalg.norm(entries, axis=1) * self.longest
        lists = asking.column("leaves")
        query = np.repeat(np.arange(len(entries)), lists.value_lengths().to_numpy())
        leaf = lists.flatten().to_numpy()
        order = np.argsort(leaf, kind="stable")
        query, leaf = query[order], leaf[order]
        given = asking.column("least").to_numpy()
        least = given - room
        kept = []
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        for group in np.split(np.arange(len(leaf)), cuts):
            rows = self.ranges.get(int(leaf[group[0]])) if len(group) else None
            if rows is None:
                continue
            own = query[group]
            scores = entries[own] @ self.entries[rows].T
            if scores.shape[1] > k:
                least[own] = np.maximum(least[own], np.partition(scores, -k - 1, axis=1)[:, -k - 1] - room[own])
            at, row = np.nonzero(scores >= least[own, None])
            kept.append((own[at], rows.start + row, scores[at, row]))
        none = np.empty(0, np.int64)
        query, row, rough = (np.concatenate(c) for c in zip(*kept)) if kept else (none, none, np.empty(0))
        still = rough >= least[query]
        query, row = query[still], row[still]
        score = np.zeros(len(query))
        for j in range(entries.shape[1]):
            score += entries[query, j] * self.entries[row, j]
        still = score >= given[query]
        query, row, score = query[still], row[still], score[still]
        unnamed = self.names.is_null().to_numpy(zero_copy_only=False)[row]
        name = self.names.fill_null(0).to_numpy()[row]
        order = np.lexsort((name, unnamed, -score, query))
        query, row, score = query[order], row[order], score[order]
        best = np.arange(len(query)) - np.searchsorted(query, query) < k + 1
        query, row, score = query[best], row[best], score[best]
        same = (entries[query] == self.entries[row]).all(axis=1)
        keys = [asking.column(c).take(pa.array(query)) for c in KEY]
        return pa.RecordBatch.from_arrays([*keys, self.names.take(pa.array(row)), pa.array(score), pa.array(same)], [*KEY, "vec_id", "score", "same"])
