"""Bias terms of one or several models over one table of cells cut into a grid of blocks.

With the mean taken out of the ratings, a half step of Koren's rule is

    b_i = (base_i - sum(n b_u)) / (reg_i + n_i),    base_i = sum(r - mean)

so the loop needs the counts n of the cells, but no rating.  Users and items
have dense codes and are dealt to G groups each; a cell lies in the block of its
two groups.  The cells are packed once (two places and a count each) and kept
where they are; a half step sends each group's terms, one array, to the G blocks
that need them, and the blocks send back one array of sums for the other side.
What moves is ids x G numbers, with G about the root of the number of tasks,
whatever the number of ratings.  Models that differ in their penalties only
share the blocks and take their steps in the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteforge.operators.codes import number_rows
from tasteforge.operators.prep import ITEM, USER
from tasteforge.operators.skew import hot_of_counts, join_sliced
from tasteforge.sources.shared import cut_lineage, stage

# Blocks per task, so that a task with several blocks evens out; ids in a group at most; cells packed at a time.
BLOCKS_PER_TASK, GROUP_IDS, PACK_ROWS = 2, 1_000_000, 1_000_000
TERMS = "own int, model int, terms array<double>"
CODE, AT = "_code", ["u", "i"]


def fit(
    cells: DataFrame, mean: float, regs: Sequence[tuple[float, float]], epochs: int, cut_every: int, rows_per_slice: int, groups: int | None = None
) -> list[tuple[DataFrame, DataFrame]]:
    """(items, users) of each (reg_i, reg_u) from stored cells (user_id, business_id, _sum, _n)."""
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = {key: coded(cells, key, mean) for key in (USER, ITEM)}
    sizes = {key: table.agg(F.count(F.lit(1)), F.coalesce(F.max("cells"), F.lit(0))).first() for key, table in ids.items()}
    most = max(size[0] for size in sizes.values())
    groups = groups or max(math.ceil(math.sqrt(BLOCKS_PER_TASK * tasks)), math.ceil(most / GROUP_IDS))
    hot = {
        key: hot_of_counts(table.select(key, F.col("cells").alias("_n")), [key], rows_per_slice)
        for key, table in ids.items()
        if sizes[key][1] > rows_per_slice
    }
    blocks = packed(cells, ids, hot, groups).repartition(tasks, *AT).sortWithinPartitions(*AT).persist()
    bases = {
        key: stage(bases_of(ids[key], groups, [reg[n] for reg in regs]), "bias-bases").repartition(tasks, "own", "model").persist()
        for n, key in enumerate((ITEM, USER))
    }

    def half_step(own: str, terms: DataFrame) -> DataFrame:
        here, there = AT if own == USER else AT[::-1]
        copies = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias(here)
        sent = terms.select(F.col("own").alias(there), copies, "model", "terms").repartition(tasks, *AT)
        sums = blocks.groupBy(*AT).cogroup(sent.groupBy(*AT)).applyInArrow(block_sums(here, there), TERMS)
        return bases[own].groupBy("own", "model").cogroup(sums.groupBy("own", "model")).applyInArrow(solve, TERMS)

    items = bases[ITEM].select("own", "model", F.zip_with("base", "weight", lambda b, w: b / w).alias("terms"))
    try:
        for epoch in range(1, epochs + 1):
            items = half_step(ITEM, users) if epoch > 1 else items
            items = cut_lineage(items) if epoch == epochs else items
            users = half_step(USER, items)
            users = cut_lineage(users) if epoch == epochs or epoch % cut_every == 0 else users
        items, users = (cut_lineage(named(terms, ids[key], key, name, groups)) for terms, key, name in ((items, ITEM, "b_i"), (users, USER, "b_u")))
    finally:
        for table in (blocks, *bases.values()):
            table.unpersist()
    return [tuple(table.filter(F.col("model") == n).drop("model") for table in (items, users)) for n in range(len(regs))]


def coded(cells: DataFrame, key: str, mean: float) -> DataFrame:
    """(key, cells, n, base, _code) of each id, stored: its cells and ratings, what these leave after the mean, its code."""
    base = F.sum(F.col("_sum") - F.col("_n") * mean)
    counts = cells.groupBy(key).agg(F.count(F.lit(1)).alias("cells"), F.sum("_n").cast("double").alias("n"), base.alias("base"))
    return stage(number_rows(counts, [key], CODE), "bias-ids")


def packed(cells: DataFrame, ids: dict[str, DataFrame], hot: dict[str, DataFrame], groups: int) -> DataFrame:
    """(u, i, left, right, n): the cells of a block, as arrays of places in its two groups and of counts."""
    found = cells.select(USER, ITEM, F.col("_n").cast("int").alias("n"))
    for key, name in ((USER, "_u"), (ITEM, "_i")):
        codes = ids[key].select(key, F.col(CODE).alias(name))
        found = (join_sliced(found, codes, [key], hot=hot[key]) if key in hot else found.join(codes, key)).drop(key)
    return found.select("_u", "_i", "n").mapInArrow(pack(groups), "u int, i int, left binary, right binary, n binary")


def pack(groups: int):
    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        user, item, n = (np.concatenate([batch.column(c).to_numpy(zero_copy_only=False) for batch in held]) for c in range(3))
        block = user % groups * groups + item % groups
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
        parts = np.split(order, starts[1:])
        found = block[order[starts]]
        arrays = [[(part_of[part]).astype(np.int32).tobytes() for part in parts] for part_of in (user // groups, item // groups, n)]
        columns = [pa.array((found // groups).astype(np.int32)), pa.array((found % groups).astype(np.int32)), *[pa.array(a, pa.binary()) for a in arrays]]
        return pa.RecordBatch.from_arrays(columns, [*AT, "left", "right", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= PACK_ROWS:
                yield packs(held)
                held, rows = [], 0
        if held:
            yield packs(held)

    return run


def bases_of(ids: DataFrame, groups: int, regs: Sequence[float]) -> DataFrame:
    """(own, model, base, weight): of each group and model, the arrays that a half step starts from and divides by."""

    def gather(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(CODE)
        base, n = (rows[c].to_numpy() for c in ("base", "n"))
        columns = [
            pa.array([key[0].as_py()] * len(regs), pa.int32()),
            pa.array(range(len(regs)), pa.int32()),
            pa.array([base] * len(regs), pa.list_(pa.float64())),
            pa.array([n + reg for reg in regs], pa.list_(pa.float64())),
        ]
        return pa.table(columns, ["own", "model", "base", "weight"])

    grouped = ids.select((F.col(CODE) % groups).cast("int").alias("own"), CODE, "base", "n").groupBy("own")
    return grouped.applyInArrow(gather, "own int, model int, base array<double>, weight array<double>")


def _array(column: pa.ChunkedArray, row: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False)


def block_sums(own: str, other: str):
    """Of each model, the sums of n times the other side's term, one number per place of the block's own group."""
    mine, theirs = ("left", "right") if own == "u" else ("right", "left")

    def run(cells: pa.Table, sent: pa.Table) -> pa.Table:
        read = lambda name: np.concatenate([np.frombuffer(b.as_buffer(), np.int32) for b in cells[name]])
        models, sums = sent["model"].to_pylist(), []
        if len(cells):
            at, place, n = read(mine), read(theirs), read("n")
            for row in range(len(sent)):
                sums.append(np.bincount(at, n * _array(sent["terms"], row)[place]))
        models = models[: len(sums)]
        group = [cells[own][0].as_py()] * len(sums) if len(sums) else []
        return pa.table([pa.array(group, pa.int32()), pa.array(models, pa.int32()), pa.array(sums, pa.list_(pa.float64()))], ["own", "model", "terms"])

    return run


def solve(key: tuple, bases: pa.Table, sums: pa.Table) -> pa.Table:
    """The new terms of a group; an array of sums ends at the last place that its block holds."""
    left = _array(bases["base"], 0).copy()
    for row in range(len(sums)):
        part = _array(sums["terms"], row)
        left[: len(part)] -= part
    terms = left / _array(bases["weight"], 0)
    own, model = (pa.array([k.as_py()], pa.int32()) for k in key)
    return pa.table([own, model, pa.array([terms], pa.list_(pa.float64()))], ["own", "model", "terms"])


def named(terms: DataFrame, ids: DataFrame, key: str, name: str, groups: int) -> DataFrame:
    """(key, name, model) from the arrays of all models."""
    each = terms.select("own", "model", F.posexplode("terms").alias("_place", name))
    coded_terms = each.select((F.col("_place").cast("long") * groups + F.col("own")).alias(CODE), "model", name)
    return ids.select(key, CODE).join(coded_terms, CODE).select(key, name, "model")
