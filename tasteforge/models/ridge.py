"""Alternating weighted ridge regression over a two-sided table of entries.

An entry (left, right, x, w) says that the inner product of the factors of
``left`` and ``right`` should be near ``x``, with weight ``w``.  With one side
fixed, each id of the other side is a small ridge problem (Hu, Koren, Volinsky
2008; Singh and Gordon 2008).

Zeros need no rows.  Where all ids of a group on one side meet all ids of the
same group on the other with the same weight, and most of those meetings are
zeros, only the others are entries; they add nothing to the matrices
(``gram`` 0), and each id of the group adds the group's own matrix, the weighted
sum over the factors of the other side, which is worked out once a half step.

Where the factors of both sides are small, they are sent to every task: Spark
lays the entries out by id, and a task walks its ids in order and adds up a
k x k matrix for each, holding one matrix, not the id's rows.  A hot id is cut
into slices whose matrices are added by a grouped sum before they are solved.
Larger factors go to packed blocks of entries (``id_blocks``), so that no entry
is shuffled with a factor.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteforge.functions.hashing import uniform
from tasteforge.models.id_blocks import Blocks
from tasteforge.operators.skew import ROWS_PER_SLICE, SLICE, SLICES, add_slice, hot_of_counts
from tasteforge.sources.shared import cut_lineage, stage

# Factors up to this size are sent to every task; larger ones go to blocks.
BROADCAST_BYTES = 8 << 20
ID_BYTES = 64
SIDES = ("left", "right")
# Systems solved at a time.
SOLVED_ROWS = 50_000
# Width of an even spread whose variance is 1.
UNIT_SPREAD = 12**0.5


def alternate(
    entries: DataFrame,
    k: int,
    reg: float,
    iterations: int,
    seed: int = 16,
    rows_per_slice: int = ROWS_PER_SLICE,
    broadcast_bytes: int = BROADCAST_BYTES,
    groups: Mapping[int, float] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Factors of both sides: (left, factor) and (right, factor).

    With ``groups``, the weight of each group's meetings by its number (from 1
    on), entries have the columns ``gram``, ``left_group`` and ``right_group``;
    an id belongs to the greatest group that any of its entries names, 0 is none.
    """
    columns = ["left", "right", "x", "w"]
    entries = entries.dropna(subset=list(SIDES))
    if groups:
        stored = stage(entries.select(*columns, "gram", "left_group", "right_group"), "ridge-entries")
    else:
        stored = stage(entries.select(*columns), "ridge-entries").withColumns({"gram": F.col("w"), "left_group": F.lit(0), "right_group": F.lit(0)})
    counts = {
        side: stage(stored.groupBy(side).agg(F.count(F.lit(1)).alias("_n"), F.max(f"{side}_group").alias("group")), f"ridge-ids-{side}")
        for side in SIDES
    }
    small = max(table.count() for table in counts.values()) * (8 * k + ID_BYTES) <= broadcast_bytes
    problem = (_Problem if small else _Blocks)(stored, counts, k, reg, rows_per_slice, groups or {})
    right = problem.start("right", seed)
    left = right
    for _ in range(iterations):
        left = problem.solve("left", "right", right)
        right = problem.solve("right", "left", left)
    named = problem.named("left" if iterations else "right", left), problem.named("right", right)
    problem.close()
    return named


def _starting(ids: DataFrame, side: str, k: int, seed: int) -> DataFrame:
    """Hashed factors of unit variance: smaller ones take the penalty more steps to leave."""
    steps = F.sequence(F.lit(1), F.lit(k))
    value = lambda j: (uniform(seed, side, j) - 0.5) * UNIT_SPREAD
    return ids.select(side, F.transform(steps, value).alias("factor"))


def _by_group(sums: DataFrame, groups: Mapping[int, float], k: int) -> dict[int, np.ndarray]:
    """The matrix that every id of a group adds, from partial sums (group, sums): one k x k matrix per group."""
    rows = sums.select("group", F.posexplode("sums").alias("_at", "_v")).groupBy("group", "_at").agg(F.sum("_v").alias("_v")).collect()
    found = {group: np.zeros(k * k) for group in groups}
    for group, at, value in rows:
        found[group][at] = value * groups[group]
    return {group: total.reshape(k, k) for group, total in found.items()}


class _Problem:
    """Steps whose factors are sent to every task."""

    def __init__(
        self, stored: DataFrame, counts: dict[str, DataFrame], k: int, reg: float, rows_per_slice: int, groups: Mapping[int, float]
    ) -> None:
        spark = stored.sparkSession
        self.k, self.reg = k, reg
        self.tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.groups, self.counts = dict(groups), counts
        # Not hot here means not hot in any iteration: the entries are fixed.
        hot = {side: hot_of_counts(counts[side].select(side, "_n"), [side], rows_per_slice) for side in SIDES}
        found = {side: hot[side].collect() for side in SIDES}
        self.any_hot = {side: bool(found[side]) for side in SIDES}
        sliced = stored
        for side in SIDES:
            pinned = spark.createDataFrame(found[side], hot[side].schema)
            sliced = add_slice(sliced, [side], pinned).withColumnsRenamed({SLICE: f"{side}_slice", SLICES: f"{side}_slices"})
        self.entries = sliced
        self.layouts: dict[str, DataFrame] = {}

    def close(self) -> None:
        for table in self.layouts.values():
            table.unpersist()

    def named(self, side: str, factors: DataFrame) -> DataFrame:
        """Factors with the ids they belong to."""
        return factors

    def layout(self, side: str) -> DataFrame:
        """Entries partitioned and sorted by (id, slice) of one side, kept."""
        if side not in self.layouts:
            keys = [side, f"{side}_slice"]
            self.layouts[side] = self.entries.repartition(self.tasks, *keys).sortWithinPartitions(*keys).persist()
        return self.layouts[side]

    def start(self, side: str, seed: int) -> DataFrame:
        return cut_lineage(_starting(self.counts[side], side, self.k, seed))

    def solve(self, own: str, other: str, factors: DataFrame) -> DataFrame:
        """Factors of ``own`` with the factors of ``other`` fixed."""
        keys = [own, f"{own}_slice"]
        needed = [*keys, f"{own}_slices", "x", "w", "gram", f"{own}_group", "factor"]
        shared = self.shared(other, factors)
        joined = self.layout(own).join(F.broadcast(factors), other).select(*needed)
        parts = joined.sortWithinPartitions(*keys).mapInArrow(
            _normal_equations(self.k, self.reg, shared), f"{own} string, factor array<double>, sums array<double>"
        )
        if not self.any_hot[own]:
            return cut_lineage(parts.select(own, "factor"))
        parts = cut_lineage(parts)
        return cut_lineage(parts.filter("factor is not null").select(own, "factor").unionByName(self.merge(parts, own, shared)))

    def shared(self, other: str, factors: DataFrame) -> dict[int, np.ndarray]:
        """The matrix that every id of a group adds."""
        if not self.groups:
            return {}
        grouped = factors.join(self.counts[other].filter("group > 0"), other).select("group", "factor")
        return _by_group(grouped.mapInArrow(_group_sums(self.k), "group int, sums array<double>"), self.groups, self.k)

    def merge(self, parts: DataFrame, own: str, shared: dict[int, np.ndarray]) -> DataFrame:
        """Add the matrices of hot ids element by element, then solve them.  The last element is the group, not a sum."""
        value = F.when(F.col("_at") == self.k * (self.k + 1), F.max("_v")).otherwise(F.sum("_v"))
        sums = (
            parts.filter("factor is null")
            .select(own, F.posexplode("sums").alias("_at", "_v"))
            .groupBy(own, "_at")
            .agg(value.alias("_v"))
            .groupBy(own)
            .agg(F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_s"))
            .select(own, F.transform("_s", lambda e: e["_v"]).alias("sums"))
        )
        return sums.mapInArrow(_solve_sums(self.k, self.reg, shared), f"{own} string, factor array<double>")


class _Blocks:
    """Steps whose factors are sent to the blocks of entries that need them."""

    def __init__(
        self, stored: DataFrame, counts: dict[str, DataFrame], k: int, reg: float, rows_per_slice: int, groups: Mapping[int, float]
    ) -> None:
        self.k, self.reg, self.groups, self.counts = k, reg, dict(groups), counts
        self.width = k * (k + 1) // 2 + k
        self.blocks = Blocks(stored, counts, ["x", "w", *["gram"] * bool(groups)], self.width, rows_per_slice)
        self.labels = {
            side: cut_lineage(self.blocks.pack(side, table.select(side, F.col("group").cast("byte").alias("group")), "group", "int8"))
            for side, table in counts.items()
            if groups
        }

    def close(self) -> None:
        self.blocks.close()

    def named(self, side: str, factors: DataFrame) -> DataFrame:
        return cut_lineage(self.blocks.unpack(side, factors, self.k, "factor"))

    def start(self, side: str, seed: int) -> DataFrame:
        return cut_lineage(self.blocks.pack(side, _starting(self.counts[side], side, self.k, seed), "factor"))

    def solve(self, own: str, other: str, factors: DataFrame) -> DataFrame:
        """Factors of ``own``, an array per group, with the factors of ``other`` fixed."""
        finish = _solve_triangles(self.k, self.reg, self.shared(other, factors))
        return cut_lineage(self.blocks.sums(own, factors, self.k, self.width, _triangles(self.k), finish, self.labels.get(own)))

    def shared(self, other: str, factors: DataFrame) -> dict[int, np.ndarray]:
        if not self.groups:
            return {}
        both = factors.join(self.labels[other].withColumnRenamed("data", "label"), "at").select("data", "label")
        return _by_group(both.mapInArrow(_packed_group_sums(self.k), "group int, sums array<double>"), self.groups, self.k)


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    return pa.array(rows, type=pa.list_(pa.float64()))


def _ridge(grams: np.ndarray, rights: np.ndarray, reg: float) -> np.ndarray:
    """Solve a stack of small systems; a tiny ridge keeps singular ones solvable."""
    eye = np.eye(grams.shape[-1])
    return np.linalg.solve(grams + max(reg, 1e-10) * eye, rights[..., None])[..., 0]


def _group_sums(k: int):
    """Per task and group, the sum of the outer products of its factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            group = batch.column(0).to_numpy(zero_copy_only=False)
            factor = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)
            for g in np.unique(group):
                rows = factor[group == g]
                sums[int(g)] = sums.get(int(g), np.zeros((k, k))) + rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), _lists([m.ravel() for m in sums.values()])], ["group", "sums"])

    return run


def _with_shared(grams: np.ndarray, groups: np.ndarray, shared: dict[int, np.ndarray]) -> np.ndarray:
    for group, total in shared.items():
        grams = grams + (groups == group)[:, None, None] * total
    return grams


def _normal_equations(k: int, reg: float, shared: dict[int, np.ndarray]):
    """Rows sorted by (id, slice) to one factor, or one partial sum, per slice."""

    def emit(done: list[tuple]) -> pa.RecordBatch:
        ids = [d[0] for d in done]
        whole = [n for n, d in enumerate(done) if d[2] == 1]
        factors: list[np.ndarray | None] = [None] * len(done)
        sums: list[np.ndarray | None] = [np.concatenate([d[3].ravel(), d[4], [d[5]]]) if d[2] > 1 else None for d in done]
        if whole:
            grams = _with_shared(np.stack([done[n][3] for n in whole]), np.array([done[n][5] for n in whole]), shared)
            solved = _ridge(grams, np.stack([done[n][4] for n in whole]), reg)
            for n, factor in zip(whole, solved):
                factors[n] = factor
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), _lists(factors), _lists(sums)], ["id", "factor", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            part = batch.column(1).to_numpy(zero_copy_only=False)
            parts = batch.column(2).to_numpy(zero_copy_only=False)
            x = batch.column(3).to_numpy(zero_copy_only=False)
            w = batch.column(4).to_numpy(zero_copy_only=False)
            gram_w = batch.column(5).to_numpy(zero_copy_only=False)
            group = batch.column(6).to_numpy(zero_copy_only=False)
            factor = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(n, k)
            weighted, gram_weighted = factor * (w * x)[:, None], factor * gram_w[:, None]
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (part[1:] != part[:-1])])
            tops = np.maximum.reduceat(group, starts)
            done = []
            for s, e, top in zip(starts, np.r_[starts[1:], n], tops):
                gram = gram_weighted[s:e].T @ factor[s:e]
                right = weighted[s:e].sum(axis=0)
                if held is not None and held[0] == ids[s] and held[1] == part[s]:
                    held[3] += gram
                    held[4] += right
                    held[5] = max(held[5], top)
                    continue
                if held is not None:
                    done.append(tuple(held))
                held = [ids[s], part[s], parts[s], gram, right, top]
            if done:
                yield emit(done)
        if held is not None:
            yield emit([tuple(held)])

    return run


def _solve_sums(k: int, reg: float, shared: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sums = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k * k + k + 1)
            grams = _with_shared(sums[:, : k * k].reshape(-1, k, k), sums[:, -1], shared)
            solved = _ridge(grams, sums[:, k * k : -1], reg)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(solved))], ["id", "factor"])

    return run


def _packed_group_sums(k: int):
    """``_group_sums`` of factors and labels packed by group of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, label in zip(batch.column(0), batch.column(1)):
                factor, group = np.frombuffer(data.as_buffer()).reshape(-1, k), np.frombuffer(label.as_buffer(), np.int8)
                found = [int(g) for g in np.unique(group) if g > 0]
                sums = [(factor[group == g].T @ factor[group == g]).ravel() for g in found]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), _lists(sums)], ["group", "sums"])

    return run


def _triangles(k: int):
    """Of each entry the upper half of its factor's outer product and its right side."""
    first, second = np.triu_indices(k)

    def terms(factor: np.ndarray, x: np.ndarray, w: np.ndarray, gram: np.ndarray | None = None) -> np.ndarray:
        products = factor[:, first] * factor[:, second] * (w if gram is None else gram)[:, None]
        return np.hstack([products, factor * (w * x)[:, None]])

    return terms


def _solve_triangles(k: int, reg: float, shared: dict[int, np.ndarray]):
    first, second = np.triu_indices(k)

    def finish(total: np.ndarray, label: np.ndarray | None) -> np.ndarray:
        factors = np.empty((len(total), k))
        for start in range(0, len(total), SOLVED_ROWS):
            part = slice(start, start + SOLVED_ROWS)
            sums = total[part]
            grams = np.empty((len(sums), k, k))
            grams[:, first, second] = grams[:, second, first] = sums[:, : len(first)]
            grams = grams if label is None else _with_shared(grams, label[part], shared)
            factors[part] = _ridge(grams, sums[:, len(first) :], reg)
        return factors

    return finish
