"""Keys that hold a large share of the rows.

One user or item may own a third of a table.  Three tools keep such a key out
of a single task:

* ``hot_keys`` finds every key that holds more than a slice: a sixteenth of a
  task's even share of the rows, or ``rows_per_slice`` where that is more;
* ``join_sliced`` cuts their rows into slices and repeats the other side once
  per slice, so that a join on the key is spread out;
* ``positions`` numbers rows inside a group by counting slices of the group
  first, so that no window ever holds a whole hot group.

At most SLICES_PER_TASK keys per task can hold that much, so the table of hot
keys is bounded by the number of tasks, without a limit that would leave a key
out, and no slice is larger than the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SLICES_PER_TASK = 16
ROWS_PER_SLICE = 1_000_000

SLICE = "_slice"
SLICES = "_slices"


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Every key with more rows than a slice, and its number of slices.

    The count is partial on the map side, so a hot key costs one row per task;
    the total is a scalar subquery over the same counts.
    """
    return hot_of_counts(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, rows_per_slice)


def hot_of_counts(counts: DataFrame, keys: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``hot_keys`` of a table whose rows per key (``_n``) are known."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("_n").alias("_all")).scalar()
    sized = counts.withColumn("_slice_rows", F.greatest(F.lit(float(rows_per_slice)), total / (SLICES_PER_TASK * tasks)))
    return sized.filter(F.col("_n") > F.col("_slice_rows")).select(*keys, F.ceil(F.col("_n") / F.col("_slice_rows")).cast("int").alias(SLICES))


def with_slices(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Add the number of slices of each row's key: 1 unless it is hot."""
    return df.join(F.broadcast(hot), list(keys), "left").withColumn(SLICES, F.coalesce(SLICES, F.lit(1)))


def add_slice(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Give each row of a hot key one of the key's slices, other rows slice 0.

    The input partition takes part in the hash, so that copies of one row are
    spread too; both parts are the same when a lost task runs again.
    """
    code = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in df.columns])
    cut = with_slices(df.withColumn("_code", code), keys, hot)
    return cut.withColumn(SLICE, F.when(F.col(SLICES) > 1, F.pmod("_code", F.col(SLICES))).otherwise(0).cast("int")).drop("_code")


def repeat_slices(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Repeat each row once per slice of its key."""
    return with_slices(df, keys, hot).withColumn(SLICE, F.explode(F.sequence(F.lit(0), F.col(SLICES) - 1))).drop(SLICES)


def join_sliced(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Equi-join of a large ``left``, skewed on ``keys``, with ``right``.

    ``right`` should hold few rows per key: it is repeated for hot keys.
    ``left`` is read twice, once to count its keys, unless ``hot`` is given.
    Works for inner, left, left_semi and left_anti.
    """
    keys = list(keys)
    hot = hot_keys(left, keys, rows_per_slice) if hot is None else hot
    cut = add_slice(left, keys, hot).drop(SLICES)
    joined = cut.join(repeat_slices(right, keys, hot), [*keys, SLICE], how)
    extra = [] if how in ("left_semi", "left_anti") else [c for c in right.columns if c not in keys]
    return joined.select(*left.columns, *extra)


def join_chain(
    df: DataFrame,
    steps: Sequence[tuple[DataFrame, Sequence[str], str]],
    rows_per_slice: int = ROWS_PER_SLICE,
    pin: bool = False,
) -> DataFrame:
    """``join_sliced`` with several tables in turn: (right, keys, how) each.

    Every key is counted on ``df`` itself, once, not on the joins before it:
    counting those would work them out again for each further join.  ``df`` is
    read once per key and once for the joins, so store it if it is costly.
    ``pin`` looks for hot keys at once (``pin_hot_keys``): right for a stored
    ``df``, where it mostly leaves plain joins.
    """
    find = pin_hot_keys if pin else hot_keys
    hot = {keys: find(df, keys, rows_per_slice) for keys in dict.fromkeys(tuple(keys) for _, keys, _ in steps)}
    for right, keys, how in steps:
        df = join_sliced(df, right, keys, how, hot[tuple(keys)])
    return df


def positions(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    order: Sequence[str] = (),
    weight: str | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Rows before each row of its group, and the group's total.

    The group is ordered by ``unit``, an evenly spread number in [0, 1), then
    by ``order``.  Adds ``_before`` and ``_total``; each row counts ``weight``
    times.  A hot group is cut into ranges of ``unit`` that are counted apart
    and put back together through their totals.
    """
    keys = list(keys)
    grouped = [*keys, SLICE]
    cut = with_slices(df, keys, hot_keys(df, keys, rows_per_slice))
    cut = cut.withColumn(SLICE, F.floor(F.col(unit) * F.col(SLICES)).cast("int")).drop(SLICES)
    size = F.col(weight) if weight else F.lit(1)

    ordered = Window.partitionBy(*grouped).orderBy(unit, *order)
    inside = cut.withColumn("_inside", _before(F.sum(size), ordered))

    across = Window.partitionBy(*keys).orderBy(SLICE)
    totals = (
        cut.groupBy(*grouped)
        .agg(F.sum(size).alias("_size"))
        .withColumn("_offset", _before(F.sum("_size"), across))
        .withColumn("_total", F.sum("_size").over(Window.partitionBy(*keys)))
        .drop("_size")
    )
    return (
        inside.join(totals, grouped)
        .withColumn("_before", (F.col("_inside") + F.col("_offset")).cast("long"))
        .select(*df.columns, "_before", F.col("_total").cast("long").alias("_total"))
    )


def _before(total: Column, window) -> Column:
    return F.coalesce(total.over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def pin_hot_keys(df: DataFrame, keys: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``hot_keys`` worked out at once, for tables that are joined often.

    The result is a local table of at most SLICES_PER_TASK rows per task.  When no key is
    hot it is empty, and Spark removes the slicing from later plans.  A table
    with no more rows than a slice has no hot key: for a stored table that
    count reads the file footers only.
    """
    hot = hot_keys(df, keys, rows_per_slice)
    rows = hot.collect() if df.count() > rows_per_slice else []
    return df.sparkSession.createDataFrame(rows, hot.schema)
