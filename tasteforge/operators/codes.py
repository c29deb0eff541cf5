"""Dense integer codes for string ids, and numbers of rows in an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tasteforge.sources.shared import cut_lineage

# Low bits of monotonically_increasing_id: the row's number in its partition.
ROW_BITS = 33


def dense_codes(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, code): codes 0..n-1 in the order of the key."""
    return number_rows(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], code)


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Add ``name``: 0..n-1 in the given order, which must leave no ties.

    The rows are sorted across partitions; a row's number is its place in its
    partition plus the sizes of the partitions before.  No task sees all rows,
    and only the partition sizes (one row per partition) are broadcast.  The
    sorted rows are checkpointed, so sizes and places belong to one layout.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = cut_lineage(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order))
    placed = laid_out.select(*df.columns, F.monotonically_increasing_id().alias("_id")).select(
        *df.columns,
        F.shiftright("_id", ROW_BITS).alias("_partition"),
        F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"),
    )
    sizes = placed.groupBy("_partition").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so one task is enough to add them up.
    before = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_partition", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_partition").select(
        *df.columns, (F.col("_row") + F.col("_offset")).cast("long").alias(name)
    )
