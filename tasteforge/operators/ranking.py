"""Per-user ranking of scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tasteforge.operators.lists import ranked_lists
from tasteforge.operators.prep import ITEM, USER


def rank_candidates(scored: DataFrame, top_n: int = 50, strict: bool = False, dedupe: bool = True) -> DataFrame:
    """(user_id, business_id, prediction, rank) for ranks up to ``top_n``.

    Rows without a usable prediction are dropped first: Spark would sort NaN
    ahead of every number.  Equal predictions share the lowest rank and may
    exceed ``top_n``; ``strict`` breaks ties by item and keeps exactly top_n.
    Spark keeps only the first ``top_n`` ranks of each user in every map task,
    before the shuffle.
    """
    usable = scored.filter(F.col("prediction").isNotNull() & ~F.isnan("prediction"))
    if dedupe:
        usable = usable.groupBy(USER, ITEM).agg(F.max("prediction").alias("prediction"))
    best = F.desc("prediction")
    window = Window.partitionBy(USER)
    rank = F.row_number().over(window.orderBy(best, ITEM)) if strict else F.rank().over(window.orderBy(best))
    return usable.select(USER, ITEM, "prediction").withColumn("rank", rank).filter(F.col("rank") <= top_n)


def first_items(scored: DataFrame, top_n: int) -> DataFrame:
    """(user_id, business_id, prediction): every copy of the first ``top_n`` different rows of each user, ties by item.

    Rows without a usable prediction are dropped.  As in ``rank_candidates``
    no more than these leave a map task.
    """
    usable = scored.filter(F.col("prediction").isNotNull() & ~F.isnan("prediction")).select(USER, ITEM, "prediction")
    window = Window.partitionBy(USER).orderBy(F.desc("prediction"), ITEM)
    return usable.withColumn("_first", F.dense_rank().over(window)).filter(F.col("_first") <= top_n).drop("_first")


def list_positions(ranked: DataFrame, top_n: int | None = None) -> DataFrame:
    """Add ``position``: 1, 2, ... in rank order, ties by item.

    With ``top_n`` a list ends there, in the middle of a tie if need be, and
    Spark keeps no more than that of a user in any task before the shuffle.
    """
    window = Window.partitionBy(USER).orderBy("rank", ITEM)
    placed = ranked.withColumn("position", F.row_number().over(window))
    return placed if top_n is None else placed.filter(F.col("position") <= top_n)


def recommend_lists(ranked: DataFrame, top_n: int) -> DataFrame:
    """(user_id, recommendations): an array of at most ``top_n`` items in rank order, ties by item."""
    placed = list_positions(ranked.select(USER, ITEM, "rank"), top_n)
    return ranked_lists(placed, USER, "position", ITEM, "recommendations")
