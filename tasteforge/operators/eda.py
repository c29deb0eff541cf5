"""Counts by place and category, and the review map selection.

Input: reviews joined with item features (``denormalise``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tasteforge.operators.prep import ITEM, USER
from tasteforge.operators.skew import ROWS_PER_SLICE, join_sliced


def denormalise(ratings: DataFrame, features: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Reviews with their item's state and top category."""
    return join_sliced(ratings.select(USER, ITEM), features.select(ITEM, "state", "top_category"), [ITEM], rows_per_slice=rows_per_slice)


def distinct_pairs(reviews: DataFrame) -> DataFrame:
    """One row per (user, item): repeats go before any distinct count."""
    return reviews.select(USER, ITEM, "state", "top_category").distinct()


def distinct_by(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct items, users and (user, item) pairs per group.

    ``pairs`` is distinct already, so the number of pairs is a plain count.
    """
    return pairs.groupBy(*keys).agg(
        F.count_distinct(ITEM).alias("n_items"),
        F.count_distinct(USER).alias("n_users"),
        F.count(F.lit(1)).alias("n_pairs"),
    )


# Buckets of a sketch, as a power of two: a standard error of 1.04 / 2^6, 1.6 %.
SKETCH_BITS = 12
SKETCHES = ("items", "users", "pairs")


def distinct_sketches(reviews: DataFrame, keys: Sequence[str], bits: int = SKETCH_BITS) -> DataFrame:
    """Sketches of distinct items, users and (user, item) pairs per group: tasks fold their rows, repeats too, before anything moves.

    The finest grouping is worked out once; coarser ones are unions of it
    (``merge_sketches``), so tables of several levels take one scan and no
    distinct count.  A sketch takes a few KB whatever it counts.
    """
    counted = {"items": F.col(ITEM), "users": F.col(USER), "pairs": F.xxhash64(USER, ITEM)}
    return reviews.groupBy(*keys).agg(*[F.hll_sketch_agg(column, bits).alias(name) for name, column in counted.items()])


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of a coarser grouping."""
    return sketches.groupBy(*keys).agg(*[F.hll_union_agg(name).alias(name) for name in SKETCHES])


def sketched_counts(sketches: DataFrame) -> DataFrame:
    """``distinct_by`` as the sketches estimate it."""
    keys = [c for c in sketches.columns if c not in SKETCHES]
    return sketches.select(*keys, *[F.hll_sketch_estimate(name).alias(f"n_{name}") for name in SKETCHES])


def top_category_by_state(by_both: DataFrame) -> DataFrame:
    """(state, top_category) with the most items; ties are all kept."""
    window = Window.partitionBy("state").orderBy(F.desc("n_items"))
    return by_both.withColumn("_r", F.rank().over(window)).filter("_r = 1").select("state", "top_category")


def state_summary(by_state: DataFrame, top: DataFrame) -> DataFrame:
    """Counts per state with its top category and a label text."""
    joined = by_state.join(top.withColumnRenamed("top_category", "top_cat"), "state", "left")
    label = F.concat_ws(
        "<br>",
        F.col("state"),
        F.concat(F.lit("User Count: "), F.col("n_users").cast("string")),
        F.concat(F.lit("Business Count: "), F.col("n_items").cast("string")),
        F.concat(F.lit("Mostly Reviewed Category: "), F.coalesce("top_cat", F.lit("None"))),
    )
    return joined.select("state", "n_items", "n_users", "n_pairs", "top_cat", label.alias("text"))


def category_histogram(pairs: DataFrame) -> DataFrame:
    """Reviewed (user, item) pairs per category, in rising order."""
    return pairs.groupBy("top_category").agg(F.count(F.lit(1)).alias("n_pairs")).orderBy("n_pairs", "top_category")


def review_map_points(
    reviews: DataFrame,
    categories: Iterable[str],
    users: DataFrame | Sequence[str] = ("All",),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Reviews of the chosen categories and users; "All" chooses every user.

    The users are names, or a frame of user ids.  An empty result is allowed.
    """
    kept = reviews.filter(F.col("top_category").isin(list(categories)))
    if isinstance(users, DataFrame):
        return join_sliced(kept, users.select(USER).distinct(), [USER], "left_semi", rows_per_slice=rows_per_slice)
    users = list(users)
    return kept if "All" in users else kept.filter(F.col(USER).isin(users))
