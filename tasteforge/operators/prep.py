"""Tidy ratings, item features and user features; activity filters; splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tasteforge.functions.hashing import uniform
from tasteforge.functions.text import comma_parts, first_known
from tasteforge.operators.skew import ROWS_PER_SLICE, join_chain, join_sliced, positions
from tasteforge.sources.tables import REVIEW_COLUMNS

USER, ITEM = "user_id", "business_id"

# Fixed: the day that membership is counted up to.
MEMBERSHIP_END = "2019-12-31"


def tidy_reviews(raw: DataFrame) -> DataFrame:
    """The eight review columns that later steps read."""
    return raw.select(*REVIEW_COLUMNS)


def default_label(df: DataFrame, label: str = "stars") -> DataFrame:
    """Label 1.0 when the frame has none."""
    return df if label in df.columns else df.withColumn(label, F.lit(1.0))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows without any null or NaN."""
    return df.na.drop()


def record_counts(df: DataFrame, key: str = USER, name: str = "record_count") -> DataFrame:
    """Rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def active_users(ratings: DataFrame, at_least: int) -> DataFrame:
    """Users with enough ratings, with their count."""
    return record_counts(ratings, USER, "count_business").filter(F.col("count_business") >= at_least)


def active_items(ratings: DataFrame, at_least: int) -> DataFrame:
    """Items with enough ratings, with their count."""
    return record_counts(ratings, ITEM, "count_user").filter(F.col("count_user") >= at_least)


def active_ratings(ratings: DataFrame, user_at_least: int, item_at_least: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Ratings of active users and active items.

    Both counts come from the whole table, in one pass: dropping an item does
    not make a user inactive.
    """
    # A threshold of one holds for every key present, so it needs no join; only
    # a NULL key, which no join would match, can fail it.
    known = ratings.filter(F.col(USER).isNotNull() & F.col(ITEM).isNotNull())
    # The counts are those that hot keys are found by, so Spark shuffles them once.
    steps = []
    if user_at_least > 1:
        steps.append((active_users(known, user_at_least).select(USER), [USER], "left_semi"))
    if item_at_least > 1:
        steps.append((active_items(known, item_at_least).select(ITEM), [ITEM], "left_semi"))
    return join_chain(known, steps, rows_per_slice)


def filter_outlier_users(ratings: DataFrame, at_most: int = 500, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Ratings of users with no more than ``at_most`` records."""
    kept = record_counts(ratings).filter(F.col("record_count") <= at_most).select(USER)
    # A kept user has at most ``at_most`` rows, so a semi join cannot run hot on
    # the kept side; the rows of dropped users still have to be spread.
    return join_sliced(ratings, kept, [USER], "left_semi", rows_per_slice=rows_per_slice)


def mark_latest(
    ratings: DataFrame, time: str = "review_ts", user_at_least: int = 1, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Add ``is_test``: true for every row on its user's latest time.

    Users with fewer than ``user_at_least`` rows are dropped by the same join.

    The same rows as dense_rank = 1 by time descending, found through a grouped
    maximum: a maximum combines on the map side, a window would put all rows of
    a user into one task.  Rows of a user without any time are all latest.
    """
    latest = ratings.groupBy(USER).agg(F.max(time).alias("_latest"), F.count(F.lit(1)).alias("_n"))
    kept = latest.filter(F.col("_n") >= user_at_least).select(USER, "_latest")
    how = "left" if user_at_least <= 1 else "inner"
    marked = join_sliced(ratings, kept, [USER], how, rows_per_slice=rows_per_slice)
    return marked.withColumn("is_test", F.col(time).eqNullSafe(F.col("_latest"))).drop("_latest")


def split_latest(
    ratings: DataFrame, time: str = "review_ts", user_at_least: int = 1, rows_per_slice: int = ROWS_PER_SLICE
) -> tuple[DataFrame, DataFrame]:
    """(train, test): each user's latest rows, ties included, are the test set.

    To use both, store ``mark_latest`` once and filter it twice instead.
    """
    marked = mark_latest(ratings, time, user_at_least, rows_per_slice)
    return (
        marked.filter(~F.col("is_test")).drop("is_test"),
        marked.filter("is_test").drop("is_test"),
    )


def mark_percent_rank(
    ratings: DataFrame,
    bounds: tuple[float, float] = (0.0, 0.2),
    by: str = USER,
    row_key: Sequence[str] = (USER, ITEM, "review_ts"),
    seed: int = 42,
    half_open: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add ``is_test``: rows whose random percent rank within ``by`` is in bounds.

    The random number is a hash of ``row_key``; copies of a row tie and stay
    together.  Both bounds count unless ``half_open``, which
    leaves the upper one out, but for the last fold's 1: folds cover every row once.  A group of one row has
    percent rank 0.  The rank is monotone in the random number, so each group
    needs only the range of numbers it puts into the test set.
    """
    low, high = bounds
    numbered = ratings.withColumn("_u", uniform(seed, *row_key))
    counts = numbered.groupBy(by, "_u").agg(F.count(F.lit(1)).alias("_copies"))
    placed = positions(counts, [by], "_u", weight="_copies", rows_per_slice=rows_per_slice)
    rank = F.when(F.col("_total") > 1, F.col("_before") / (F.col("_total") - 1)).otherwise(F.lit(0.0))
    inside = (rank >= low) & ((rank < high) if half_open and high < 1 else (rank <= high))
    ranges = placed.filter(inside).groupBy(by).agg(F.min("_u").alias("_low"), F.max("_u").alias("_high"))
    marked = join_sliced(numbered, ranges, [by], "left", rows_per_slice=rows_per_slice)
    return marked.withColumn("is_test", F.coalesce(F.col("_u").between(F.col("_low"), F.col("_high")), F.lit(False))).select(
        *ratings.columns, "is_test"
    )


def split_percent_rank(ratings: DataFrame, *args, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(train, test) by random percent rank; see ``mark_percent_rank``."""
    marked = mark_percent_rank(ratings, *args, **kwargs)
    return (
        marked.filter(~F.col("is_test")).drop("is_test"),
        marked.filter("is_test").drop("is_test"),
    )


def with_top_category(items: DataFrame, top_categories: DataFrame | Sequence[str]) -> DataFrame:
    """Add ``top_category``: the item's first category in the top list.

    Items without categories are dropped.  A list given as a frame is looked up
    by joins on the category, so it may be of any length.
    """
    items = items.filter(F.col("categories").isNotNull())
    if not isinstance(top_categories, DataFrame):
        return items.withColumn("top_category", first_known(comma_parts("categories"), top_categories))
    known = top_categories.select(F.col("category").alias("_part")).distinct()
    hits = (
        items.select(ITEM, F.posexplode(comma_parts("categories")).alias("_at", "_part"))
        .join(known, "_part", "left_semi")
        .groupBy(ITEM)
        .agg(F.min(F.struct("_at", "_part")).alias("_hit"))
    )
    return (
        items.join(hits, ITEM, "left")
        .withColumn("top_category", F.coalesce(F.col("_hit._part"), F.lit("NotFound")))
        .drop("_hit")
    )


def business_features(items: DataFrame, top_categories: DataFrame | Sequence[str]) -> DataFrame:
    """Item side information."""
    return with_top_category(items, top_categories).select(ITEM, "top_category", "review_count", "stars", "state", "city")


def business_names(items: DataFrame) -> DataFrame:
    """Item names, of items with categories."""
    return items.filter(F.col("categories").isNotNull()).select(ITEM, "name")


def user_features(users: DataFrame, since: str = "member_since", drop: Sequence[str] = ("friends", "name")) -> DataFrame:
    """User side information: compliments summed, membership in days, elite years."""
    compliments = [c for c in users.columns if "compliment_" in c]
    gone = {*compliments, *drop, since, "elite"}
    total = sum((F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in compliments), F.lit(0).cast("long"))
    years = F.when(F.col("elite").isNull() | (F.col("elite") == ""), 0).otherwise(F.size(F.split("elite", ",")))
    return users.select(
        *[c for c in users.columns if c not in gone],
        total.alias("cnt_compliment"),
        F.datediff(F.lit(MEMBERSHIP_END).cast("date"), F.to_date(since)).alias("yelp_days"),
        years.alias("elite_years"),
    )


def category_edges(categories: DataFrame) -> DataFrame:
    """(parent, child) titles from aliases; of an array ``parent_aliases`` the first counts.

    A single ``parent_alias`` per row is taken as well.
    """
    if "parent_aliases" in categories.columns:
        categories = categories.withColumn("parent_alias", F.get("parent_aliases", F.lit(0)))
    parent = categories.select(F.col("alias").alias("parent_alias"), F.col("title").alias("parent"))
    return categories.select("parent_alias", F.col("title").alias("child")).join(parent, "parent_alias").select("parent", "child")


def category_roots(categories: DataFrame) -> DataFrame:
    """Categories that are a parent and never a child."""
    edges = category_edges(categories)
    children = edges.select(F.col("child").alias("parent")).distinct()
    return edges.select("parent").distinct().join(children, "parent", "left_anti").select(F.col("parent").alias("category"))


def dataset_stats(ratings: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: distinct users, distinct items, ratings."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return ratings.agg(
        distinct(F.col(USER)).alias("n_users"),
        distinct(F.col(ITEM)).alias("n_items"),
        F.count(F.lit(1)).alias("n_ratings"),
    )
