"""Queries: counts by place and category, review map."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasteforge.operators import eda
from tasteforge.operators.prep import active_users
from tasteforge.plans import data
from tasteforge.plans.registry import query, step
from tasteforge.sources import views
from tasteforge.sources.shared import stage

step("reviews", "ratings features", "select user_id, business_id, state, top_category from ratings join features using (business_id)")
step(
    "by_both",
    "reviews",
    """select state, top_category, count(distinct business_id) as n_items, count(distinct user_id) as n_users,
              count(distinct (user_id, business_id)) as n_pairs from reviews group by 1, 2""",
)
step(
    "by_state",
    "reviews",
    """select state, count(distinct business_id) as n_items, count(distinct user_id) as n_users,
              count(distinct (user_id, business_id)) as n_pairs from reviews group by 1""",
)
step(
    "state_top",
    "by_both",
    """select state, top_category from (select *, rank() over (partition by state order by n_items desc) as r from by_both)
       where r = 1""",
)


def reviews(spark, sf_dir):
    return eda.denormalise(views.ratings(spark, sf_dir), data.features(spark, sf_dir))


def pairs(spark, sf_dir):
    return eda.distinct_pairs(reviews(spark, sf_dir))


@query("distinct_by_state_category", "by_both", "select * from by_both")
def distinct_by_state_category(spark, sf_dir):
    return eda.distinct_by(pairs(spark, sf_dir), ["state", "top_category"])


@query("distinct_by_state", "by_state", "select * from by_state")
def distinct_by_state(spark, sf_dir):
    return eda.distinct_by(pairs(spark, sf_dir), ["state"])


@query(
    "category_histogram",
    "reviews",
    "select top_category, count(distinct (user_id, business_id)) as n_pairs from reviews group by 1",
)
def category_histogram(spark, sf_dir):
    return eda.category_histogram(pairs(spark, sf_dir))


# Estimates: tests hold them against the exact tables, SQL has no such sketch.
@query("distinct_sketched")
def distinct_sketched(spark, sf_dir):
    """The counts per (state, category), per state and per category from one scan; null stands for all."""
    finest = stage(eda.distinct_sketches(reviews(spark, sf_dir), ["state", "top_category"]), "distinct-sketches")
    by_state = eda.merge_sketches(finest, ["state"]).withColumn("top_category", F.lit(None).cast("string"))
    by_category = eda.merge_sketches(finest, ["top_category"]).withColumn("state", F.lit(None).cast("string"))
    return eda.sketched_counts(finest.unionByName(by_state).unionByName(by_category))


@query("top_category_by_state", "state_top", "select * from state_top")
def top_category_by_state(spark, sf_dir):
    return eda.top_category_by_state(eda.distinct_by(pairs(spark, sf_dir), ["state", "top_category"]))


@query(
    "state_summary",
    "by_state state_top",
    """select s.state, n_items, n_users, n_pairs, top_category as top_cat,
              s.state || '<br>User Count: ' || n_users || '<br>Business Count: ' || n_items
              || '<br>Mostly Reviewed Category: ' || coalesce(top_category, 'None') as text
       from by_state s left join state_top t on s.state = t.state""",
)
def state_summary(spark, sf_dir):
    distinct = stage(pairs(spark, sf_dir), "distinct-pairs")
    top = eda.top_category_by_state(eda.distinct_by(distinct, ["state", "top_category"]))
    return eda.state_summary(eda.distinct_by(distinct, ["state"]), top)


MAP_CATEGORIES = ["ECONOMY", "ring", "NotFound"]


@query(
    "review_map_points",
    "reviews",
    """select user_id, business_id, state, top_category from reviews
       where top_category in ('ECONOMY', 'ring', 'NotFound')
         and user_id in (select user_id from reviews group by 1 having count(*) >= 50)""",
)
def review_map_points(spark, sf_dir):
    top_reviewers = active_users(views.ratings(spark, sf_dir), 50)
    return eda.review_map_points(reviews(spark, sf_dir), MAP_CATEGORIES, top_reviewers)
