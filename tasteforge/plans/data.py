"""Inputs that several registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tasteforge.functions.hashing import uniform_sql
from tasteforge.operators import prep, sampling
from tasteforge.plans.registry import step
from tasteforge.sources import views
from tasteforge.sources.shared import stage

USER_AT_LEAST, ITEM_AT_LEAST = 10, 1
NEGATIVES = 200
SEED = 7


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.business_features(views.items(spark, sf_dir), views.top_categories(spark, sf_dir))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings, joined once and stored: counts of hot keys and joins read them several times."""
    return stage(views.ratings(spark, sf_dir), "ratings")


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(train, test), marked once and stored, one folder for each.

    An item threshold of one drops nothing, so the user threshold and the mark
    take one join together.
    """
    marked = prep.mark_latest(ratings(spark, sf_dir), user_at_least=USER_AT_LEAST)
    marked = stage(marked, "split", ["is_test"])
    return marked.filter("not is_test").drop("is_test"), marked.filter("is_test").drop("is_test")


def draws(spark: SparkSession, sf_dir: str, test: DataFrame, per_pair: int = NEGATIVES) -> sampling.Draws:
    """Negatives that are not spelled out yet."""
    return sampling.draw_negatives(test, stage(features(spark, sf_dir), "features"), per_pair, SEED)


def negatives(spark: SparkSession, sf_dir: str, test: DataFrame, per_pair: int = NEGATIVES) -> DataFrame:
    return sampling.sample_negatives(test, stage(features(spark, sf_dir), "features"), per_pair, SEED)


def unseen(spark: SparkSession, sf_dir: str, train: DataFrame, test: DataFrame) -> sampling.Draws:
    """Negatives without items that the user has rated in training, not spelled out yet."""
    return sampling.drop_seen_candidates(draws(spark, sf_dir, test), train)


def candidates(
    spark: SparkSession, sf_dir: str, train: DataFrame, test: DataFrame, terms: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """True items and negatives, without items the user has rated in training; with the ``terms`` of users and items, if given."""
    return sampling.test_candidates(unseen(spark, sf_dir, train, test), test, terms)


step(
    "features",
    "items top_categories",
    """select business_id, coalesce(list_filter(list_transform(string_split(categories, ','), lambda x: trim(x)),
              lambda x: list_contains(known, x))[1], 'NotFound') as top_category, review_count, stars, state, city
       from items, (select list(category) as known from top_categories) where categories is not null""",
)
step(
    "active",
    "ratings",
    f"""select * from ratings
        where user_id in (select user_id from ratings group by 1 having count(*) >= {USER_AT_LEAST})
          and business_id in (select business_id from ratings group by 1 having count(*) >= {ITEM_AT_LEAST})""",
)
step(
    "marked",
    "active",
    "select *, dense_rank() over (partition by user_id order by review_ts desc) = 1 as is_test from active",
)
step("train", "marked", "select user_id, business_id, stars, review_ts, useful from marked where not is_test")
step("test", "marked", "select user_id, business_id, stars, review_ts, useful from marked where is_test")
step(
    "numbered",
    "features",
    f"""select business_id, top_category, state,
               row_number() over (partition by top_category, state order by {uniform_sql(SEED, 'business_id')}, business_id) - 1 as place,
               count(*) over (partition by top_category, state) as size
        from features""",
)


def negatives_sql(per_pair: int) -> str:
    """Negatives drawn place by place, as text for DuckDB."""
    words = ", ".join(f"cast('0x' || substr(digest, {8 * n + 1}, 8) as bigint) as _w{n}" for n in range(4))
    drawn = f"""
        select p.*, (_j + _w0) % _others as _x from (
            select *, unnest(range(0, least({per_pair}, _others))) as _j from (
                select t.user_id, t.business_id, m.top_category, m.state, m.place, m.size, m.size - 1 as _others, {words}
                from (select *, md5(concat_ws('|', user_id, business_id, '{SEED}-order')) as digest
                      from (select distinct user_id, business_id from test)) t
                join numbered m on t.business_id = m.business_id where m.size > 1
            )
        ) p"""
    for n in range(sampling.ROUNDS):
        partner, moved = sampling.shuffle_round(str(n), "_x", "_y")
        drawn = f"select * replace ({moved} as _x) from (select *, {partner} as _y from ({drawn}))"
        drawn = f"select * exclude (_y) from ({drawn})"
    return f"""
        select d.user_id, d.business_id, n.business_id as candidate_id from (select *, (place + 1 + _x) % size as drawn from ({drawn})) d
        join numbered n on d.top_category = n.top_category and d.state = n.state and d.drawn = n.place"""


step("negatives", "test numbered", negatives_sql(NEGATIVES))
step(
    "unseen_negatives",
    "negatives train",
    """select * from negatives n where not exists
       (select 1 from train t where t.user_id = n.user_id and t.business_id = n.candidate_id)""",
)
step(
    "candidates",
    "test unseen_negatives",
    """select distinct user_id, business_id as candidate_id from test
       union all select user_id, candidate_id from unseen_negatives""",
)
