"""Queries: scans and sinks, tidy tables, filters, splits, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasteforge.functions.hashing import uniform_sql
from tasteforge.operators import features as feats
from tasteforge.operators import prep
from tasteforge.plans import data
from tasteforge.plans.registry import query, ts_sql, ts_text
from tasteforge.sources import tables, views
from tasteforge.sources.shared import fresh_path


def rating_rows(df, *more):
    """The rating columns, with the time as text."""
    return df.select("user_id", "business_id", "stars", ts_text("review_ts"), "useful", *more)


RATING_SQL = f"user_id, business_id, stars, {ts_sql('review_ts')}, useful"


@query("scan_csv_ratings", "ratings", "select user_id, business_id, stars from ratings")
def scan_csv_ratings(spark, sf_dir):
    path = fresh_path(spark, "ratings-csv")
    tables.write_csv(prep.tidy_reviews(views.raw_reviews(spark, sf_dir)), path)
    return tables.read_ratings(spark, path)


@query("scan_csv_side_info", "features", "select * from features")
def scan_csv_side_info(spark, sf_dir):
    path = fresh_path(spark, "features-csv")
    tables.write_csv(data.features(spark, sf_dir), path)
    return tables.read_csv(spark, path, tables.BUSINESS_FEATURE_SCHEMA)


@query("scan_json_business", "items", "select * from items")
def scan_json_business(spark, sf_dir):
    path = fresh_path(spark, "business-json")
    tables.write_json_lines(views.items(spark, sf_dir), path)
    return tables.read_json_lines(spark, path, tables.BUSINESS_SCHEMA)


@query("scan_parquet", "", "select l_orderkey, l_partkey, l_quantity from lineitem")
def scan_parquet(spark, sf_dir):
    return tables.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity"])


@query("scan_json_list", "top_categories", "select category from top_categories")
def scan_json_list(spark, sf_dir):
    path = fresh_path(spark, "top-categories")
    # The list of top categories is a short vocabulary: one document.
    names = views.top_categories(spark, sf_dir).agg(F.to_json(F.array_sort(F.collect_set("category"))).alias("value"))
    names.write.text(path)
    return tables.read_json_list(spark, path, "category")


@query("sink_parquet_roundtrip", "items", "select * from items")
def sink_parquet_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "items")
    tables.write_parquet(views.items(spark, sf_dir).drop("name"), path)
    tables.write_parquet(views.items(spark, sf_dir), path)
    return tables.read_parquet(spark, path)


@query(
    "sink_csv_roundtrip",
    "users",
    "select user_id, name, segment, cast(member_since as varchar) as member_since, elite, compliment_cool from users",
)
def sink_csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "users-csv")
    users = views.users(spark, sf_dir).select("user_id", "name", "segment", "member_since", "elite", "compliment_cool")
    tables.write_csv(users, path, null_text="NULL")
    return tables.read_csv(spark, path, users.schema, null_text="NULL").withColumn("member_since", F.col("member_since").cast("string"))


@query("materialize_reuse", "ratings", "select business_id, count(*) as n from ratings group by 1")
def materialize_reuse(spark, sf_dir):
    path = fresh_path(spark, "item-counts")

    def never():
        raise AssertionError("a committed table must be reused")

    tables.materialize(spark, path, lambda: prep.record_counts(views.ratings(spark, sf_dir), "business_id", "n"))
    return tables.materialize(spark, path, never)


@query(
    "tidy_reviews",
    "raw_reviews",
    f"select business_id, cool, {ts_sql('date')}, funny, review_id, stars, useful, user_id from raw_reviews",
)
def tidy_reviews(spark, sf_dir):
    return prep.tidy_reviews(views.raw_reviews(spark, sf_dir)).withColumn("date", ts_text("date"))


@query("explicit_to_implicit", "ratings", "select user_id, business_id, 1.0::double as stars from ratings")
def explicit_to_implicit(spark, sf_dir):
    return tables.to_implicit(views.ratings(spark, sf_dir).select("user_id", "business_id", "stars"))


@query("default_label", "ratings", "select user_id, business_id, 1.0::double as stars from ratings")
def default_label(spark, sf_dir):
    return prep.default_label(views.ratings(spark, sf_dir).select("user_id", "business_id"))


WITH_GAPS = "case when compliment_hot = 3 then {nan} else compliment_hot * 0.5 end"


@query(
    "drop_incomplete",
    "users",
    f"""select * from (select user_id, elite, compliment_cool,
               cast({WITH_GAPS.format(nan="'nan'::double")} as double) as score from users)
        where elite is not null and compliment_cool is not null and not isnan(score)""",
)
def drop_incomplete(spark, sf_dir):
    score = WITH_GAPS.format(nan="double('NaN')")
    users = views.users(spark, sf_dir).selectExpr("user_id", "elite", "compliment_cool", f"cast({score} as double) as score")
    return prep.drop_incomplete(users)


@query("record_counts", "ratings", "select user_id, count(*) as record_count from ratings group by 1")
def record_counts(spark, sf_dir):
    return prep.record_counts(views.ratings(spark, sf_dir))


@query("active_users", "ratings", "select user_id, count(*) as count_business from ratings group by 1 having count(*) >= 10")
def active_users(spark, sf_dir):
    return prep.active_users(views.ratings(spark, sf_dir), data.USER_AT_LEAST)


@query("active_items", "ratings", "select business_id, count(*) as count_user from ratings group by 1 having count(*) >= 20")
def active_items(spark, sf_dir):
    return prep.active_items(views.ratings(spark, sf_dir), 20)


@query(
    "active_ratings",
    "ratings",
    f"""select {RATING_SQL} from ratings
        where user_id in (select user_id from ratings group by 1 having count(*) >= 10)
          and business_id in (select business_id from ratings group by 1 having count(*) >= 20)""",
)
def active_ratings(spark, sf_dir):
    return rating_rows(prep.active_ratings(data.ratings(spark, sf_dir), data.USER_AT_LEAST, 20))


@query(
    "filter_outlier_users",
    "ratings",
    f"""select {RATING_SQL} from ratings
        where user_id in (select user_id from ratings group by 1 having count(*) <= 50)""",
)
def filter_outlier_users(spark, sf_dir):
    return rating_rows(prep.filter_outlier_users(views.ratings(spark, sf_dir), 50))


@query(
    "dataset_stats",
    "ratings",
    "select count(distinct user_id) as n_users, count(distinct business_id) as n_items, count(*) as n_ratings from ratings",
)
def dataset_stats(spark, sf_dir):
    return prep.dataset_stats(views.ratings(spark, sf_dir))


@query("split_latest_test", "test", f"select {RATING_SQL} from test")
def split_latest_test(spark, sf_dir):
    return rating_rows(prep.split_latest(views.ratings(spark, sf_dir), user_at_least=data.USER_AT_LEAST)[1])


@query("split_latest_train", "train", f"select {RATING_SQL} from train")
def split_latest_train(spark, sf_dir):
    return rating_rows(prep.split_latest(views.ratings(spark, sf_dir), user_at_least=data.USER_AT_LEAST)[0])


@query(
    "split_percent_rank",
    "ratings",
    f"""select {RATING_SQL}, p >= 0.0 and p <= 0.2 as is_test from (
            select *, percent_rank() over (partition by user_id order by u) as p from (
                select *, {uniform_sql(42, 'user_id', 'business_id', 'review_ts')} as u from ratings))""",
)
def split_percent_rank(spark, sf_dir):
    return rating_rows(prep.mark_percent_rank(data.ratings(spark, sf_dir), (0.0, 0.2), seed=42), "is_test")


@query("business_features", "features", "select * from features")
def business_features(spark, sf_dir):
    return data.features(spark, sf_dir)


@query("business_names", "items", "select business_id, name from items where categories is not null")
def business_names(spark, sf_dir):
    return prep.business_names(views.items(spark, sf_dir))


@query(
    "user_features",
    "users",
    """select user_id, segment,
              coalesce(compliment_hot, 0) + coalesce(compliment_cool, 0) + coalesce(compliment_note, 0) as cnt_compliment,
              cast(date_diff('day', member_since, date '2019-12-31') as int) as yelp_days,
              cast(case when elite is null or elite = '' then 0 else len(string_split(elite, ',')) end as int) as elite_years
       from users""",
)
def user_features(spark, sf_dir):
    return prep.user_features(views.users(spark, sf_dir))


@query(
    "category_roots",
    "cats",
    """select distinct p.title as category from cats c join cats p on c.parent_alias = p.alias
       where p.title not in (select c2.title from cats c2 join cats p2 on c2.parent_alias = p2.alias)""",
)
def category_roots(spark, sf_dir):
    return prep.category_roots(views.categories(spark, sf_dir))


@query(
    "side_info_join",
    "ratings users items",
    """select r.user_id, r.business_id, r.stars as stars_user, u.elite, u.compliment_cool,
              i.state, i.review_count, i.stars as stars_business
       from ratings r join users u on r.user_id = u.user_id join items i on r.business_id = i.business_id
       where u.elite is not null and u.compliment_cool is not null""",
)
def side_info_join(spark, sf_dir):
    ratings = views.ratings(spark, sf_dir).select("user_id", "business_id", "stars")
    users = views.users(spark, sf_dir).select("user_id", "elite", "compliment_cool")
    items = views.items(spark, sf_dir).select("business_id", "state", "review_count", "stars")
    return feats.side_info_join(ratings, users, items, "Both")


@query(
    "id_map",
    "ratings",
    """select business_id, row_number() over (order by business_id) - 1 as item_code
       from (select distinct business_id from ratings)""",
)
def id_map(spark, sf_dir):
    return feats.id_map(views.ratings(spark, sf_dir), "business_id", "item_code")


@query(
    "id_map_join",
    "train test",
    """select t.user_id, t.business_id, u.user_code, i.item_code from test t
       join (select user_id, row_number() over (order by user_id) - 1 as user_code
             from (select distinct user_id from train)) u on t.user_id = u.user_id
       join (select business_id, row_number() over (order by business_id) - 1 as item_code
             from (select distinct business_id from train)) i on t.business_id = i.business_id""",
)
def id_map_join(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    users = feats.id_map(train, "user_id", "user_code")
    items = feats.id_map(train, "business_id", "item_code")
    return feats.id_map_join(test.select("user_id", "business_id"), users, items)


DUMMY_CATEGORIES = ["ECONOMY", "PROMO", "ring", "NotFound"]
DUMMY_STATES = ["Brand#1", "Brand#2", "Brand#25"]


@query(
    "item_dummies",
    "features",
    "select business_id, review_count, stars, "
    + ", ".join(
        f"""cast(case when {column} = '{value}' then 1 else 0 end as int) as "{prefix}_{value}\""""
        for column, prefix, values in (("top_category", "bin_cat", DUMMY_CATEGORIES), ("state", "bin_state", DUMMY_STATES))
        for value in values
    )
    + " from features",
)
def item_dummies(spark, sf_dir):
    return feats.item_dummies(data.features(spark, sf_dir), DUMMY_CATEGORIES, DUMMY_STATES)


@query(
    "item_dummies_all",
    "features",
    """select business_id, 'top_category=' || top_category as feature, 1.0::double as value from features where top_category is not null
       union all select business_id, 'state=' || state, 1.0 from features where state is not null""",
)
def item_dummies_all(spark, sf_dir):
    """Every category and state found in the data; a row that is absent is a zero."""
    return feats.vectorise(data.features(spark, sf_dir), "business_id", ["top_category", "state"])


@query(
    "fm_features",
    "features",
    """select business_id, 'top_category=' || top_category as feature, 1.0::double as value from features
       union all select business_id, 'state=' || state, 1.0 from features
       union all select business_id, 'city=' || city, 1.0 from features
       union all select business_id, 'review_count', review_count from features
       union all select business_id, 'stars', stars from features""",
)
def fm_features(spark, sf_dir):
    return feats.vectorise(data.features(spark, sf_dir), "business_id")


@query(
    "interaction_matrix",
    "ratings",
    "select user_id, business_id, sum(stars) as weight from ratings group by 1, 2",
)
def interaction_matrix(spark, sf_dir):
    return feats.interaction_matrix(views.ratings(spark, sf_dir))
