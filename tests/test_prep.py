"""Tidy tables, filters and splits on small frames."""

import pytest

from tasteforge.functions.text import canonical_hyper, hyper_pairs, hyper_text, metric_k
from tasteforge.operators import features as feats
from tasteforge.operators import prep
from tasteforge.sources import tables

RATINGS = [
    ("a", "x", 5.0, "2020-01-01"),
    ("a", "y", 4.0, "2020-01-03"),
    ("a", "z", 3.0, "2020-01-03"),
    ("b", "x", 2.0, "2020-01-02"),
    ("c", "x", 1.0, "2020-01-02"),
    ("c", "y", 1.0, "2020-01-01"),
    ("c", "y", 1.0, "2020-01-01"),
]


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame(RATINGS, "user_id string, business_id string, stars double, review_ts string").selectExpr(
        "user_id", "business_id", "stars", "cast(review_ts as timestamp_ntz) as review_ts"
    )


def pairs(df):
    return sorted((r.user_id, r.business_id) for r in df.collect())


def test_activity_counts_come_from_the_whole_table(ratings):
    # y has 3 ratings by a and c; b is dropped but still counts for x.
    assert pairs(prep.active_ratings(ratings, 2, 3)) == [("a", "x"), ("a", "y"), ("c", "x"), ("c", "y"), ("c", "y")]


def test_outlier_users_go(ratings):
    assert pairs(prep.filter_outlier_users(ratings, 2)) == [("b", "x")]


@pytest.mark.parametrize("rows_per_slice", [1, 10**6])
def test_latest_split_keeps_ties_and_all_rows(ratings, rows_per_slice):
    train, test = prep.split_latest(ratings, rows_per_slice=rows_per_slice)
    assert pairs(test) == [("a", "y"), ("a", "z"), ("b", "x"), ("c", "x")]
    assert sorted(pairs(train) + pairs(test)) == pairs(ratings)
    assert train.columns == ratings.columns


@pytest.mark.parametrize("rows_per_slice", [3, 10**6])
def test_percent_rank_split_matches_pandas(spark, rows_per_slice):
    from tasteforge.functions.hashing import uniform

    df = spark.range(400).selectExpr(
        "concat('u', cast(case when id % 3 = 0 then 0 else id % 30 end as string)) as user_id",
        "concat('b', cast(id % 90 as string)) as business_id",
    )
    marked = prep.mark_percent_rank(df, (0.2, 0.4), row_key=("user_id", "business_id"), rows_per_slice=rows_per_slice)
    got = marked.withColumn("u", uniform(42, "user_id", "business_id")).toPandas()
    group = got.groupby("user_id")["u"]
    size = group.transform("size")
    rank = (group.rank(method="min") - 1) / (size - 1).where(size > 1, 1)
    assert len(got) == 400
    assert (got.is_test == ((rank >= 0.2) & (rank <= 0.4))).all()


def test_single_record_user_has_rank_zero(spark):
    df = spark.createDataFrame([("a", "x", "t")], "user_id string, business_id string, review_ts string")
    assert prep.mark_percent_rank(df, (0.0, 0.2)).first().is_test
    assert not prep.mark_percent_rank(df, (0.2, 0.4)).first().is_test


def test_half_open_folds_are_disjoint(spark):
    df = spark.range(200).selectExpr("'u' as user_id", "cast(id as string) as business_id", "id as review_ts")
    folds = [prep.split_percent_rank(df, (n / 5, (n + 1) / 5), half_open=True)[1] for n in range(5)]
    ids = [r.business_id for fold in folds for r in fold.collect()]
    assert len(ids) == len(set(ids)) == 200


@pytest.mark.parametrize("as_frame", [True, False])
def test_top_category(spark, as_frame):
    items = spark.createDataFrame(
        [("1", "Pets,  Food , Bars"), ("2", "Nothing"), ("3", None), ("4", ""), ("5", "Bars,Food")], "business_id string, categories string"
    )
    names = ["Food", "Bars"]
    top = spark.createDataFrame([(n,) for n in names], "category string") if as_frame else names
    got = {r.business_id: r.top_category for r in prep.with_top_category(items, top).collect()}
    assert got == {"1": "Food", "2": "NotFound", "4": "NotFound", "5": "Bars"}


def test_user_features(spark):
    users = spark.createDataFrame(
        [("a", "n", "2019-12-30", None, 1, None), ("b", "n", "2019-12-31", "", None, None), ("c", "n", "2018-12-31", "2012,2013", 2, 3)],
        "user_id string, name string, member_since string, elite string, compliment_a long, compliment_b long",
    )
    got = {r.user_id: tuple(r)[1:] for r in prep.user_features(users).collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 0, 0), "c": (5, 365, 2)}


def test_roots_leave_out_tops_without_children(spark):
    cats = spark.createDataFrame(
        [("r", "Root", None), ("m", "Middle", "r"), ("l", "Leaf", "m"), ("x", "Lonely", None)],
        "alias string, title string, parent_alias string",
    )
    assert [r.category for r in prep.category_roots(cats).collect()] == ["Root"]


def test_gaps_and_labels(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "p double, s string")
    assert [r.p for r in prep.drop_incomplete(df).collect()] == [1.0]
    assert prep.default_label(df).first().stars == 1.0
    assert prep.default_label(df.withColumnRenamed("p", "stars")).columns == ["stars", "s"]


def test_side_info_modes(spark, ratings):
    users = spark.createDataFrame([("a", 1, "q"), ("b", None, "r")], "user_id string, n int, city string")
    items = spark.createDataFrame([("x", "c1", 9.0), ("y", "c2", 8.0)], "business_id string, city string, stars double")
    three = ratings.select("user_id", "business_id", "stars")
    assert feats.side_info_join(three, users, items, "None").count() == 7
    both = feats.side_info_join(three, users, items, "Both", rows_per_slice=1)
    assert set(both.columns) == {"user_id", "business_id", "stars_user", "n", "city_user", "city_business", "stars_business"}
    assert pairs(both) == [("a", "x"), ("a", "y")]
    with pytest.raises(ValueError):
        feats.side_info_join(three, users, items, "Most")


def test_backfill_does_not_multiply(spark):
    asked = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "user_id string, business_id string")
    made = spark.createDataFrame([("a", "x", 1.5), ("a", "x", 1.5)], "user_id string, business_id string, prediction double")
    got = sorted((r.user_id, r.prediction) for r in feats.predictions_backfill(asked, made).collect() if r.prediction)
    assert got == [("a", 1.5), ("a", 1.5)]
    assert feats.predictions_backfill(asked, made).count() == 3


def test_vectorise_and_scale(spark):
    df = spark.createDataFrame([("1", "red", 2.0), ("2", None, 4.0)], "id string, colour string, size double")
    long = feats.vectorise(df, "id")
    assert sorted(map(tuple, long.collect())) == [("1", "colour=red", 1.0), ("1", "size", 2.0), ("2", "size", 4.0)]
    scaled = {(r.id, r.feature): r.value for r in feats.standardise(long, "id").collect()}
    assert scaled[("1", "colour=red")] == 1.0
    assert scaled[("1", "size")] == pytest.approx(-scaled[("2", "size")])


def test_hyper_text(spark):
    text = hyper_text({"reg": 0.1, "k": 16, "mode": "None"})
    assert text == "[('k', 16), ('mode', 'None'), ('reg', 0.1)]"
    df = spark.createDataFrame([(text, "ndcg@10"), ("[('z', 'a b'), ('b', 1)]", "rmse")], "hyper string, metric string")
    rows = df.select(hyper_pairs().alias("p"), canonical_hyper().alias("c"), metric_k().alias("k")).collect()
    assert [tuple(p) for p in rows[0].p] == [("k", "16"), ("mode", "None"), ("reg", "0.1")]
    assert rows[1].c == "b_1-z_a b"
    assert [r.k for r in rows] == [10, None]


def test_materialize_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/t.parquet"
    for force in (False, False, True):
        assert tables.materialize(spark, path, build, force).count() == 3
    assert len(built) == 2


def test_implicit_csv(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    tables.write_csv(spark.createDataFrame([("a", "x", 4.0)], tables.RATING_SCHEMA), path)
    row = tables.read_ratings(spark, path, tables.RATING_SCHEMA, implicit=True).first()
    assert tuple(row) == ("a", "x", 1.0)
