"""Ranking and metrics on small frames, and against Spark's own metrics."""

import math

import pytest
from pyspark.mllib.evaluation import RankingMetrics, RegressionMetrics

from tasteforge.operators import metrics as met
from tasteforge.operators.ranking import list_positions, rank_candidates, recommend_lists

PAIRS = "user_id string, business_id string"


def lists_of(spark, lists):
    rows = [(u, b, n) for u, items in lists.items() for n, b in enumerate(items, 1)]
    return spark.createDataFrame(rows, PAIRS + ", position int")


def truth_of(spark, truth):
    return spark.createDataFrame([(u, b) for u, items in truth.items() for b in items], PAIRS)


def test_rank_drops_nan_keeps_ties(spark):
    rows = [("u", "a", 2.0), ("u", "b", 1.0), ("u", "c", 1.0), ("u", "d", 0.5), ("u", "e", float("nan")), ("u", "f", None), ("v", "a", float("nan"))]
    scored = spark.createDataFrame(rows, PAIRS + ", prediction double")
    got = sorted((r.business_id, r.rank) for r in rank_candidates(scored, 2).collect())
    assert got == [("a", 1), ("b", 2), ("c", 2)]
    assert [r.business_id for r in rank_candidates(scored, 2, strict=True).orderBy("rank").collect()] == ["a", "b"]
    lists = recommend_lists(rank_candidates(scored, 5), 50).collect()
    assert [(r.user_id, r.recommendations) for r in lists] == [("u", ["a", "b", "c", "d"])]


def test_rank_prunes_before_the_shuffle(spark):
    scored = spark.range(10).selectExpr("'u' as user_id", "cast(id as string) as business_id", "cast(id as double) as prediction")
    plan = rank_candidates(scored, 3, dedupe=False)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert plan.count("WindowGroupLimit") == 2


CASES = {
    "perfect": (["a", "b"], ["a", "b"]),
    "late": (["x", "y", "a"], ["a"]),
    "short": (["a"], ["a", "b", "c"]),
    "twice": (["a", "a", "b"], ["a"]),
    "none": (["x"], ["a"]),
    "only_list": (["a"], []),
    "only_truth": ([], ["a"]),
}


def test_against_spark_ranking_metrics(spark):
    lists, truth = {u: c[0] for u, c in CASES.items()}, {u: c[1] for u, c in CASES.items()}
    joined = [(c[0], c[1]) for c in CASES.values() if c[0] and c[1]]
    reference = RankingMetrics(spark.sparkContext.parallelize(joined))
    curve = {r.k: r for r in met.ranking_curve(lists_of(spark, lists), truth_of(spark, truth), [1, 2, 3, 5]).collect()}
    for k, row in curve.items():
        assert row.ndcg == pytest.approx(reference.ndcgAt(k))
        assert row.prec == pytest.approx(reference.precisionAt(k))
        assert row.n_users == len(joined)
    users = {r.user_id: r for r in met.ranking_per_user(lists_of(spark, lists), truth_of(spark, truth), 3).collect()}
    assert set(users) == {"perfect", "late", "short", "twice", "none"}
    assert users["perfect"].ndcg == pytest.approx(1.0)
    assert users["late"].ndcg == pytest.approx(math.log(2) / math.log(4))
    assert users["twice"].ndcg > 1


def test_against_spark_regression_metrics(spark):
    rows = [(4.0, 3.5), (2.0, 2.5), (5.0, 4.0), (1.0, None), (3.0, float("nan"))]
    df = spark.createDataFrame(rows, "stars double, prediction double")
    got = met.regression_metrics(df).first()
    reference = RegressionMetrics(spark.sparkContext.parallelize([(p, y) for y, p in rows[:3]]))
    assert got.n == 3
    assert got.rmse == pytest.approx(reference.rootMeanSquaredError)
    assert got.mae == pytest.approx(reference.meanAbsoluteError)
    assert got.rsquared == pytest.approx(reference.r2)


def test_missing_label_counts_as_one(spark):
    df = spark.createDataFrame([(0.5,), (1.5,)], "prediction double")
    got = met.regression_metrics(df).first()
    assert (got.rmse, got.rsquared) == (0.5, None)


def test_metric_names():
    assert met.check_metrics(["ndcg", "rmse"]) == (["ndcg"], ["rmse"])
    with pytest.raises(ValueError):
        met.check_metrics(["recall"])


def test_positions_break_ties_by_item(spark):
    scored = spark.createDataFrame([("u", "b", 1.0), ("u", "a", 1.0), ("u", "c", 2.0)], PAIRS + ", prediction double")
    got = list_positions(rank_candidates(scored, 5)).orderBy("position").collect()
    assert [(r.business_id, r.rank, r.position) for r in got] == [("c", 1, 1), ("a", 2, 2), ("b", 2, 3)]


def test_key_of_many_candidates(spark):
    """The hashes of 20 million rows add up to more than a long holds."""
    from tasteforge.plans.evaluate import content_key

    assert content_key(spark.range(20_000_000)).startswith("20000000-")
