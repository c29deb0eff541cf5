"""Experiment log reports on a hand-made log."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tasteforge.operators import xlog
from tasteforge.sources.log import LOG_SCHEMA, append_log, metric_rows, read_log, unpivot_metrics

DAY = [datetime(2020, 1, d) for d in range(1, 5)]
K1, K2 = "[('k', 1), ('reg', 0.1)]", "[('k', 2), ('reg', 0.1)]"
ROWS = [
    (1, "d", "M", K1, "rmse", 1.5, -1, "p", DAY[0]),
    (2, "d", "M", K1, "rmse", 1.2, -1, "p", DAY[1]),
    (3, "d", "M", K1, "rmse", 1.3, -1, "p", DAY[1]),
    (4, "d", "M", K2, "rmse", 1.4, -1, "p", DAY[0]),
    (5, "d", "M", K1, "ndcg@10", 0.1, -1, "p", DAY[0]),
    (6, "d", "M", K2, "ndcg@10", 0.2, -1, "p", DAY[0]),
    (7, "d", "M", K2, "ndcg@5", 0.15, -1, "p", DAY[0]),
    (8, "e", "M", K2, "rmse", 0.1, -1, "p", DAY[3]),
    (9, "d", "M", K1, "rmse", 1.0, 0, "p", DAY[0]),
    (10, "d", "M", K1, "rmse", 2.0, 1, "p", DAY[0]),
    (11, "d", "M", K2, "rmse", 1.1, 0, "p", DAY[0]),
    (12, "d", "N", K2, "ndcg@10", 0.3, 0, "p", DAY[0]),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(ROWS, LOG_SCHEMA)


def test_latest_breaks_ties_by_id(log):
    kept = xlog.model_test_perf(log, "d", ["M"]).filter("metric = 'rmse'").collect()
    assert {(r.id, r.hyper) for r in kept} == {(3, K1), (4, K2)}
    assert xlog.dedupe_log(log).count() == 10


def test_best_config_knows_the_direction(log):
    assert xlog.best_config(log, "d", "M", "rmse").first().hyper == K1
    assert xlog.best_config(log, "d", "M", "ndcg@10").first().hyper == K2
    assert xlog.best_config(log, "d", "missing", "rmse").isEmpty()
    assert xlog.result_for_config(log, "d", "M", K1, "mae").isEmpty()
    assert xlog.result_for_config(log, "d", "M", K1, "rmse").first().value == 1.3


def test_cv_summary(log):
    got = {(r.metric, r.hyper): r for r in xlog.cv_summary(log, "d").collect()}
    assert got[("rmse", K1)].mean == 1.5
    assert got[("rmse", K1)].std == pytest.approx(0.5**0.5)
    assert got[("rmse", K2)].std is None
    assert (got[("rmse", K2)].rnk, got[("rmse", K1)].rnk) == (1, 2)
    assert got[("ndcg@10", K2)].rnk == 1


def test_curve_and_report(log):
    assert sorted((r.k, r.value) for r in xlog.topk_curve(log, "d").collect()) == [(5, 0.15), (10, 0.2)]
    assert sorted((r.is_rmse_opt, r.value) for r in xlog.rmse_report(log, "d").collect()) == [(False, 1.4), (True, 1.3)]


def test_pivot_keeps_equal_values_apart(spark):
    rows = [(n, "d", "M", h, "rmse", 1.0, -1, "p", DAY[0]) for n, h in enumerate((K1, K2))]
    wide = xlog.hyper_pivot(spark.createDataFrame(rows, LOG_SCHEMA), ["k", "reg", "none"])
    assert sorted((r.k, r.reg, r.none) for r in wide.collect()) == [("1", "0.1", None), ("2", "0.1", None)]
    assert [(r.model, r.k) for r in xlog.hyper_slice(wide, "rmse", "k", {"reg": 0.1}).collect()] == [("M", 1.0), ("M", 2.0)]
    named = wide.withColumn("used", F.lit("'Both'"))
    assert xlog.hyper_slice(named, "rmse", "k", {"used": "Both"}).count() == 2
    assert xlog.hyper_slice(named, "rmse", "k", {"used": "User"}).count() == 0


def test_append_and_stack(spark, tmp_path):
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    for path in (one, one, two):
        append_log(metric_rows(spark, {"rmse": 1.0, "mae": None}, "d", "M", K1, -1, "p", DAY[0], 5), path)
    assert read_log(spark, one).count() == 4
    both = read_log(spark, one, two)
    assert both.count() == 6 and both.schema["ts"].dataType.typeName() == "timestamp_ntz"


def test_unpivot(spark):
    runs = spark.createDataFrame([("M", 1.0, 2.0)], "model string, rmse double, mae double")
    assert sorted(map(tuple, unpivot_metrics(runs, ["rmse", "mae"], ["model"]).collect())) == [("M", "mae", 2.0), ("M", "rmse", 1.0)]


def test_a_large_log_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).selectExpr(
        "id", "'d' as dataset", "'M' as model", "'h' as hyper", "'rmse' as metric", "1.0D as value", "0 as fold", "'p' as path",
        "timestamp_ntz'2020-01-01 00:00:00' as ts",
    )
    append_log(rows, str(tmp_path / "log"))
    assert len(list((tmp_path / "log").glob("dataset=d/*.parquet"))) == 4
    assert read_log(spark, str(tmp_path / "log")).count() == 400
