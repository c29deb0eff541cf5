"""Reports over the experiment log."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tasteforge.functions.text import hyper_pairs, metric_k
from tasteforge.operators.codes import number_rows
from tasteforge.operators.metrics import ASCENDING

TEST_FOLD = -1
RESULT = ["model", "hyper", "metric", "value", "ts"]


def latest_per_config(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row of each configuration; equal times by the higher id.

    Spark keeps one row per configuration in every map task before the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("id"))
    return log.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def log_filter(
    log: DataFrame,
    dataset: str,
    metrics: Iterable[str] | None = None,
    models: Iterable[str] | None = None,
    folds: Column | None = None,
) -> DataFrame:
    """Rows of one dataset, optionally of some metrics, models and folds."""
    kept = log.filter(F.col("dataset") == dataset)
    if metrics is not None:
        kept = kept.filter(F.col("metric").isin(list(metrics)))
    if models is not None:
        kept = kept.filter(F.col("model").isin(list(models)))
    return kept if folds is None else kept.filter(folds)


def list_models(log: DataFrame) -> DataFrame:
    """The models in the log."""
    return log.select("model").distinct()


def cv_summary(log: DataFrame, dataset: str, metrics: Iterable[str] | None = None, ascending: Sequence[str] = ASCENDING) -> DataFrame:
    """(model, hyper, metric, mean, std, rnk) over the newest run of each fold.

    ``rnk`` 1 is the best within the metric: the smallest mean for metrics in
    ``ascending``, the largest for others.  ``std`` of a single fold is NULL.
    """
    folds = log_filter(log, dataset, metrics, folds=F.col("fold") >= 0)
    newest = latest_per_config(folds, ["model", "hyper", "metric", "fold"])
    summary = newest.groupBy("model", "hyper", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    # All configurations are sorted by metric across tasks: a window by metric would put each metric's in one.
    numbered = number_rows(summary, ["metric", *_best_first("mean", ascending)], "_row")
    first = numbered.groupBy("metric").agg(F.min("_row").alias("_first"))
    ranked = numbered.join(first.withColumnRenamed("metric", "_metric"), F.col("metric").eqNullSafe(F.col("_metric")))
    rank = (F.col("_row") - F.col("_first") + 1).cast("int")
    return ranked.select(*summary.columns, rank.alias("rnk"))


def _best_first(value: str, ascending: Sequence[str]) -> list[Column | str]:
    """The order that puts the best value of a metric first.

    The sign of ascending metrics is turned, so one order fits all.
    """
    better = F.when(F.col("metric").isin(list(ascending)), -F.col(value)).otherwise(F.col(value))
    return [F.desc_nulls_last(better), "model", "hyper"]


def model_test_perf(log: DataFrame, dataset: str, models: Iterable[str] | None = None) -> DataFrame:
    """Newest test rows (fold -1): (id, model, hyper, metric, value, ts)."""
    rows = log_filter(log, dataset, models=models, folds=F.col("fold") == TEST_FOLD)
    return latest_per_config(rows, ["model", "hyper", "metric"]).drop("dataset", "path", "fold")


def best_configs(
    log: DataFrame,
    dataset: str,
    metric: str,
    models: Iterable[str] | None = None,
    ascending: Sequence[str] = ASCENDING,
) -> DataFrame:
    """The best configuration of every model by one metric."""
    perf = model_test_perf(log, dataset, models).filter(F.col("metric") == metric)
    best = perf.withColumn("_rn", F.row_number().over(Window.partitionBy("model").orderBy(*_best_first("value", ascending))))
    return best.filter("_rn = 1").select("model", "hyper", "metric", "value")


def best_config(log: DataFrame, dataset: str, model: str, metric: str) -> DataFrame:
    """The best configuration of one model: one row, or none."""
    return best_configs(log, dataset, metric, [model])


def result_for_config(log: DataFrame, dataset: str, model: str, hyper: str, metric: str) -> DataFrame:
    """The newest test result of one configuration; empty when there is none."""
    perf = model_test_perf(log, dataset, [model])
    return perf.filter((F.col("hyper") == hyper) & (F.col("metric") == metric)).select(*RESULT)


def results_for_configs(log: DataFrame, dataset: str, configs: DataFrame) -> DataFrame:
    """Newest test results of many (model, hyper) configurations."""
    chosen = configs.select("model", "hyper").distinct()
    return model_test_perf(log, dataset).join(chosen, ["model", "hyper"], "left_semi").select(*RESULT)


def dedupe_log(log: DataFrame) -> DataFrame:
    """The newest row per dataset, model, parameters, metric and fold."""
    return latest_per_config(log, ["dataset", "model", "hyper", "metric", "fold"])


def topk_curve(log: DataFrame, dataset: str, metric: str = "ndcg@10", models: Iterable[str] | None = None) -> DataFrame:
    """metric@K for every K, for each model's best configuration by ``metric``."""
    name = metric.split("@")[0]
    best = best_configs(log, dataset, metric, models)
    results = results_for_configs(log, dataset, best)
    return results.filter(F.col("metric").startswith(f"{name}@")).withColumn("k", metric_k())


def rmse_report(log: DataFrame, dataset: str, other: str = "ndcg@10", models: Iterable[str] | None = None) -> DataFrame:
    """RMSE of each model's best configuration by RMSE (flag true) and by ``other``."""
    parts = [
        results_for_configs(log, dataset, best_configs(log, dataset, metric, models))
        .filter(F.col("metric") == "rmse")
        .withColumn("is_rmse_opt", F.lit(metric == "rmse"))
        for metric in (other, "rmse")
    ]
    return parts[0].unionByName(parts[1])


def hyper_explode(log: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per hyper-parameter: (keep, params_name, params_val)."""
    return log.select(*keep, F.explode(hyper_pairs()).alias("_p")).select(*keep, "_p.params_name", "_p.params_val")


def hyper_pivot(results: DataFrame, params: Sequence[str], keys: Sequence[str] = ("model", "hyper", "metric", "value")) -> DataFrame:
    """One row per result, one column per named hyper-parameter.

    The parameters are in the row's own text, so the pivot is a projection:
    nothing is exploded or shuffled.
    """
    pairs = F.map_from_entries(hyper_pairs())
    values = results.withColumn("_map", pairs)
    return values.select(*keys, *[F.try_element_at("_map", F.lit(p)).alias(p) for p in params])


def hyper_slice(pivoted: DataFrame, metric: str, along: str, fixed: Mapping[str, object], models: Iterable[str] | None = None) -> DataFrame:
    """The metric along one parameter with the others fixed, in number order."""
    kept = pivoted.filter(F.col("metric") == metric)
    if models is not None:
        kept = kept.filter(F.col("model").isin(list(models)))
    for name, value in fixed.items():
        if isinstance(value, str):
            # Text stands in the log with or without its quotes.
            kept = kept.filter(F.regexp_replace(name, "^'|'$", "") == value)
        else:
            kept = kept.filter(F.col(name).try_cast("double") == float(value))
    point = F.col(along).try_cast("double")
    return kept.select("model", point.alias(along), "value").orderBy("model", along)
