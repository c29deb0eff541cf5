"""Queries: the experiment log and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasteforge.functions.text import canonical_hyper
from tasteforge.operators import xlog
from tasteforge.plans.registry import query, rounded, step, ts_sql, ts_text
from tasteforge.sources import views
from tasteforge.sources.log import append_log, read_log
from tasteforge.sources.shared import fresh_path

LOG = ["id", "dataset", "model", "hyper", "metric", "value", "fold", "path"]
LOG_SQL = ", ".join(LOG) + ", " + ts_sql()
DATASET = "ds_exp"
RANDOM_HYPER = "[('k', 1), ('reg', 0.2)]"


def latest_sql(source: str, keys: str) -> str:
    return f"""select * exclude (rn) from (select *, row_number() over (partition by {keys} order by ts desc, id desc) as rn
               from {source}) where rn = 1"""


step("test_rows", "xlog", f"select * from xlog where dataset = '{DATASET}' and fold = -1")
step("perf", "test_rows", latest_sql("test_rows", "model, hyper, metric"))


def best_sql(metric: str) -> str:
    direction = "asc" if metric in ("rmse", "mae") else "desc"
    return f"""select * exclude (rb) from (
        select model, hyper, metric, value, row_number() over (partition by model order by value {direction}, hyper) as rb
        from perf where metric = '{metric}') where rb = 1"""


step("best_ndcg", "perf", best_sql("ndcg@10"))
step("best_rmse", "perf", best_sql("rmse"))


def log_rows(df):
    return df.select(*LOG, ts_text())


@query("log_append", "xlog", f"select {LOG_SQL} from xlog")
def log_append(spark, sf_dir):
    path = fresh_path(spark, "log")
    log = views.xlog(spark, sf_dir)
    append_log(log.filter("fold >= 0"), path)
    append_log(log.filter("fold = -1"), path)
    return log_rows(read_log(spark, path))


@query("log_scan", "xlog", f"select {LOG_SQL} from xlog")
def log_scan(spark, sf_dir):
    path = fresh_path(spark, "log")
    append_log(views.xlog(spark, sf_dir).withColumn("ts", F.col("ts").cast("string")), path)
    return log_rows(read_log(spark, path))


@query("log_union", "xlog", f"select {LOG_SQL} from xlog")
def log_union(spark, sf_dir):
    log = views.xlog(spark, sf_dir)
    paths = {name: fresh_path(spark, name) for name in ("ds_exp", "ds_imp")}
    for name, path in paths.items():
        append_log(log.filter(F.col("dataset") == name), path)
    return log_rows(read_log(spark, *paths.values()))


@query(
    "log_filter",
    "xlog",
    f"""select {LOG_SQL} from xlog where dataset = '{DATASET}' and metric in ('rmse', 'ndcg@10')
        and model in ('view', 'click') and fold >= 0""",
)
def log_filter(spark, sf_dir):
    log = views.xlog(spark, sf_dir)
    return log_rows(xlog.log_filter(log, DATASET, ["rmse", "ndcg@10"], ["view", "click"], F.col("fold") >= 0))


@query("list_models", "xlog", "select distinct model from xlog")
def list_models(spark, sf_dir):
    return xlog.list_models(views.xlog(spark, sf_dir))


@query("latest_per_config", "xlog", f"select {LOG_SQL} from ({latest_sql('xlog', 'model, hyper, metric, fold')})")
def latest_per_config(spark, sf_dir):
    return log_rows(xlog.latest_per_config(views.xlog(spark, sf_dir), ["model", "hyper", "metric", "fold"]))


@query("dedupe_log", "xlog", f"select {LOG_SQL} from ({latest_sql('xlog', 'dataset, model, hyper, metric, fold')})")
def dedupe_log(spark, sf_dir):
    return log_rows(xlog.dedupe_log(views.xlog(spark, sf_dir)))


step("cv_rows", "xlog", f"select * from xlog where dataset = '{DATASET}' and fold >= 0")
step("cv_latest", "cv_rows", latest_sql("cv_rows", "model, hyper, metric, fold"))


@query(
    "cv_summary",
    "cv_latest",
    """select model, hyper, metric, round(mean, 6) as mean, round(std, 6) as std,
              cast(row_number() over (partition by metric
                   order by case when metric in ('rmse', 'mae') then -mean else mean end desc, model, hyper) as int) as rnk
       from (select model, hyper, metric, avg(value) as mean, stddev_samp(value) as std from cv_latest group by 1, 2, 3)""",
)
def cv_summary(spark, sf_dir):
    summary = xlog.cv_summary(views.xlog(spark, sf_dir), DATASET)
    return summary.select("model", "hyper", "metric", rounded("mean", "mean"), rounded("std", "std"), "rnk")


@query("model_test_perf", "perf", f"select id, model, hyper, metric, value, {ts_sql()} from perf where model = 'view'")
def model_test_perf(spark, sf_dir):
    return xlog.model_test_perf(views.xlog(spark, sf_dir), DATASET, ["view"]).withColumn("ts", ts_text())


@query("best_config", "best_rmse", "select * from best_rmse where model = 'view'")
def best_config(spark, sf_dir):
    return xlog.best_config(views.xlog(spark, sf_dir), DATASET, "view", "rmse")


@query("best_configs", "best_ndcg", "select * from best_ndcg")
def best_configs(spark, sf_dir):
    return xlog.best_configs(views.xlog(spark, sf_dir), DATASET, "ndcg@10")


@query(
    "result_for_config",
    "perf",
    f"""select model, hyper, metric, value, {ts_sql()} from perf where model = 'click' and metric = 'rmse'
        and hyper = '{RANDOM_HYPER.replace("'", "''")}'""",
)
def result_for_config(spark, sf_dir):
    log = views.xlog(spark, sf_dir)
    return xlog.result_for_config(log, DATASET, "click", RANDOM_HYPER, "rmse").withColumn("ts", ts_text())


@query(
    "topk_curve",
    "perf best_ndcg",
    f"""select p.model, p.hyper, p.metric, p.value, {ts_sql()}, cast(split_part(p.metric, '@', 2) as int) as k
        from perf p join best_ndcg b on p.model = b.model and p.hyper = b.hyper where starts_with(p.metric, 'ndcg@')""",
)
def topk_curve(spark, sf_dir):
    return xlog.topk_curve(views.xlog(spark, sf_dir), DATASET).withColumn("ts", ts_text())


@query(
    "rmse_report",
    "perf best_ndcg best_rmse",
    " union all ".join(
        f"""select p.model, p.hyper, p.metric, p.value, {ts_sql()}, {flag} as is_rmse_opt
            from perf p join {best} b on p.model = b.model and p.hyper = b.hyper where p.metric = 'rmse'"""
        for best, flag in (("best_ndcg", "false"), ("best_rmse", "true"))
    ),
)
def rmse_report(spark, sf_dir):
    return xlog.rmse_report(views.xlog(spark, sf_dir), DATASET).withColumn("ts", ts_text())


PARSED = "regexp_extract_all(hyper, '\\(''([^'']+)'', ([^)]*)\\)', {group})"


@query(
    "hyper_explode",
    "xlog",
    f"""select id, model, metric, value, unnest({PARSED.format(group=1)}) as params_name,
               unnest({PARSED.format(group=2)}) as params_val from xlog""",
)
def hyper_explode(spark, sf_dir):
    return xlog.hyper_explode(views.xlog(spark, sf_dir), ["id", "model", "metric", "value"])


@query(
    "canonical_hyper",
    "xlog",
    r"""select distinct hyper, 'k_' || regexp_extract(hyper, '''k'', ([^)]*)', 1)
               || '-reg_' || regexp_extract(hyper, '''reg'', ([^)]*)', 1) as run_dir from xlog""",
)
def canonical_hyper_query(spark, sf_dir):
    return views.xlog(spark, sf_dir).select("hyper", canonical_hyper().alias("run_dir")).distinct()


step(
    "pivoted",
    "perf",
    r"""select model, hyper, metric, value, regexp_extract(hyper, '''k'', ([^)]*)', 1) as k,
               regexp_extract(hyper, '''reg'', ([^)]*)', 1) as reg from perf""",
)


@query("hyper_pivot", "pivoted", "select * from pivoted")
def hyper_pivot(spark, sf_dir):
    return xlog.hyper_pivot(xlog.model_test_perf(views.xlog(spark, sf_dir), DATASET), ["k", "reg"])


@query(
    "hyper_slice",
    "pivoted",
    "select model, cast(k as double) as k, value from pivoted where metric = 'ndcg@10' and cast(reg as double) = 0.1",
)
def hyper_slice(spark, sf_dir):
    pivoted = xlog.hyper_pivot(xlog.model_test_perf(views.xlog(spark, sf_dir), DATASET), ["k", "reg"])
    return xlog.hyper_slice(pivoted, "ndcg@10", "k", {"reg": 0.1})
