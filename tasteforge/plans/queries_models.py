"""Queries: models, ranking, metrics, whole evaluations."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, functions as F

from tasteforge.functions.hashing import uniform_sql
from tasteforge.models.bias import BiasModel
from tasteforge.models.bpr import BPR
from tasteforge.models.cmf import CollectiveMF
from tasteforge.models.fm import FactorisationMachine
from tasteforge.models.fm_local import LOCAL_ROWS
from tasteforge.models.mf import BiasedMF
from tasteforge.models.pure_random import PureRandom
from tasteforge.operators import metrics as met
from tasteforge.operators.features import predictions_backfill
from tasteforge.operators.prep import user_features
from tasteforge.operators.ranking import rank_candidates, recommend_lists
from tasteforge.plans import data, model_steps
from tasteforge.plans.evaluate import evaluate, sweep
from tasteforge.plans.registry import query, rounded, step
from tasteforge.sources import views
from tasteforge.sources.shared import fresh_path, stage

EPOCHS = 10
DIGITS = 6
TOP_N = 50


def bias_steps(tag: str, reg_i: float, reg_u: float) -> None:
    """Steps bi1, bu1, bi2, bu2, ... (with a tag) and the scores of test pairs and candidates."""
    step(f"mean{tag}", "train", "select avg(stars) as mean from train")
    before_u = ""
    for epoch in range(1, EPOCHS + 1):
        join_u = f"join bu{epoch - 1}{tag} u on t.user_id = u.user_id" if before_u else ""
        take_u = "- b_u" if before_u else ""
        step(
            f"bi{epoch}{tag}",
            f"train mean{tag} {before_u}",
            f"""select t.business_id, sum(stars - mean {take_u}) / ({reg_i} + count(*)) as b_i
                from train t {join_u}, mean{tag} group by 1""",
        )
        step(
            f"bu{epoch}{tag}",
            f"train mean{tag} bi{epoch}{tag}",
            f"""select t.user_id, sum(stars - mean - b_i) / ({reg_u} + count(*)) as b_u
                from train t join bi{epoch}{tag} i on t.business_id = i.business_id, mean{tag} group by 1""",
        )
        before_u = f"bu{epoch}{tag}"
    for name, source in (("rated", "select user_id, business_id, stars from test"),
                         ("scored", "select distinct user_id, candidate_id as business_id from candidates")):
        step(
            f"{name}{tag}",
            f"{'test' if name == 'rated' else 'candidates'} mean{tag} bi{EPOCHS}{tag} bu{EPOCHS}{tag}",
            f"""select p.*, least(greatest(mean + coalesce(b_u, 0) + coalesce(b_i, 0), 1.0), 5.0) as prediction
                from ({source}) p left join bi{EPOCHS}{tag} i on p.business_id = i.business_id
                left join bu{EPOCHS}{tag} u on p.user_id = u.user_id, mean{tag}""",
        )


GRID = {"reg_i": [10, 5, 20], "reg_u": [15, 5, 30]}
# The first point is that of the other queries.
GRID_TAGS = {(i, u): f"_{i}_{u}" if n else "" for n, (i, u) in enumerate(product(GRID["reg_i"], GRID["reg_u"]))}
for (reg_i, reg_u), tag in GRID_TAGS.items():
    bias_steps(tag, reg_i, reg_u)

TRAINED, PUBLISHED = 3, 100
FM_RATE, BPR_RATE = 0.2, 0.1
model_steps.mf_steps(0.1, TRAINED)
model_steps.cmf_steps(0.1, TRAINED, 0.3, 0.2)
model_steps.fm_steps(PUBLISHED, 2, FM_RATE, 0.1, 0.5)
ALS_ROUNDS, ALS_REG = 2, (1.0, 1.0)
model_steps.fm_als_steps(ALS_ROUNDS, *ALS_REG)
model_steps.bpr_steps(4, 8, BPR_RATE, 0.001)
LOCAL_EPOCHS, LOCAL_FACTORS, LOCAL_BLOCKS, LOCAL_RATE = 3, 3, 4, 0.05
model_steps.bpr_local_steps(LOCAL_EPOCHS, LOCAL_FACTORS, LOCAL_BLOCKS, LOCAL_RATE, 0.001)


def rated_sql(table: str, columns: str = "user_id, business_id, stars") -> str:
    return f"select {columns}, round(prediction, {DIGITS}) as prediction from {table}"


def rounded_predictions(scored: DataFrame) -> DataFrame:
    return scored.withColumn("prediction", F.round("prediction", DIGITS))

step(
    "ranked",
    "scored",
    f"""select *, row_number() over (partition by user_id order by rank, business_id) as position from (
            select user_id, business_id, round(prediction, {DIGITS}) as prediction,
                   rank() over (partition by user_id order by round(prediction, {DIGITS}) desc) as rank from scored)
        where rank <= {TOP_N} qualify position <= {TOP_N}""",
)
step("labels_set", "test", "select distinct user_id, business_id from test")
step("label_sizes", "labels_set", "select user_id, count(*) as n_truth from labels_set group by 1")


def hits_sql(k: str) -> str:
    return f"""
        select r.user_id, s.n_truth,
               sum(case when l.user_id is not null and r.position <= {k} then 1 / ln(r.position + 1) else 0 end) as dcg,
               sum(case when l.user_id is not null and r.position <= {k} then 1 else 0 end) as hits
        from ranked r join label_sizes s on r.user_id = s.user_id
        left join labels_set l on r.user_id = l.user_id and r.business_id = l.business_id
        group by 1, 2"""


def ideal_sql(k: str) -> str:
    return f"list_sum(list_transform(range(1, least(n_truth, {k}) + 1), lambda p: 1 / ln(p + 1)))"


step("per_user", "ranked labels_set label_sizes", hits_sql("10"))


def bias_model() -> BiasModel:
    return BiasModel(reg_i=10, reg_u=15, n_epochs=EPOCHS)


def bias_inputs(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    return train, test, data.candidates(spark, sf_dir, train, test)


def bias_lists(spark, sf_dir):
    """(lists, test): the flagship run up to the ranked lists.  Candidates bring the model's terms, so they are not joined with its tables."""
    train, test = data.split(spark, sf_dir)
    model = bias_model().fit(train)
    candidates = data.candidates(spark, sf_dir, train, test, model.terms())
    return model.recommend(candidates, TOP_N, digits=DIGITS), test


@query(
    "model_random",
    "candidates",
    f"""select user_id, business_id, round({uniform_sql(42, 'user_id', 'business_id')}, 6) as prediction
        from (select user_id, candidate_id as business_id from candidates)""",
)
def model_random(spark, sf_dir):
    train, test, candidates = bias_inputs(spark, sf_dir)
    pairs = candidates.withColumnRenamed("candidate_id", "business_id")
    scored = PureRandom(random_state=42).fit(train).transform(pairs)
    return scored.withColumn("prediction", F.round("prediction", 6))


@query("model_bias_fit_items", f"bi{EPOCHS}", f"select business_id, round(b_i, 6) as b_i from bi{EPOCHS}")
def model_bias_fit_items(spark, sf_dir):
    model = bias_model().fit(data.split(spark, sf_dir)[0])
    return model.tables["items"].select("business_id", rounded("b_i", "b_i"))


@query("model_bias_fit_users", f"bu{EPOCHS}", f"select user_id, round(b_u, 6) as b_u from bu{EPOCHS}")
def model_bias_fit_users(spark, sf_dir):
    model = bias_model().fit(data.split(spark, sf_dir)[0])
    return model.tables["users"].select("user_id", rounded("b_u", "b_u"))


@query("model_bias_predict", "rated", "select user_id, business_id, stars, round(prediction, 6) as prediction from rated")
def model_bias_predict(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    scored = bias_model().fit(train).transform(test.select("user_id", "business_id", "stars"))
    return scored.withColumn("prediction", F.round("prediction", 6))


@query("model_mf_predict")
def model_mf_predict(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    model = BiasedMF(n_factors=10, reg_all=0.1, n_epochs=3).fit(train)
    return model.transform(test.select("user_id", "business_id", "stars"))


# Two factors, whose normal equations have a closed form in SQL.
@query("model_mf_rank2", "mf_rated", rated_sql("mf_rated"))
def model_mf_rank2(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    model = BiasedMF(n_factors=2, reg_all=0.1, n_epochs=TRAINED).fit(train)
    return rounded_predictions(model.transform(test.select("user_id", "business_id", "stars")))


# Steps on one rating after the other, which SQL can't repeat: tests hold them against a plain loop.
@query("model_mf_sgd")
def model_mf_sgd(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    model = BiasedMF(n_factors=10, reg_all=0.02, n_epochs=TRAINED, lr_all=0.005).fit(train)
    return model.transform(test.select("user_id", "business_id", "stars"))


def side_tables(spark, sf_dir):
    return user_features(views.users(spark, sf_dir)), data.features(spark, sf_dir)


@query("model_cmf_predict")
def model_cmf_predict(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    model = CollectiveMF(
        k=8, reg_param=0.1, w_main=1.0, use_user_info=True, use_item_info=True, iterations=3, standardise=True
    )
    model.fit(train, *side_tables(spark, sf_dir))
    return model.transform(test.select("user_id", "business_id", "stars"))


@query("model_cmf_rank2", "cmf_rated", rated_sql("cmf_rated"))
def model_cmf_rank2(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    model = CollectiveMF(
        k=2, reg_param=0.1, w_main=1.0, use_user_info=True, use_item_info=True, iterations=TRAINED, standardise=True
    )
    model.fit(train, *side_tables(spark, sf_dir))
    return rounded_predictions(model.transform(test.select("user_id", "business_id", "stars")))


@query("model_fm_predict", "fm_rated", rated_sql("fm_rated"))
def model_fm_predict(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    model = FactorisationMachine(n_iter=PUBLISHED, rank=2, model_info_used="Both", rate=FM_RATE, solver="gradient", local_rows=LOCAL_ROWS)
    model.fit(train, *side_tables(spark, sf_dir))
    return rounded_predictions(model.transform(test.select("user_id", "business_id", "stars")))


# One factor and few rounds, whose steps SQL can repeat.
@query("model_fm_als_rank1", "als_rated", rated_sql("als_rated"))
def model_fm_als_rank1(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    model = FactorisationMachine(
        n_iter=ALS_ROUNDS, rank=1, l2_reg_w=ALS_REG[0], l2_reg_V=ALS_REG[1], model_info_used="Both", local_rows=LOCAL_ROWS
    )
    model.fit(train, *side_tables(spark, sf_dir))
    return rounded_predictions(model.transform(test.select("user_id", "business_id", "stars")))


# The published number of iterations, by coordinate descent.
@query("model_fm_published")
def model_fm_published(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    model = FactorisationMachine(n_iter=PUBLISHED, rank=2, l2_reg_w=1.0, l2_reg_V=1.0, model_info_used="Both", local_rows=LOCAL_ROWS)
    model.fit(train, *side_tables(spark, sf_dir))
    return model.transform(test.select("user_id", "business_id", "stars"))


@query("model_bpr_published")
def model_bpr_published(spark, sf_dir):
    train, test, candidates = bias_inputs(spark, sf_dir)
    model = BPR(factors=8, iteration=PUBLISHED, regularization=0.001, learning_rate=BPR_RATE).fit(train)
    return model.transform(candidates.withColumnRenamed("candidate_id", "business_id"))


# A block's positives taken at once, in stated blocks: steps that SQL can repeat.
@query("model_bpr_local_steps", "bpr_local_scored", rated_sql("bpr_local_scored", "user_id, business_id"))
def model_bpr_local_steps(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    model = BPR(factors=LOCAL_FACTORS, iteration=LOCAL_EPOCHS, regularization=0.001, learning_rate=LOCAL_RATE, blocks=LOCAL_BLOCKS, batch=0)
    return rounded_predictions(model.fit(train).transform(test.select("user_id", "business_id").distinct()))


@query("model_bpr_predict", "bpr_scored", rated_sql("bpr_scored", "user_id, business_id"))
def model_bpr_predict(spark, sf_dir):
    train, test, candidates = bias_inputs(spark, sf_dir)
    model = BPR(factors=8, iteration=4, regularization=0.001, learning_rate=BPR_RATE, solver="gradient").fit(train)
    return rounded_predictions(model.transform(candidates.withColumnRenamed("candidate_id", "business_id")))


@query("factors_roundtrip", "rated", "select user_id, business_id, stars, round(prediction, 6) as prediction from rated")
def factors_roundtrip(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    path = fresh_path(spark, "bias-model")
    bias_model().fit(train).save(path)
    model = BiasModel.restore(spark, path)
    return model.transform(test.select("user_id", "business_id", "stars")).withColumn("prediction", F.round("prediction", 6))


@query(
    "predictions_backfill",
    "test train rated",
    """select t.user_id, t.business_id, t.stars, round(r.prediction, 6) as prediction
       from test t left join (select distinct user_id, business_id, prediction from rated
            where user_id in (select user_id from train) and business_id in (select business_id from train)) r
         on t.user_id = r.user_id and t.business_id = r.business_id""",
)
def predictions_backfill_query(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    pairs = test.select("user_id", "business_id", "stars")
    warm = BiasModel(reg_i=10, reg_u=15, n_epochs=EPOCHS, cold_start="drop").fit(train).transform(pairs)
    return predictions_backfill(pairs, warm).withColumn("prediction", F.round("prediction", 6))


@query(
    "rank_candidates",
    "candidates",
    """select user_id, business_id, prediction, rank from (
           select *, rank() over (partition by user_id order by prediction desc) as rank from (
               select distinct user_id, candidate_id as business_id,
                      round({u}, 1) as prediction from candidates)) where rank <= 5""".format(
        u=uniform_sql(42, "user_id", "candidate_id")
    ),
)
def rank_candidates_query(spark, sf_dir):
    train, test, candidates = bias_inputs(spark, sf_dir)
    scored = PureRandom(random_state=42).transform(candidates.withColumnRenamed("candidate_id", "business_id"))
    return rank_candidates(scored.withColumn("prediction", F.round("prediction", 1)), 5)


@query(
    "recommend_lists",
    "ranked",
    "select user_id, string_agg(business_id, ',' order by rank, business_id) as recommendations from ranked group by 1",
)
def recommend_lists_query(spark, sf_dir):
    lists, _ = bias_lists(spark, sf_dir)
    return recommend_lists(lists, TOP_N).withColumn("recommendations", F.array_join("recommendations", ","))


@query(
    "ndcg_per_user",
    "per_user",
    f"select user_id, round(dcg / {ideal_sql('10')}, 6) as ndcg, round(hits / 10.0::double, 6) as prec from per_user",
)
def ndcg_per_user(spark, sf_dir):
    users = met.ranking_per_user(*bias_lists(spark, sf_dir), 10)
    return users.select("user_id", rounded("ndcg", "ndcg"), rounded("prec", "prec"))


@query("ndcg_at_k", "per_user", f"select round(avg(dcg / {ideal_sql('10')}), 6) as ndcg from per_user")
def ndcg_at_k(spark, sf_dir):
    return met.ranking_curve(*bias_lists(spark, sf_dir), [10]).select(rounded("ndcg", "ndcg"))


@query("precision_at_k", "per_user", "select round(avg(hits / 10.0::double), 6) as prec from per_user")
def precision_at_k(spark, sf_dir):
    return met.ranking_curve(*bias_lists(spark, sf_dir), [10]).select(rounded("prec", "prec"))


@query(
    "ndcg_curve",
    "ranked labels_set label_sizes",
    "select k, round(avg(ndcg), 6) as ndcg, round(avg(prec), 6) as prec, count(*) as n_users from ("
    + " union all ".join(
        f"select {k} as k, user_id, dcg / {ideal_sql(str(k))} as ndcg, hits / {k}.0::double as prec from ({hits_sql(str(k))})"
        for k in range(1, 11)
    )
    + ") group by 1",
)
def ndcg_curve(spark, sf_dir):
    curve = met.ranking_curve(*bias_lists(spark, sf_dir), range(1, 11))
    return curve.select("k", rounded("ndcg", "ndcg"), rounded("prec", "prec"), "n_users")


REGRESSION_SQL = """select round(sqrt(avg(pow(stars - prediction, 2))), 6) as rmse,
       round(avg(abs(stars - prediction)), 6) as mae,
       round(1 - sum(pow(stars - prediction, 2)) / (var_pop(stars) * count(*)), 6) as rsquared, count(*) as n from rated"""


@query("regression_metrics", "rated", REGRESSION_SQL)
def regression_metrics(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    rated = bias_model().fit(train).transform(test.select("user_id", "business_id", "stars"))
    row = met.regression_metrics(rated)
    return row.select(*[rounded(c, c) for c in ("rmse", "mae", "rsquared")], "n")


def metric_frame(spark, found, **extra):
    rows = [(*extra.values(), name, float(value)) for name, value in found.items()]
    schema = ", ".join([*(f"{c} string" for c in extra), "metric string", "value double"])
    return spark.createDataFrame(rows, schema).withColumn("value", F.round("value", 6))


@query(
    "evaluate_model",
    "per_user rated",
    f"""select 'ndcg@10' as metric, round(avg(dcg / {ideal_sql('10')}), 6) as value from per_user
        union all select 'precision@10', round(avg(hits / 10.0::double), 6) from per_user
        union all select 'rmse', round(sqrt(avg(pow(stars - prediction, 2))), 6) from rated
        union all select 'mae', round(avg(abs(stars - prediction)), 6) from rated
        union all select 'rsquared', round(1 - sum(pow(stars - prediction, 2)) / (var_pop(stars) * count(*)), 6) from rated""",
)
def evaluate_model(spark, sf_dir):
    train, test, candidates = bias_inputs(spark, sf_dir)
    root = fresh_path(spark, "runs")
    found = evaluate(
        spark, bias_model(), train, test.select("user_id", "business_id", "stars"), candidates, root, "user_10_item_1_exp",
        metrics=("ndcg", "precision", "rmse", "mae", "rsquared"), num_candidates=TOP_N, log_path=f"{root}/log", digits=DIGITS,
    )
    return metric_frame(spark, found)


@query(
    "grid_sweep",
    " ".join(f"rated{tag}" for tag in GRID_TAGS.values()),
    " union all ".join(
        f"select '[(''n_epochs'', {EPOCHS}), (''reg_i'', {i}), (''reg_u'', {u})]' as hyper, 'rmse' as metric,"
        f" round(sqrt(avg(pow(stars - prediction, 2))), 6) as value from rated{tag}"
        for (i, u), tag in GRID_TAGS.items()
    ),
)
def grid_sweep(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    runs = sweep(
        BiasModel, {**GRID, "n_epochs": [EPOCHS]},
        spark=spark, train=train, test=test.select("user_id", "business_id", "stars"), candidates=None,
        root=fresh_path(spark, "runs"), dataset="user_10_item_1_exp", metrics=("rmse",),
    )
    # One row per point of the grid.
    return reduce(DataFrame.unionByName, [metric_frame(spark, found, hyper=model.hyper) for model, found in runs])
