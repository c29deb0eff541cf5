"""Queries: key samples, negatives, candidates, lists per key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tasteforge.functions.hashing import uniform_sql
from tasteforge.operators import sampling
from tasteforge.operators.lists import list_per_key
from tasteforge.plans import data
from tasteforge.plans.queries_prep import RATING_SQL, rating_rows
from tasteforge.plans.registry import query, step
from tasteforge.sources import views


@query("sample_keys", "ratings", f"select distinct user_id from ratings where {uniform_sql(24, 'user_id')} <= 0.3")
def sample_keys(spark, sf_dir):
    return sampling.sample_keys(views.ratings(spark, sf_dir), "user_id", 0.3, seed=24)


@query(
    "sample_dataset",
    "ratings",
    f"""select {RATING_SQL} from ratings
        where user_id in (select user_id from ratings where {uniform_sql(24, 'user_id')} <= 0.6)
          and business_id in (select business_id from ratings where {uniform_sql(24, 'business_id')} <= 0.5)""",
)
def sample_dataset(spark, sf_dir):
    return rating_rows(sampling.sample_dataset(views.ratings(spark, sf_dir), 0.5, 0.6))


@query(
    "candidate_pool",
    "test features",
    """select t.user_id, t.business_id, f.top_category, f.state, g.size - 1 as pool_size
       from (select distinct user_id, business_id from test) t
       join features f on t.business_id = f.business_id
       join (select top_category, state, count(*) as size from features group by 1, 2) g
         on f.top_category = g.top_category and f.state = g.state""",
)
def candidate_pool(spark, sf_dir):
    test = data.split(spark, sf_dir)[1]
    return sampling.candidate_pool(test, data.features(spark, sf_dir))


@query("sample_negatives", "negatives", "select user_id, business_id, candidate_id from negatives")
def sample_negatives(spark, sf_dir):
    return data.negatives(spark, sf_dir, data.split(spark, sf_dir)[1])


@query(
    "sample_negatives_200",
    "test numbered",
    f"select user_id, business_id, candidate_id from ({data.negatives_sql(200)})",
)
def sample_negatives_200(spark, sf_dir):
    return data.negatives(spark, sf_dir, data.split(spark, sf_dir)[1], 200)


step(
    "unseen_pairs",
    "negatives train",
    """select * from negatives n where not exists
       (select 1 from train t where t.user_id = n.user_id and t.business_id = n.business_id)""",
)


@query("drop_seen_test_pairs", "unseen_pairs", "select user_id, business_id, candidate_id from unseen_pairs")
def drop_seen_test_pairs(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    return sampling.drop_seen_test_pairs(data.draws(spark, sf_dir, test), train, test).rows()


@query("drop_seen_candidates", "unseen_negatives", "select user_id, business_id, candidate_id from unseen_negatives")
def drop_seen_candidates(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    return data.unseen(spark, sf_dir, train, test).rows()


@query("test_candidates", "candidates", "select user_id, candidate_id from candidates")
def test_candidates(spark, sf_dir):
    return data.candidates(spark, sf_dir, *data.split(spark, sf_dir))


@query(
    "test_candidates_by_test_pair",
    "unseen_pairs",
    """select distinct user_id, business_id as candidate_id from unseen_pairs
       union all select user_id, candidate_id from unseen_pairs""",
)
def test_candidates_by_test_pair(spark, sf_dir):
    train, test = data.split(spark, sf_dir)
    return sampling.test_candidates(sampling.drop_seen_test_pairs(data.draws(spark, sf_dir, test), train, test))


@query(
    "nested_candidates",
    "negatives",
    """select user_id, business_id, 0 as part, string_agg(candidate_id, ',' order by candidate_id) as candidates
       from negatives group by 1, 2""",
)
def nested_candidates(spark, sf_dir):
    drawn = data.draws(spark, sf_dir, data.split(spark, sf_dir)[1])
    lists = list_per_key(drawn.lists(), ["user_id", "business_id"], "candidate_id", "candidates")
    return lists.withColumn("candidates", F.array_join("candidates", ","))


@query(
    "ground_truth_lists",
    "test",
    "select user_id, 0 as part, string_agg(business_id, ',' order by business_id) as business_gt from test group by 1",
)
def ground_truth_lists(spark, sf_dir):
    lists = list_per_key(data.split(spark, sf_dir)[1], ["user_id"], "business_id", "business_gt")
    return lists.withColumn("business_gt", F.array_join("business_gt", ","))
