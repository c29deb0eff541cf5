"""Samples and negatives: properties that no seed may break."""

from collections import Counter

import pytest

from tasteforge.operators import sampling
from tasteforge.operators.lists import list_per_key
from tasteforge.sources.shared import stage


@pytest.fixture(scope="module")
def items(spark):
    # One group of 300 items, one of 3, one of a single item.
    return spark.range(304).selectExpr(
        "concat('b', cast(id as string)) as business_id",
        "case when id < 300 then 'big' when id < 303 then 'small' else 'one' end as top_category",
        "'S' as state",
    )


@pytest.fixture(scope="module")
def test_pairs(spark):
    rows = [("u1", "b0"), ("u1", "b0"), ("u1", "b7"), ("u2", "b300"), ("u3", "b303"), ("u4", "b299"), ("u5", "unknown")]
    return spark.createDataFrame(rows, "user_id string, business_id string")


def drawn(df):
    return sorted(map(tuple, df.select("user_id", "business_id", "candidate_id").collect()))


@pytest.mark.parametrize("rows_per_slice", [2, 10**6])
def test_negatives(items, test_pairs, rows_per_slice):
    got = drawn(sampling.sample_negatives(test_pairs, items, 20, rows_per_slice=rows_per_slice))
    assert Counter((u, b) for u, b, _ in got) == {("u1", "b0"): 20, ("u1", "b7"): 20, ("u2", "b300"): 2, ("u4", "b299"): 20}
    assert len(set(got)) == len(got)
    assert all(b != c for _, b, c in got)
    assert {c for u, _, c in got if u == "u2"} == {"b301", "b302"}
    assert all(int(c[1:]) < 300 for u, _, c in got if u != "u2")


def test_all_others_when_the_group_is_smaller(items, test_pairs):
    got = drawn(sampling.sample_negatives(test_pairs, items, 1000))
    assert {c for u, b, c in got if (u, b) == ("u1", "b7")} == {f"b{i}" for i in range(300)} - {"b7"}


def test_negatives_do_not_depend_on_partitions(items, test_pairs):
    one = drawn(sampling.sample_negatives(test_pairs.repartition(1), items.repartition(1), 10))
    many = drawn(sampling.sample_negatives(test_pairs.repartition(7), items.repartition(9), 10))
    assert one == many


def test_negatives_cover_the_group_evenly(spark, items):
    pairs = spark.range(600).selectExpr("concat('u', cast(id as string)) as user_id", "'b5' as business_id")
    hits = Counter(c for _, _, c in drawn(sampling.sample_negatives(pairs, items, 50)))
    # 600 x 50 draws over 299 items: 100 each on average.
    assert len(hits) == 299
    assert 50 < min(hits.values()) and max(hits.values()) < 160


def test_pairs_of_a_group_have_orders_of_their_own(spark, items):
    pairs = spark.range(40).selectExpr("concat('u', cast(id as string)) as user_id", "'b5' as business_id")
    lists = {}
    for u, _, c in drawn(sampling.sample_negatives(pairs, items, 60)):
        lists.setdefault(u, set()).add(c)
    # 60 of 299 twice by chance: 60 * 60 / 299 = 12 in common on average, deviation 2.8.
    common = [len(lists[a] & lists[b]) for a in lists for b in lists if a < b]
    assert abs(sum(common) / len(common) - 60 * 60 / 299) < 0.5
    assert max(common) < 30 and min(common) > 0


@pytest.mark.parametrize("others", [1, 2, 3, 7, 64, 299])
def test_the_shuffle_maps_a_group_onto_itself(spark, others):
    rows = spark.range(others).selectExpr("id as _j", f"cast({others} as bigint) as _others", "4000000000 as _w0", "123456789L as _w1", "987654321L as _w2", "55555L as _w3")
    assert sorted(r[0] for r in rows.selectExpr(sampling.shuffled_place("_j")).collect()) == list(range(others))


def test_draws_are_spread_over_tasks(spark, items):
    pairs = spark.range(400).selectExpr("concat('u', cast(id as string)) as user_id", "'b5' as business_id")
    plan = sampling.sample_negatives(pairs, items, 50)._jdf.queryExecution().executedPlan().toString()
    tasks = sampling.DRAW_TASKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {tasks}), REPARTITION_BY_NUM" in plan


def test_key_sample_is_repeatable_and_near_its_ratio(spark):
    df = spark.range(4000).selectExpr("concat('u', cast(id % 2000 as string)) as user_id")
    one = {r[0] for r in sampling.sample_keys(df.repartition(3), "user_id", 0.3).collect()}
    two = {r[0] for r in sampling.sample_keys(df.repartition(11), "user_id", 0.3).collect()}
    assert one == two
    assert 500 < len(one) < 700


def test_sample_ratios(spark):
    df = spark.range(500).selectExpr("cast(id % 50 as string) as user_id", "cast(id % 70 as string) as business_id", "id")
    assert sampling.sample_dataset(df, 1, 1) is df
    with pytest.raises(ValueError):
        sampling.sample_dataset(df, 0, 0.5)
    assert sampling.sample_dataset(df, 0.5, 0).isEmpty()
    users = sampling.sample_keys(df, "user_id", 0.5)
    items = sampling.sample_keys(df, "business_id", 0.4)
    want = df.join(users, "user_id", "left_semi").join(items, "business_id", "left_semi").select("id")
    got = sampling.sample_dataset(df, 0.4, 0.5).select("id")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_both_anti_joins_and_the_union(spark):
    candidates = spark.createDataFrame(
        [("u", "t", "c"), ("u", "t", "d"), ("u", "s", "c"), ("v", "t", "c")], "user_id string, business_id string, candidate_id string"
    )
    train = spark.createDataFrame([("u", "c"), ("u", "c"), ("u", "s")], "user_id string, business_id string")
    assert drawn(sampling.drop_seen_test_pairs(candidates, train)) == [("u", "t", "c"), ("u", "t", "d"), ("v", "t", "c")]
    assert drawn(sampling.drop_seen_candidates(candidates, train)) == [("u", "t", "d"), ("v", "t", "c")]
    table = sorted(map(tuple, sampling.test_candidates(candidates).collect()))
    assert table == [("u", "c"), ("u", "c"), ("u", "d"), ("u", "s"), ("u", "t"), ("v", "c"), ("v", "t")]
    pool = sampling.candidate_pool(
        candidates.select("user_id", "business_id"),
        spark.createDataFrame([("s", "a", "X"), ("t", "a", "X"), ("c", "a", "Y")], "business_id string, top_category string, state string"),
    )
    assert {(r.user_id, r.business_id, r.pool_size) for r in pool.collect()} == {("u", "t", 1), ("u", "s", 1), ("v", "t", 1)}


def test_draws_from_lists_are_those_by_place(spark, items, test_pairs, monkeypatch):
    listed = drawn(sampling.sample_negatives(test_pairs, items, 20))
    monkeypatch.setattr(sampling, "LISTED", 0)
    assert drawn(sampling.sample_negatives(test_pairs, items, 20)) == listed


def test_drawn_rows_are_not_shuffled(items, test_pairs):
    """Each exchange is below the step that makes rows of a pair's places."""
    numbered = sampling.number_items(items)
    pairs = sampling.keyed_pairs(test_pairs, numbered, 7)
    plan = sampling.from_lists(pairs, numbered, 20, 10**6)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]
    assert "Exchange" in plan


def test_seen_draws(spark, items, test_pairs):
    train = spark.createDataFrame([("u1", f"b{i}") for i in range(0, 304, 3)] + [("u2", "b301"), ("u9", "b1"), (None, "b1")], "user_id string, business_id string")
    candidates = sampling.sample_negatives(test_pairs, items, 20)
    seen = sampling.seen_draws(train, test_pairs, items, 20)
    met = {(u, c) for u, _, c in drawn(candidates)} & {tuple(r) for r in train.collect()}
    assert met and {tuple(r) for r in seen.collect()} == met
    assert drawn(sampling.drop_seen_candidates(candidates, train, seen)) == drawn(sampling.drop_seen_candidates(candidates, train))
    again = train.unionByName(test_pairs.filter("user_id = 'u4'"))
    assert drawn(sampling.drop_seen_test_pairs(candidates, again, test_pairs)) == drawn(sampling.drop_seen_test_pairs(candidates, again))


def test_seen_draws_go_without_a_shuffle_of_candidates(spark, items, test_pairs, monkeypatch):
    """Repeated items, null users and unnamed groups included: the rows are those of the joins with all candidates."""
    drawn = lambda df: sorted(map(tuple, df.select("user_id", "business_id", "candidate_id").collect()), key=str)
    more = spark.createDataFrame([("b3", "a", "X"), ("b3", "c", "Y"), ("n1", None, "X"), ("n2", None, "X")], "business_id string, top_category string, state string")
    items = items.select("business_id", "top_category", "state").unionByName(more)
    asked = test_pairs.unionByName(spark.createDataFrame([(None, "b4"), ("u1", "n1"), ("u1", "b3")], "user_id string, business_id string"))
    rated = [(u, f"b{i}") for u in ("u1", "u4") for i in range(0, 304, 2)]
    train = spark.createDataFrame([*rated, ("u1", "b3"), ("u1", "b3"), ("u9", "b1"), (None, "b1")], "user_id string, business_id string")
    items, asked, train = (stage(df.coalesce(1), "given") for df in (items, asked, train))
    rows = stage(sampling.sample_negatives(asked, items, 20), "rows")
    draws = sampling.draw_negatives(asked, items, 20)
    kept, by_pair = sampling.drop_seen_candidates(draws, train), sampling.drop_seen_test_pairs(draws, train)
    left = stage(sampling.drop_seen_candidates(rows, train), "left")
    assert drawn(kept.rows()) == drawn(left) != drawn(rows)
    assert drawn(by_pair.rows()) == drawn(sampling.drop_seen_test_pairs(rows, train)) != drawn(rows)
    table = [sorted(map(tuple, sampling.test_candidates(part).collect()), key=str) for part in (kept, left)]
    assert table[0] == table[1]
    lists = [sorted(map(tuple, list_per_key(df, ["user_id", "business_id"], "candidate_id", "found", 10).collect())) for df in (kept.lists(), left)]
    assert lists[0] == lists[1] and max(row[2] for row in lists[0]) > 0
    short = kept.pairs.filter("_group_size <= 100000")
    plan = sampling.from_lists(short, kept.numbered, 20, 10**6)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]
    monkeypatch.setattr(sampling, "LISTED", 0)
    assert drawn(kept.rows()) == drawn(left)


def test_candidates_bring_the_terms_of_a_model(spark, items, test_pairs, monkeypatch):
    """Ranked as candidates that are joined with the model's tables, without an exchange between a draw and the cut to the first ones."""
    from tasteforge.models.bias import BiasModel

    train = spark.createDataFrame([(f"u{n % 4}", f"b{n * 7 % 304}", float(n % 5 + 1)) for n in range(200)], "user_id string, business_id string, stars double")
    asked = test_pairs.unionByName(spark.createDataFrame([(None, "b4"), ("new", "b9")], "user_id string, business_id string"))
    model = BiasModel(n_epochs=2).fit(train)
    kept = sampling.drop_seen_candidates(sampling.draw_negatives(asked, items, 20), train)
    plain, bringing = sampling.test_candidates(kept, asked), sampling.test_candidates(kept, asked, model.terms())
    assert {"b_u", "b_i"} <= set(bringing.columns)
    lists = [sorted(map(tuple, model.recommend(part, 5, digits=6).collect()), key=str) for part in (plain, bringing)]
    assert lists[0] == lists[1] and len(lists[0]) > 10
    draws = kept.with_terms(*model.terms())
    whole = sorted(map(tuple, draws.rows().collect()), key=str)
    drawn_rows = sampling.from_lists(draws.pairs, draws.numbered, 20, 10**6, user_terms=["b_u"], item_terms=["b_i"])
    scored = model.transform(drawn_rows.drop("business_id").withColumnRenamed("candidate_id", "business_id"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode")]
    monkeypatch.setattr(sampling, "LISTED", 0)
    assert sorted(map(tuple, draws.rows().collect()), key=str) == whole
