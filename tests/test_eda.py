"""Mergeable distinct counts against exact ones."""

import pytest

from tasteforge.operators import eda
from tasteforge.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def rows_by(df, keys):
    return {tuple(r[k] for k in keys): (r.n_items, r.n_users, r.n_pairs) for r in df.collect()}


def test_sketches_are_near_the_exact_counts(spark):
    got = QUERIES["distinct_sketched"](spark, SF_DIR).cache()
    exact = {
        ("state", "top_category"): QUERIES["distinct_by_state_category"](spark, SF_DIR),
        ("state",): QUERIES["distinct_by_state"](spark, SF_DIR),
    }
    for keys, df in exact.items():
        level = got.filter("state is not null")
        level = level.filter("top_category is not null" if len(keys) == 2 else "top_category is null")
        want, found = rows_by(df, keys), rows_by(level, keys)
        assert set(want) == set(found)
        errors = [abs(a - b) / b for key in want for a, b in zip(found[key], want[key])]
        # Three standard errors of 1.6 %; small counts are exact.
        assert max(errors) < 0.05 and sum(errors) / len(errors) < 0.016
    histogram = {r.top_category: r.n_pairs for r in QUERIES["category_histogram"](spark, SF_DIR).collect()}
    found = {r.top_category: r.n_pairs for r in got.filter("state is null").collect()}
    assert set(found) == set(histogram)
    assert all(found[c] == pytest.approx(histogram[c], rel=0.05) for c in found)


def test_merged_sketches_are_those_of_the_whole(spark):
    rows = [(f"u{n % 7}", f"b{n % 50}", "S" if n % 50 % 2 else "T", "c" if n % 50 % 3 else "d") for n in range(400)]
    reviews = spark.createDataFrame(rows + rows[:100], "user_id string, business_id string, state string, top_category string")
    fine = eda.distinct_sketches(reviews, ["state", "top_category"])
    merged = rows_by(eda.sketched_counts(eda.merge_sketches(fine, ["state"])), ["state"])
    assert merged == rows_by(eda.sketched_counts(eda.distinct_sketches(reviews, ["state"])), ["state"])
    assert merged == rows_by(eda.distinct_by(eda.distinct_pairs(reviews), ["state"]), ["state"])
    assert eda.sketched_counts(eda.distinct_sketches(reviews.limit(0), ["state"])).collect() == []


def test_standardise_knows_number_columns_by_type(spark):
    from tasteforge.operators.features import number_columns, standardise, vectorise

    info = spark.createDataFrame([("a", 1.0, "x"), ("b", 3.0, "y")], "user_id string, `rate=5` double, kind string")
    scaled = standardise(vectorise(info, "user_id"), "user_id", number_columns(info, "user_id"))
    got = {(r.user_id, r.feature): r.value for r in scaled.collect()}
    assert got[("a", "rate=5")] == -got[("b", "rate=5")] == pytest.approx(-(0.5**0.5))
    assert got[("a", "kind=x")] == got[("b", "kind=y")] == 1.0
