"""Hot keys: sliced joins and numbering give the rows of the plain ones."""

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tasteforge.functions.hashing import uniform
from tasteforge.operators.codes import dense_codes
from tasteforge.operators.lists import list_per_key
from tasteforge.operators.skew import SLICE, add_slice, hot_keys, join_chain, join_sliced, pin_hot_keys, positions


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on key k0, half of those copies of one row."""
    rows = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 'k0' else concat('k', cast(id % 50 as string)) end as k",
        "case when id % 6 = 0 then 7 else id end as v",
    )
    return rows.repartition(8)


def test_hot_keys_are_found(spark, skewed):
    found = {r.k: r._slices for r in hot_keys(skewed, ["k"], 200).collect()}
    assert set(found) == {"k0"}
    assert found["k0"] == 6
    assert pin_hot_keys(skewed, ["k"], 10_000).isEmpty()


def test_slices_spread_copies(skewed):
    cut = add_slice(skewed, ["k"], hot_keys(skewed, ["k"], 100))
    copies = cut.filter("k = 'k0' and v = 7").groupBy(SLICE).count().collect()
    assert len(copies) > 1
    assert cut.filter("k <> 'k0'").select(SLICE).distinct().count() == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sliced_join_is_the_join(spark, skewed, how):
    right = spark.createDataFrame([("k0", 1), ("k1", 2), ("k2", 3), ("zz", 4)], "k string, w int")
    got = join_sliced(skewed, right, ["k"], how, rows_per_slice=50)
    want = skewed.join(right, ["k"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_chain_is_the_joins(spark, skewed):
    one = spark.createDataFrame([("k0", 1), ("k1", 2)], "k string, a int")
    two = spark.createDataFrame([(7, "x"), (10, "y")], "v bigint, b string")
    got = join_chain(skewed, [(one, ["k"], "left"), (two, ["v"], "left")], 40).select("k", "v", "a", "b")
    want = skewed.join(one, ["k"], "left").join(two, ["v"], "left").select("k", "v", "a", "b")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


@pytest.mark.parametrize("rows_per_slice", [20, 10**6])
def test_positions_count_what_is_before(skewed, rows_per_slice):
    rows = skewed.distinct().withColumn("u", uniform(1, "v"))
    window = Window.partitionBy("k")
    want = rows.select(
        "k", "v", (F.row_number().over(window.orderBy("u", "v")) - 1).cast("long").alias("_before"), F.count("v").over(window).alias("_total")
    )
    got = positions(rows, ["k"], "u", ["v"], rows_per_slice=rows_per_slice).select("k", "v", "_before", "_total")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_dense_codes_follow_the_order_of_the_keys(spark):
    df = spark.range(1000).selectExpr("concat('n', cast(id * 7919 % 1000 as string)) as k").union(
        spark.createDataFrame([(None,), ("n5",)], "k string")
    )
    got = sorted((r.k, r.c) for r in dense_codes(df, "k", "c").collect())
    assert got == [(k, n) for n, k in enumerate(sorted({f"n{i}" for i in range(1000)}))]


def test_long_lists_come_in_parts(skewed):
    lists = list_per_key(skewed, ["k"], "v", "vs", max_length=100)
    parts = lists.filter("k = 'k0'").toPandas()
    assert len(parts) > 1
    assert sorted(pd.Series(sum((list(v) for v in parts.vs), []))) == sorted(
        r.v for r in skewed.filter("k = 'k0'").collect()
    )
    assert lists.filter("k <> 'k0'").groupBy("k").count().filter("count > 1").isEmpty()


def test_every_heavy_key_is_sliced(spark):
    """Ten thousand heavy keys of equal weight: no limit leaves one out."""
    rows = spark.range(200_000).selectExpr("concat('k', cast(id % 10000 as string)) as k", "id as v")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        hot = hot_keys(rows, ["k"], 7)
        assert hot.count() == 10_000 and hot.filter("_slices < 2").isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
