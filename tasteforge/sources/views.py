"""The driver's tables seen as reviews, items, users, categories and a log.

``SQL`` holds the same views as text for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review per line item, with a text column that no step needs."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
        "concat('b', cast(l_partkey as string)) as business_id",
        "cast(l_suppkey % 5 as bigint) as cool",
        "o_orderdate as date",
        "cast(l_linenumber % 3 as bigint) as funny",
        "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string)) as review_id",
        "cast(cast(l_quantity as int) % 5 + 1 as double) as stars",
        "o_orderpriority as text",
        "cast(l_linenumber as bigint) as useful",
        "concat('u', cast(o_custkey as string)) as user_id",
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_reviews(spark, sf_dir).selectExpr("user_id", "business_id", "stars", "date as review_ts", "useful")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "concat('b', cast(p_partkey as string)) as business_id",
        "p_name as name",
        "concat(p_type, ', ', replace(p_name, ' ', ', ')) as categories",
        "p_brand as state",
        "concat('city', cast(p_size % 10 as string)) as city",
        "cast(p_size as bigint) as review_count",
        "cast(1 + (p_partkey % 9) * 0.5 as double) as stars",
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('u', cast(c_custkey as string)) as user_id",
        "c_name as name",
        "c_mktsegment as segment",
        "date_add(date '2005-01-01', cast(c_custkey % 5000 as int)) as member_since",
        "case when c_custkey % 7 = 0 then null when c_custkey % 3 = 0 then ''"
        " when c_custkey % 3 = 1 then '2012' else '2012,2013,2014' end as elite",
        "c_custkey % 5 as compliment_hot",
        "case when c_custkey % 4 = 0 then null else c_custkey % 3 end as compliment_cool",
        "cast(c_nationkey as bigint) as compliment_note",
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").selectExpr(
        "concat('n', cast(n_nationkey as string)) as alias",
        "n_name as title",
        "array(concat('r', cast(n_regionkey as string)), 'x0') as parent_aliases",
    )
    region = table(spark, sf_dir, "region").selectExpr(
        "concat('r', cast(r_regionkey as string)) as alias", "r_name as title", "cast(array() as array<string>) as parent_aliases"
    )
    lonely = spark.range(1).selectExpr("'x0' as alias", "'Lonely' as title", "cast(null as array<string>) as parent_aliases")
    return nation.unionByName(region).unionByName(lonely)


def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = table(spark, sf_dir, "part").filter("p_type <> 'SMALL'").selectExpr("p_type as category").distinct()
    return types.unionByName(spark.range(1).select(F.explode(F.array(F.lit("ring"), F.lit("plate"))).alias("category")))


def xlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = "cast(regexp_extract(props, '[0-9]+', 0) as int)"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as id",
        "case when event_id % 3 = 0 then 'ds_imp' else 'ds_exp' end as dataset",
        "event_type as model",
        f"concat('[(\\'k\\', ', cast({number} % 3 as string), '), (\\'reg\\', 0.',"
        f" cast(cast(floor({number} / 3) as int) % 2 + 1 as string), ')]') as hyper",
        "case event_id % 4 when 0 then 'ndcg@10' when 1 then 'ndcg@5' when 2 then 'rmse' else 'precision@10' end as metric",
        "value",
        "cast(user_id % 6 as int) - 1 as fold",
        "concat('/cache/', cast(event_id % 10 as string)) as path",
        "ts",
    )


SQL = {
    "raw_reviews": """
        select concat('b', cast(l_partkey as varchar)) as business_id, cast(l_suppkey % 5 as bigint) as cool,
               o_orderdate as date, cast(l_linenumber % 3 as bigint) as funny,
               concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as review_id,
               cast(cast(l_quantity as int) % 5 + 1 as double) as stars, o_orderpriority as text,
               cast(l_linenumber as bigint) as useful, concat('u', cast(o_custkey as varchar)) as user_id
        from orders join lineitem on l_orderkey = o_orderkey""",
    "ratings": """
        select concat('u', cast(o_custkey as varchar)) as user_id, concat('b', cast(l_partkey as varchar)) as business_id,
               cast(cast(l_quantity as int) % 5 + 1 as double) as stars, o_orderdate as review_ts,
               cast(l_linenumber as bigint) as useful
        from orders join lineitem on l_orderkey = o_orderkey""",
    "items": """
        select concat('b', cast(p_partkey as varchar)) as business_id, p_name as name,
               concat(p_type, ', ', replace(p_name, ' ', ', ')) as categories, p_brand as state,
               concat('city', cast(p_size % 10 as varchar)) as city, cast(p_size as bigint) as review_count,
               cast(1 + (p_partkey % 9) * 0.5 as double) as stars
        from part""",
    "users": """
        select concat('u', cast(c_custkey as varchar)) as user_id, c_name as name, c_mktsegment as segment,
               date '2005-01-01' + cast(c_custkey % 5000 as int) as member_since,
               case when c_custkey % 7 = 0 then cast(null as varchar) when c_custkey % 3 = 0 then ''
                    when c_custkey % 3 = 1 then '2012' else '2012,2013,2014' end as elite,
               c_custkey % 5 as compliment_hot,
               case when c_custkey % 4 = 0 then cast(null as bigint) else c_custkey % 3 end as compliment_cool,
               cast(c_nationkey as bigint) as compliment_note
        from customer""",
    "cats": """
        select concat('n', cast(n_nationkey as varchar)) as alias, n_name as title,
               concat('r', cast(n_regionkey as varchar)) as parent_alias from nation
        union all select concat('r', cast(r_regionkey as varchar)), r_name, cast(null as varchar) from region
        union all select 'x0', 'Lonely', cast(null as varchar)""",
    "top_categories": """
        select distinct p_type as category from part where p_type <> 'SMALL'
        union all select 'ring' union all select 'plate'""",
    "xlog": """
        select event_id as id, case when event_id % 3 = 0 then 'ds_imp' else 'ds_exp' end as dataset, event_type as model,
               concat('[(', chr(39), 'k', chr(39), ', ', cast(cast(regexp_extract(props, '[0-9]+', 0) as int) % 3 as varchar),
                      '), (', chr(39), 'reg', chr(39), ', 0.',
                      cast(cast(floor(cast(regexp_extract(props, '[0-9]+', 0) as int) / 3) as int) % 2 + 1 as varchar),
                      ')]') as hyper,
               case event_id % 4 when 0 then 'ndcg@10' when 1 then 'ndcg@5' when 2 then 'rmse' else 'precision@10' end as metric,
               value, cast(user_id % 6 as int) - 1 as fold, concat('/cache/', cast(event_id % 10 as varchar)) as path, ts
        from events""",
}
