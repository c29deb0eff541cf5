"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1]: a line that
starts at ``1 + tilt`` times its weight and ends at ``1 - tilt`` times it, so
its integral is the weight.  The integral up to t, times the source's target,
is the source's demand: how many of its words have been taken by then.
Documents of a source are laid end to end in hashed order, again and again for
as many passes as the demand lasts; the demand is inverted at the middle of
each document's stretch, and that t is the document's training position.
``order_by_position`` sorts the mix by it across partitions.

Targets: sources share the words of the corpus by weight; a source stops at
``max_passes`` times its size, and what it leaves is shared again by weight
until none is above.  The limit is found by repeated sums over the table of
sources, so no task and no driver sees them all.

The last document of the last pass is taken in part, so a source's taken words
are its target rounded to a whole word; no document is taken more than
``max_passes`` times its size.  Places are hashes of doc_id: reruns agree.

Null or blank text: size 0, nothing taken.  Null source: a source of its own,
after all others.  Rows repeated with one doc_id count each; their places are
next to each other.  An empty table gives an empty result.  Further columns
stay in ``order_by_position``; ``mix`` returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tasteforge.functions.hashing import uniform
from tasteforge.llm.common import word_count
from tasteforge.operators.codes import dense_codes
from tasteforge.operators.skew import positions
from tasteforge.sources.shared import stage

WEIGHTS = (5.0, 2.0, 1.0)
TILTS = (0.5, 0.0, -0.5)
MAX_PASSES = 3
# A source of more rows is numbered in slices.
ROWS_PER_SLICE = 1000
OUTPUTS = ("size", "source_size", "target", "taken", "passes")


def source_key(column: str = "source") -> Column:
    """A text that is never null and sorts sources by code point, null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, tilts: Sequence[float] = TILTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """From (key, size): key, source_size, weight, tilt, target; one row per source."""
    summed = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    summed = stage(summed, "source-sizes")
    place = dense_codes(summed, "key", "place")
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod("place", F.lit(len(values))) + 1).cast("int"))
    sources = stage(summed.join(place, "key").select("key", "source_size", pick(weights).alias("weight"), pick(tilts).alias("tilt")), "sources")
    limit = F.col("source_size") * float(max_passes)
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    share, known = 0.0, -1
    while True:
        # Stopped sources only grow in number, so this ends; each turn is a sum over the sources.
        stopped = F.lit(False) if known < 0 else limit < F.col("weight") * share
        row = sources.agg(
            F.sum(stopped.cast("long")).alias("n"),
            F.sum(F.when(stopped, limit).otherwise(0.0)).alias("held"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if row["n"] is None or row["n"] == known or not row["weight"]:
            break
        known, share = row["n"], (total - row["held"]) / row["weight"]
    return sources.withColumn("target", F.least(limit, F.col("weight") * share))


def row_key() -> Column:
    """Tells rows of one doc_id apart; rows that still agree are copies and may stand for each other."""
    return F.xxhash64("text", "source")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    tilts: Sequence[float] = TILTS,
    max_passes: int = MAX_PASSES,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, row_key, size, source_size, target, taken, passes): one row per row of ``docs``.

    ``passes`` is an array of (pass, taken, position), one for each pass that
    takes words of the document.  Text itself is only read for its size.
    """
    sizes = docs.select("doc_id", row_key().alias("row_key"), source_key().alias("key"), word_count("text").alias("size"))
    sizes = stage(sizes.withColumn("unit", uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), "document-sizes")
    targets = source_targets(sizes, weights, tilts, max_passes)
    laid = positions(sizes, ["key"], "unit", order=["doc_id", "row_key"], weight="size", rows_per_slice=ROWS_PER_SLICE).join(targets, "key")
    wanted = F.round("target").cast("long")
    takes = []
    for p in range(max_passes + 1):
        before = F.col("_before") + F.col("source_size") * p
        take = F.greatest(F.lit(0), F.least(F.col("size"), wanted - before)).cast("long")
        share = F.least(F.lit(1.0), (before + take / 2) / wanted)
        takes.append(F.when(take > 0, F.struct(F.lit(p).alias("pass"), take.alias("taken"), demand_time(share, F.col("tilt")).alias("position"))))
    passes = F.array_compact(F.array(*takes))
    return laid.select("doc_id", "row_key", "size", "source_size", "target", passes.alias("passes")).select(
        "doc_id",
        "row_key",
        "size",
        "source_size",
        "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x["taken"]).alias("taken"),
        "passes",
    )


def demand_time(share: Column, tilt: Column) -> Column:
    """The t at which the share of a source's demand is reached.

    The schedule 1 + tilt - 2 tilt t has the integral (1 + tilt) t - tilt t^2.
    """
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + tilt) * (1 + tilt) - 4 * tilt * share))
    return F.when(F.abs(tilt) < 1e-9, share).otherwise(((1 + tilt) - root) / (2 * tilt))


def order_by_position(docs: DataFrame, mixed: DataFrame, parts: int | None = None, plan: Sequence[str] = ()) -> DataFrame:
    """The mix itself: a row of ``docs`` for each pass, cut to the words taken, sorted by position.

    Columns of ``docs`` are kept.  Rows of one doc_id, or of a null one, are
    told apart by their text and source, and copies of a row by number, so each
    row gets its own passes.  Where all ids differ, the ids alone are joined.

    With ``plan``, names of columns of ``mixed``, these are kept too, with the
    row's ``pass``, ``pass_taken`` and ``position``; rows of which nothing is
    taken then come after all others, once, with nulls for these and the text.
    """
    plan_columns = [F.col(c).alias(f"_plan_{c}") for c in plan]
    given_plan = mixed.select(
        F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.col("size").alias("_size"), F.col("passes").alias("_passes"), *plan_columns
    )
    repeated = stage(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "repeated-ids")
    if repeated.isEmpty():
        given, same = docs, docs["doc_id"].eqNullSafe(given_plan["_id"])
    else:
        one = lambda doc_id, key: Window.partitionBy(doc_id, key).orderBy(key)
        given = docs.withColumn("_row", row_key()).withColumn("_copy", F.row_number().over(one("doc_id", "_row")))
        given_plan = given_plan.withColumn("_nth", F.row_number().over(one("_id", "_key")))
        same = given["doc_id"].eqNullSafe(given_plan["_id"]) & (given["_row"] == given_plan["_key"]) & (given["_copy"] == given_plan["_nth"])
    kept = [*docs.columns, "_size", *[f"_plan_{c}" for c in plan]]
    each = given.join(given_plan, same).select(*kept, (F.explode_outer if plan else F.explode)("_passes").alias("_p"))
    joined = each.select(*kept, *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("pass", "taken", "position")])
    # Cut behind each word, so that every part but a blank last one ends with a word.
    parted = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first_words = F.array_join(F.slice(parted, 1, F.col("_taken").cast("int")), "")
    cut = F.when(F.col("_taken") < F.col("_size"), first_words).when(F.col("_taken").isNotNull(), F.col("text"))
    more = [*[F.col(f"_plan_{c}").alias(c) for c in plan], F.col("_pass").alias("pass"), F.col("_taken").alias("pass_taken"), F.col("_position").alias("position")]
    chosen = joined.select(*[cut.alias("text") if c == "text" else c for c in docs.columns], *(more if plan else []), "_position")
    by = [F.asc_nulls_last("_position"), F.asc("doc_id")]
    spread = chosen.repartitionByRange(parts, *by) if parts else chosen.repartitionByRange(*by)
    return spread.sortWithinPartitions(*by).drop("_position")
