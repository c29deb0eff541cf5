"""Quality rules as a short-circuit cascade.

Each rule is a boolean expression that is true for a text to be rejected.  On
a bounded sample (the ``sample_rows`` documents of lowest hashed doc_id) each
rule is timed and its rejections counted; rules then run in the order of
rejection per cost, and a text that one rule rejects is not shown to the next.
The order changes the cost only: a text is kept when no rule rejects it.  Only
built-in Spark functions are used, and every text is judged within its row:
there is no shuffle but that of the sample.

Measures, over words ``[^\\x20\\x09-\\x0D]+`` of the whole text: ``n_words``,
``word_chars`` (code points in words), ``n_symbols`` (characters of
``#*$%&|<>``), ``n_dup_lines`` (lines with a word, equal to an earlier line),
``n_repeat_words`` (words inside 8-word windows found twice or more).

Null or blank text: every measure 0, so the base rule rejects it.  An empty
table gives an empty result; repeated rows are judged alike; columns named
like an output are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tasteforge.llm.common import SPACES, words_column
from tasteforge.sources.shared import stage

SYMBOLS = "#*$%&|<>"
REPEAT_WIDTH = 8
SAMPLE_ROWS = 2000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` reads ``text`` and the measures."""

    name: str
    rejects: Callable[[], Column]


def _share(pattern: str) -> Column:
    """Part of the word characters that match."""
    return F.regexp_count("text", F.lit(pattern)) / F.greatest(F.col("word_chars"), F.lit(1))


RULES = (
    Rule("mean word length outside 2..20", lambda: ~(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))).between(2, 20)),
    Rule("more than one symbol in ten characters", lambda: 10 * F.col("n_symbols") > F.col("word_chars")),
    Rule("more than half of the lines repeated", lambda: 2 * F.col("n_dup_lines") > F.size(F.split("text", "\n"))),
    Rule("fewer than six letters in ten characters", lambda: _share(r"\p{L}") < 0.6),
    Rule("more than three digits in ten characters", lambda: _share(r"\d") > 0.3),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = REPEAT_WIDTH) -> Column:
    """Number of words covered by windows that occur at least twice.

    Hashed windows are sorted with their places, so equal ones stand side by
    side; the covered words follow from the sorted places of those.  n log n,
    also for a text that repeats throughout.
    """

    def spans(places: Column) -> Column:
        # Each window adds what the one after it does not cover again.
        step = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(1))), places, lambda b, a: F.when(b.isNull(), F.lit(width)).otherwise(F.least(b - a, F.lit(width))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def covered(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda x, i: (F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False))),
        )
        return let(F.sort_array(F.transform(same, lambda x: x["p"])), spans)

    def of_windows(w: Column) -> Column:
        # Most texts repeat nothing, which the number of distinct windows tells without a sort.
        pairs = F.transform(w, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.sort_array(pairs), covered))

    def of_hashes(h: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda p: F.xxhash64(F.slice(h, p, width))), of_windows)

    return F.when(F.size(words) > width, let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).otherwise(F.lit(0)).cast("long")


def with_measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in docs.columns if c not in (*MEASURES, "base_failed", "kept", "_words")]
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    base = docs.select(*kept, words_column("text").alias("_words"))
    return base.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sampled(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents of the ``sample_rows`` lowest hashed doc_ids.

    Ids are sorted without their texts; the texts follow by a join with so many ids.
    """
    ids = docs.select("doc_id").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows)
    return docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost on the sample: (rule, rejected share, seconds), best first."""
    sample = stage(with_measures(sampled(docs, sample_rows)), "rule-sample")
    n = sample.count()
    found = []
    for rule in rules:
        begun = time.perf_counter()
        hits = sample.agg(F.sum(F.coalesce(rule.rejects(), F.lit(False)).cast("long"))).first()[0] or 0
        found.append((rule, hits / max(n, 1), time.perf_counter() - begun))
    return sorted(found, key=lambda x: -x[1] / max(x[2], 1e-9))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the measures, base_failed, kept and rejected_by (name of the rule, or "base")."""
    measured = with_measures(docs.drop("rejected_by"))
    order = ordered_rules(docs.select("doc_id", "text"), rules, sample_rows)
    verdict = F.lit(None).cast("string")
    for rule, _, _ in reversed(order):
        verdict = F.when(rule.rejects(), F.lit(rule.name)).otherwise(verdict)
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict)
    judged = measured.withColumn("base_failed", base_failed()).withColumn("rejected_by", verdict)
    return judged.withColumn("kept", F.col("rejected_by").isNull())
