"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

1. language ID: documents in which no language is found go; where no row is labelled nothing can be learned and all stay;
2. near-dedup: of each group of near copies (five words, similarity 0.8) the one of smallest doc_id stays (null last);
   rows are told apart by doc_id and text, so no other text of a doc_id goes with it;
3. secret scan: every secret found in a text is replaced by a mark;
4. mixture: documents are repeated or cut to what their source's target takes, in the order of their training positions;
5. BPE: texts become ids, and ids the text that they stand for, still in that order.

All stages but the last return the columns of ``documents``.  Between stages 4
and 5 the order lies in the files: a row's ``position`` is made of the number
of its part file and its place in it, and the result is sorted by it again.
Documents that come from no Parquet files have no order to keep: their
position is null.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasteforge.llm import bpe, language_id, mixture, near_dedup, secret_scan
from tasteforge.llm.common import documents
from tasteforge.sources.shared import stage

Frame = DataFrame

# Each stage's decisions hang on sketches, fitted models and hashes that SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None

SHINGLE, SIMILARITY = 5, 80
# A pair at the threshold shares no band with probability (1 - 0.8^6)^64 = 4e-9.
BANDS, ROWS = 64, 6


def identify_language(spark: SparkSession, docs: Frame, sf_dir: str) -> Frame:
    # Columns of the documents that are named like an output step aside meanwhile.
    if docs.filter(~language_id.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).isEmpty():
        return docs
    given = {c: f"_given_{c}" for c in docs.columns if c in language_id.OUTPUTS}
    found = language_id.identify(docs.withColumnsRenamed(given)).filter(F.col("lang_pred") != language_id.UNDETERMINED)
    return found.select(*[F.col(given.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: Frame, sf_dir: str) -> Frame:
    return near_dedup.without_copies(docs, SHINGLE, SIMILARITY, BANDS, ROWS)


def redact_secrets(spark: SparkSession, docs: Frame, sf_dir: str) -> Frame:
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: Frame, sf_dir: str) -> Frame:
    return mixture.order_by_position(docs, mixture.mix(docs))


# Bits of a position: the part file, the file of that part, the row of that file.
PART_BITS, FILE_BITS = 40, 32


def file_position() -> Column:
    """Rises with the order in which a sorted table was written."""
    number = lambda pattern: F.coalesce(F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long"), F.lit(0))
    return F.shiftleft(number(r"^part-(\d+)"), PART_BITS) + F.shiftleft(number(r"-c(\d+)\."), FILE_BITS) + F.col("_metadata.row_index")


def tokenize(spark: SparkSession, docs: Frame, sf_dir: str) -> Frame:
    try:
        placed = docs.select(file_position().alias("position"), "doc_id", "text")
        placed.schema
    except AnalysisException:
        return bpe.decode(bpe.encode(docs.select("doc_id", "text"))).withColumn("position", F.lit(None).cast("long"))
    # Encoded by position, which no two rows share, so passes of one document are told apart and spread.
    # The ids pass two shuffles, so they go as packed 16-bit numbers.
    encoded = bpe.narrow(bpe.encode(placed.select(F.col("position").alias("doc_id"), "text"))).withColumnRenamed("doc_id", "position")
    named = placed.select("position", "doc_id").join(encoded, "position").select("doc_id", "position", "n", "packed")
    return bpe.decode(bpe.widen(named.repartitionByRange("position").sortWithinPartitions("position")))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixture", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> Frame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
