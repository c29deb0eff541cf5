"""MinHash near-dedup with fast similarity sketching, banding and exact checks.

Sketch: in round i < COORDS every shingle is hashed to one of COORDS bins and
leaves its round and hash there; in round COORDS + j all shingles go to bin j.
A bin keeps the least entry, and the rounds of a text end when all its bins are
filled, as they must be after twice COORDS rounds.  Two sketches agree in each
coordinate with a probability equal to the similarity, and the agreeing share is
concentrated at least as well as with independent hashes.

Banding: ``BANDS`` bands of ``ROWS`` coordinates; a pair of similarity 0.85
misses all of them with probability 2.3e-7.

Exact checks, on full sets of shingles:

1. Texts with one set are a class; its first document stands for it.  Classes are
   numbered in the order of those, so the smallest number of a component leads
   to its smallest doc_id.
2. Each member of a bucket is compared with the bucket's smallest member.
3. A bucket whose members do not end up in one component is searched on: its
   members outside its largest component are compared with all its members, in
   blocks.  Parity bitmaps, which never show more differences than there are,
   spare most comparisons and lose none.

So no bucket is emitted as pairs, however large, pairs already connected are not
compared, and no member is left out.  Components follow from the links.

Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``.  Fewer words than a
shingle has make one shingle; null or blank text has none and is linked with
nothing.  A document is a doc_id with its text: rows that repeat both are one
document, and each text of a repeated doc_id is judged by itself.  Rows without
doc_id come after all others and come back each; of a component without any
doc_id the first text is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tasteforge.llm.common import ASCII_LOWER, WordCodes, few_rows, mixed, window_hashes
from tasteforge.llm.components import components
from tasteforge.operators.codes import number_rows
from tasteforge.sources.shared import stage

BANDS, ROWS = 48, 8
COORDS = BANDS * ROWS
SHINGLE = 3
THRESHOLD = 85
QUERY_BLOCK, MEMBER_BLOCK = 256, 1024
PARITY_BITS = 4096
UNFILLED = np.uint64(2**64 - 1)


def shingle_set(text: bytes, codes: WordCodes, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(codes.of(words), min(width, len(words))) ^ np.uint64(min(width, len(words))))


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """One row of ``coords`` numbers per set; an empty set's row stays unfilled."""
    n = len(sets)
    out = np.full(n * coords, UNFILLED, np.uint64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * coords):
        if not len(items):
            break
        h = mixed(items, i)
        low = h & np.uint64(0xFFFFFFFF)
        place = (((h >> np.uint64(32)) * np.uint64(coords)) >> np.uint64(32)).astype(np.int64) if i < coords else np.full(len(h), i - coords)
        np.minimum.at(out, owner * coords + place, (np.uint64(i) << np.uint64(32)) | low)
        open_rows = (out.reshape(n, coords) == UNFILLED).any(axis=1)
        keep = open_rows[owner]
        items, owner = items[keep], owner[keep]
    return out.reshape(n, coords)


def band_hashes(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = sketch.reshape(len(sketch), bands, -1)
    total = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2])
    for k in range(rows.shape[2]):
        total = mixed(total ^ rows[:, :, k])
    return total


def sketch_documents(docs: DataFrame, width: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_key, bands) of each row; no set_key and bands without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sets = [shingle_set(t or b"", codes, width) for t in part["text"].to_pylist()]
                hashes = band_hashes(sketches(sets, bands * rows), bands).astype(np.int64)
                lists = pa.array([b if len(s) else None for s, b in zip(sets, hashes, strict=True)], pa.list_(pa.int64()))
                keys = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                names = ["doc_id", "text_key", "n_shingles", "set_key", "bands"]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], sizes, keys, lists], names=names)

    result = "doc_id long, text_key binary, n_shingles long, set_key binary, bands array<long>"
    return as_bytes(docs).transform(few_rows).mapInArrow(run, result)


def text_key(text: str | Column) -> Column:
    """128 bits that stand for a text; null and empty text have the same."""
    column = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(column.cast("binary"), F.lit(b""))))


def as_bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), text_key("text").alias("text_key"))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(node, shingles) of the documents in ``wanted`` (columns rep_id, rep_text, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            sets = [shingle_set(t or b"", codes, width).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.binary())], names=["node", "shingles"])

    named = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_text"))
    found = as_bytes(docs).join(wanted.select("rep_id", "rep_text", "node"), named).select("node", "text")
    return found.transform(few_rows).mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Sets are read where they lie in the batch, without a copy.
            pairs_of_sets = zip(batch["one"], batch["other"], strict=True)
            keep = pa.array([similar(*(np.frombuffer(s.as_buffer(), np.uint64) for s in pair), threshold) for pair in pairs_of_sets], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("other"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "one", "other").transform(few_rows).mapInArrow(run, "a long, b long")


def parity(shingles: np.ndarray) -> np.ndarray:
    """Bit k is set when an odd number of shingles falls on k: two sets differ in at least as many as their bitmaps."""
    odd = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def block_links(left: pa.Table, right: pa.Table, threshold: int = THRESHOLD) -> pa.Table:
    """Links between the queries ``left`` and the members ``right`` of other components.

    One link is enough to join two components, so those that a link of this
    block has joined are not compared again.
    """
    found: list[tuple[int, int]] = []
    ids, labels = right["node"].to_pylist(), right["component"].to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in right["shingles"].to_pylist()]
    maps = np.array([parity(s) for s in sets]) if sets else np.zeros((0, PARITY_BITS // 64), np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for own, label, packed in zip(left["node"].to_pylist(), left["component"].to_pylist(), left["shingles"].to_pylist(), strict=True):
        query = np.frombuffer(packed, np.uint64)
        differ = np.bitwise_count(maps ^ parity(query)).sum(axis=1, dtype=np.int64)
        # similarity >= t/100 means 100 differences <= (100 - t)/(100 + t) of both sizes together
        near = np.flatnonzero((100 + threshold) * differ <= (100 - threshold) * (sizes + len(query)))
        for k in near:
            x, y = root(label), root(labels[k])
            if x != y and similar(query, sets[k], threshold):
                parent[max(x, y)] = min(x, y)
                found.append((min(own, ids[k]), max(own, ids[k])))
    return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, node, component, is_query) of buckets of three or more with several components.

    A bucket of two was settled when its members were compared.
    """
    named = members.select("bucket", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = (
        counts.groupBy("bucket")
        .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1 and size > 2")
        .select("bucket", F.col("top.component").alias("main"), "size", (F.col("size") - F.col("top.n")).alias("queries"))
    )
    return named.join(largest, "bucket").withColumn("is_query", F.col("component") != F.col("main"))


def search_open(opened: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links found by comparing each open bucket's queries with all its members, block by block."""
    full = opened.join(sets, "node")
    query_blocks = F.ceil(F.col("queries") / QUERY_BLOCK).cast("int")
    member_blocks = F.ceil(F.col("size") / MEMBER_BLOCK).cast("int")
    own = lambda blocks, salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    # Aliases make the columns of the two sides distinct, as grouping the same table twice needs.
    kept = [F.col(c).alias(c) for c in ("node", "component", "shingles")]
    queries = full.filter("is_query").select(F.col("bucket").alias("bucket"), own(query_blocks, 1).alias("q"), every(member_blocks).alias("m"), *kept)
    members = full.select(F.col("bucket").alias("bucket"), own(member_blocks, 2).alias("m"), every(query_blocks).alias("q"), *kept)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_links(left, right, threshold)

    keys = ("bucket", "q", "m")
    return queries.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(compare, "a long, b long").distinct()


def judge(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, stays) of each row.

    Of each component one document, with all rows that repeat it, stays: that
    of smallest doc_id (null last), in ties of smallest ``text_key``.  A row
    without shingles stays.

    A pair of similarity s shares no band with probability (1 - s^rows)^bands:
    choose them so that this is negligible at the threshold (in hundredths).
    """
    known = stage(sketch_documents(docs, width, bands, rows), "sketches")
    # The sketch hangs on the set alone: any row's bands are those of its class.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("rep")
    classes = stage(known.filter("n_shingles > 0").groupBy("set_key").agg(first, F.first("bands").alias("bands")), "classes")
    order = ["no_id", "rep_id", "rep_text", "set_key"]
    heads = classes.select("rep.no_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_text"), "set_key")
    heads = stage(number_rows(heads, order, "node"), "class-numbers")
    buckets = classes.join(heads, "set_key").select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("center")).filter("n > 1").drop("n")
    members = stage(buckets.join(shared, "bucket"), "bucket-members")

    sets = stage(sets_of(docs, heads.join(members.select("node").distinct(), "node", "left_semi"), width), "shingle-sets")
    pairs = members.filter("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = stage(confirmed(pairs, sets, threshold), "links-to-centers")
    labels = stage(components(links, "a", "b"), "components")
    opened = stage(open_buckets(members, labels), "open-buckets")
    if not opened.isEmpty():
        more = stage(search_open(opened, sets, threshold), "further-links")
        if not more.isEmpty():
            labels = stage(components(links.unionByName(more), "a", "b"), "components")

    head = heads.select(F.col("node").alias("component"), F.col("rep_id").alias("component_id"), F.col("rep_text").alias("component_text"))
    placed = heads.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    placed = placed.join(head, "component").select("set_key", "component_id", "component_text")
    is_head = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_text"))
    alone = F.col("set_key").isNull()
    return (
        known.select("doc_id", "text_key", "n_shingles", "set_key")
        .join(placed, "set_key", "left")
        .select("doc_id", "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (alone | is_head).alias("stays"))
    )


def near_duplicates(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document, and per row without doc_id.

    ``kept`` is doc_id = component_id; without doc_id it tells whether the row's
    text stays (see ``judge``), so it is never null.
    """
    judged = judge(docs, width, threshold, bands, rows)
    found = judged.groupBy(*judged.columns).agg(F.count(F.lit(1)).alias("n"))
    copies = F.sequence(F.lit(1).cast("long"), F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(1))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("stays")).alias("kept")
    return found.withColumn("_copy", F.explode(copies)).select("doc_id", "n_shingles", "component_id", kept)


def without_copies(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` (any columns) without near copies: of each component one row, and all rows without shingles.

    Where rows repeat doc_id and text, one of them is left, whatever their other columns.
    """
    judged = judge(docs.select("doc_id", "text"), width, threshold, bands, rows).filter("n_shingles > 0")
    counted = judged.groupBy("doc_id", "text_key", "stays").agg(F.count(F.lit(1)).alias("n"))
    marks = stage(counted.filter("not stays or n > 1"), "marks")

    def of(mark: DataFrame, kind: str, rest: DataFrame) -> DataFrame:
        same = rest["doc_id"].cast("long").eqNullSafe(mark["doc_id"]) & (text_key(rest["text"]) == mark["text_key"])
        return rest.join(mark, same, kind)

    left = of(marks.filter("not stays"), "left_anti", docs)
    repeated = marks.filter("stays")
    if repeated.isEmpty():
        return left
    return of(repeated, "left_anti", left).unionByName(of(repeated, "left_semi", left).dropDuplicates(["doc_id", "text"]))
