"""Document fingerprints: digests of improbable features.

Every 64-byte window of a text has an entropy.  How often each entropy (in
thousandths of its range) occurs over the whole corpus gives its rank, rarest
first.  In each run of 64 windows the leftmost one of lowest rank gets a point;
windows with at least ``POINTS`` points are the text's features.  Each feature
sets 5 bits of a Bloom filter of 2,048 bits; after 160 features the next filter
of the chain begins.  A fingerprint is the chain, 512 hexadecimal digits each.

Two fingerprints are compared filter by filter: the bits in common, less those
expected by chance, as a share of the most that is possible.  Each filter of
the shorter chain takes its best partner; the likeness is their mean.

Texts of under 64 bytes are one feature, shorter than two runs have their
rarest window.  Null or empty text: no feature, an empty fingerprint; two empty
ones are alike (1.0), an empty one is unlike any other (0.0).  Equal texts have
equal fingerprints.  An empty table gives an empty result; repeated rows follow
one another (ties of doc_id by text, null doc_id last) as documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tasteforge.llm.common import few_rows, mixed, tasks

WINDOW = 64
RUN = 64
POINTS = 16
BUCKETS = 1000
LEAST = 100
BITS = 2048
PER_FEATURE = 5
PER_FILTER = 160
CHUNK = 400_000
# n log2 n in 2^-20 parts, so that sums are exact.
_PART = 1 << 20
NLOGN = np.array([0] + [round(n * np.log2(n) * _PART) for n in range(1, WINDOW + 1)], np.int64)
STEP = np.diff(NLOGN)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of each window, 0..BUCKETS, all windows of ``data`` in turn.

    Moving on by a byte changes the sum of n log n by what the leaving and the
    entering byte's counts change; those counts come from comparing the data
    with itself at each distance below a window.
    """
    n = len(data)
    leaving, entering = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for k in range(1, WINDOW):
        same = (data[k:] == data[:-k]).view(np.uint8)
        leaving[:-k] += same
        entering[k:] += same
    moves = STEP[entering[WINDOW:]] - STEP[leaving[: n - WINDOW]]
    first = NLOGN[np.bincount(data[:WINDOW], minlength=256)].sum()
    total = first + np.concatenate([[0], np.cumsum(moves)])
    return (BUCKETS - total * BUCKETS // NLOGN[WINDOW]).astype(np.int16)


class Texts:
    """Texts laid end to end, each of at least a window."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.entropy = entropies(self.data)
        owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.owner = owner[: len(self.entropy)]
        self.inside = self.owner == owner[WINDOW - 1 :]


def chunks(texts: list[bytes], least: int = WINDOW) -> Iterator[list[int]]:
    """Numbers of the texts of at least ``least`` bytes, in parts of about CHUNK bytes."""
    part, size = [], 0
    for k, text in enumerate(texts):
        if len(text) >= least:
            part.append(k)
            size += len(text)
            if size >= CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each entropy: BUCKETS + 1 numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            for part in chunks(texts):
                laid = Texts([texts[k] for k in part])
                total += np.bincount(laid.entropy[laid.inside], minlength=BUCKETS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1, dtype=np.int32)), pa.array(total)], names=["entropy", "n"])

    counted = docs.select(F.col("text").cast("binary").alias("text")).transform(few_rows).mapInArrow(run, "entropy int, n long")
    out = np.zeros(BUCKETS + 1, np.int64)
    for row in counted.groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        out[row["entropy"]] = row["n"]
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank by rarity, rarest first; almost uniform windows come last."""
    order = np.lexsort((np.arange(len(counts)), counts, np.arange(len(counts)) < LEAST))
    out = np.empty(len(counts), np.int64)
    out[order] = np.arange(len(counts))
    return out


def features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of each feature, by text, then place; texts of at least a window."""
    laid = Texts(texts)
    n, last = len(laid.entropy), np.int64(BUCKETS + 1)
    key = np.where(laid.inside, rank[laid.entropy], last) * np.int64(n + 1) + np.arange(n)
    best = key
    for step in (1, 2, 4, 8, 16, 32):
        best = np.minimum(best[:-step], best[step:]) if len(best) > step else best[:0]
    run_inside = laid.inside[: len(best)] & laid.inside[RUN - 1 :] & (laid.owner[: len(best)] == laid.owner[RUN - 1 :]) if len(best) else np.zeros(0, bool)
    points = np.bincount((best[run_inside] % (n + 1)).astype(np.int64), minlength=n)
    chosen = np.flatnonzero(points >= POINTS)
    bare = np.setdiff1d(np.arange(len(texts)), laid.owner[chosen])
    extra = [begin + int(np.argmin(key[begin : begin + size - WINDOW + 1])) for begin, size in zip(laid.begins[bare], laid.sizes[bare], strict=True)]
    chosen = np.sort(np.concatenate([chosen, np.array(extra, np.int64)]).astype(np.int64))
    words = np.lib.stride_tricks.sliding_window_view(laid.data, WINDOW)[chosen].view(np.uint64)
    hashes = np.zeros(len(chosen), np.uint64)
    for k in range(words.shape[1]):
        hashes = mixed(hashes ^ words[:, k])
    return laid.owner[chosen], hashes


def fingerprints(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The chain of filters of each text: an array of bytes, 256 for each filter."""
    out = [np.zeros((0, BITS // 8), np.uint8)] * len(texts)
    for part in chunks(texts):
        owner, hashes = features([texts[k] for k in part], rank)
        begin = np.searchsorted(owner, np.arange(len(part)))
        place = np.arange(len(owner)) - begin[owner]
        sizes = np.bincount(owner, minlength=len(part))
        filters = -(-sizes // PER_FILTER)
        first = np.concatenate([[0], np.cumsum(filters)])
        bits = np.zeros((first[-1], BITS), bool)
        row = first[owner] + place // PER_FILTER
        for j in range(PER_FEATURE):
            bits[row, ((hashes >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1)
        for k, number in enumerate(part):
            out[number] = packed[first[k] : first[k + 1]]
    for k, text in enumerate(texts):
        if 0 < len(text) < WINDOW:
            digest = np.frombuffer(hashlib.sha256(text).digest(), np.uint16)[:PER_FEATURE] % BITS
            bits = np.zeros((1, BITS), bool)
            bits[0, digest] = True
            out[k] = np.packbits(bits, axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    size_a, size_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (a, b))
    best = []
    for row, size in zip(a, size_a, strict=True):
        common = np.bitwise_count(row & b).sum(axis=1, dtype=np.int64)
        chance, most = size * size_b / BITS, np.minimum(size, size_b)
        best.append(np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return float(np.mean(best))


def bucket_of(column: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the value, by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    known = F.lit(bounds).cast("array<long>")
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(known, low + step - 1) <= F.col(column), F.lit(False)), low + step).otherwise(low))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, bucket, halo), laid out so that the next document follows.

    Documents are dealt to buckets by ranges of doc_id and sorted downwards in
    each; a bucket ends with a halo row, the document that comes after its own
    last one.  One halo row per bucket is found by its id; the driver handles
    one id per bucket.
    """
    parts = parts or tasks(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = chosen.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(c) for c in cuts})
    dealt = chosen.withColumn("bucket", bucket_of("doc_id", bounds))
    heads = sorted((r["bucket"], r["head"]) for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return dealt.withColumn("halo", F.lit(False))
    # Downwards, a bucket is followed by the next lower one, and the lowest by the highest.
    follows = [(heads[k - 1][0], heads[k - 1][1], heads[k][0]) for k in range(len(heads))]
    table = docs.sparkSession.createDataFrame(follows, "_bucket int, _head long, _target int")
    found = dealt.join(F.broadcast(table), (F.col("bucket") == F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("_head")))
    halo = found.groupBy("_target", "doc_id").agg(F.min(F.struct("text")).alias("t")).select("doc_id", F.col("t.text").alias("text"), F.col("_target").alias("bucket"), F.lit(True).alias("halo"))
    both = dealt.withColumn("halo", F.lit(False)).unionByName(halo)
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", F.desc_nulls_last("doc_id"), "text")


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def compare_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each text against its edited text and its next document's text.

    The edited text has its last half (floor) replaced by the first as many
    code points of the next document, downwards by doc_id, the first after the
    last.  Texts are moved once; each is read from its neighbour in the sort.
    """
    rank = ranks(entropy_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def rows(texts: list[str], ids: list, rank: np.ndarray) -> pa.RecordBatch:
        """Rows for all texts but the last, which is only a neighbour."""
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + n[:h] for t, n, h in zip(texts, texts[1:], halves, strict=False)]
        plain = [t.encode() for t in texts]
        changed = [t.encode() for t in edited]
        own, other = fingerprints(plain, rank), fingerprints(changed, rank)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                pa.array([f.tobytes().hex() for f in own[:-1]], pa.string()),
                pa.array([f.tobytes().hex() for f in other], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        texts: list[str] = []
        ids: list = []
        size = 0
        for batch in batches:
            for doc_id, text, halo in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                texts.append(text or "")
                ids.append(doc_id)
                size += len(texts[-1])
                if len(texts) > 1 and (halo or size > 4 * CHUNK):
                    yield rows(texts, ids, rank)
                    texts, ids = ([], []) if halo else (texts[-1:], ids[-1:])
                    size = sum(map(len, texts))

    return with_next(docs, parts).select("doc_id", "text", "halo").transform(few_rows).mapInArrow(run, EDITED)
