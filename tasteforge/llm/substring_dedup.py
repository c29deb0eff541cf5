"""Substring dedup by suffix automata of reference shards.

A window is ``WIDTH`` consecutive words of one document.  A word goes when some
window over it also starts in a document with a smaller doc_id.

The reference of a corpus is the corpus itself, and to stream every document
past the automaton of every shard of it would cost the square of its size.  So
texts meet only the shards they can match:

1. Each window has an anchor: the least of its runs of ``ANCHOR`` words, by
   hash.  Equal windows have equal anchors.  An anchor in one document only
   marks windows that occur nowhere else; for the rest of the work its windows
   are left alone.
2. Windows that lie side by side and have one shared anchor make a passage.
   Passages go to the shard of their anchor; a block sends each distinct
   passage once, with its smallest doc_id.
3. A shard builds the suffix automaton of all passages of an anchor, streams
   the passages past it, and reads for each window the least document that has
   it.  Words are compared, not hashes.
4. The block covers the words of windows whose least document is smaller.

An anchor in more than ``HOT_DOCS`` documents may stand at the edge of a common
passage and have as many different passages; its windows then travel one by
one, each to its own shard, where all copies of a block are one entry.  So no
shard gathers what grows with a hot group, and every window is judged.

``remove_reference`` is the same removal against a given reference, in
broadcast automata of bounded shards.

Null or blank text: no words.  Texts shorter than a window stay whole.  Rows
repeated with one doc_id are one document and remove nothing from each other.
Rows with null doc_id come after all others, as one document.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tasteforge.llm.automaton import SuffixAutomaton
from tasteforge.llm.blocks import block_count, pack, unpacked
from tasteforge.llm.common import SPACES, few_rows, mixed, ranges, window_hashes

WIDTH = 13
ANCHOR = 5
HOT_DOCS = 10_000
BLOCK_BYTES = 8_000_000
SHARD_WORDS = 200_000
UNIQUE, SHARED, HOT = 0, 1, 2
# Rows without an id come after all others.
LAST = 2**63 - 1
CODED_AT_ONCE = 1 << 20
BASE = 0x9E3779B97F4A7C15
IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
STATES, FIRSTS = 0, 1
RIGHT = "block int, bucket int, kind int, entries array<long>"


class Block:
    """A block's documents as one sequence of words, with its passages.

    ``begin``, ``end`` (numbers of the first and last window), ``anchor`` (hash)
    and ``doc`` of each run of windows with one anchor, in order.
    """

    def __init__(self, table: pa.Table, width: int = WIDTH, keep_words: bool = True):
        # In an order of their own: a block is read more than once, and its batches may come in another order each time.
        rows = [
            (LAST if doc is None else doc, doc is None, text or b"")
            for batch in unpacked(table)
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
        ]
        rows.sort()
        self.doc_ids: list = [None if missing else doc for doc, missing, _ in rows]
        self.words: list[bytes] = []
        sizes, parts = [], []
        texts = [text for _, _, text in rows]
        for begin, end in together(list(map(len, texts))):
            counts, codes = word_codes(texts[begin:end])
            sizes.append(counts)
            parts.append(codes)
            if keep_words:
                self.words += b" ".join(texts[begin:end]).split()
        self.sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
        numbers = np.array([LAST if d is None else d for d in self.doc_ids], np.int64)
        coded = np.concatenate([np.zeros(0, np.uint64), *parts])
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        runs = window_hashes(coded, ANCHOR)
        n = len(coded) - width + 1
        self.begin = self.end = self.anchor = self.doc = np.zeros(0, np.int64)
        if n <= 0:
            return
        # Half of the hash, then the place: the leftmost of the least.
        key = (runs & ~np.uint64((1 << 32) - 1)) | np.arange(len(runs), dtype=np.uint64)
        least = key[:n]
        for k in range(1, width - ANCHOR + 1):
            least = np.minimum(least, key[k : k + n])
        window = np.flatnonzero(owner[:n] == owner[width - 1 :])
        if not len(window):
            return
        place = (least[window] & np.uint64((1 << 32) - 1)).astype(np.int64)
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)])
        start = np.flatnonzero(new)
        self.begin = window[start]
        self.end = window[np.concatenate([start[1:], [len(window)]]) - 1]
        self.anchor = runs[place[start]].view(np.int64)
        self.doc = numbers[owner[self.begin]]

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, anchor, number of documents), one row per anchor, by bucket, then anchor."""
        order = np.lexsort((self.doc, self.anchor))
        anchor, doc = self.anchor[order], self.doc[order]
        if not len(anchor):
            return (np.zeros(0, np.int64),) * 3
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new_doc = new | np.concatenate([[True], doc[1:] != doc[:-1]])
        first = np.flatnonzero(new)
        counts = np.add.reduceat(new_doc.astype(np.int64), first)
        keys = anchor[first]
        bucket = shard_of(keys, buckets)
        order = np.lexsort((keys, bucket))
        return bucket[order], keys[order], counts[order]

    def passages(self, state: np.ndarray, width: int = WIDTH) -> Iterator[tuple[int, int, int, int]]:
        """(key, first window, last window, document) of what is sent to shards; ``state`` is per run."""
        for k in np.flatnonzero(state):
            begin, end, doc = int(self.begin[k]), int(self.end[k]), int(self.doc[k])
            if state[k] == SHARED:
                yield int(self.anchor[k]), begin, end, doc
            else:
                for w in range(begin, end + 1):
                    yield hash_words(self.words[w : w + width]), w, w, doc

    def distinct(self, state: np.ndarray, width: int = WIDTH) -> tuple[dict[tuple[int, bytes], int], list[tuple[int, int, int, int]]]:
        """The distinct passages (key, words) with their least document, in order of appearance, and every occurrence (number, windows, document)."""
        least: dict[tuple[int, bytes], int] = {}
        number: dict[tuple[int, bytes], int] = {}
        seen = []
        for key, begin, end, doc in self.passages(state, width):
            name = (key, b" ".join(self.words[begin : end + width]))
            if doc < least.setdefault(name, doc):
                least[name] = doc
            seen.append((number.setdefault(name, len(number)), begin, end, doc))
        return least, seen


def together(sizes: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CODED_AT_ONCE bytes."""
    begin, held = 0, 0
    for n, size in enumerate(sizes):
        held += size
        if held >= CODED_AT_ONCE:
            yield begin, n + 1
            begin, held = n + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    size = 2 * CODED_AT_ONCE + 1
    ups, downs = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 2**64), np.uint64)
    ups[0] = downs[0] = 1
    return np.cumprod(ups), np.cumprod(downs)


def word_codes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, code of each word): equal words have equal codes, others hardly ever.

    A word's code is a polynomial in its bytes, as a difference of running
    sums, so there is no step per word.  Codes choose and compare anchors;
    passages are compared as texts.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = IS_SPACE[joined]
    edges = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, offsets))
    codes = np.zeros(len(starts), np.uint64)
    ups, downs = powers()
    at = 0
    while at < len(starts):
        # Words from here on whose bytes fit the table of powers; a longer word is hashed by itself.
        upto = int(np.searchsorted(ends, starts[at] + len(ups) - 1, "right"))
        if upto == at:
            codes[at] = xxhash.xxh3_64_intdigest(joined[starts[at] : ends[at]].tobytes())
            at += 1
            continue
        low, high = int(starts[at]), int(ends[upto - 1])
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(joined[low:high] * ups[: high - low])])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        codes[at:upto] = mixed(((running[e] - running[s]) * downs[s]) ^ ((e - s).astype(np.uint64) << np.uint64(48)))
        at = upto
    return counts, codes


def hash_words(words: Sequence[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - 2**63


def shard_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64), 11) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each bucket, buckets and rows in order."""
    order = np.argsort(bucket, kind="stable")
    return [p for p in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(p)]


def judge_group(texts: list[bytes], docs: list[int], width: int = WIDTH) -> dict[bytes, list[int]]:
    """For each distinct passage of one key, the least document of each of its windows."""
    least: dict[bytes, int] = {}
    for text, doc in zip(texts, docs, strict=True):
        if doc < least.setdefault(text, doc):
            least[text] = doc
    words = {t: t.split(b" ") for t in least}
    if len(least) == 1:
        # One passage: each of its windows has its least document.
        (text, doc), = least.items()
        return {text: [doc] * (len(words[text]) - width + 1)}
    automaton = SuffixAutomaton()
    for text, doc in least.items():
        automaton.add(words[text], doc)
    automaton.close()
    return {t: automaton.matches(w, width)[width - 1 :] for t, w in words.items()}


def dedup_substrings(docs: DataFrame, width: int = WIDTH, hot_docs: int = HOT_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words joined by one space; one row per row of ``docs``."""
    n = block_count(docs, block_bytes)
    blocks = pack(docs, n)

    def anchors(table: pa.Table) -> pa.Table:
        bucket, keys, counts = Block(table, width, keep_words=False).anchors(n)
        parts = by_bucket(bucket)
        return pa.table(
            {
                "block": pa.array([table["block"][0].as_py()] * len(parts), pa.int32()),
                "bucket": pa.array([int(bucket[p[0]]) for p in parts], pa.int32()),
                "anchors": pa.array([keys[p] for p in parts], pa.list_(pa.int64())),
                "docs": pa.array([counts[p].astype(np.int32) for p in parts], pa.list_(pa.int32())),
            }
        )

    def judge_anchors(table: pa.Table) -> pa.Table:
        lists = table["anchors"].combine_chunks()
        keys, counts = lists.flatten().to_numpy(), table["docs"].combine_chunks().flatten().to_numpy()
        _, index = np.unique(keys, return_inverse=True)
        total = np.bincount(index, weights=counts)[index]
        state = np.where(total > hot_docs, HOT, np.where(total > 1, SHARED, UNIQUE)).astype(np.int64)
        ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int32)
        return returned(table, STATES, ends, state)

    def passages(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"block": [], "bucket": [], "keys": [], "passages": [], "docs": []}, schema=PASSAGES)
        block = Block(left, width)
        least, _ = block.distinct(run_states(block, right, n), width)
        names, documents = list(least), list(least.values())
        parts = by_bucket(shard_of(np.array([k for k, _ in names], np.int64), n))
        bucket = shard_of(np.array([names[p[0]][0] for p in parts], np.int64), n)
        return pa.table(
            {
                "block": pa.array([left["block"][0].as_py()] * len(parts), pa.int32()),
                "bucket": pa.array(bucket, pa.int32()),
                "keys": pa.array([[names[i][0] for i in p] for p in parts], pa.list_(pa.int64())),
                "passages": pa.array([[names[i][1] for i in p] for p in parts], pa.list_(pa.binary())),
                "docs": pa.array([[documents[i] for i in p] for p in parts], pa.list_(pa.int64())),
            }
        )

    def judge_shard(table: pa.Table) -> pa.Table:
        lists = table["keys"].combine_chunks()
        keys = lists.flatten().to_numpy()
        texts, docs = (table[c].combine_chunks().flatten().to_pylist() for c in ("passages", "docs"))
        firsts: list[list[int]] = [[]] * len(keys)
        for rows in by_bucket(keys):
            found = judge_group([texts[r] for r in rows], [docs[r] for r in rows], width)
            for r in rows:
                firsts[r] = found[texts[r]]
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, firsts), np.int64, len(firsts)))])
        ends = sizes[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int32)
        return returned(table, FIRSTS, ends, np.fromiter((f for x in firsts for f in x), np.int64, int(sizes[-1])))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left, width)
        state = run_states(block, right, n)
        least, seen = block.distinct(state, width)
        firsts, starts = passage_firsts(list(least), right, n, width)
        delta = np.zeros(len(block.words) + 1, np.int32)
        number, begin, end, doc = np.array(seen, np.int64).reshape(-1, 4).T
        windows = ranges(begin, end + 1)
        later = firsts[ranges(starts[number], starts[number] + end + 1 - begin)] < np.repeat(doc, end + 1 - begin)
        np.add.at(delta, windows[later], 1)
        np.add.at(delta, windows[later] + width, -1)
        gone = np.cumsum(delta[:-1]) > 0
        kept, removed, at = [], [], 0
        for size in block.sizes.tolist():
            hit = gone[at : at + size]
            removed.append(int(hit.sum()))
            words = block.words[at : at + size]
            kept.append(b" ".join([w for w, g in zip(words, hit.tolist(), strict=True) if not g] if removed[-1] else words))
            at += size
        return pa.table({"doc_id": pa.array(block.doc_ids, pa.int64()), "n_words": pa.array(block.sizes), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    found = blocks.groupBy("block").applyInArrow(anchors, "block int, bucket int, anchors array<long>, docs array<int>")
    states = found.groupBy("bucket").applyInArrow(judge_anchors, RIGHT)
    sent = blocks.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(passages, "block int, bucket int, keys array<long>, passages array<binary>, docs array<long>")
    firsts = sent.groupBy("bucket").applyInArrow(judge_shard, RIGHT)
    answers = states.unionByName(firsts)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


PASSAGES = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("passages", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64()))])


def returned(table: pa.Table, kind: int, ends: np.ndarray, values: np.ndarray) -> pa.Table:
    """One answer list for each row of ``table``, in its order."""
    return pa.table(
        {
            "block": table["block"],
            "bucket": table["bucket"],
            "kind": pa.array([kind] * len(table), pa.int32()),
            "entries": pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
        }
    )


def answers_of(right: pa.Table, kind: int) -> np.ndarray:
    """All answers of a kind, by bucket."""
    rows = sorted((b, k) for k, (b, own) in enumerate(zip(right["bucket"].to_pylist(), right["kind"].to_pylist(), strict=True)) if own == kind)
    return np.concatenate([np.zeros(0, np.int64), *(right["entries"][k].values.to_numpy() for _, k in rows)])


def run_states(block: Block, right: pa.Table, buckets: int) -> np.ndarray:
    """State of each run of windows: that of its anchor."""
    _, keys, _ = block.anchors(buckets)
    state = answers_of(right, STATES)
    if len(state) != len(keys):
        raise RuntimeError(f"{len(keys)} anchors, states for {len(state)}")
    order = np.argsort(keys)
    return state[order][np.searchsorted(keys[order], block.anchor)] if len(keys) else np.zeros(0, np.int64)


def passage_firsts(names: list[tuple[int, bytes]], right: pa.Table, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least documents of the windows of all distinct passages, from answers in the order they were sent, and where each passage's begin."""
    values = answers_of(right, FIRSTS)
    starts = np.zeros(len(names), np.int64)
    at = 0
    for part in by_bucket(shard_of(np.array([k for k, _ in names], np.int64), buckets)):
        for i in part:
            starts[i] = at
            at += names[i][1].count(b" ") + 2 - width
    if at != len(values):
        raise RuntimeError(f"{at} windows, answers for {len(values)}")
    return values, starts


def remove_reference(docs: DataFrame, reference: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without the words that lie in a window of some text of ``reference``; rows and columns stay.

    The reference (column ``text``) is read in shards of about ``shard_words``
    words; each is built into an automaton and broadcast, and documents are
    streamed past it, one pass per shard.  Meant for references such as
    benchmarks; the removed words are those of the given texts.
    """
    texts = (row["text"] for row in reference.select("text").filter("text is not null").toLocalIterator())
    shards: list[list[list[bytes]]] = [[]]
    size = 0
    for text in texts:
        words = text.encode().split()
        if size + len(words) > shard_words and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(words)
        size += len(words)
    context = docs.sparkSession.sparkContext
    names, at = docs.columns, docs.columns.index("text")
    shared = [context.broadcast(built(s)) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([cleaned(t, [s.value for s in shared], width) if t else t for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.transform(few_rows).mapInArrow(run, docs.schema)


def built(texts: list[list[bytes]]) -> SuffixAutomaton:
    automaton = SuffixAutomaton()
    for number, words in enumerate(texts):
        automaton.add(words, number)
    automaton.close()
    return automaton


def cleaned(text: str, automata: list[SuffixAutomaton], width: int) -> str:
    words = text.encode().split()
    gone = [False] * len(words)
    for automaton in automata:
        for end, first in enumerate(automaton.matches(words, width)):
            if first is not None:
                gone[end - width + 1 : end + 1] = [True] * width
    return b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode() if any(gone) else text
