"""BPE encoding and decoding by a table of distinct words.

The tokenizer of ``word_bpe_49k.json`` never joins characters over white space,
so a text's ids are those of its words, one after the other.  Spark splits the
texts into words, ``[^\\x20\\x09-\\x0D]+`` unchanged, and every distinct word of
the corpus is encoded once:

1. Documents are dealt to blocks by hash, packed and compressed; a block holds
   about ``BLOCK_BYTES`` of text and is the unit that a task holds.
2. A block's distinct words are dealt to buckets by hash, as sorted lists.
3. A bucket gathers the lists of all blocks: its share of the table of distinct
   words.  Each word is encoded once; ids go back list by list, in the order
   of the words.
4. The block lists its words again in the same order, so ids join words by
   position, and words' ids join texts by position.

A word is at most once in a block's lists, so the most frequent one costs a
bucket one entry per block.  Blocks and buckets grow in number with the text,
and neither is larger for it.

``decode`` joins ids with the tokenizer's pieces (a table of the vocabulary's
size, 49,408 rows) and joins pieces by a space, as the tokenizer, which has no
decoder of its own, does.

Null text: no ids, empty text back.  A null list of ids decodes to an empty
text, an id outside the vocabulary to nothing.  Strings of special tokens in a
text become their ids, as the tokenizer does.  Repeated rows, and rows of one
doc_id, are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tasteforge.llm.blocks import LEVEL, block_count, compressed, opened, pack, unpacked
from tasteforge.llm.common import few_rows

BLOCK_BYTES = 12_000_000
SUB_BATCH = 2_000_000
DECODE_ROWS = 512


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


def word_lists(table: pa.Table, buckets: int) -> dict[int, list[bytes]]:
    """The block's distinct words by bucket, sorted: the same each time it is asked for."""
    words: set[bytes] = set()
    for batch in unpacked(table):
        for text in batch["text"].to_pylist():
            if text:
                words.update(text.split())
    lists: dict[int, list[bytes]] = {}
    for word in sorted(words):
        lists.setdefault(zlib.crc32(word) % buckets, []).append(word)
    return dict(sorted(lists.items()))


def encode(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, input_ids): one row per row of ``docs``."""
    path = path or default_path()
    if tokenizer(path).get_vocab_size(with_added_tokens=True) > 1 << 16:
        raise ValueError("ids travel as 16-bit numbers; this vocabulary needs more")
    n = block_count(docs, block_bytes)
    blocks = pack(docs, n)

    def words(table: pa.Table) -> pa.Table:
        lists = word_lists(table, n)
        block = table["block"][0].as_py() if len(table) else None
        packed = [compressed(pa.record_batch({"word": pa.array(x, pa.binary())})) for x in lists.values()]
        return pa.table({"block": pa.array([block] * len(lists), pa.int32()), "bucket": pa.array(list(lists), pa.int32()), "words": pa.array(packed, pa.binary())})

    def encode_bucket(table: pa.Table) -> pa.Table:
        lists = [opened(packed)["word"] for packed in table["words"]]
        coded = pa.concat_arrays(lists).dictionary_encode()
        ids = [e.ids for e in tokenizer(path).encode_batch([w.decode() for w in coded.dictionary.to_pylist()], add_special_tokens=False)]
        flat = np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        index = coded.indices.to_numpy()
        packed, at = [], 0
        for words in lists:
            own = index[at : at + len(words)]
            at += len(words)
            rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[own])]).astype(np.int32)), pa.array(flat[spread(begins[own], sizes[own])].astype(np.uint16)))
            packed.append(compressed(pa.record_batch({"ids": rows})))
        return pa.table({"block": table["block"], "bucket": table["bucket"], "ids": pa.array(packed, pa.binary())})

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = word_lists(left, n)
        order = np.argsort(right["bucket"].to_numpy())
        place = {w: k for k, w in enumerate(w for words in lists.values() for w in words)}
        empty = np.zeros(0, np.int32)
        returned = [opened(right["ids"][int(k)])["ids"] for k in order]
        flat = np.concatenate([empty, *(r.values.to_numpy().astype(np.int32) for r in returned)])
        sizes = np.concatenate([empty, *(np.diff(r.offsets.to_numpy()) for r in returned)])
        if len(sizes) != len(place):
            raise RuntimeError(f"{len(place)} words, ids for {len(sizes)}")
        begins = np.concatenate([[0], np.cumsum(sizes)])
        doc_ids, parts, counts = [], [], []
        for batch in unpacked(left):
            doc_ids += batch["doc_id"].to_pylist()
            waiting: list[int] = []
            held = 0
            for text in batch["text"].to_pylist():
                found = [place[w] for w in text.split()] if text else []
                counts.append(int(sizes[found].sum()) if found else 0)
                waiting += found
                held += len(text or b"")
                if held > SUB_BATCH:
                    index = np.array(waiting, np.int64)
                    parts.append(flat[spread(begins[index], sizes[index])])
                    waiting, held = [], 0
            index = np.array(waiting, np.int64)
            parts.append(flat[spread(begins[index], sizes[index])])
        ends = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int32)
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "input_ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([empty, *parts])))})

    lists = blocks.groupBy("block").applyInArrow(words, "block int, bucket int, words binary")
    ids = lists.groupBy("bucket").applyInArrow(encode_bucket, "block int, bucket int, ids binary")
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(join_back, "doc_id long, input_ids array<int>")


def narrow(encoded: DataFrame) -> DataFrame:
    """``encode``'s rows with ``n`` and ``packed``, the ids as compressed 16-bit numbers, in place of ``input_ids``: less to shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=LEVEL)
        for batch in batches:
            column = batch["input_ids"]
            ends = column.offsets.to_numpy()
            flat = column.flatten().to_numpy().astype(np.uint16)
            packed = [codec.compress(flat[a:b].tobytes(), asbytes=True) for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(ends), pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "n", "packed"])

    return encoded.transform(few_rows).mapInArrow(run, "doc_id long, n int, packed binary")


def widen(narrowed: DataFrame) -> DataFrame:
    """Rows with ``input_ids`` again, after their other columns and in their order."""
    names = [c for c in narrowed.columns if c not in ("n", "packed")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrowed.select(*names).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            sizes = batch["n"].to_numpy()
            each = [np.frombuffer(codec.decompress(p.as_buffer(), 2 * int(n), asbytes=True), np.uint16) for p, n in zip(batch["packed"], sizes)]
            flat = np.concatenate([np.zeros(0, np.uint16), *each]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, ids], names=[*names, "input_ids"])

    return narrowed.transform(few_rows).mapInArrow(run, f"{schema}, input_ids array<int>")


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(total)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Add ``decoded``: the pieces of ``input_ids``, special ones too, joined by a space."""
    path = path or default_path()
    names = [c for c in encoded.columns if c != "decoded"]
    chosen = encoded.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        size = own.get_vocab_size(with_added_tokens=True)
        pieces = pa.array([own.id_to_token(i) for i in range(size)], pa.string())
        for batch in (b.slice(k, DECODE_ROWS) for b in batches for k in range(0, b.num_rows, DECODE_ROWS)):
            column = pc.fill_null(batch["input_ids"], pa.scalar([], pa.list_(pa.int32())))
            flat = column.flatten()
            joined = pieces.take(pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, size)), flat, None))
            if joined.null_count:
                rows = [[p for p in r if p is not None] for r in pa.ListArray.from_arrays(_offsets(column), joined).to_pylist()]
                lists = pa.array(rows, pa.list_(pa.string()))
            else:
                lists = pa.ListArray.from_arrays(_offsets(column), joined)
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pc.binary_join(lists, " ")], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return chosen.transform(few_rows).mapInArrow(run, f"{schema}, decoded string")


def _offsets(column: pa.ListArray) -> pa.Array:
    return pc.subtract(column.offsets, column.offsets[0])
