"""Documents in blocks: what a task holds at a time, moved once and compressed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteforge.llm.common import few_rows, tasks

LEVEL = 3
PACKED = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])


def block_count(docs: DataFrame, block_bytes: int) -> int:
    """Enough blocks for about ``block_bytes`` of text in each, and one for each task at least."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(tasks(docs.sparkSession), math.ceil(total / block_bytes))


def compressed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, docs): documents of one block, as they come, in compressed batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch["block"].to_numpy()
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            keys, packed = [], []
            for rows in np.split(order, cuts):
                if len(rows):
                    keys.append(int(block[rows[0]]))
                    packed.append(compressed(batch.select(["doc_id", "text"]).take(pa.array(rows)).cast(PACKED)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packed, pa.binary())], names=["block", "docs"])

    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("block")), F.lit(blocks)).cast("int")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), block.alias("block"))
    return chosen.transform(few_rows).mapInArrow(run, "block int, docs binary").repartition(blocks, "block")


def opened(packed: pa.Scalar) -> pa.RecordBatch:
    """The one batch that ``compressed`` has packed."""
    return pa.ipc.open_stream(packed.as_buffer()).read_next_batch()


def unpacked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for packed in table["docs"]:
        yield from pa.ipc.open_stream(packed.as_buffer())
