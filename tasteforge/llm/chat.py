"""Chat formatting: conversations as token ids with a loss mask.

Template of one turn, with reserved ids in brackets::

    [TURN] role [TEXT] text [END]

Role and text are encoded apart, with a byte-level BPE that never yields a
reserved id, and the reserved ids are spliced in between, so no text can forge
a marker.  The mask is 1 on the ids of an assistant's text: +1 where the text
begins, -1 where it ends, summed up from the left.

The formatted text (``render``) shows the markers as strings.  Control strings
inside roles and texts (those markers and the ones of other common templates)
are escaped before encoding: a backslash is put after their first character,
and one more where there are backslashes already, so ``</s>`` becomes
``<\\/s>`` and ``<\\/s>`` becomes ``<\\\\/s>``.  ``unescape`` takes one away.

A row of ``conversations`` gives a row of tokens; a conversation is its rows
by turn, one after the other (ties: by role, then text).  Rows are formatted
where they lie, without a shuffle, so one conversation may hold any share of
them.  Null role or text counts as empty.  Repeated rows are turns of their
own; an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteforge.llm.common import few_rows

VOCABULARY = 50_256
TURN, TEXT, END = VOCABULARY, VOCABULARY + 1, VOCABULARY + 2
MARKERS = {TURN: "<|turn|>", TEXT: "<|text|>", END: "<|end|>\n"}
# Strings that chat templates treat as control strings.
CONTROL = (
    "<|turn|>", "<|text|>", "<|end|>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>",
    "<|assistant|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>",
)
ASSISTANT = "assistant"


def _control_pattern(slashes: str) -> re.Pattern:
    rests = sorted({c[0] for c in CONTROL})
    return re.compile("|".join(f"({re.escape(f)})({slashes})(?={'|'.join(re.escape(c[1:]) for c in CONTROL if c[0] == f)})" for f in rests))


BARE, ESCAPED = _control_pattern(r"\\*"), _control_pattern(r"\\+")


def escape(text: str) -> str:
    return BARE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][:-1], text)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The public byte-level BPE at ``path`` (a file of ranks)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


FORMATTED = "conv_id long, turn long, input_ids array<int>, loss_mask array<tinyint>"


def format_turns(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """(conv_id, turn, input_ids, loss_mask), one row per row of ``conversations``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path)
        roles: dict[str, list[int]] = {}
        for batch in batches:
            parts, sizes, marks = [], [], []
            at = 0
            for role, text in zip(batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                role = role or ""
                head = roles.get(role)
                if head is None:
                    head = [TURN, *bpe.encode_ordinary(escape(role)), TEXT]
                    if len(roles) < 1000:
                        roles[role] = head
                body = bpe.encode_ordinary(escape(text or ""))
                parts += (head, body, (END,))
                if role == ASSISTANT:
                    marks.append((at + len(head), at + len(head) + len(body)))
                sizes.append(len(head) + len(body) + 1)
                at += sizes[-1]
            ids = np.fromiter((i for p in parts for i in p), np.int32, at)
            delta = np.zeros(at + 1, np.int8)
            for begin, end in marks:
                delta[begin] += 1
                delta[end] -= 1
            mask = np.cumsum(delta[:-1], dtype=np.int8)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [batch["conv_id"], batch["turn"], pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(mask))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "input_ids", "loss_mask"])

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").transform(few_rows).mapInArrow(run, FORMATTED)


READ = "conv_id long, turn long, role string, text string, loss_text string, formatted_chars long"


def read_turns(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Read turns back from ids and mask alone: (conv_id, turn, role, text, loss_text, formatted_chars).

    ``loss_text`` is what lies under the mask, unescaped; ``formatted_chars``
    the length of the rendered turn.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path)
        for batch in batches:
            out: dict[str, list] = {"role": [], "text": [], "loss_text": [], "formatted_chars": []}
            ids_column, mask_column = batch["input_ids"], batch["loss_mask"]
            for k in range(batch.num_rows):
                ids, mask = ids_column[k].values.to_numpy(), mask_column[k].values.to_numpy()
                middle = int(np.flatnonzero(ids == TEXT)[0])
                role, text = bpe.decode(ids[1:middle].tolist()), bpe.decode(ids[middle + 1 : -1].tolist())
                out["role"].append(unescape(role))
                out["text"].append(unescape(text))
                out["loss_text"].append(unescape(bpe.decode(ids[mask == 1].tolist())))
                out["formatted_chars"].append(len(role) + len(text) + sum(len(MARKERS[int(i)]) for i in ids[ids >= VOCABULARY]))
            yield pa.RecordBatch.from_pydict({"conv_id": batch["conv_id"], "turn": batch["turn"], **out}, schema=_schema(READ_TYPES))

    return formatted.transform(few_rows).mapInArrow(run, READ)


READ_TYPES = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "loss_text": pa.string(), "formatted_chars": pa.int64()}
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_TYPES = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def _schema(types: dict) -> pa.Schema:
    return pa.schema(list(types.items()))


def digest_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation from ``read_turns``.

    A digest needs a conversation's turns in order, so its rows meet in one
    task; they are sorted by Spark (which spills) and folded one at a time, so
    the task's memory does not grow with the conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        done: list[tuple] = []

        def closed() -> tuple:
            return (current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("conv_id", "role", "text", "loss_text", "formatted_chars")]
            for conv, role, text, loss, chars in zip(*columns, strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        done.append(closed())
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            if done:
                yield _digests(done)
                done = []
        if current is not None:
            yield _digests([closed()])

    sorted_turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_turns.select("conv_id", "role", "text", "loss_text", "formatted_chars").transform(few_rows).mapInArrow(run, DIGEST)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGEST_TYPES.values(), strict=True)], schema=_schema(DIGEST_TYPES))


def render(ids: list[int], path: str | None = None) -> str:
    """The formatted text of some turns, markers as strings."""
    bpe = encoding(path or default_path())
    out, begin = [], 0
    for k, i in enumerate(ids):
        if i >= VOCABULARY:
            out += (bpe.decode(ids[begin:k]), MARKERS[i])
            begin = k + 1
    return "".join(out) + bpe.decode(ids[begin:])
