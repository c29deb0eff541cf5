"""Periodic run detection by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same) of at least ``max(least, 2 q)`` words that no neighbouring word
extends.  Every word of a run occurs in it at least twice, so:

1. *Splitting.*  A word that occurs too rarely within its segment to be in a
   run there splits the segment.  The parts are looked at again, since words
   become rarer in them, until none splits.  After a split only the smaller
   parts and the words that had their nearest partner there can have become
   rare, so the largest part is not read again.
2. *Lag scan.*  For lags from Q to 2Q - 1 a run holds a stretch of matching
   words that covers a whole block on a grid of half that length.  The hash of
   each block is compared with those of the windows Q to 2Q - 1 words on; hits
   are confirmed and extended word by word.  The cost is 2 n per doubling of Q,
   not n x n.  A hit inside a run found before, whose period divides the lag,
   belongs to that run.

Texts of an Arrow batch are scanned together in one array, with a mark of its
own between two texts.  Nothing is shuffled: a text lies in one task, which
holds some hundred bytes for each of its words.

Null and blank texts have no words and no run.  Null ids are kept as they are,
repeated rows give a row each, further columns are dropped, an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasteforge.llm.common import few_rows, mixed, ranges

LEAST = 12
# Texts are scanned together until they hold so many words.
WORDS_AT_ONCE = 200_000
COMPARED_AT_ONCE = 1 << 20
FIRST_STEP = 64
RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, kept): every run by start, then period, and the words no run repeats, joined by one space.

    ``kept`` leaves out a word if any run holds it after that run's first
    ``period`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _together(batch.column(1)):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), *_of_texts(part.column(1), least)], names=["doc_id", "n_words", "runs", "kept"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.transform(few_rows).mapInArrow(run, f"doc_id {kind}, {FOUND}")


def _together(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts to scan at once; a word takes two bytes at least."""
    first, size = 0, 0
    for n, text in enumerate(texts):
        size += 0 if text.as_py() is None else text.as_buffer().size
        if size >= 2 * WORDS_AT_ONCE:
            yield first, n + 1
            first, size = n + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _of_texts(texts: pa.Array, least: int) -> list[pa.Array]:
    words = [(text or b"").split() for text in texts.to_pylist()]
    sizes = np.array([len(w) for w in words], np.int64)
    # Each text is followed by a mark that no other place holds.
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    codes = np.empty(int(sizes.sum()) + len(words), np.int64)
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    for n, (start, size) in enumerate(zip(starts, sizes)):
        codes[start : start + size] = np.fromiter(map(numbers.__getitem__, words[n]), np.int64, size)
        codes[start + size] = -1 - n
    found = runs_in(codes, starts + sizes, least)
    owner = np.searchsorted(starts, found[:, 0], "right") - 1
    cuts = np.searchsorted(owner, np.arange(len(words) + 1))
    spans, kept = found - np.c_[starts[owner], np.zeros((len(found), 2), np.int64)], []
    for n, own in enumerate(words):
        if cuts[n] < cuts[n + 1]:
            keep = np.ones(len(own), bool)
            for start, length, period in spans[cuts[n] : cuts[n + 1]]:
                keep[start + period : start + length] = False
            own = [own[k] for k in np.flatnonzero(keep)]
        kept.append(b" ".join(own))
    columns = [pa.array(np.ascontiguousarray(spans[:, k])) for k in range(3)]
    runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(RUN_TYPE)))
    return [pa.array(sizes), runs, pa.array(kept, pa.binary()).cast(pa.string())]


def runs_in(codes: np.ndarray, marks: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs between the marks, one row each, by start, then period.

    ``marks`` are the places, in order, that no run may hold.
    """
    starts, ends = split(codes, marks, least)
    if not len(starts):
        return np.empty((0, 3), np.int64)
    sizes = ends - starts
    # The segments left are moved together, each followed by a mark.
    moved = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    left = np.full(int(sizes.sum()) + len(sizes), -1, np.int64)
    left[ranges(moved, moved + sizes)] = codes[ranges(starts, ends)]
    found = lag_scan(left, moved, moved + sizes, least)
    if not found:
        return np.empty((0, 3), np.int64)
    spans = np.array(found, np.int64)
    at = np.searchsorted(moved, spans[:, 0], "right") - 1
    spans[:, 0] += starts[at] - moved[at]
    return spans[np.lexsort((spans[:, 2], spans[:, 0]))]


def neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest earlier and later place of the same word: -1 and the number of places where there is none."""
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    before, after = np.full(len(codes), -1, np.int64), np.full(len(codes), len(codes), np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def fewest(least: int) -> int:
    """How often each word of a run occurs in it, at least: whole periods in the shortest run of any period."""
    return min(max(least, 2 * period) // period for period in range(1, least + 1))


def split(codes: np.ndarray, marks: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the segments, ``least`` words or longer, in which every word occurs often enough to be in a run.

    A word is too rare when it has no second place in its segment: two places
    are what the longest periods ask for.
    """
    assert fewest(least) == 2
    before, after = neighbours(codes)
    cuts = np.r_[-1, marks, len(codes)]
    todo = np.setdiff1d(np.arange(len(codes)), marks, assume_unique=True)
    while len(todo):
        at = np.searchsorted(cuts, todo)
        rare = todo[(before[todo] <= cuts[at - 1]) & (after[todo] >= cuts[at])]
        if not len(rare):
            break
        old = cuts
        cuts = np.insert(old, np.searchsorted(old, rare), rare)
        # Segments that touch a new cut, without empty ones.
        right = np.searchsorted(cuts, rare)
        touched = np.unique(np.r_[right - 1, right])
        starts, ends = cuts[touched] + 1, cuts[touched + 1]
        some = ends > starts
        starts, ends = starts[some], ends[some]
        # All parts of a segment but its largest.
        whole = np.searchsorted(old, starts)
        order = np.lexsort((starts - ends, whole))
        largest = order[np.r_[True, whole[order[1:]] != whole[order[:-1]]]] if len(order) else order
        small = np.ones(len(starts), bool)
        small[largest] = False
        # A word's rarity hangs on its nearest places only, so the largest part is reached through its partners.
        read = ranges(starts[small], ends[small])
        long_part = small & (ends - starts >= least)
        todo = np.unique(np.r_[ranges(starts[long_part], ends[long_part]), before[read], after[read]])
        todo = todo[(todo >= 0) & (todo < len(codes))]
        at = np.searchsorted(cuts, todo)
        inside = cuts[at] != todo
        todo, at = todo[inside], at[inside]
        todo = todo[cuts[at] - cuts[at - 1] > least]
    starts, ends = cuts[:-1] + 1, cuts[1:]
    enough = ends - starts >= least
    return starts[enough], ends[enough]


def lag_scan(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run inside the segments, in no order."""
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    hashes = {1: mixed(codes.view(np.uint64))}
    low = 1
    while len(starts):
        enough = ends - starts >= max(least, 2 * low)
        starts, ends = starts[enough], ends[enough]
        shortest = min(max(least - lag, lag) for lag in range(low, 2 * low))
        width = 1 << ((shortest + 1) // 2).bit_length() - 1
        at, lags, segment = _hits(_hash_of(hashes, width), starts, ends, low, width)
        fresh = np.ones(len(at), bool)
        if len(at):
            order = np.argsort(at, kind="stable")
            at, lags, segment = at[order], lags[order], segment[order]
            for start, length, period in found:
                if length >= low + width:
                    near = slice(*np.searchsorted(at, [start, start + length]))
                    fresh[near] &= (lags[near] % period != 0) | (at[near] + lags[near] + width > start + length)
        at, lags, segment = at[fresh], lags[fresh], segment[fresh]
        order = np.lexsort((at, lags))
        lag_before, reached = 0, 0
        for place, lag, own in zip(at[order].tolist(), lags[order].tolist(), segment[order].tolist()):
            if lag == lag_before and place < reached:
                continue
            first, reached = _stretch(codes, place, lag, int(starts[own]), int(ends[own]))
            lag_before = lag
            span = (first, reached - first + lag)
            if span[1] >= max(least, 2 * lag) and span not in known:
                known.add(span)
                found.append((*span, lag))
        low *= 2
    return found


def _hash_of(hashes: dict[int, np.ndarray], width: int) -> np.ndarray:
    """Hash of the ``width`` (a power of two) codes from each place on, made of two halves; windows past the end repeat its last code."""
    if width not in hashes:
        half = _hash_of(hashes, width // 2)
        later = np.minimum(np.arange(len(half)) + width // 2, len(half) - 1)
        hashes[width] = mixed(half ^ mixed(half[later], 1))
        # Widths rise but for the first lags, which use 2 and 4.
        for old in [w for w in hashes if 4 < w < width]:
            del hashes[old]
    return hashes[width]


def _hits(code: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, segment) of each block that is met again ``low`` to 2 ``low`` - 1 words on, inside its segment."""
    blocks = np.maximum((ends - starts - width - low) // width + 1, 0)
    segment = np.repeat(np.arange(len(starts)), blocks)
    place = starts[segment] + width * (np.arange(len(segment)) - (np.cumsum(blocks) - blocks)[segment])
    # No further than the segment's end, and than half the segment.
    furthest = np.minimum((ends - starts)[segment] // 2, ends[segment] - width - place)
    lags = np.arange(low, 2 * low)
    rows = max(1, COMPARED_AT_ONCE // low)
    parts = []
    for begin in range(0, len(place), rows):
        here = place[begin : begin + rows]
        there = np.minimum(here[:, None] + lags, len(code) - 1)
        row, column = np.nonzero((code[here][:, None] == code[there]) & (lags <= furthest[begin : begin + rows, None]))
        parts.append((here[row], lags[column], segment[begin + row]))
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(p) for p in zip(*parts))


def _stretch(codes: np.ndarray, place: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The places around ``place`` whose word is met again ``lag`` on, as [first, end)."""
    end, step = place, FIRST_STEP
    while end < high - lag:
        stop = min(end + step, high - lag)
        other = np.flatnonzero(codes[end:stop] != codes[end + lag : stop + lag])
        if len(other):
            end += int(other[0])
            break
        end, step = stop, 4 * step
    first, step = place, FIRST_STEP
    while first > low:
        stop = max(first - step, low)
        other = np.flatnonzero(codes[stop:first] != codes[stop + lag : first + lag])
        if len(other):
            first = stop + int(other[-1]) + 1
            break
        first, step = stop, 4 * step
    return first, max(end, first)
