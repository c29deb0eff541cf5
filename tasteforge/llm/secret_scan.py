"""Secret scans: formats of credentials learned as probabilistic automata.

Base rules find credentials by pattern; what they find is the labelled sample
for grammar inference.  For each kind the values' prefix tree, over classes of
characters, is folded into a probabilistic automaton: two states are merged
when their outgoing frequencies, and those of the states they lead to, agree
within Hoeffding's bound (``alpha``).  Candidates are what base spans leave of a
run of credential characters, and every part of it that begins at its start or
behind one of ``+/_.=-`` and ends at its end or before one; 6 characters or
more, as in ``assign``, with a digit and a letter.  Each is scored by its
likelihood per character in each automaton, the end of the value included,
against a model of ordinary candidates; what looks more like one of the formats
than ``threshold`` asks, and no less likely than the bulk of the labelled
values, is a further span, of kind ``format``.  Of the parts with one end the
one of the greatest lead is taken, and parts inside another are left out.

Texts are read once; spans and what they leave of runs are written and scored
from there.  The model of ordinary candidates has the frequency of each
character in all that base spans leave of runs, each time it occurs, counted in
Spark.  All parts are walked side by side; where two are in one state and
one trails in both tests, it is dropped, as the other passes whenever it does.
A run whose parts all stay in play costs its length times its separators.  The labelled sample is at most ``fit_values``
distinct values per kind, of lowest hash, so the automata are small and are
sent to the tasks.  There is no other shuffle but that of the character counts.

Places count code points, the end is exclusive.  Base rules, leftmost and
non-overlapping by kind: ``assign`` (a keyword, = or :, a value of 6
characters or more; the span is the whole match), ``access`` and ``hex``.
``format`` spans overlap no base span.

Null or empty text: no span.  An empty table gives an empty result; repeated
rows are scanned alike; with no labelled value no ``format`` span is found.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tasteforge.llm.common import few_rows
from tasteforge.sources.shared import stage

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are greedy and maximal, so a length in the pattern drops the same matches as a check afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "format")
MIN_VALUE = 6
SEPARATORS = "+/_.=-"
CHARACTERS = {c: k for k, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + SEPARATORS)}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_VALUE)
FIT_VALUES = 1500
ALPHA = 0.05
THRESHOLD = 1.0
BULK = 0.05

SPAN = "struct<kind:string,start:int,end:int,value:string>"
SCAN = f"doc_id long, base array<{SPAN}>, candidates array<{SPAN}>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, taken: Sequence[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """What base spans leave of each run, where it can hold a value."""
    out, spans, at = [], sorted((s, e) for _, s, e, _ in taken), 0
    for m in CANDIDATE.finditer(text):
        begin = m.start()
        while at < len(spans) and spans[at][1] <= begin:
            at += 1
        k = at
        while begin < m.end():
            covered = k < len(spans) and spans[k][0] < m.end()
            end = max(begin, spans[k][0]) if covered else m.end()
            if may_be_value(text[begin:end]):
                out.append(("format", begin, end, text[begin:end]))
            begin = max(begin, spans[k][1]) if covered else m.end()
            k += 1
    return out


def may_be_value(part: str) -> bool:
    return len(part) >= MIN_VALUE and any(c.isdigit() for c in part) and any(c.isalpha() for c in part)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates): one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "value")
        for batch in batches:
            base, more = [], []
            for text in batch["text"].to_pylist():
                spans = base_spans(text) if text else []
                base.append([dict(zip(names, s, strict=True)) for s in spans])
                more.append([dict(zip(names, s, strict=True)) for s in candidates(text, spans)] if text else [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, SPAN_TYPE), pa.array(more, SPAN_TYPE)], names=["doc_id", "base", "candidates"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(few_rows).mapInArrow(run, SCAN)


def symbol(c: str) -> str:
    """Class of a character: a-f and 0-9 tell hexadecimal values from others."""
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "g"
    if "A" <= c <= "Z":
        return "A"
    return c


CLASS_SIZE = {"0": 10, "a": 6, "g": 20, "A": 26}
END = ""


class Automaton:
    """States with counts: ``moves[s][symbol] = (next, count)``, ``ends[s]``."""

    def __init__(self, values: Sequence[str], alpha: float = ALPHA):
        self.moves: list[dict[str, list[int]]] = [{}]
        self.ends: list[int] = [0]
        self._tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for value in values:
            self._add(value)
        self._merge(alpha)
        scores = sorted(self.score(v) for v in values)
        self.least = scores[int(BULK * len(scores))] if scores else math.inf

    def _add(self, value: str) -> None:
        state = 0
        for c in map(symbol, value):
            move = self.moves[state].get(c)
            if move is None:
                move = self.moves[state][c] = [len(self.moves), 0]
                self.moves.append({})
                self.ends.append(0)
            move[1] += 1
            state = move[0]
        self.ends[state] += 1

    def _seen(self, state: int) -> int:
        return self.ends[state] + sum(n for _, n in self.moves[state].values())

    def _agree(self, a: int, b: int, bound: float) -> bool:
        """Hoeffding's test on every symbol and the end, on down the tree below b."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._seen(a), self._seen(b)
            if not n or not m:
                continue
            width = bound * (n**-0.5 + m**-0.5)
            if abs(self.ends[a] / n - self.ends[b] / m) > width:
                return False
            for c in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(c), self.moves[b].get(c)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > width:
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, (target, n) in self.moves[b].items():
                if c in self.moves[a]:
                    self.moves[a][c][1] += n
                    todo.append((self.moves[a][c][0], target))
                else:
                    self.moves[a][c] = [target, n]

    def _merge(self, alpha: float) -> None:
        """Red states are final; blue ones, next to a red state, are merged into one or become red."""
        bound = math.sqrt(0.5 * math.log(2 / alpha))
        red = [0]
        while True:
            blue = [(s, c) for s in red for c in sorted(self.moves[s]) if self.moves[s][c][0] not in red]
            if not blue:
                break
            source, c = min(blue, key=lambda x: (-self.moves[x[0]][x[1]][1], self.moves[x[0]][x[1]][0]))
            state = self.moves[source][c][0]
            into = next((r for r in red if self._agree(r, state, bound)), None)
            if into is None:
                red.append(state)
            else:
                self.moves[source][c][0] = into
                self._fold(into, state)

    def score(self, value: str) -> float:
        """Log probability per character; a move never seen costs a thousandth."""
        state, total = 0, 0.0
        for c in value:
            s = symbol(c)
            move = self.moves[state].get(s)
            n = self._seen(state)
            total += math.log(((move[1] if move else 0) + 1e-3) / (n + 1.0)) - math.log(CLASS_SIZE.get(s, 1))
            state = move[0] if move else state
        total += math.log((self.ends[state] + 1e-3) / (self._seen(state) + 1.0))
        return total / max(1, len(value))


    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probability and next state by (state, character), log probability of the end by state; as in ``score``."""
        if self._tables is None:
            number, order = {0: 0}, [0]
            for state in order:
                for target, _ in self.moves[state].values():
                    if target not in number:
                        number[target] = len(order)
                        order.append(target)
            chance, after = np.empty((len(order), len(CHARACTERS))), np.empty((len(order), len(CHARACTERS)), np.int64)
            for k, state in enumerate(order):
                n = self._seen(state)
                for c, i in CHARACTERS.items():
                    s = symbol(c)
                    move = self.moves[state].get(s)
                    chance[k, i] = math.log(((move[1] if move else 0) + 1e-3) / (n + 1.0)) - math.log(CLASS_SIZE.get(s, 1))
                    after[k, i] = number[move[0]] if move else k
            end = np.array([math.log((self.ends[s] + 1e-3) / (self._seen(s) + 1.0)) for s in order])
            self._tables = chance, after, end
        return self._tables


def ordinary(values: Sequence[str]) -> dict[str, float]:
    """Log probability of each character by frequency, add one."""
    counts: dict[str, int] = defaultdict(int)
    for value in values:
        for c in value:
            counts[c] += 1
    return ordinary_of(counts)


def ordinary_of(counts: dict[str, int]) -> dict[str, float]:
    total = sum(counts.values()) + 66
    return defaultdict(lambda: math.log(1 / total), {c: math.log((n + 1) / total) for c, n in counts.items()})


def count_characters(scanned: DataFrame) -> dict[str, int]:
    """How often each character stands in the candidates; counted in the tasks, a row per character comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch["value"].to_pylist():
                counts.update(value)
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["c", "n"])

    values = scanned.select(F.explode("candidates").alias("s")).select("s.value")
    counted = values.transform(few_rows).mapInArrow(run, "c string, n long").groupBy("c").agg(F.sum("n").alias("n"))
    return {row["c"]: row["n"] for row in counted.collect()}


def least_hashed(values: DataFrame, n: int) -> DataFrame:
    """At most ``n`` distinct values per kind, of lowest hash; pruned before the shuffle."""
    by_hash = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    return values.distinct().withColumn("_place", F.row_number().over(by_hash)).filter(F.col("_place") <= n).drop("_place")


def fit(scanned: DataFrame, fit_values: int = FIT_VALUES, alpha: float = ALPHA) -> tuple[dict[str, Automaton], dict[str, float]]:
    """Automata by kind from the base spans, and the model of ordinary candidates."""
    labelled = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    rows = least_hashed(labelled, fit_values).collect()
    values: dict[str, list[str]] = defaultdict(list)
    for row in sorted(rows):
        values[row["kind"]].append(row["value"])
    counts = count_characters(scanned)
    return {k: Automaton(v, alpha) for k, v in values.items()}, dict(ordinary_of(counts)) | {END: math.log(1 / (sum(counts.values()) + 66))}


def secret_like(value: str, automata: dict[str, Automaton], plain: dict[str, float], threshold: float) -> bool:
    background = sum(plain.get(c, plain[END]) for c in value) / max(1, len(value))
    return any((s := a.score(value)) >= a.least and s - background >= threshold for a in automata.values())


ROUNDING = 1e-9


def secret_parts(value: str, automata: dict[str, Automaton], plain: dict[str, float], threshold: float) -> list[tuple[int, int]]:
    """(start, end) of the parts of a candidate that are ``secret_like``, in order."""
    places = [i for i, c in enumerate(value) if c in SEPARATORS]
    if not places:
        return [(0, len(value))] if may_be_value(value) and secret_like(value, automata, plain, threshold) else []
    codes = [CHARACTERS[c] for c in value]
    usual = [plain.get(c, plain[END]) + threshold for c in value]
    best: dict[int, tuple[float, int]] = {}
    for automaton in automata.values():
        chance, after, last = automaton.tables()
        # Of each open part: its start, its state, and what it leads by in the two tests, times its length.
        start, state = np.zeros(len(places) + 1, np.int64), np.zeros(len(places) + 1, np.int64)
        over_usual, over_least = np.zeros(len(places) + 1), np.zeros(len(places) + 1)
        n, full, digit, letter = 0, 64, -1, -1
        for i in range(len(value) + 1):
            if i == len(value) or value[i] in SEPARATORS:
                # Starts are in order: the first ``ripe`` parts have the length, a digit and a letter.
                ripe = int(np.searchsorted(start[:n], min(i - MIN_VALUE, digit, letter), "right"))
                if ripe:
                    end = last[state[:ripe]]
                    lead = np.where(over_least[:ripe] + end >= -ROUNDING, over_usual[:ripe] + end, -np.inf)
                    k = int(np.argmax(lead))
                    if lead[k] >= -ROUNDING and (i not in best or lead[k] > best[i][0]):
                        best[i] = (float(lead[k]), int(start[k]))
                if ripe > full:
                    kept = np.concatenate([_leading(state[:ripe], over_usual[:ripe], over_least[:ripe]), np.arange(ripe, n)])
                    for column in (start, state, over_usual, over_least):
                        column[: len(kept)] = column[kept]
                    n, full = len(kept), max(64, 2 * len(kept))
            if i == len(value):
                break
            if i == 0 or value[i - 1] in SEPARATORS:
                start[n], state[n], over_usual[n], over_least[n] = i, 0, 0.0, 0.0
                n += 1
            step = chance[state[:n], codes[i]]
            over_usual[:n] += step - usual[i]
            over_least[:n] += step - automaton.least
            state[:n] = after[state[:n], codes[i]]
            if value[i].isdigit():
                digit = i
            elif value[i].isalpha():
                letter = i
    out: list[tuple[int, int]] = []
    for end, (_, begin) in sorted(best.items()):
        while out and out[-1][0] >= begin:
            out.pop()
        if not out or begin > out[-1][0]:
            out.append((begin, end))
    return out


def _leading(state: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places, in order, of those that none of the same state equals or passes in both ``a`` and ``b``."""
    order = np.lexsort((-b, -a, state))
    kept, most, at = [], -np.inf, -1
    for k in order:
        if state[k] != at:
            at, most = state[k], -np.inf
        if b[k] > most:
            most = b[k]
            kept.append(k)
    return np.sort(np.array(kept, np.int64))


def format_spans(found: Sequence[dict], automata: dict[str, Automaton], plain: dict[str, float], threshold: float) -> list[dict]:
    """The ``format`` spans of a text's candidates."""
    out = []
    for s in found:
        for begin, end in secret_parts(s["value"], automata, plain, threshold):
            out.append({"kind": "format", "start": s["start"] + begin, "end": s["start"] + end, "value": s["value"][begin:end]})
    return out


def find_secrets(docs: DataFrame, fit_values: int = FIT_VALUES, alpha: float = ALPHA, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end, value), by start, then kind; spans holds base and format spans."""
    scanned = stage(scan(docs), "secret-candidates")
    automata, plain = fit(scanned, fit_values, alpha)
    shared = docs.sparkSession.sparkContext.broadcast((automata, plain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, plain = shared.value
        for batch in batches:
            spans = []
            for base, more in zip(batch["base"].to_pylist(), batch["candidates"].to_pylist(), strict=True):
                found = base + format_spans(more, automata, plain, threshold)
                spans.append(sorted(found, key=lambda s: (s["start"], KINDS.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["base"].cast(SPAN_TYPE), pa.array(spans, SPAN_TYPE)], names=["doc_id", "base", "spans"])

    return scanned.transform(few_rows).mapInArrow(run, f"doc_id long, base array<{SPAN}>, spans array<{SPAN}>")


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: float = THRESHOLD, **fitting) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; all rows and columns stay.

    The automata are fitted first; each text is then scanned where it lies, so
    rows need no key and no text is moved.
    """
    scanned = stage(scan(docs), "secret-candidates")
    shared = docs.sparkSession.sparkContext.broadcast(fit(scanned, **fitting))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, plain = shared.value
        for batch in batches:
            texts = [_without(t, automata, plain, threshold, mark) if t else t for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.transform(few_rows).mapInArrow(run, docs.schema)


def _without(text: str, automata: dict, plain: dict, threshold: float, mark: str) -> str:
    base = base_spans(text)
    spans = [(s, e) for _, s, e, _ in base]
    for _, s, _, value in candidates(text, base):
        spans += [(s + begin, s + end) for begin, end in secret_parts(value, automata, plain, threshold)]
    out, end = [], 0
    for s, e in sorted(spans):
        if s >= end:
            out += (text[end:s], mark)
        end = max(end, e)
    return "".join(out) + text[end:] if spans else text
