"""Language ID by unigrams over pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary (``piece_bpe_32k.model``).
Each language has a probability per piece.  A word's probability is the sum,
over every way to cut it into pieces, of the product of their probabilities;
a forward pass over its letters gives that sum.  Probabilities are fitted by
expectation-maximisation: a backward pass gives each piece's expected count.

Fitting reads at most ``fit_docs`` labelled texts per language (those of lowest
hashed doc_id), which bounds the word table; each step is a Spark job over that
table, and only a (language, piece) table, bounded by languages x vocabulary,
comes back to the driver.  Prediction works on whole texts without a shuffle.

Words are runs of letters, lower-cased; a run over ``MAX_RUN`` letters is cut
into parts of that length.  A letter outside the vocabulary counts as a piece
of probability ``OTHER`` in every language.  The score is the posterior of the
predicted language, languages being equally likely before the text; equal
scores go to the language that sorts first.

Null text, or one without a letter: ``und`` with score 0.  With nothing to
learn from, every text is ``und``.  Repeated rows are predicted alike, an empty
table gives an empty result, and columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tasteforge.llm.common import few_rows
from tasteforge.sources.shared import stage

FIT_DOCS = 1500
STEPS = 3
MAX_RUN = 48
MAX_PIECE = 16
OTHER = 1e-6
SMOOTHING = 0.05
UNDETERMINED = "und"
OUTPUTS = ("lang_pred", "score", "held_out")
LETTERS = re.compile(r"[^\W\d_]+")
CACHED_WORDS, CACHED_LETTERS = 100_000, 5_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary as a sorted table of piece hashes, looked up for many substrings at once.

    A substring's hash is a polynomial in its code points, so the hashes of all
    substrings of a given length follow from one pass over the words.  Two
    pieces of one hash would be refused when the table is built.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size())}
        self.names = sorted(n for n in names if LETTERS.fullmatch(n) and len(n) <= MAX_PIECE)
        hashes = np.array([self._hash(n) for n in self.names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order.astype(np.int64)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        self.longest = max(map(len, self.names))

    def _hash(self, text: str) -> int:
        value = 0
        for c in text:
            value = (value * self.BASE + ord(c) + 1) % 2**64
        return value

    def of_substrings(self, chars: np.ndarray, longest: int) -> np.ndarray:
        """ids[w, i, k]: the piece that ends before place i + 1 of word w and has k + 1 letters; -1 if none.

        ``chars`` holds words of one length as rows of code points.
        """
        n, length = chars.shape
        out = np.full((n, length, min(longest, length)), -1, np.int64)
        value = np.zeros_like(chars, np.uint64)
        plain = chars.astype(np.uint64) + np.uint64(1)
        power = 1
        for k in range(out.shape[2]):
            # Hash of the k + 1 letters that end at i: the new letter stands in front.
            value[:, k:] = value[:, k:] + plain[:, : length - k] * np.uint64(power)
            power = power * self.BASE % 2**64
            found = value[:, k:]
            at = np.searchsorted(self.hashes, found).clip(max=len(self.hashes) - 1)
            out[:, k:, k] = np.where(self.hashes[at] == found, self.ids[at], -1)
        return out


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(ids: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """ratio[w, i, l]: probability of the first i + 1 letters of word w in language l over that of the first i, over all cuts.

    ``probability`` has a row per piece and a last row for "not a piece" (0).
    """
    n, length, longest = ids.shape
    ratio = np.empty((n, length, probability.shape[1]))
    # behind[:, k]: probability of the letters up to k back, over that of all letters so far.
    behind = np.zeros((n, longest, probability.shape[1]))
    behind[:, 0] = 1.0
    for i in range(length):
        share = probability[ids[:, i]]
        share[ids[:, i, 0] < 0, 0] = OTHER
        ratio[:, i] = (share * behind).sum(axis=1)
        behind[:, 1:] = behind[:, :-1] / ratio[:, i, None]
    return ratio


def backward(ids: np.ndarray, probability: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """cut[w, i, l]: probability that word w is cut before letter i, given its letters."""
    n, length, longest = ids.shape
    cut = np.ones((n, length + 1, probability.shape[1]))
    for i in range(length - 1, -1, -1):
        k = np.arange(min(longest, length - i))
        piece = ids[:, i + k, k]
        share = probability[piece]
        share[piece[:, 0] < 0, 0] = OTHER
        cut[:, i] = (share * cut[:, i + k + 1] / ratio[:, i + k].cumprod(axis=1)).sum(axis=1)
    return cut


def by_length(words: Sequence[str], at_most: int = 4096, letters: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, their letters as a matrix) for words of one length at a time; of long words, fewer at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    begin = 0
    while begin < len(order):
        length = lengths[order[begin]]
        end = min(begin + max(1, min(at_most, letters // int(length))), int(np.searchsorted(lengths[order], length, "right")))
        chosen = order[begin:end]
        joined = "".join(words[i] for i in chosen)
        yield chosen, np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(chosen), length)
        begin = end


def runs(text: str) -> list[str]:
    """The letter runs of a text, lower-cased."""
    return LETTERS.findall(text.lower())


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


class Model:
    """Languages in order, and log-scale-free piece probabilities: (pieces + 1) x languages, last row 0."""

    def __init__(self, path: str, languages: list[str], probability: np.ndarray):
        self.path, self.languages, self.probability = path, languages, probability

    def score(self, words: Sequence[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        table = pieces(self.path)
        out = np.zeros((len(words), len(self.languages)))
        for chosen, chars in by_length(words):
            out[chosen] = np.log(forward(table.of_substrings(chars, table.longest), self.probability)).sum(axis=1)
        return out


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS, steps: int = STEPS, path: str | None = None) -> Model:
    """Model from (doc_id, text, lang); rows with null lang or text are left out."""
    path = path or default_path()
    usable = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    # Ids are ranked without their texts and pruned in each task before they meet.
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    ranked = usable.select("doc_id", "lang").withColumn("_place", F.row_number().over(by_hash)).filter(F.col("_place") <= fit_docs)
    sample = usable.join(ranked.select("doc_id").distinct(), "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for word in runs(text):
                    counts[lang, word] = counts.get((lang, word), 0) + 1
            keys = list(counts)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n"])

    counted = sample.select("lang", "text").transform(few_rows).mapInArrow(count, "lang string, word string, n long")
    words = stage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    table = pieces(path)
    probability = np.vstack([np.full((len(table.names), len(languages)), 1.0 / len(table.names)), np.zeros((1, len(languages)))])
    for _ in range(steps if languages else 0):
        expected = np.full((len(table.names), len(languages)), SMOOTHING)
        for row in expected_counts(words, Model(path, languages, probability)).collect():
            expected[row["piece"], languages.index(row["lang"])] += row["n"]
        probability = np.vstack([expected / expected.sum(axis=0), np.zeros((1, len(languages)))])
    return Model(path, languages, probability)


def expected_counts(words: DataFrame, model: Model) -> DataFrame:
    """E step: expected count of each (lang, piece) over all cuts of the counted words."""
    shared = words.sparkSession.sparkContext.broadcast((model.path, model.languages, model.probability))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, languages, probability = shared.value
        table = pieces(path)
        total = np.zeros((len(table.names) + 1, len(languages)))
        for batch in batches:
            text, n = batch["word"].to_pylist(), batch["n"].to_numpy()
            lang = np.array([languages.index(x) for x in batch["lang"].to_pylist()], np.int64)
            for chosen, chars in by_length(text):
                ids = table.of_substrings(chars, table.longest)
                # Each word is worked out in its own language only.
                for own in np.unique(lang[chosen]):
                    rows = np.flatnonzero(lang[chosen] == own)
                    mine, share = ids[rows], probability[:, own : own + 1]
                    ratio = forward(mine, share)
                    cut, passed = backward(mine, share, ratio)[..., 0], np.ones_like(ratio[..., 0])
                    for k in range(mine.shape[2]):
                        piece = mine[:, k:, k]
                        # Probability of the k + 1 letters from each place on, given those before.
                        passed = passed[:, : piece.shape[1]] * ratio[:, k:, 0]
                        part = share[piece, 0] * cut[:, k + 1 :] / passed * n[chosen[rows], None]
                        np.add.at(total[:, own], piece.ravel(), part.ravel())
        for own, lang_name in enumerate(languages):
            found = np.flatnonzero(total[:-1, own] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang_name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(total[found, own])], names=["lang", "piece", "n"]
            )

    return words.transform(few_rows).mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows: new words are scored together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score; text and rows are left as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.path, model.languages, model.probability))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    chosen = docs.select(*kept)
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        known: dict[str, int] = {}
        letters = 0
        scores = np.zeros((0, len(own.languages)))
        for batch in gathered(batches):
            texts = [runs(t) if t else [] for t in batch.column(at).to_pylist()]
            if len(known) > CACHED_WORDS or letters > CACHED_LETTERS:
                known, letters, scores = {}, 0, scores[:0]
            new = list({w for words in texts for w in words if w not in known})
            letters += sum(map(len, new))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            scores = np.vstack([scores, own.score(new)]) if new else scores
            langs, values = [], []
            for words in texts:
                if not words or not own.languages:
                    langs.append(UNDETERMINED)
                    values.append(0.0)
                    continue
                total = scores[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0)
                best = int(np.argmax(total))
                langs.append(own.languages[best])
                values.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(values, pa.float64())], names=[*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return chosen.transform(few_rows).mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS, steps: int = STEPS, path: str | None = None) -> DataFrame:
    """Fit on the labelled rows that are not held out, then predict every row; adds held_out too."""
    model = fit(docs.filter(~held_out()), fit_docs, steps, path)
    return predict(docs.withColumn("held_out", held_out()), model)
