"""Whitening, nearest neighbours and periodic runs against brute force, on awkward rows and on empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasteforge.llm import kmeans_tree, nearest, periodic_runs, queries, whitening

SF_DIR = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<float>, label int, rank int, component string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def awkward_vectors(width=6, rows=300):
    """Copies of one vector, ties, repeated rows, null ids, and vectors that take no part."""
    draw = np.random.default_rng(3)
    good = [(n, [float(v) for v in draw.normal(size=width).astype(np.float32)], n % 3, None, None) for n in range(rows)]
    hot = [(1000 + n, [3.0] * width, None, 1, "x") for n in range(80)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * (width - 1), [None] + [1.0] * (width - 1), [nan] * width, [inf] + [0.0] * (width - 1)]
    odd = [(2000 + 20 * n, v, None, None, None) for n, v in enumerate(bad)]
    more = [(None, [0.5] * width, 1, 1, "y"), (-20, [0.25] * width, 1, 1, "y"), (20, [2.0] * width, 1, 1, "z"), (3000, [0.0] * width, 1, 1, "z")]
    return good + hot + odd + more + [good[0], good[40]]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(awkward_vectors(), VECTORS).repartition(3).cache()


@pytest.fixture(scope="module")
def given_vectors(spark):
    return spark.read.parquet(f"{SF_DIR}/embeddings.parquet").cache()


def whiten_by_hand(table, most=32):
    x = np.floor(64 * np.array([v for _, v in table], np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    exact = n * x.astype(object) - total
    centred = (n * x - total) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    return [sum(v * v for v in row) for row in exact], centred @ parts[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()


@pytest.mark.parametrize("which", ["vectors", "given_vectors"])
def test_whitening(request, which):
    df = request.getfixturevalue(which)
    width = 6 if which == "vectors" else 64
    usable = lambda v: v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)
    table = [(r["vec_id"], r["embedding"]) for r in df.collect() if usable(r["embedding"])]
    deviation, whitened, explained = whiten_by_hand(table)
    most = whitened.shape[1]
    got = whitening.whiten(df).collect()
    assert len(got) == len(table) * most and {r["n"] for r in got} == {len(table)}
    assert max(r["identity_error"] for r in got) < 1e-9
    for r in got:
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    # One sign for each component, taken from the row that lies farthest out.
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
    want = {(i, d): row for (i, _), d, row in zip(table, deviation, whitened)}
    assert set(by) == set(want)
    for c in range(most):
        far = max(want, key=lambda key: abs(want[key][c]))
        sign = 1 if by[far][c + 1] * want[far][c] > 0 else -1
        assert max(abs(sign * by[key][c + 1] - want[key][c]) for key in want) < 1e-9


def test_whitening_without_spread(spark):
    kind = "vec_id long, embedding array<double>"
    for table in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(table, kind)).collect() == []
    # A constant dimension and one that follows another leave one component.
    flat = whitening.whiten(spark.createDataFrame([(n, [float(n), 2.0 * n, 7.0]) for n in range(10)], kind)).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 10 and flat[0]["identity_error"] < 1e-9
    # Numbers beyond 64 bits: the deviation is exact or null, never wrong.
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 2.0]), (2, [-1e300, 5.0]), (3, [1.0, 1.0])], kind)).collect()
    assert {r["vec_id"]: r["deviation"] is None for r in huge} == {1: True, 2: True, 3: False}


def test_whitening_of_nearly_dependent_rows(spark):
    draw = np.random.default_rng(0)
    rows = draw.normal(size=(2000, 8)) * 10.0 ** np.arange(8)
    df = spark.createDataFrame([(n, [float(v) for v in row]) for n, row in enumerate(rows)], "vec_id long, embedding array<double>")
    fitted = whitening.fit_whitening(whitening.usable(df, "vec_id", "embedding"))
    x = np.floor(64 * rows)
    singular = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert fitted.passes >= 2
    np.testing.assert_allclose(fitted.eigenvalues, singular**2 / 2000, rtol=1e-9)
    got = whitening.whiten(df).agg(F.max("identity_error")).first()[0]
    assert got < 1e-6


def nearest_by_hand(table, width, asks, k=20):
    usable = lambda v: v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v) and any(v)
    table = sorted({(i, tuple(v)) for i, v in table if usable(v)}, key=lambda r: (r[0] is None, r[0] or 0))
    entries = np.array([v for _, v in table], np.float64)
    found = {}
    for n, (i, v) in enumerate(table):
        if i is None or not asks(i):
            continue
        score = np.zeros(len(table))
        for j in range(width):
            score += entries[n, j] * entries[:, j]
        order = sorted((m for m in range(len(table)) if m != n), key=lambda m: (-score[m], table[m][0] is None, table[m][0] or 0))
        found[(i, v)] = [(table[m][0], score[m]) for m in order[:k]]
    return found


def lists_of(df):
    lists = {}
    for r in df.collect():
        lists.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert all(sorted(ranks) == list(range(1, len(ranks) + 1)) for ranks in lists.values())
    return {i: [ranks[r] for r in sorted(ranks)] for i, ranks in lists.items()}


def test_nearest_is_exact_when_all_leaves_are_visited(vectors):
    want = nearest_by_hand([(r["vec_id"], r["embedding"]) for r in vectors.collect()], 6, lambda i: i % 20 == 0)
    # Two rows with id 20 ask apart, so their lists are compared elsewhere.
    want = {i: hits for (i, v), hits in want.items() if i != 20}
    df = nearest.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, leaf_rows=16, shard_rows=50, recall=1.1)
    got = lists_of(df.filter("query_id <> 20"))
    assert got == want
    assert df.filter("query_id = 20").count() == 40
    # Copies of one vector: the smallest ids first, the query's own row left out.
    assert [i for i, _ in got[1020]][:5] == [1000, 1001, 1002, 1003, 1004] and 1020 not in [i for i, _ in got[1020]]


def test_nearest_reaches_its_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = nearest_by_hand([(r["vec_id"], r["embedding"]) for r in df.collect()], 64, lambda i: i % 20 == 0)
    got = lists_of(nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0))
    assert {len(hits) for hits in got.values()} == {20} and len(got) == len(want)
    met = sum(len({i for i, _ in hits} & {i for i, _ in got[query]}) for (query, _), hits in want.items())
    assert met >= 0.9 * 20 * len(want)
    for (query, _), hits in want.items():
        exact = dict(hits)
        assert all(score == exact[i] for i, score in got[query] if i in exact)


def test_nearest_small_tables(spark):
    kind = "vec_id long, embedding array<double>"
    ask = F.col("vec_id") % 20 == 0
    run = lambda table: lists_of(nearest.nearest_neighbours(spark.createDataFrame(table, kind), ask))
    assert run([]) == {} and run([(0, [1.0, 1.0])]) == {} and run([(0, None), (20, [0.0, 0.0])]) == {}
    assert run([(1, [1.0]), (2, [2.0])]) == {}
    assert run([(0, [1.0, 1.0]), (5, [2.0, 0.5]), (7, [-1.0, 0.0])]) == {0: [(5, 2.5), (7, -1.0)]}


def test_tree_walks_meet_each_leaf_once():
    rows = np.random.default_rng(1).normal(size=(500, 8))
    tree = kmeans_tree.grow(rows, 20)
    assert tree.leaves > 20
    for walk in tree.visits(rows[:5]):
        assert sorted(walk) == list(range(tree.leaves))
    assert kmeans_tree.grow(np.ones((100, 4)), 10).leaves == 1


def runs_by_hand(words, least=12):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        start = 0
        while start < len(words) - period:
            end = start
            while end < len(words) - period and words[end] == words[end + period]:
                end += 1
            length = end - start + period
            if end > start and length >= max(least, 2 * period):
                found.setdefault((start, length), period)
            start = max(end, start + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    draw = random.Random(5)
    for _ in range(600):
        kinds = draw.choice([1, 2, 3, 6, 40])
        words = [draw.randrange(kinds) for _ in range(draw.randrange(100))]
        for _ in range(draw.randrange(3)):
            period = draw.randrange(1, 25)
            base = [draw.randrange(kinds + 2) for _ in range(period)]
            at = draw.randrange(len(words) + 1)
            words[at:at] = (base * 5)[: draw.randrange(period, 5 * period)]
        got = periodic_runs.runs_in(np.array(words + [-1]), np.array([len(words)]))
        assert [tuple(map(int, r)) for r in got] == runs_by_hand(words)


def test_splitting_keeps_runs_and_comes_to_rest():
    # Each split makes the word before the last one rare: the text is peeled word by word.
    peeled = [0]
    for n in range(1, 300):
        peeled += [n, n - 1]
    starts, _ = periodic_runs.split(np.array(peeled + [-1]), np.array([len(peeled)]))
    assert len(starts) == 0
    # Only the inner part, twelve words of period three, survives two levels.
    words = [90, 1, 91] + [7, 8, 9] * 4 + [92, 1, 93]
    starts, ends = periodic_runs.split(np.array(words + [-1]), np.array([len(words)]))
    assert list(zip(starts, ends)) == [(3, 15)]


def documents_for_runs():
    phrase = " ".join(f"w{k}" for k in range(7))
    odd = " ".join(["a b a b c"] * 6)
    texts = [None, "", " \t\n", "one", "same " * 12, "same " * 11, phrase + " " + phrase + " end", odd, "x y " * 40, ("verse one two three four five\n" * 9)]
    rows = [(n, t, "en", t, 0) for n, t in enumerate(texts)] + [(n, " ".join(f"q{(n * k) % 17}" for k in range(120)), None, None, 1) for n in range(10, 60)]
    long = " ".join(f"z{k % 5000}" for k in range(40_000))
    return rows + [(None, "again and " * 20, None, None, 1), (9, texts[9], "en", None, 0), (-7, texts[7], None, None, 2), (10**12 + 2, long, None, None, 3)]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@pytest.mark.parametrize("which", ["odd", "given"])
def test_periodic_runs(spark, which, tmp_path):
    if which == "odd":
        df = spark.createDataFrame(documents_for_runs(), "doc_id long, text string, lang string, kept string, runs int")
        df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        folder = str(tmp_path)
    else:
        folder, df = SF_DIR, spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = []
    for r in df.collect():
        words = planted(r["doc_id"], [w for w in SPACE.split(r["text"] or "") if w])
        runs = runs_by_hand(words) if len(words) < 5000 else [(0, 40_000, 5000)]
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        spans = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        want.append((r["doc_id"], len(runs), *spans, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    got = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, folder).collect()]
    key = lambda row: (row[0] is None, row[0] or 0, row[-1])
    assert sorted(got, key=key) == sorted(want, key=key)
    if which == "given":
        assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got) > 5


def test_periodic_runs_of_an_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
