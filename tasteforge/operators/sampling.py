"""Key samples, negative candidates and the candidate table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tasteforge.functions.hashing import uniform
from tasteforge.operators.prep import ITEM, USER
from tasteforge.operators.skew import ROWS_PER_SLICE, SLICE, SLICES, add_slice, hot_keys, join_chain, join_sliced, positions, repeat_slices
from tasteforge.sources.shared import stage

GROUP = ["top_category", "state"]
CANDIDATE = "candidate_id"

# Rounds of the shuffle that gives every pair its own order, and the prime that
# its coin tosses are taken under.
ROUNDS = 8
PRIME = 2**31 - 1
# The bit of a number that is the coin: low ones follow the places' own parity too closely.
COIN = 1024
# Tasks that draw, as a multiple of the shuffle partitions: pairs are few bytes
# before they are multiplied, so adaptive execution would put them together.
DRAW_TASKS = 4

# Groups smaller than this are repeated so that their few members do not become
# the hot keys of the lookup join.
SPREAD = 256

# Largest group whose members are held as one array.
LISTED = 100_000
# Pairs whose places are worked out at a time.
PAIRS_AT_ONCE = 500
WORDS = ["_w0", "_w1", "_w2", "_w3"]
# A pair's numbers that are left out.
SKIP = "_skip"


def sample_keys(df: DataFrame, key: str, ratio: float, seed: int = 24) -> DataFrame:
    """A Bernoulli sample of the distinct keys."""
    return df.select(key).distinct().filter(uniform(seed, key) <= ratio)


def sample_dataset(
    ratings: DataFrame,
    item_ratio: float,
    user_ratio: float,
    seed: int = 24,
    user: str = USER,
    item: str = ITEM,
) -> DataFrame:
    """Ratings whose user and item were both sampled.

    Whether a key is in the sample depends on the key alone, so the two semi
    joins of the definition are two filters: nothing is shuffled.
    """
    if item_ratio <= 0:
        raise ValueError(f"item ratio {item_ratio} must be greater than 0")
    if user_ratio == 1 and item_ratio == 1:
        return ratings
    return ratings.filter(
        F.col(user).isNotNull()
        & F.col(item).isNotNull()
        & (uniform(seed, user) <= user_ratio)
        & (uniform(seed, item) <= item_ratio)
    )


def number_items(items: DataFrame, seed: int = 7, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Items with a shuffled place in their (category, state) group and its size."""
    drawn = items.select(ITEM, *GROUP).withColumn("_u", uniform(seed, ITEM))
    placed = positions(drawn, GROUP, "_u", [ITEM], rows_per_slice=rows_per_slice)
    return placed.select(ITEM, *GROUP, F.col("_before").alias("_place"), F.col("_total").alias("_group_size"))


def candidate_pool(test: DataFrame, items: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Each test pair with its group and the number of other items in it.

    The pool is named, not spelled out: listing every item of the group for
    every test pair would grow with the square of the group.
    """
    sizes = items.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_group_size"))
    # Items meet their group's size first: the test pairs are joined once.
    sized = join_sliced(items.select(ITEM, *GROUP), sizes, GROUP, rows_per_slice=rows_per_slice)
    pooled = join_sliced(test.select(USER, ITEM).distinct(), sized, [ITEM], rows_per_slice=rows_per_slice)
    return pooled.select(USER, ITEM, *GROUP, (F.col("_group_size") - 1).alias("pool_size"))


def sample_negatives(
    test: DataFrame,
    items: DataFrame,
    per_pair: int = 200,
    seed: int = 7,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """(user_id, business_id, candidate_id): negatives for each test pair.

    Every pair gets min(per_pair, group size - 1) different items of its item's
    (category, state) group, never the item itself.  The group is numbered once;
    a pair draws the first places of its own order of the other members
    (``shuffled_place``).  The cost is pairs x per_pair lookups, whatever the
    group size: in an array of the group's members up to LISTED of them, by a
    join beyond.
    """
    return draw_negatives(test, items, per_pair, seed, rows_per_slice).rows()


@dataclass(frozen=True)
class Draws:
    """Negatives of test pairs that are not spelled out yet: ``rows`` gives those of ``sample_negatives``.

    What a step takes away is taken from the pairs, or noted beside a pair as
    numbers in its order (``SKIP``, null where there are none), so that no drawn
    row is shuffled to find out that it goes.
    """

    pairs: DataFrame
    numbered: DataFrame
    per_pair: int
    rows_per_slice: int
    user_terms: tuple[str, ...] = ()
    item_terms: tuple[str, ...] = ()

    def rows(self) -> DataFrame:
        """(user_id, business_id, candidate_id), and the terms of user and candidate if there are any."""
        listed, terms = F.col("_group_size") <= LISTED, {"user_terms": self.user_terms, "item_terms": self.item_terms}
        short = from_lists(self.pairs.filter(listed), self.numbered.filter(listed), self.per_pair, self.rows_per_slice, **terms)
        return short.unionByName(from_places(self.pairs.filter(~listed), self.numbered.filter(~listed), self.per_pair, **terms))

    def with_terms(self, users: DataFrame, items: DataFrame) -> "Draws":
        """With further columns of (user_id, ..) and (business_id, ..), one row per id, null for others: pairs and items meet them, not candidates."""
        return replace(
            self,
            pairs=join_sliced(self.pairs, users, [USER], "left", rows_per_slice=self.rows_per_slice),
            numbered=join_sliced(self.numbered, items, [ITEM], "left", rows_per_slice=self.rows_per_slice),
            user_terms=tuple(c for c in users.columns if c != USER),
            item_terms=tuple(c for c in items.columns if c != ITEM),
        )

    def lists(self) -> DataFrame:
        """``rows`` with the candidates of a pair as one array; groups too large to be listed have one row per candidate."""
        listed = F.col("_group_size") <= LISTED
        short = from_lists(self.pairs.filter(listed), self.numbered.filter(listed), self.per_pair, self.rows_per_slice, spelled=False)
        long = from_places(self.pairs.filter(~listed), self.numbered.filter(~listed), self.per_pair)
        return short.unionByName(long.withColumn(CANDIDATE, F.array(CANDIDATE)))

    def without_pairs(self, seen: DataFrame) -> "Draws":
        """Without the pairs in ``seen`` (user_id, business_id)."""
        return replace(self, pairs=self.pairs.join(seen, [USER, ITEM], "left_anti"))

    def without_rated(self, train: DataFrame) -> "Draws":
        """Without candidates that the user has a row of in ``train``."""
        keys = [USER, ITEM, "_group", "_first"]
        # Two rows of one pair differ in group or place: an item may be repeated.
        skips = traced(train, self.pairs, self.numbered, self.per_pair, self.rows_per_slice).groupBy(*keys).agg(F.collect_set("_number").alias(SKIP))
        pairs = self.pairs.drop(SKIP).withColumn("_group", F.xxhash64(*GROUP))
        return replace(self, pairs=pairs.join(stage(skips, "seen-numbers"), keys, "left").drop("_group"))

    def truth(self) -> DataFrame:
        """(user_id, business_id) of the pairs that have a negative left; a group without a name has no members."""
        left = F.least(F.lit(self.per_pair), "_others") > F.coalesce(F.size(F.col(SKIP)), F.lit(0))
        named = F.col(GROUP[0]).isNotNull() & F.col(GROUP[1]).isNotNull()
        return self.pairs.filter(left & named & (F.lit(self.per_pair) > 0)).select(USER, ITEM).distinct()


def draw_negatives(
    test: DataFrame, items: DataFrame, per_pair: int = 200, seed: int = 7, rows_per_slice: int = ROWS_PER_SLICE
) -> Draws:
    """The negatives of ``sample_negatives``, not spelled out yet."""
    # Read by item for the pairs, and by group for the draws.
    numbered = stage(number_items(items, seed, rows_per_slice), "numbered-items")
    return Draws(keyed_pairs(test, numbered, seed, rows_per_slice), numbered, per_pair, rows_per_slice)


def keyed_pairs(test: DataFrame, numbered: DataFrame, seed: int, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Test pairs with their group, the first place that they may draw and the four words that key their order."""
    pairs = join_sliced(test.select(USER, ITEM).distinct(), numbered, [ITEM], rows_per_slice=rows_per_slice)
    size = F.col("_group_size")
    words = [F.conv(F.substring("_digest", 8 * n + 1, 8), 16, 10).cast("long").alias(f"_w{n}") for n in range(4)]
    # The other members form a ring that begins after the item's own place.
    pairs = pairs.filter(size > 1).withColumn("_digest", F.md5(F.concat_ws("|", USER, ITEM, F.lit(f"{seed}-order"))))
    skip = F.lit(None).cast("array<int>").alias(SKIP)
    return pairs.select(USER, ITEM, *GROUP, "_group_size", (size - 1).alias("_others"), (F.col("_place") + 1).alias("_first"), *words, skip)


def drawn_places(per_pair: int) -> Column:
    """The places that a pair draws, worked out in its row."""
    return F.expr(f"transform(sequence(0L, least({per_pair}L, _others) - 1), _j -> (_first + {shuffled_place('_j')}) % _group_size)")


def kept_places(places: str | Column) -> Column:
    """A pair's places without those of the numbers in SKIP."""
    kept = F.filter(places, lambda _, number: ~F.array_contains(SKIP, number))
    return F.when(F.col(SKIP).isNull(), places).otherwise(kept)


def listed_places(per_pair: int) -> Callable[..., Column]:
    """``drawn_places`` for groups of at most LISTED members, worked out for many pairs at once."""

    @F.arrow_udf("array<int>")
    def places(first: pa.Array, others: pa.Array, w0: pa.Array, w1: pa.Array, w2: pa.Array, w3: pa.Array) -> pa.Array:
        given = [c.to_numpy(zero_copy_only=False) for c in (first, others, w0, w1, w2, w3)]
        found = [np.zeros(0, np.int32)]
        for at in range(0, len(first), PAIRS_AT_ONCE):
            found.append(_places(per_pair, *(c[at : at + PAIRS_AT_ONCE] for c in given)))
        ends = np.concatenate([[0], np.cumsum(np.minimum(per_pair, given[1]))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))

    return places


def _places(per_pair: int, first: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The places of all pairs, one pair after the other: the rounds of ``shuffle_round``."""
    counts = np.minimum(per_pair, keys[0])
    first, others, w0, w1, w2, w3 = (np.repeat(c, counts) for c in (first, *keys))
    x = (np.arange(len(first)) - np.repeat(np.cumsum(counts) - counts, counts) + w0) % others
    for n in range(ROUNDS):
        y = ((w1 * (2 * n + 1) + w2 * n * n) % PRIME % others - x + others) % others
        coin = (np.maximum(x, y) * (1 + (w3 + n * w0) % (PRIME - 1)) + w2 + n * w3) % PRIME & COIN
        x = np.where(coin == COIN, y, x)
    return ((first + x) % (others + 1)).astype(np.int32)


def from_lists(
    pairs: DataFrame, numbered: DataFrame, per_pair: int, rows_per_slice: int, spelled: bool = True, user_terms: Sequence[str] = (), item_terms: Sequence[str] = ()
) -> DataFrame:
    """Draws from groups whose members fit one array: pairs meet their group's array, and no drawn row is shuffled.

    A group of many pairs is cut into slices, counted by the rows that pairs
    become.  Places are worked out after the shuffle and the sort, so neither
    moves them.  Unless ``spelled``, a pair's candidates stay one array.
    """
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = numbered.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("_place", ITEM, *item_terms))).alias("_entries"))
    lists = {ITEM: "_members", **{c: f"_members_{c}" for c in item_terms}}
    members = entries.select(*GROUP, *[F.col("_entries")[c].alias(name) for c, name in lists.items()])
    hot = hot_keys(pairs, GROUP, max(1, rows_per_slice // max(1, per_pair)))
    keys = [*GROUP, SLICE]
    dealt = add_slice(pairs, GROUP, hot).drop(SLICES).repartition(DRAW_TASKS * tasks, *keys).sortWithinPartitions(*keys)
    placed = dealt.select(USER, ITEM, *user_terms, SKIP, *keys, listed_places(per_pair)("_first", "_others", *WORDS).alias("_places"))
    joined = placed.join(repeat_slices(members, GROUP, hot).hint("merge"), keys)
    if not spelled:
        return joined.select(USER, ITEM, F.transform(kept_places(F.col("_places")), lambda at: F.get("_members", at)).alias(CANDIDATE))
    places = F.explode_outer(kept_places(F.col("_places"))).alias("_at")
    each = joined.select(USER, ITEM, *user_terms, *lists.values(), places).filter(F.col("_at").isNotNull())
    terms = [F.get(lists[c], F.col("_at")).alias(c) for c in item_terms]
    return each.select(USER, ITEM, F.get("_members", F.col("_at")).alias(CANDIDATE), *user_terms, *terms)


def from_places(pairs: DataFrame, numbered: DataFrame, per_pair: int, user_terms: Sequence[str] = (), item_terms: Sequence[str] = ()) -> DataFrame:
    """Draws from groups of any size: every drawn place is looked up by a join."""
    size = F.col("_group_size")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out before they are multiplied.  A pair's places are worked out in its row, below the explode, which is an
    # outer one because Spark would put a test for empty lists, with all rounds in it, below any other.
    dealt = pairs.withColumn("_repeat", F.pmod(F.xxhash64(USER, ITEM), _repeats(size))).repartition(DRAW_TASKS * tasks, USER, ITEM)
    placed = dealt.select(USER, ITEM, *user_terms, *GROUP, SKIP, "_repeat", drawn_places(per_pair).alias("_places"))
    drawn = placed.select(USER, ITEM, *user_terms, *GROUP, "_repeat", F.explode_outer(kept_places(F.col("_places"))).alias("_place"))
    looked_up = numbered.select(
        *GROUP,
        "_place",
        F.col(ITEM).alias(CANDIDATE),
        *item_terms,
        F.explode(F.sequence(F.lit(0).cast("long"), _repeats(size) - 1)).alias("_repeat"),
    )
    return drawn.join(looked_up, [*GROUP, "_place", "_repeat"]).select(USER, ITEM, CANDIDATE, *user_terms, *item_terms)


def shuffle_round(n: str, x: str, y: str) -> tuple[str, str]:
    """Texts of a round, for Spark and for DuckDB: the partner of place ``x``, and the place after the round, given the partner as ``y``.

    A round pairs x with K - x, for a key K of the round, and a coin that
    depends on the pair of places decides whether both change: the swap-or-not
    shuffle (Hoang, Morris, Rogaway 2012).  It maps 0 .. _others - 1 onto itself
    for any size, so there is nothing to walk past.
    """
    partner = f"(((_w1 * (2 * {n} + 1) + _w2 * {n} * {n}) % {PRIME} % _others - {x} + _others) % _others)"
    coin = f"((greatest({x}, {y}) * (1 + (_w3 + {n} * _w0) % {PRIME - 1}) + _w2 + {n} * _w3) % {PRIME} & {COIN})"
    return partner, f"(case when {coin} = {COIN} then {y} else {x} end)"


def shuffled_place(number: str) -> str:
    """Text of the place of ``number`` in the order of 0 .. _others - 1 that _w0 .. _w3 key.

    One expression: a column per round would put each round's text into the
    constraints that the optimiser derives for the next.
    """
    partner, _ = shuffle_round("n", "x", "")
    _, moved = shuffle_round("n", "x", partner)
    return f"aggregate(sequence(0, {ROUNDS - 1}), ({number} + _w0) % _others, (x, n) -> {moved})"


def number_of_place(place: str) -> str:
    """Text of the number that ``shuffled_place`` sends to ``place``: the rounds in reverse, each of which undoes itself."""
    partner, _ = shuffle_round("n", "x", "")
    _, moved = shuffle_round("n", "x", partner)
    return f"pmod(aggregate(sequence({ROUNDS - 1}, 0, -1), {place}, (x, n) -> {moved}) - _w0, _others)"


def _repeats(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(SPREAD) / size)).cast("long")


def drop_seen_test_pairs(candidates: DataFrame | Draws, train: DataFrame, test: DataFrame | None = None) -> DataFrame | Draws:
    """Candidates whose test pair does not occur in the training set; of ``Draws``, the pairs themselves go.

    ``test`` are the pairs that the candidates were drawn for: with it the
    training set meets these, not every candidate.
    """
    # A test pair has at most per_pair rows: no key is hot.
    seen = train.select(USER, ITEM).distinct()
    if test is not None:
        # Stored, so that Spark knows its size before it chooses how to join.
        seen = stage(test.select(USER, ITEM).distinct().join(seen, [USER, ITEM], "left_semi"), "seen-pairs")
    if isinstance(candidates, Draws):
        return candidates.without_pairs(seen)
    return candidates.join(seen, [USER, ITEM], "left_anti").select(*candidates.columns)


def drop_seen_candidates(candidates: DataFrame | Draws, train: DataFrame, seen: DataFrame | None = None) -> DataFrame | Draws:
    """Candidates that the user has not rated in the training set.

    ``seen`` are the rows of ``train`` that candidates can meet, if they are
    known (``seen_draws``): they take the place of the whole table.
    """
    if isinstance(candidates, Draws):
        return candidates.without_rated(train if seen is None else seen)
    met = (train if seen is None else seen).select(USER, F.col(ITEM).alias(CANDIDATE)).distinct()
    return candidates.join(met, [USER, CANDIDATE], "left_anti").select(*candidates.columns)


def seen_draws(
    train: DataFrame, test: DataFrame, items: DataFrame, per_pair: int = 200, seed: int = 7, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """(user_id, business_id): training pairs that ``sample_negatives`` draws for a test pair of the user."""
    draws = draw_negatives(test, items, per_pair, seed, rows_per_slice)
    found = traced(train, draws.pairs, draws.numbered, per_pair, rows_per_slice)
    return stage(found.select(USER, F.col("_rated").alias(ITEM)).distinct(), "seen-draws")


def traced(train: DataFrame, pairs: DataFrame, numbered: DataFrame, per_pair: int, rows_per_slice: int) -> DataFrame:
    """(user_id, business_id, _group, _first, _rated, _number): training items that a pair draws, and their number in its order.

    A training item in the group of a test pair is traced back to its number in
    that pair's order, so the draws need not be spelled out to find them.
    """
    keyed = pairs.drop("_group_size", SKIP).withColumn("_group", F.xxhash64(*GROUP))
    placed = numbered.select(F.col(ITEM).alias("_rated"), F.col("_place").alias("_seen"), F.xxhash64(*GROUP).alias("_group"), "_group_size")
    rated = join_sliced(train.select(USER, F.col(ITEM).alias("_rated")), placed, ["_rated"], rows_per_slice=rows_per_slice)
    met = join_sliced(rated, keyed.drop(*GROUP), [USER, "_group"], rows_per_slice=rows_per_slice)
    # A pair's own item is the last of its ring and is never drawn.
    ring = met.withColumn("_x", F.pmod(F.col("_seen") - F.col("_first"), F.col("_group_size"))).filter(F.col("_x") < F.col("_others"))
    drawn = ring.withColumn("_number", F.expr(number_of_place("_x"))).filter(F.col("_number") < per_pair)
    return drawn.select(USER, ITEM, "_group", "_first", "_rated", F.col("_number").cast("int").alias("_number"))


def test_candidates(
    negatives: DataFrame | Draws, test: DataFrame | None = None, terms: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(user_id, candidate_id): the true items and their negatives, duplicates kept.

    The true items are those of ``test``.  Without it they are read off the
    negatives, and a test pair that has none left loses its true item too.
    ``terms``, tables of users and of items (``Draws.with_terms``), come with
    candidates of ``Draws``.
    """
    if isinstance(negatives, Draws):
        known = negatives.truth() if test is None else test
        if terms is not None:
            rows = negatives.with_terms(*terms).rows().drop(ITEM)
            users, items = terms
            truth = join_chain(known.select(USER, ITEM).distinct(), [(users, [USER], "left"), (items, [ITEM], "left")], negatives.rows_per_slice)
            return truth.withColumnRenamed(ITEM, CANDIDATE).unionByName(rows)
        rows = negatives.rows()
    else:
        known, rows = (negatives if test is None else test), negatives
    truth = known.select(USER, F.col(ITEM).alias(CANDIDATE)).distinct()
    return truth.unionByName(rows.select(USER, CANDIDATE))
