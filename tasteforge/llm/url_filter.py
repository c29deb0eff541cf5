"""URL filter: a cascade of Bloom filters that is exact over the corpus's own keys.

Level 0 holds the listed keys.  The keys of the corpus that are not listed but
pass level 0 go into level 1, the listed keys that pass level 1 into level 2,
and so on until no key is wrong.  A key of the corpus is then judged by the
number of the first level it fails: no join, no false answer.  Only built-in
Spark functions are used.

Building a level needs the false positives of the level before, one pass over
the distinct keys.  The bits of a level are collected as one small row per
byte, at most ``max_bits`` of them; a list that would need more is answered by
a plain join (``by_join``), with the same result.

A rule is (host, path): it fits the host and all its subdomains when the path
of the url starts with the rule's, and must end in "/".  The longest rule that
fits wins; of equally long ones the greater by code points.  Where the same
(host, path) is given twice, the last verdict holds.

Null url, or one without "://": host and path empty, no rule, default verdict.
An empty table gives an empty result; repeated rows and further columns pass
through; columns named like an output are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tasteforge.llm.common import ascii_lower
from tasteforge.sources.shared import stage

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MAX_BITS = 1 << 23
HASHES = 7
MAX_LEVELS = 64


def url_host(url: str | Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def url_path(url: str | Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Every (host suffix + path prefix) of a url that has the shape of some rule.

    The shapes (labels of the host, depth of the path) come from the rules, so
    a url has at most as many keys as there are shapes, however long it is.
    """
    shapes = sorted({(h.count(".") + 1, p.count("/")) for h, p in rules})
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    keys = [
        F.when(
            (host != "") & (labels >= k) & (depth >= d),
            F.concat(F.substring_index(host, ".", -k), F.substring_index(path, "/", d), F.lit("/")),
        )
        for k, d in shapes
    ]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


class Level:
    """One Bloom filter: its bits as bytes, tested by built-in functions."""

    def __init__(self, number: int, bits: int, data: bytes):
        self.number, self.bits, self.data = number, bits, data

    def contains(self, key: Column) -> Column:
        data = F.lit(bytearray(self.data))
        passes = F.lit(True)
        for position in bit_positions(key, self.number, self.bits):
            byte = F.conv(F.hex(F.substring(data, (F.shiftright(position, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            passes = passes & (F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(position, F.lit(8)))), F.lit(2)) == 1)
        return passes


def bit_positions(key: Column, number: int, bits: int) -> list[Column]:
    """Places by double hashing: a + j b, both hashes salted with the level."""
    a = F.pmod(F.xxhash64(key, F.lit(2 * number)), F.lit(bits))
    b = F.pmod(F.xxhash64(key, F.lit(2 * number + 1)), F.lit(bits - 1)) + 1
    return [F.pmod(a + b * j, F.lit(bits)) for j in range(HASHES)]


def build_level(keys: DataFrame, number: int, bits: int) -> Level:
    """``keys`` has one column, ``key``.  Bits are or-ed per byte on the map side."""
    places = keys.select(F.explode(F.array(*bit_positions(F.col("key"), number, bits))).alias("place"))
    rows = (
        places.groupBy(F.shiftright("place", 3).alias("byte"))
        .agg(F.bit_or(F.pow(F.lit(2), F.pmod("place", F.lit(8))).cast("int")).alias("mask"))
        .collect()
    )
    data = bytearray((bits + 7) // 8)
    for row in rows:
        data[row["byte"]] = row["mask"]
    return Level(number, bits, bytes(data))


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, key: Column) -> Column:
        """True when the key, one of the universe's, is listed."""
        answer = F.lit(bool(self.levels) and len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(~level.contains(key), F.lit(level.number % 2 == 1)).otherwise(answer)
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> Cascade | None:
    """Cascade for the distinct keys ``listed`` against all of ``universe`` (column ``key``).

    None when a level would need more than ``max_bits``.
    """
    here = listed.distinct()
    away = stage(universe.distinct().join(here, "key", "left_anti"), "unlisted-keys")
    n_here, n_away = here.count(), away.count()
    levels: list[Level] = []
    if not n_here:
        return Cascade(levels)
    inside, outside, n = here, away, n_here
    while n:
        number = len(levels)
        if number == MAX_LEVELS:
            raise RuntimeError("the cascade does not end: keys of both sides collide at every level")
        # The first level is made so tight that few keys are left for the second.
        per_key = 10 + max(0, math.ceil(1.44 * math.log2(max(1, n_away / n_here)))) if number == 0 else 10
        bits = max(64, n * per_key)
        if bits > max_bits:
            return None
        level = build_level(inside, number, bits)
        levels.append(level)
        wrong = stage(outside.filter(level.contains(F.col("key"))), f"passed-{number}")
        inside, outside, n = wrong, inside, wrong.count()
    return Cascade(levels)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    default: str = "allow",
    url: str = "url",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Add host, path, rule and verdict.  ``rules`` holds (host, path, verdict)."""
    for host, path, _ in rules:
        if not host or not path.startswith("/") or not path.endswith("/"):
            raise ValueError(f"a rule is a host and a path from / to /: {host!r} {path!r}")
    spark = pages.sparkSession
    verdicts = {h.lower() + p: v for h, p, v in rules}
    shapes = [(h.lower(), p) for h, p, _ in rules]
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*rest, url_host(url).alias("host"), url_path(url).alias("path"))
    keyed = split.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), shapes))
    universe = keyed.select(F.explode("_keys").alias("key"))
    listed = spark.createDataFrame([(k,) for k in sorted(verdicts)], "key string")
    cascade = build_cascade(listed, universe, max_bits)
    if cascade is None:
        return by_join(keyed, verdicts, default, rest)
    hits = F.filter("_keys", cascade.listed)
    best = F.array_max(F.transform(hits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    ruled = keyed.select(*rest, "host", "path", best.alias("rule"))
    return ruled.withColumn("verdict", verdict_of(F.col("rule"), verdicts, default))


def verdict_of(rule: Column, verdicts: dict[str, str], default: str) -> Column:
    """The rule's verdict: which of the two lists it is on; else the default."""
    blocking = sorted(k for k, v in verdicts.items() if v == "block")
    return F.when(rule.isNull(), F.lit(default)).when(rule.isin(blocking), F.lit("block")).otherwise(F.lit("allow"))


def by_join(keyed: DataFrame, verdicts: dict[str, str], default: str, rest: list[str]) -> DataFrame:
    """The way for lists too long for a filter: the keys of each url are joined with the list."""
    spark = keyed.sparkSession
    listed = spark.createDataFrame(sorted(verdicts.items()), "key string, listed_verdict string")
    numbered = stage(keyed.withColumn("_row", F.monotonically_increasing_id()), "keyed-urls")
    hits = (
        numbered.select("_row", F.explode("_keys").alias("key"))
        .join(listed, "key")
        .groupBy("_row")
        .agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("k"), F.col("listed_verdict").alias("v"))).alias("_best"))
    )
    return numbered.join(hits, "_row", "left").select(
        *rest, "host", "path", F.col("_best.k").alias("rule"), F.coalesce("_best.v", F.lit(default)).alias("verdict")
    )
