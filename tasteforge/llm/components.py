"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tasteforge.sources.shared import stage

MAX_ROUNDS = 200


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Each round every node moves to the first of itself and its neighbours, and
    links are redrawn between the places moved to, so connected parts stay
    connected and shrink.  "First" is by number in even rounds, which folds a
    star at once, and by a fresh hash in odd ones, which folds chains however
    they are numbered.  All steps are joins and map-side combined groupings of
    written tables; nothing is collected.
    """
    edges = stage(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct(), "links")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        if len(moves) == MAX_ROUNDS:
            raise RuntimeError(f"components are not found after {MAX_ROUNDS} rounds")
        order = [F.xxhash64("b", F.lit(len(moves)))] if len(moves) % 2 else []
        own = [F.xxhash64("a", F.lit(len(moves)))] if len(moves) % 2 else []
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy("a").agg(F.min(F.struct(*order, F.col("b").alias("to"))).alias("best"))
        here = F.struct(*own, F.col("a").alias("to"))
        move = stage(move.select(F.col("a").alias("node"), F.least("best", here)["to"].alias("to")), "moves")
        moves.append(move)
        ends = edges.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = stage(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    placed = moves[0]
    for move in moves[1:]:
        further = move.select(F.col("node").alias("to"), F.col("to").alias("further"))
        placed = placed.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
    placed = stage(placed, "places")
    least = placed.groupBy("to").agg(F.min("node").alias("component"))
    return placed.join(least, "to").select("node", "component")
