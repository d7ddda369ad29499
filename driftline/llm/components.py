"""Connected components of a graph that stays distributed: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import discard, materialize


def _stars(pairs: DataFrame, keep_greater: bool) -> DataFrame:
    """For each ``u`` the least of itself and its neighbours ``v``; neighbours are linked to that instead.

    Grouping combines on the map side and the join can be split where a centre is hot, so no star meets in one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, pairs["u"] == least["c"])
    if keep_greater:
        return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
    centre = least.select(F.col("c").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(centre).where("a <> b")


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Undirected ``edges`` -> (id, component): the smallest id reachable, for every id that has an edge.

    Loops and repeated edges are harmless, edges with a null end are ignored, and no edges give no rows.
    Each round is written to the shared folder and the one before it deleted; the rounds grow with the logarithm of the longest path.
    """
    current = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    current = materialize(current.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "components")
    before = _state(current)
    for _ in range(most_rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _stars(both, True).distinct()
        small = _stars(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), False).distinct()
        grown = materialize(small, "components")
        discard(current)
        current, after = grown, _state(grown)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = current.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
