"""Connected components by alternating large and small stars, without any collection on the driver.

Each round sends the neighbours of a node to the smallest of them (first the larger neighbours, then
the smaller ones), so chains shorten geometrically. The edge list is written to the shared folder
after each round; a round starts from files, never from a long lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_materialized, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Has every ``a`` one ``b`` alone, which is no ``a`` itself? Then each ``b`` is the least of its component."""
    several = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi")
    return several.unionByName(chained).isEmpty()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``: the smallest node it reaches.

    Loops, repeated and reversed edges are fine; an edge with a null end counts as none; no edges, no rows.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    rounds = 0
    while not _settled(now):
        if (rounds := rounds + 1) > most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        after = materialize(_star(_star(now, large=True), large=False), "edges")
        drop_materialized(now)
        now = after
    out = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), "components")
    drop_materialized(now)
    return out
