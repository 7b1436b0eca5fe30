"""Connected components of edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MOST_ROUNDS = 100


def _is_star_forest(edges: DataFrame) -> bool:
    """Each u has one v, and no v is a u."""
    got = edges.agg(F.count("*").alias("n"), F.countDistinct("u").alias("us")).first()
    return got["n"] == got["us"] and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node that the edges' two columns name, the component being its smallest node.

    Large-star and small-star rounds in turn: each links a node's neighbours to the smallest among them, until every
    component is a star around its smallest node.  Loops, repeated edges and nulls are left out.  Only flags and counts
    come to the driver; each round is written to the shared folder.  The smallest neighbour of a node is written before it
    is joined back, so that both sides of that join are plain shuffles, whose large keys adaptive execution can split.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    flat = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = staged(flat.distinct(), label)
    for _ in range(MOST_ROUNDS):
        if _is_star_forest(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), label)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u != v").distinct(), label)
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), label)
        joined = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(joined.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
