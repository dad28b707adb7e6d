"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Each step points every node's larger (then smaller) neighbours to its least one; the edges end up as stars whose
centre is the least node of a component. Edges and minima are written to the shared folder between steps, so lineage
stays short and joins have two shuffled sides, which adaptive execution splits where a node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axiloom.llm.common import materialize, release

MOST_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b) of type long, any order, repeats and loops allowed. Returns (node, root) for each node but roots."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "edges")
    seen = _mark(edges)
    for _ in range(MOST_ROUNDS):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        release(edges, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        met = large.join(least.hint("merge"), "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct(), "edges")
        release(large, least)
        now = _mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
