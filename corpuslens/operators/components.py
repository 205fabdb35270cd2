"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import discard, stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another; component is its smallest node.

    Each round lets every node hand its larger neighbours, then its smaller
    ones, to the least node it knows (Kiveris et al. 2014). The least neighbour
    comes from a partial aggregation and goes back by a join that AQE can
    split, so a hub needs no task of its own. Self-loops, repeated edges and
    nulls are dropped; rounds are staged, and grow with the logarithm of the
    size.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    e = stage(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct(),
            "cc",
        )
        discard(e)
        e = after
        mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
