"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """`(node, root)` for every node of an edge; `root` is the smallest node that can be reached.

    Each round is two joins on pre-aggregated minima and writes its edges, so the plan never grows; a node with very many
    neighbours is a skewed join key, which adaptive execution splits. Loops and null ends are ignored, repeated edges count
    once, no edges give no rows. Rounds grow with the logarithm of the longest chain, and end when one changes no edge.
    """
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    e = materialise(e.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    while not e.isEmpty():
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.join(low, "a").where("b > a and m <> b").select(F.col("m").alias("u"), F.col("b").alias("v")).distinct()
        star = materialise(star, "star")
        low = star.groupBy("v").agg(F.min("u").alias("m"))
        kept = star.join(low, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        before, e = e, materialise(kept.union(low.select(F.col("m"), F.col("v"))).distinct(), "edges")
        if e.count() == before.count() and e.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.select(F.col("u"), F.col("u")).distinct())
