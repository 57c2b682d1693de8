"""Similarities between the sources of one catalogue, and marginals, for the regularised match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def binary(truth: DataFrame) -> DataFrame:
    """`(i, j, s)` with s = 1 for sources of `truth(target, source)` that serve a target together, each with itself among
    them; all other pairs are 0 and left out. A source twice under one target counts once."""
    own = truth.select("target", "source").distinct()
    a, b = own.select("target", F.col("source").alias("i")), own.select("target", F.col("source").alias("j"))
    return a.join(b, "target").select("i", "j", F.lit(1.0).alias("s")).distinct()


def by_terms(profile: DataFrame, weights: DataFrame, kind: str = "weighted_jaccard") -> DataFrame:
    """`(i, j, s)` of the entities of `(entity, term)` that share a term, each with itself among them; others are 0.

    Kinds: `jaccard` of the sets, `cosine` of the vectors of weights `(term, w)`, `weighted_jaccard`, the weight of shared
    terms over that of all. A term without weight counts 0; entities whose weights are all 0 have 0."""
    rows = profile.select("entity", "term").distinct().join(weights.select("term", "w"), "term", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = rows.groupBy("entity").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    a, b = rows.select(F.col("entity").alias("i"), "term", "w"), rows.select(F.col("entity").alias("j"), "term")
    shared = a.join(b, "term").groupBy("i", "j").agg(F.count("*").alias("c"), F.sum("w").alias("wc"), F.sum(F.col("w") * F.col("w")).alias("wwc"))
    both = shared.join(sums.toDF("i", "ni", "wi", "wwi"), "i").join(sums.toDF("j", "nj", "wj", "wwj"), "j")
    s = {
        "jaccard": F.col("c") / (F.col("ni") + F.col("nj") - F.col("c")),
        "cosine": F.try_divide(F.col("wwc"), F.sqrt(F.col("wwi") * F.col("wwj"))),
        "weighted_jaccard": F.try_divide(F.col("wc"), F.col("wi") + F.col("wj") - F.col("wc")),
    }[kind]
    return both.select("i", "j", F.coalesce(s, F.lit(0.0)).alias("s"))


def random_like(similarity: DataFrame, entities: DataFrame, seed: str = "S") -> DataFrame:
    """`(i, j, s)` with as many ones as `similarity` has, the diagonal and otherwise pairs in the order of a seeded hash."""
    n, ones = entities.count(), similarity.where("s > 0").count()
    names = entities.select("entity").distinct()
    pairs = names.select(F.col("entity").alias("i")).join(names.select(F.col("entity").alias("j")), F.col("i") < F.col("j"))
    chosen = pairs.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "i", "j")), "i", "j").limit(max(0, ones - n) // 2)
    both = chosen.union(chosen.select("j", "i")).union(names.select("entity", "entity"))
    return both.toDF("i", "j").withColumn("s", F.lit(1.0))


def marginals(profile: DataFrame, weights: DataFrame) -> DataFrame:
    """`(db, entity, mass)`: the mean weight of an entity's terms, as a share of its catalogue's; unknown terms count 0."""
    rows = profile.join(weights.select("term", "w"), "term", "left").groupBy("db", "entity").agg(F.avg(F.coalesce("w", F.lit(0.0))).alias("m"))
    total = rows.groupBy("db").agg(F.sum("m").alias("total"))
    return rows.join(F.broadcast(total), "db").select("db", "entity", (F.col("m") / F.col("total")).alias("mass"))


def correlation_of_terms(values: DataFrame, n: int) -> DataFrame:
    """`(t1, t2, r)`, t1 < t2: Pearson correlation of two terms' values `(term, entity, value)` over `n` entities, absent ones 0.

    Only pairs that share an entity are compared; a term without variance has no correlation."""
    rows = values.groupBy("term", "entity").agg(F.sum("value").alias("x"))
    sums = rows.groupBy("term").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    a, b = rows.toDF("t1", "entity", "x"), rows.toDF("t2", "entity", "y")
    both = a.join(b, "entity").where("t1 < t2").groupBy("t1", "t2").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    both = both.join(sums.toDF("t1", "s1", "ss1"), "t1").join(sums.toDF("t2", "s2", "ss2"), "t2")
    spread = F.sqrt((n * F.col("ss1") - F.col("s1") ** 2) * (n * F.col("ss2") - F.col("s2") ** 2))
    return both.select("t1", "t2", F.try_divide(n * F.col("xy") - F.col("s1") * F.col("s2"), spread).alias("r")).where("r is not null")


def merged_neighbours(one: DataFrame, two: DataFrame, mode: str, k: int) -> DataFrame:
    """`(i, j, d)` from two k-nearest relations of the same ids: `union` (either has it), `intersection` (both have it) or
    `closest` (the k nearest of either); a pair in both takes the smaller distance."""
    both = one.toDF("i", "j", "d1").join(two.toDF("i", "j", "d2"), ["i", "j"], "inner" if mode == "intersection" else "full")
    near = both.select("i", "j", F.least("d1", "d2").alias("d"))
    if mode != "closest":
        return near
    order = W.partitionBy("i").orderBy(F.round("d", 9), "j")
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
