"""Costs between the entities of catalogue 0 (i) and 1 (j): entity sums and an equi-join on shared terms.

|a - b| over weights is sum(a) + sum(b) - 2 * shared, so no operator compares two profiles term by term; the output has a row
for each pair, as a cost matrix has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(profile: DataFrame, weights: DataFrame | None = None, dense: bool = True) -> DataFrame:
    """`(i, j, ni, nj, c, wi, wj, wc)`: numbers of terms, shared terms, and their weights (1 where there is no weight relation,
    0 for terms that it lacks). Without `dense`, only pairs that share a term."""
    rows = profile.join(weights.select("term", "w"), "term", "left").withColumn("w", F.coalesce("w", F.lit(0.0))) if weights is not None else profile.withColumn("w", F.lit(1.0))
    sums = rows.groupBy("db", "entity").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    left = sums.where("db = 0").select(F.col("entity").alias("i"), F.col("n").alias("ni"), F.col("w").alias("wi"))
    right = sums.where("db = 1").select(F.col("entity").alias("j"), F.col("n").alias("nj"), F.col("w").alias("wj"))
    a = rows.where("db = 0").select(F.col("entity").alias("i"), "term", "w")
    b = rows.where("db = 1").select(F.col("entity").alias("j"), "term")
    shared = a.join(b, "term").groupBy("i", "j").agg(F.count("*").alias("c"), F.sum("w").alias("wc"))
    if not dense:
        return shared.join(left, "i").join(right, "j").select("i", "j", "ni", "nj", "c", "wi", "wj", "wc")
    # a cost matrix is every pair: the join is on no key by definition
    pairs = left.crossJoin(right).join(shared, ["i", "j"], "left")
    return pairs.select("i", "j", "ni", "nj", F.coalesce("c", F.lit(0)).alias("c"), "wi", "wj", F.coalesce("wc", F.lit(0.0)).alias("wc"))


def jaccard() -> Column:
    union = F.col("ni") + F.col("nj") - F.col("c")
    return F.when(union == 0, 0.0).otherwise(1.0 - F.col("c") / union)


def hamming() -> Column:
    return F.col("ni") + F.col("nj") - 2 * F.col("c")


def euclidean() -> Column:
    return F.sqrt((F.col("ni") + F.col("nj") - 2 * F.col("c")).cast("double"))


def weighted_hamming() -> Column:
    return F.col("wi") + F.col("wj") - 2 * F.col("wc")


def dice() -> Column:
    return F.try_divide(2.0 * F.col("c"), F.col("ni") + F.col("nj"))


#: Costs by name, over overlaps().
COSTS = {"jaccard": jaccard, "hamming": hamming, "euclidean": euclidean, "weighted_hamming": weighted_hamming}


def cost(profile: DataFrame, method: str = "jaccard", weights: DataFrame | None = None) -> DataFrame:
    """`(i, j, cost)` by one of COSTS."""
    return overlaps(profile, weights).select("i", "j", COSTS[method]().cast("double").alias("cost"))


def normalised(costs: DataFrame) -> DataFrame:
    """Each cost over the largest of its row; rows of zeros stay."""
    top = costs.groupBy("i").agg(F.max("cost").alias("top"))
    return costs.join(top, "i").select("i", "j", F.when(F.col("top") == 0, 0.0).otherwise(F.col("cost") / F.col("top")).alias("cost"))


def composed(one: DataFrame, two: DataFrame, share: list[float]) -> DataFrame:
    """`(a, i, j, cost)`: a of the row-normalised first cost and 1 - a of the second, for each a."""
    both = normalised(one).withColumnRenamed("cost", "x").join(two.withColumnRenamed("cost", "y"), ["i", "j"])
    return both.select(F.explode(F.array(*map(F.lit, share))).alias("a"), "i", "j", "x", "y").select("a", "i", "j", (F.col("a") * F.col("x") + (1 - F.col("a")) * F.col("y")).alias("cost"))


def tree_wasserstein(profile: DataFrame, paths: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """`(i, j, cost)`: sum over nodes of w * |mass below in i - mass below in j|; an entity's mass is even over its terms.

    `paths(term, ancestor, n_paths)`: a term's mass reaches an ancestor once for each path (pass n_paths = 1 for one each).
    min(x, y) is what two masses share, so |x - y| = x + y - 2 min: nodes that only one entity reaches cost no join."""
    n = profile.groupBy("db", "entity").agg(F.count("*").alias("n"))
    own = profile.join(n, ["db", "entity"]).select("db", "entity", "term", (1.0 / F.col("n")).alias("m"))
    up = own.join(paths, "term").select("db", "entity", F.col("ancestor").alias("node"), (F.col("m") * F.col("n_paths")).alias("m"))
    mass = own.select("db", "entity", F.col("term").alias("node"), "m").union(up).groupBy("db", "entity", "node").agg(F.sum("m").alias("m"))
    w = mass.join(weights.select(F.col("term").alias("node"), "w"), "node", "left").withColumn("w", F.coalesce("w", F.lit(0.0))) if weights is not None else mass.withColumn("w", F.lit(1.0))
    total = w.groupBy("db", "entity").agg(F.sum(F.col("w") * F.col("m")).alias("t"))
    a = w.where("db = 0").select(F.col("entity").alias("i"), "node", "w", F.col("m").alias("x"))
    b = w.where("db = 1").select(F.col("entity").alias("j"), "node", F.col("m").alias("y"))
    both = a.join(b, "node").groupBy("i", "j").agg(F.sum(F.col("w") * F.least("x", "y")).alias("s"))
    left = total.where("db = 0").select(F.col("entity").alias("i"), F.col("t").alias("ti"))
    right = total.where("db = 1").select(F.col("entity").alias("j"), F.col("t").alias("tj"))
    pairs = left.crossJoin(right).join(both, ["i", "j"], "left")
    return pairs.select("i", "j", (F.col("ti") + F.col("tj") - 2 * F.coalesce("s", F.lit(0.0))).alias("cost"))


def squared(costs: DataFrame, least: float = 1e-10) -> DataFrame:
    """Each cost over the largest of all, squared; what is below `least` is 0. Without a positive cost all are 0."""
    top = F.broadcast(costs.agg(F.max("cost").alias("top")))  # one row
    s = F.coalesce(F.pow(F.try_divide(F.col("cost"), F.col("top")), 2), F.lit(0.0))
    return costs.crossJoin(top).select("i", "j", F.when(s < least, 0.0).otherwise(s).alias("cost"))


def path_distance(lcas: DataFrame, depths: DataFrame) -> DataFrame:
    """`(t1, t2, cost)`: depth of both terms less twice that of their deepest common ancestor `(t1, t2, depth)`."""
    own = lambda n: depths.select(F.col("term").alias(n), F.col("depth").alias(f"d_{n}"))
    return lcas.join(own("t1"), "t1").join(own("t2"), "t2").select("t1", "t2", (F.col("d_t1") + F.col("d_t2") - 2 * F.col("depth")).alias("cost"))
