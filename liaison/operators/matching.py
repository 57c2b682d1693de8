"""Ranks, accuracy and comparison of matches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import materialise
from .ranking import order_statistics, quantiles


def ranked(pairs: DataFrame, value: str = "cost", ascending: bool = True) -> DataFrame:
    """`pairs(i, j, value)` with the rank of j in i's row from 1; equal values (to 9 decimals) rank by j."""
    key = F.round(value, 9)
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("i").orderBy(key.asc() if ascending else key.desc(), "j")))


def truth_ranks(pairs: DataFrame, truth: DataFrame, value: str = "cost", ascending: bool = True) -> DataFrame:
    """The ranked rows of the true pairs `(i, j)`, with the smallest k of 1, 3, 5 that holds the rank (0: none)."""
    k = F.when(F.col("rank") <= 1, 1).when(F.col("rank") <= 3, 3).when(F.col("rank") <= 5, 5).otherwise(0)
    return ranked(pairs, value, ascending).join(truth, ["i", "j"], "left_semi").withColumn("k", k)


def accuracy(ranks: DataFrame) -> DataFrame:
    """One row: truths, accuracy at 1, 3 and 5, mean and median rank."""
    at = lambda n: F.avg((F.col("rank") <= n).cast("double")).alias(f"accuracy_{n}")
    return ranks.agg(F.count("*").alias("n_truth"), at(1), at(3), at(5), F.avg("rank").alias("mean_rank"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))


def best(pairs: DataFrame, value: str = "cost", ascending: bool = True) -> DataFrame:
    """The best j of each i."""
    return ranked(pairs, value, ascending).where("rank = 1").drop("rank")


def shares(plan: DataFrame, value: str = "mass") -> DataFrame:
    """A plan with each cell's share of its row."""
    total = plan.groupBy("i").agg(F.sum(value).alias("total"))
    return plan.join(total, "i").withColumn("share", F.try_divide(F.col(value), F.col("total"))).drop("total")


def gap_features(plan: DataFrame) -> DataFrame:
    """`(i, top_share, log_gap, entropy)` of each row of a plan: what a confidence classifier takes."""
    rows = shares(plan)
    order = W.partitionBy("i").orderBy(F.round("share", 12).desc(), "j")
    rows = rows.withColumn("rank", F.row_number().over(order))
    one, two = F.max(F.when(F.col("rank") == 1, F.col("share"))), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("share"))), F.lit(0.0))
    entropy = -F.sum(F.col("share") * F.ln(F.col("share") + 1e-12))
    return rows.groupBy("i").agg(one.alias("top_share"), (F.ln(one + 1e-12) - F.ln(two + 1e-12)).alias("log_gap"), entropy.alias("entropy"))


def above_quantiles(pairs: DataFrame, levels: list[float], value: str = "value") -> DataFrame:
    """`(quantile, i, j)`: the cells over each exact quantile of all cells (linear interpolation), all to nine decimals."""
    rows = pairs.select("i", "j", F.round(value, 9).alias("_v"))
    limits = quantiles(rows, "_v", levels)
    return rows.join(F.broadcast(limits), F.col("_v") > F.col("cut")).select("quantile", "i", "j")


def recall_precision(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Recall and precision of arrays `sources` against `truth(keys, true_sources)`; empty lists give 0."""
    both = truth.join(found, keys, "left")
    hits = F.size(F.array_intersect("true_sources", F.coalesce("sources", F.array().cast("array<string>"))))
    n, m = F.size(F.array_distinct("true_sources")), F.size(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))
    return both.select(*keys, F.when(n == 0, 0.0).otherwise(hits / n).alias("recall"), F.when(m == 0, 0.0).otherwise(hits / m).alias("precision"))


def conformal(scores: DataFrame, alpha: float, value: str = "score") -> DataFrame:
    """The threshold that holds a share 1 - alpha of calibration scores, with the finite-sample correction, 1 at most."""
    spark, n = scores.sparkSession, scores.where(F.col(value).isNotNull()).count()
    if not n:
        return spark.createDataFrame([], "n long, level double, threshold double")
    level = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
    cut = quantiles(scores, value, [level], digits=12)
    return cut.select(F.lit(n).cast("long").alias("n"), F.lit(level).alias("level"), F.col("cut").alias("threshold"))


def prediction_sets(pairs: DataFrame, truth: DataFrame, alpha: float, value: str = "cost") -> DataFrame:
    """One row: a fifth of the sources (by md5 of their name) calibrates the cost that holds 1 - alpha of true pairs, and for
    the others come the share whose truth is within it and the mean size of their sets. Where so few calibrate that no cost
    holds this share, the threshold is infinite and the sets hold every candidate."""
    calibrates = F.md5(F.col("i").cast("string")) < "33"
    true = pairs.join(truth, ["i", "j"], "left_semi").select("i", F.round(value, 9).alias("_v"))
    held = true.where(calibrates)
    n = held.count()
    spark, place = pairs.sparkSession, max(1, math.ceil((n + 1) * (1 - alpha)))
    if place <= n:
        cut = order_statistics(held, "_v", spark.createDataFrame([(place - 1,)], "place long")).select(F.col("_v").alias("threshold"))
    else:
        cut = spark.createDataFrame([(math.inf,)], "threshold double")
    cut = F.broadcast(cut)  # one row
    sets = pairs.where(~calibrates).join(cut, F.round(value, 9) <= F.col("threshold")).groupBy("i").agg(F.count("*").alias("size"))
    rows = true.where(~calibrates).join(cut, F.lit(True)).join(sets, "i", "left")
    hit = F.avg((F.col("_v") <= F.col("threshold")).cast("double"))
    return rows.groupBy("threshold").agg(F.count("*").alias("n"), hit.alias("coverage"), F.avg(F.coalesce("size", F.lit(0))).alias("mean_size"))


def binary_report(rows: DataFrame, score: str, label: str, cut: float) -> DataFrame:
    """One row of counts at `score >= cut`, accuracy, precision, recall, ROC-AUC and average precision of `label` 0 or 1.

    Scores count to six decimals, so there are few distinct ones whatever the rows; equal scores count half in the AUC and
    as one step in the precision."""
    counts = rows.groupBy(F.round(score, 6).alias("s")).agg(F.sum(label).cast("long").alias("p"), F.count("*").alias("n"))
    down = W.orderBy(F.desc("s"))
    runs = counts.withColumns({"tp": F.sum("p").over(down), "all": F.sum("n").over(down)})
    above = (F.col("all") - F.col("tp")) - (F.col("n") - F.col("p"))  # label 0 with higher scores
    total = F.broadcast(counts.agg(F.sum("p").alias("pos"), F.sum("n").alias("total")))
    hit = (F.col("s") >= cut).cast("long")
    neg = F.col("total") - F.col("pos")
    sums = runs.crossJoin(total).groupBy("pos", "total").agg(
        F.sum(hit * F.col("p")).alias("tp"), F.sum(hit * (F.col("n") - F.col("p"))).alias("fp"),
        F.sum(F.col("p") * (neg - above - 0.5 * (F.col("n") - F.col("p")))).alias("auc"), F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("ap"),
    )
    tn = neg - F.col("fp")
    return sums.select("tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), tn.alias("tn"), ((F.col("tp") + tn) / F.col("total")).alias("accuracy"),
                       F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("pos")).alias("recall"),
                       F.try_divide(F.col("auc"), F.col("pos") * neg).alias("roc_auc"), F.try_divide(F.col("ap"), F.col("pos")).alias("average_precision"))


def precision_threshold(rows: DataFrame, score: str, label: str, target: float) -> DataFrame:
    """One row `(threshold, precision, recall)`: the least score, to six decimals, from which on at least a share `target` of the
    rows have `label` 1; none if no score has that. Counts by score are what is ordered, not rows."""
    counts = rows.groupBy(F.round(score, 6).alias("s")).agg(F.sum(label).cast("long").alias("p"), F.count("*").alias("n"))
    down = W.orderBy(F.desc("s"))  # of scores to six decimals
    runs = counts.withColumns({"tp": F.sum("p").over(down), "all": F.sum("n").over(down)}).where(F.col("tp") >= target * F.col("all"))
    total = F.broadcast(counts.agg(F.sum("p").alias("pos")))  # one row
    least = runs.agg(F.min(F.struct("s", "tp", "all")).alias("x")).where("x is not null").crossJoin(total)
    return least.select(F.col("x.s").alias("threshold"), (F.col("x.tp") / F.col("x.all")).alias("precision"), F.try_divide(F.col("x.tp"), F.col("pos")).alias("recall"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """Share, lower and upper bound of the Wilson interval; null where n is 0."""
    p = F.try_divide(hits.cast("double"), n)
    base = 1 + F.try_divide(F.lit(z * z), n)
    middle, half = (p + F.try_divide(F.lit(z * z), 2 * n)) / base, z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / base
    return p, middle - half, middle + half


def correlation(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pearson correlation of two costs on their common pairs."""
    both = one.select("i", "j", F.col("cost").alias("x")).join(two.select("i", "j", F.col("cost").alias("y")), ["i", "j"])
    return both.agg(F.corr("x", "y").alias("r"))


def mean_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks of a column's values, ties at their mean: counts by value in ranges, a running sum in each, and what comes before."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n")).repartitionByRange(value).withColumn("_p", F.spark_partition_id())
    counts = materialise(counts, "values")
    first = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    sizes = counts.groupBy("_p").agg(F.sum("_n").alias("_size")).select("_p", F.coalesce(F.sum("_size").over(first), F.lit(0)).alias("_first"))
    below = F.col("_first") + F.sum("_n").over(W.partitionBy("_p").orderBy(value)) - F.col("_n")
    mid = counts.join(F.broadcast(sizes), "_p").select(value, (below + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(mid, value)


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    both = mean_ranks(mean_ranks(rows.select(a, b), a, "_ra"), b, "_rb")
    return both.agg(F.corr("_ra", "_rb").alias("rho"))


def truth_from(xref: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """`(i, j)`: the pairs of `xref(a, b)` whose ends both are entities of the catalogues, each once."""
    a, b = left.select(F.col("entity").alias("i")).distinct(), right.select(F.col("entity").alias("j")).distinct()
    return xref.select(F.col("a").alias("i"), F.col("b").alias("j")).distinct().join(a, "i", "left_semi").join(b, "j", "left_semi").select("i", "j")


def many_to_many(pairs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row for sources with several truths: how often any is first or within k, the share of all truths within k, and the
    mean rank of the best one."""
    rows = ranked(pairs).join(truth, ["i", "j"], "left_semi")
    each = rows.groupBy("i").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.sum((F.col("rank") <= k).cast("long")).alias("hits"))
    share = lambda n: F.avg((F.col("first") <= n).cast("double"))
    return each.agg(F.count("*").alias("n_sources"), share(1).alias("any_1"), share(k).alias(f"any_{k}"), (F.sum("hits") / F.sum("n")).alias(f"recall_{k}"), F.avg("first").alias("mean_first"))


def agreement(truth: DataFrame, genes: DataFrame) -> DataFrame:
    """`(i, j, genes_i, genes_j, verdict)`: whether the sets of `genes(db, entity, gene)` of a pair are equal, differ or miss."""
    sets = genes.groupBy("db", "entity").agg(F.array_join(F.array_sort(F.collect_set("gene")), ",").alias("genes"))
    own = lambda db, n: sets.where(F.col("db") == db).select(F.col("entity").alias(n), F.col("genes").alias(f"genes_{n}"))
    rows = truth.join(own(0, "i"), "i", "left").join(own(1, "j"), "j", "left")
    missing = F.col("genes_i").isNull() | F.col("genes_j").isNull()
    verdict = F.when(missing, "missing").when(F.col("genes_i") == F.col("genes_j"), "equal").otherwise("differ")
    return rows.select("i", "j", F.coalesce("genes_i", F.lit("")).alias("genes_i"), F.coalesce("genes_j", F.lit("")).alias("genes_j"), verdict.alias("verdict"))


def term_coverage(profile: DataFrame, known: DataFrame) -> DataFrame:
    """One row: terms of either catalogue, of both, of any that are `known(term)`, and known ones."""
    sides = profile.groupBy("term").agg(F.max((F.col("db") == 0).cast("long")).alias("a"), F.max((F.col("db") == 1).cast("long")).alias("b"))
    rows = sides.join(known.select("term", F.lit(1).alias("k")), "term", "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    any_of = F.greatest(zero(F.col("a")), zero(F.col("b")))
    return rows.agg(F.sum(zero(F.col("a"))).alias("n_left"), F.sum(zero(F.col("b"))).alias("n_right"), F.sum(zero(F.col("a") * F.col("b"))).alias("n_both"),
                    F.sum(any_of * zero(F.col("k"))).alias("n_known"), F.sum(zero(F.col("k"))).cast("long").alias("n_terms"))


def varying(profile: DataFrame) -> DataFrame:
    """`(term, n_entities)` of the terms that some entities have and some do not."""
    n = F.broadcast(profile.select("db", "entity").distinct().agg(F.count("*").alias("_n")))  # one row
    rows = profile.distinct().groupBy("term").agg(F.count("*").alias("n_entities"))
    return rows.crossJoin(n).where(F.col("n_entities") < F.col("_n")).select("term", "n_entities")
