"""Term weights and semantic similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def information_content(profile: DataFrame, up_self: DataFrame) -> DataFrame:
    """`(term, n, n_entities, w, ic)`: each place of a term counts for the term and for each ancestor, with multiplicity; `w` is
    the share of all counts and `ic` = -ln w. `up_self` is the closure with each term itself."""
    rows = profile.join(up_self, "term").groupBy(F.col("ancestor").alias("term")).agg(F.count("*").alias("n"), F.countDistinct("entity").alias("n_entities"))
    total = rows.agg(F.sum("n").alias("total"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("w", F.col("n") / F.col("total"))  # one row is broadcast
    return rows.select("term", "n", "n_entities", "w", (-F.ln("w")).alias("ic"))


def resnik_terms(left: DataFrame, right: DataFrame, up_self: DataFrame, weights: DataFrame) -> DataFrame:
    """`(t1, t2, sim)`: the largest information content of a common ancestor; pairs without one are left out."""
    ic = up_self.join(weights.select(F.col("term").alias("ancestor"), "ic"), "ancestor")
    a = ic.join(left.select("term"), "term", "left_semi").select(F.col("term").alias("t1"), "ancestor", "ic")
    b = up_self.join(right.select("term"), "term", "left_semi").select(F.col("term").alias("t2"), "ancestor")
    return a.join(b, "ancestor").groupBy("t1", "t2").agg(F.max("ic").alias("sim"))


def resnik_dissimilarity(profile: DataFrame, terms: DataFrame, mode: str = "bma", entities: DataFrame | None = None) -> DataFrame:
    """`(i, j, score)` of catalogue 0 against 1 from dissimilarities exp(-sim) of their terms, 1 where `terms(t1, t2, sim)` has
    no row: low is alike, and a term's best match is its least.

    Modes: `sum` and `mean` over all pairs of terms, `max` the best match of all, `bma` the mean of the best matches of all
    terms, `funSimAvg` and `funSimMax` the mean and the better of both directions' means. Pairs of which no terms are in
    `terms` are left out; with `entities(db, entity)` every pair has a row, and to an entity without terms every term is twice
    the largest dissimilarity away (`sum` and `mean`: 0; `bma` of two such entities: null)."""
    own = profile.select("db", "entity", "term").distinct()
    a = own.where("db = 0").select(F.col("entity").alias("i"), F.col("term").alias("t1"))
    b = own.where("db = 1").select(F.col("entity").alias("j"), F.col("term").alias("t2"))
    near = terms.select("t1", "t2", F.exp(-F.col("sim")).alias("m"))
    rows = a.join(near, "t1").join(b, "t2").select("i", "j", "t1", "t2", "m")
    found = rows.groupBy("i", "j").agg(F.sum("m").alias("sum"), F.count("*").alias("c"), F.min("m").alias("least"))
    if mode not in ("sum", "mean", "max"):
        for t, k in (("t1", 1), ("t2", 2)):
            best = rows.groupBy("i", "j", t).agg(F.min("m").alias("m"))
            found = found.join(best.groupBy("i", "j").agg(F.sum("m").alias(f"s{k}"), F.count("*").alias(f"c{k}")), ["i", "j"])
    n1, n2 = a.groupBy("i").agg(F.count("*").alias("n1")), b.groupBy("j").agg(F.count("*").alias("n2"))
    if entities is None:
        found = found.join(n1, "i").join(n2, "j")
    else:
        known = entities.select("db", "entity").distinct()
        left = known.where("db = 0").select(F.col("entity").alias("i")).join(n1, "i", "left")
        right = known.where("db = 1").select(F.col("entity").alias("j")).join(n2, "j", "left")
        found = left.crossJoin(right).join(found, ["i", "j"], "left").fillna(0)  # the result has a row for each pair
        found = found.withColumn("least", F.when(F.col("c") > 0, F.col("least")))
    sizes = a.select("t1").distinct().agg(F.count("*").alias("t1s")).crossJoin(b.select("t2").distinct().agg(F.count("*").alias("t2s")))  # one row each
    listed = near.join(a.select("t1").distinct(), "t1", "left_semi").join(b.select("t2").distinct(), "t2", "left_semi")
    far = listed.agg(F.count("*").alias("listed"), F.max("m").alias("far")).crossJoin(sizes)
    far = far.select((2 * F.when(F.col("listed") < F.col("t1s") * F.col("t2s"), 1.0).otherwise(F.coalesce("far", F.lit(1.0)))).alias("far"))
    found = found.crossJoin(F.broadcast(far))  # one row
    n1, n2, none = F.col("n1"), F.col("n2"), (F.col("n1") == 0) | (F.col("n2") == 0)
    total = F.col("sum") + n1 * n2 - F.col("c")
    one = lambda k, n: F.when(none, n * F.col("far")).otherwise(F.col(f"s{k}") + n - F.col(f"c{k}"))
    mean = lambda k, n: one(k, n) / F.greatest(n, F.lit(1))
    score = {
        "sum": lambda: total,
        "mean": lambda: total / F.greatest(n1 * n2, F.lit(1)),
        "max": lambda: F.when(none, F.col("far")).otherwise(F.least(F.coalesce("least", F.lit(1.0)), F.lit(1.0))),
        "bma": lambda: F.try_divide(one(1, n1) + one(2, n2), n1 + n2),
        "funSimAvg": lambda: (mean(1, n1) + mean(2, n2)) / 2,
        "funSimMax": lambda: F.least(mean(1, n1), mean(2, n2)),
    }
    return found.select("i", "j", score[mode]().cast("double").alias("score"))


def tf_idf(names: DataFrame, sizes: tuple[int, int] = (3, 5)) -> DataFrame:
    """`(id, gram, w)` from `(id, name)`: character n-grams within words padded by spaces, smooth idf, unit length."""
    words = names.select("id", F.explode(F.split(F.lower("name"), r"\s+")).alias("word")).where("word <> ''")
    padded = words.select("id", F.concat(F.lit(" "), "word", F.lit(" ")).alias("word"))
    grams = None
    for n in range(sizes[0], sizes[1] + 1):
        at = F.sequence(F.lit(1), F.greatest(F.length("word") - n + 1, F.lit(1)))
        own = padded.where(F.length("word") >= n).select("id", F.explode(at).alias("at"), "word").select("id", F.substr("word", "at", F.lit(n)).alias("gram"))
        grams = own if grams is None else grams.union(own)
    tf = grams.groupBy("id", "gram").agg(F.count("*").alias("tf"))
    df = tf.groupBy("gram").agg(F.count("*").alias("df"))
    n = names.select("id").distinct().agg(F.count("*").alias("n"))
    w = tf.join(df, "gram").crossJoin(F.broadcast(n)).select("id", "gram", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("w"))


def cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """`(i, j, sim)` of two weighted relations `(id, gram, w)`: an inverted-index join; pairs that share nothing are left out."""
    a = left.select(F.col("id").alias("i"), "gram", F.col("w").alias("x"))
    b = right.select(F.col("id").alias("j"), "gram", F.col("w").alias("y"))
    return a.join(b, "gram").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))
