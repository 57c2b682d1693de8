"""Vectors in the Poincare ball whose distances keep the shares that each row of a similarity table gives to its neighbours.

A table `(i, j, share)` says over which pairs a row is normalised; all pairs of n nodes give the dense form, n squared rows, and a
neighbour table the sparse one. Everything is a join with the vectors and sums by row or by node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .training import distance_gradients, first_vectors, measured, stepped, trained

#: Logarithms of shares below this are those of it.
LEAST = 1e-20

KERNELS = ("laplace", "gaussian", "student")
DIVERGENCES = ("kl", "symmetric", "mse")


def targets(similarities: DataFrame) -> DataFrame:
    """`(i, j, share)` of `similarities(i, j, s)`: each row's similarities over their sum; null, NaN and negative ones count as 0, pairs given twice are summed.

    Rows without any similarity have no shares and are left out, with pairs of a null node."""
    rows = similarities.where("i is not null and j is not null")
    rows = rows.groupBy("i", "j").agg(F.sum(F.greatest(F.coalesce(F.nanvl(F.col("s").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("s"))
    rows = materialise(rows, "similarities")
    total = rows.groupBy("i").agg(F.sum("s").alias("total")).where("total > 0")
    return materialise(rows.join(total, "i").select("i", "j", (F.col("s") / F.col("total")).alias("share")), "targets")


def logit(d: Column, kernel: str, gamma: float) -> Column:
    return {"laplace": lambda: -gamma * d, "gaussian": lambda: -gamma * d * d, "student": lambda: -F.log1p(gamma * d)}[kernel]()


def logit_slope(d: Column, kernel: str, gamma: float) -> Column:
    return {"laplace": lambda: F.lit(-gamma), "gaussian": lambda: -2 * gamma * d, "student": lambda: -gamma / (1 + gamma * d)}[kernel]()


def shares(params: DataFrame, table: DataFrame, kernel: str, gamma: float) -> DataFrame:
    """The rows of `table(i, j, share)` measured by `params(term, vec)`, with `model`, the softmax of the kernel over each i, and
    its logarithm. The largest logit of a row is taken off first, so that far neighbours do not leave a row without mass."""
    rows = materialise(measured(table, params, "i", "j").withColumn("z", logit(F.col("d"), kernel, gamma)), "measured")
    most = rows.groupBy("i").agg(F.max("z").alias("most"))
    rows = rows.join(most, "i").withColumn("z", F.col("z") - F.col("most")).drop("most")
    total = rows.groupBy("i").agg(F.log(F.sum(F.exp("z"))).alias("total"))
    return materialise(rows.join(total, "i").withColumn("log_model", F.col("z") - F.col("total")).withColumn("model", F.exp("log_model")).drop("z", "total"), "shares")


def _clamped(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(LEAST)))


def divergence(rows: DataFrame, kind: str) -> float:
    """The loss of `shares`: p the share and q the model, `kl` is the mean over pairs of p log(p / q), `symmetric` the mean over rows of the sums of
    (p - q) log(p / q), `mse` the mean over pairs of the squared difference. No rows give 0."""
    p, q = F.col("share"), F.col("model")
    each = {
        "kl": lambda: F.when(p > 0, p * (F.log(p) - F.col("log_model"))).otherwise(0.0),
        "symmetric": lambda: (p - q) * (_clamped(p) - _clamped(q)),
        "mse": lambda: (p - q) * (p - q),
    }[kind]()
    sums = rows.groupBy("i").agg(F.sum(each).alias("x"), F.count("*").alias("n"))
    found = sums.agg(F.sum("x").alias("x"), F.sum("n").alias("pairs"), F.count("*").alias("rows")).first()
    return float((found["x"] or 0.0) / max(1, found["rows"] if kind == "symmetric" else found["pairs"] or 0))


def gradients(rows: DataFrame, kernel: str, kind: str, gamma: float, dim: int) -> DataFrame:
    """`(term, g)`: the gradient of `divergence` at each vector, as neighbour and as the row's own.

    By a row's logits it is q - p for `kl`, and q (g - sum of q g), g the derivative by q, for the others."""
    p, q = F.col("share"), F.col("model")
    own = {
        "kl": lambda: F.lit(0.0),
        "symmetric": lambda: F.when(q > LEAST, q - p).otherwise(0.0) - q * (_clamped(p) - _clamped(q)),
        "mse": lambda: 2 * q * (q - p),
    }[kind]()
    rows = rows.withColumn("h", own)
    sums = materialise(rows.groupBy("i").agg(F.sum("h").alias("sum_h"), F.sum("share").alias("sum_p"), F.count("*").alias("n")), "row_sums")
    size = sums.agg(F.sum("n").alias("pairs"), F.count("*").alias("rows")).first()
    over = float(max(1, size["rows"] if kind == "symmetric" else size["pairs"] or 0))
    by_logit = q * F.col("sum_p") - p if kind == "kl" else F.col("h") - q * F.col("sum_h")
    slope = by_logit * logit_slope(F.col("d"), kernel, gamma) / over
    return distance_gradients(rows.join(sums.drop("n"), "i"), slope, "i", "j", dim)


def _known(kernel: str, kind: str) -> None:
    if kernel not in KERNELS or kind not in DIVERGENCES:
        raise ValueError(f"kernel must be one of {KERNELS}, divergence one of {DIVERGENCES}")


def neighbour_round(params: DataFrame, table: DataFrame, kernel: str, kind: str, lr: float, dim: int, gamma: float = 1.0, exact: bool = True, adam: int = 0) -> tuple[DataFrame, float]:
    """`params` after one step on all of `table(i, j, share)`, the shares of `targets`, and the loss before it."""
    _known(kernel, kind)
    rows = shares(params, table, kernel, gamma)
    return stepped(params, gradients(rows, kernel, kind, gamma, dim), lr, dim, exact, adam), divergence(rows, kind)


def neighbour_vectors(similarities: DataFrame, kernel: str = "laplace", kind: str = "symmetric", dim: int = 5, gamma: float = 1.0, epochs: int = 20, lr: float = 0.05, burn_in: int = 5, early_stop: float = 0.0, patience: int = 50, adam: bool = True, exact: bool = True, seed: int = 0) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """`(term, vec)` of the nodes of `similarities(i, j, s)`, and of each epoch its number, rate and loss.

    An epoch is one step on all rows. Nodes that are neighbours only have a vector, too. An empty table gives no vectors."""
    _known(kernel, kind)
    table = targets(similarities)
    nodes = table.select(F.col("i").alias("term")).union(table.select("j")).distinct()
    params = first_vectors(nodes, dim, seed=seed)
    if adam:
        params = params.withColumns({"m": F.array_repeat(F.lit(0.0), dim), "s": F.lit(0.0)})
    params, history = trained(materialise(params, "params"), lambda params, n, rate: neighbour_round(params, table, kernel, kind, rate, dim, gamma, exact, n + 1 if adam else 0), epochs, lr, burn_in, early_stop, patience)
    return params.select("term", "vec"), history
