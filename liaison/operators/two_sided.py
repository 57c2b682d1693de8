"""Transport whose plan keeps both catalogues' similarities in the space of their features.

With plan G, features Xs and Xt and Laplacians Ls and Lt, the term is alpha tr(Xt' G' Ls G Xt) + (1 - alpha) tr(Xs' G Lt G' Xs).
All of it are products of packed blocks: the plan meets the features first, so no product is larger than the plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .linear import cells_of, packed_blocks, product, transposed
from .transport import cell_sinkhorn


def laplacian_cells(similarity: DataFrame) -> DataFrame:
    """`(i, j, x)` of the Laplacian of `(i, j, x)`, made symmetric."""
    both = similarity.select("i", "j", (F.col("x") / 2).alias("x"))
    both = both.union(both.select("j", "i", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    degree = both.groupBy("i").agg(F.sum("x").alias("x")).select("i", F.col("i").alias("j"), "x")
    return degree.union(both.select("i", "j", -F.col("x"))).groupBy("i", "j").agg(F.sum("x").alias("x"))


def inner(a: DataFrame, b: DataFrame) -> float:
    """The sum of products of two relations of cells `(i, j, x)`."""
    both = a.join(b.withColumnRenamed("x", "y"), ["i", "j"])
    return both.agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0


@dataclass
class TwoSided:
    """Packed blocks of the features and Laplacians of both sides."""

    xs: DataFrame
    xt: DataFrame
    ls: DataFrame
    lt: DataFrame
    alpha: float = 0.5
    sources: tuple[DataFrame, ...] = ()

    @classmethod
    def of(cls, xs: DataFrame, xt: DataFrame, ss: DataFrame, st: DataFrame, alpha: float = 0.5) -> TwoSided:
        """From cells `(i, j, x)` of the features (rows are entities) and similarities, entities numbered from 0."""
        return cls(*(materialise(packed_blocks(x), "side") for x in (xs, xt, laplacian_cells(ss), laplacian_cells(st))), alpha, (xs, xt, ss, st))

    def reached(self, plan: DataFrame) -> DataFrame:
        """`(i, j)`: the cells of the gradient that have terms, also where these cancel to 0: products of ones, which never do."""
        ones = lambda x: materialise(packed_blocks(x.select("i", "j").distinct().withColumn("x", F.lit(1.0))), "ones")

        def linked(x: DataFrame) -> DataFrame:
            both = x.select("i", "j").union(x.select("j", "i"))
            return both.union(both.select("i", F.col("i").alias("j")))

        xs, xt, ss, st = self.sources
        xs, xt, ls, lt, g = ones(xs), ones(xt), ones(linked(ss)), ones(linked(st)), ones(plan)
        lp = materialise(product(ls, materialise(product(g, xt), "seen")), "seen")
        lq = materialise(product(lt, materialise(product(transposed(g), xs), "seen")), "seen")
        return cells_of(product(lp, transposed(xt))).union(cells_of(product(xs, transposed(lq)))).select("i", "j").distinct()

    def gradient(self, plan: DataFrame) -> tuple[DataFrame, float]:
        """The gradient's cells `(i, j, x)`, and the term itself, of the plan's cells `(i, j, x)`."""
        g = materialise(packed_blocks(plan), "plan")
        p = materialise(product(g, self.xt), "seen")
        lp = materialise(product(self.ls, p), "seen")
        q = materialise(product(transposed(g), self.xs), "seen")
        lq = materialise(product(self.lt, q), "seen")
        one = cells_of(product(lp, transposed(self.xt))).select("i", "j", (2 * self.alpha * F.col("x")).alias("x"))
        two = cells_of(product(self.xs, transposed(lq))).select("i", "j", (2 * (1 - self.alpha) * F.col("x")).alias("x"))
        value = self.alpha * inner(cells_of(p), cells_of(lp)) + (1 - self.alpha) * inner(cells_of(q), cells_of(lq))
        return materialise(one.union(two).groupBy("i", "j").agg(F.sum("x").alias("x")), "gradient"), value


def two_sided_plan(cost: DataFrame, sides: TwoSided, eps: float, eta: float, calibrated: bool = True, tolerance: float = 1e-6, limit: int = 100) -> tuple[DataFrame, list[float]]:
    """`(i, j, mass)`, and the objective after each step, of the plan of least <C, G> + eps <G, log G> + weight * term.

    The weight is `eta`, times <C, G> / term of the entropic plan if `calibrated`, so that both parts are of one size. Conditional
    gradient: the term is linearised, the entropic plan of the sum is found, and of 65 steps to it the best is taken; as the
    term is quadratic, one pass has the objective at all of them. Ends when it falls by less than `tolerance` of itself; past
    `limit` it is an error."""
    costs = materialise(cost.select(F.lit(0).alias("cell"), "i", "j", F.col("cost").cast("double").alias("cost")), "cost")
    cells = lambda plan: plan.select("i", "j", F.col("mass").alias("x"))
    solve = lambda c: materialise(cell_sinkhorn(c, ["cell"], eps, tolerance=1e-10, limit=100_000).drop("cell"), "plan")
    plan = solve(costs)
    gradient, term = sides.gradient(cells(plan))
    weight = eta * (inner(cells(plan), costs.select("i", "j", F.col("cost").alias("x"))) / term if calibrated and term else 1.0)
    steps = [k / 64 for k in range(65)]
    scores: list[float] = []
    for _ in range(limit):
        linear = costs.join(gradient, ["i", "j"], "left").select("cell", "i", "j", (F.col("cost") + weight * F.coalesce("x", F.lit(0.0))).alias("cost"))
        new = solve(linear)
        both = plan.join(new.withColumnRenamed("mass", "new"), ["i", "j"]).withColumn("step", F.col("new") - F.col("mass"))
        both = materialise(both.join(costs.drop("cell"), ["i", "j"]).join(gradient, ["i", "j"], "left").withColumn("x", F.coalesce("x", F.lit(0.0))), "step")
        _, bend = sides.gradient(both.select("i", "j", F.col("step").alias("x")))
        at = lambda t: F.col("mass") + t * F.col("step")
        entropy = lambda t: F.sum(F.when(at(t) > 0, at(t) * F.log(at(t))).otherwise(0.0))
        found = both.agg(F.sum(F.col("cost") * F.col("mass")).alias("c"), F.sum(F.col("cost") * F.col("step")).alias("d"), F.sum(F.col("x") * F.col("step")).alias("g"), F.array(*(entropy(t) for t in steps)).alias("e")).first()
        values = [found["c"] + t * found["d"] + eps * e + weight * (term + t * found["g"] + t * t * bend) for t, e in zip(steps, found["e"])]
        scores = scores or [values[0]]
        best = min(range(65), key=values.__getitem__)
        scores.append(values[best])
        plan = materialise(both.select("i", "j", at(steps[best]).alias("mass")), "plan")
        if scores[-2] - scores[-1] < tolerance * max(abs(scores[-1]), 1e-12):
            return plan, scores
        gradient, term = sides.gradient(cells(plan))
    raise RuntimeError(f"two_sided_plan: the objective still falls after {limit} steps")
