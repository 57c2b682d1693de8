"""Graph operators: spanning links, geodesics, random walks, negative pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .components import connected_components
from .ontology import closure


def spanning_links(nodes: DataFrame, edges: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """`(i, j, d)`: the edges by which Kruskal would join the components of `linked(i, j)`, found in Boruvka rounds: each
    component takes its nearest outgoing edge (order: d, i, j), components merge, until none is left."""
    e = materialise(edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d").groupBy("i", "j").agg(F.min("d").alias("d")), "edges")
    chosen = None
    base = linked.select("i", "j") if linked is not None else None
    while True:
        links = base if chosen is None else (chosen.select("i", "j") if base is None else base.union(chosen.select("i", "j")))
        label = nodes.select("node", F.col("node").alias("root")) if links is None else _labels(nodes, links)
        label = materialise(label, "labels")
        cut = e.join(label.select(F.col("node").alias("i"), F.col("root").alias("ri")), "i").join(label.select(F.col("node").alias("j"), F.col("root").alias("rj")), "j").where("ri <> rj")
        out = cut.select(F.col("ri").alias("root"), F.struct("d", "i", "j").alias("e")).union(cut.select("rj", F.struct("d", "i", "j")))
        new = materialise(out.groupBy("root").agg(F.min("e").alias("e")).select("e.i", "e.j", "e.d").distinct(), "links")
        if new.isEmpty():
            return chosen if chosen is not None else new
        chosen = new if chosen is None else chosen.union(new)


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = connected_components(links, "i", "j")
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def geodesics(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """`(i, j, d)`: shortest ways from each of `sources(i)`, by min-plus rounds over the new or shortened ways alone, until
    no way is new or shorter. Edges with a negative `d` are refused, as round a cycle they would have no end."""
    e = materialise(edges.select(F.col("i").alias("m"), F.col("j"), F.col("d").alias("w")), "edges")
    if not e.where("w < 0").isEmpty():
        raise ValueError("geodesics: an edge has a negative length")
    best = new = sources.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d"))
    while True:
        step = new.select("i", F.col("j").alias("m"), "d").join(e, "m").groupBy("i", "j").agg(F.min(F.col("d") + F.col("w")).alias("d"))
        both = materialise(best.withColumnRenamed("d", "old").join(step.withColumnRenamed("d", "new"), ["i", "j"], "full"), "ways")
        new = both.where("new is not null and (old is null or new < old - 1e-12)").select("i", "j", F.col("new").alias("d"))
        best = both.select("i", "j", F.least(F.coalesce("old", "new"), F.coalesce("new", "old")).alias("d"))
        if new.isEmpty():
            return best


def random_walks(edges: DataFrame, walks: int = 10, length: int = 5, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """`(walk_id, step, node)`: second-order walks from each node over `edges(i, j, w)`.

    Each step is a join with the neighbours and a weighted choice: the smallest of -ln(u) / weight, u from a hash of walk,
    step and candidate, so a lost task repeats its choice. Weights: w/p back, w to a neighbour of the node before, else w/q."""
    e = materialise(edges.groupBy("i", "j").agg(F.sum("w").alias("w")), "edges")
    starts = e.select(F.col("i").alias("node")).distinct()
    at = starts.select(F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("n"), "node")
    at = at.select(F.concat_ws("#", F.col("node").cast("string"), "n").alias("walk_id"), F.lit(None).cast(dict(e.dtypes)["i"]).alias("before"), "node")
    out = at.select("walk_id", F.lit(0).alias("step"), "node")
    near = e.select(F.col("i").alias("before"), F.col("j").alias("next"), F.lit(True).alias("near"))
    for step in range(1, length):
        moves = at.join(e.select(F.col("i").alias("node"), F.col("j").alias("next"), "w"), "node").join(near, ["before", "next"], "left")
        bias = F.when(F.col("before").isNull(), 1.0).when(F.col("next") == F.col("before"), 1.0 / p).when(F.col("near"), 1.0).otherwise(1.0 / q)
        u = (F.pmod(F.xxhash64("walk_id", F.lit(step), "next", F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        key = F.struct((-F.ln(u) / (F.col("w") * bias)).alias("k"), F.col("next"), F.col("node"))
        at = materialise(moves.groupBy("walk_id").agg(F.min(key).alias("x")).select("walk_id", F.col("x.node").alias("before"), F.col("x.next").alias("node")), "walks")
        out = out.union(at.select("walk_id", F.lit(step), "node"))
    return out


def walk_pairs(walks: DataFrame, window: int) -> DataFrame:
    """`(center, context)` with how often they stand within `window` steps of a walk."""
    a, b = walks.alias("a"), walks.alias("b")
    near = F.abs(F.col("a.step") - F.col("b.step"))
    pairs = a.join(b, (F.col("a.walk_id") == F.col("b.walk_id")) & near.between(1, window))
    return pairs.groupBy(F.col("a.node").alias("center"), F.col("b.node").alias("context")).agg(F.count("*").alias("n"))


def negative_pairs(nodes: DataFrame, edges: DataFrame, n: int, far: int = 5, seed: int = 0) -> DataFrame:
    """`n` pairs i < j that are `far` steps apart or more, in the order of a seeded hash. Pairs within far - 1 steps are found
    by the bounded closure of the undirected graph and taken away."""
    both = edges.select(F.col("i").alias("child"), F.col("j").alias("parent"))
    both = both.union(both.select("parent", "child")).distinct()
    near = closure(both, far - 1).select(F.col("term").alias("i"), F.col("ancestor").alias("j"))
    rank = F.md5(F.concat_ws("|", F.col("i").cast("string"), F.col("j").cast("string"), F.lit(str(seed))))
    pairs = nodes.select(F.col("node").alias("i")).join(nodes.select(F.col("node").alias("j")), F.col("i") < F.col("j"))
    return pairs.join(near, ["i", "j"], "left_anti").orderBy(rank, "i", "j").limit(n)


def row_normalised(edges: DataFrame) -> DataFrame:
    total = edges.groupBy("i").agg(F.sum("w").alias("t"))
    return edges.join(total, "i").select("i", "j", (F.col("w") / F.col("t")).alias("w"))


def pairwise_wasserstein(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """`(i, j, cost)`: for each pair of entities the exact transport between their terms, evenly weighted.

    `pairs(i, j, t1, t2)` are the pairs' terms, `terms(t1, t2, d)` the distances; each pair is a small problem of its own in
    a grouped task."""
    from .kernels import emd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index="t1", columns="t2", values="d")
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "j": pdf["j"].iloc[:1], "cost": [emd(np.ascontiguousarray(grid.to_numpy()))[1]]})

    return pairs.join(terms, ["t1", "t2"]).groupBy("i", "j").applyInPandas(solve, "i string, j string, cost double")


def hard_negatives(edges: DataFrame, hops: int) -> DataFrame:
    """`(term, ancestor)` within so many steps up, but not one."""
    return closure(edges, hops).join(edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")), ["term", "ancestor"], "left_anti")


def edge_split(edges: DataFrame, validation: str = "d9", test: str = "e6") -> DataFrame:
    """Edges with their `split` by the md5 of both ends: from the first digits given on validation, and test."""
    h = F.md5(F.concat_ws("|", "child", "parent"))
    return edges.select("child", "parent", F.when(h < validation, "train").when(h < test, "validation").otherwise("test").alias("split"))
