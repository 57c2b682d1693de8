"""Wasserstein distances of entities as distributions over terms with vectors, many pairs at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise
from .neighbours import block_distances
from .ranking import numbered_within

#: Terms of all supports of a block; numbers of the arrays that are solved at once; of a larger problem's, those of the rows that both
#: halves of a round pass over while they are at hand.
BLOCK_TERMS, BATCH, STRIP = 1 << 12, 1 << 21, 1 << 16


def support_blocks(profile: DataFrame, vectors: DataFrame) -> DataFrame:
    """`(size, ids, weights, places, vecs)` from `(entity, term[, w])` and `vectors(term, vec)`: blocks of entities with as many
    terms each. `vecs` are the vectors of the block's terms, each once, `places` where an entity's terms stand among them.

    A block has at most BLOCK_TERMS terms in all, or one entity. Terms without a vector are left out, repeated ones count once;
    weights, all alike if there are none, are divided by their sum; entities without terms, or whose weights are all 0, are in
    no block."""
    w = F.col("w") if "w" in profile.columns else F.lit(1.0)
    rows = profile.groupBy("entity", "term").agg(F.max(w).alias("w")).join(vectors.select("term", "vec"), "term")
    sums = rows.groupBy("entity").agg(F.sum("w").alias("total"), F.count("*").cast("int").alias("size")).where("total > 0")
    place = numbered_within(sums, ["size"], F.col("entity")).withColumn("block", F.floor(F.col("n") / F.greatest(F.floor(F.lit(BLOCK_TERMS) / F.col("size")), F.lit(1))))
    rows = rows.join(place, "entity").select("size", "block", "entity", "term", (F.col("w") / F.col("total")).alias("w"), "vec")
    kind = dict(profile.dtypes)["entity"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["entity", "term"])
        _, first, places = np.unique(own["term"], return_index=True, return_inverse=True)
        vecs = np.stack(own["vec"].iloc[first]).astype(float)
        ids = own["entity"].iloc[:: int(own["size"].iloc[0])].tolist()
        return pd.DataFrame({"size": own["size"].iloc[:1], "ids": [ids], "weights": [own["w"].to_numpy(float).tobytes()], "places": [places.astype(np.int64).tobytes()], "vecs": [vecs.tobytes()], "dim": [vecs.shape[1]]})

    return rows.groupBy("size", "block").applyInPandas(pack, f"size int, ids array<{kind}>, weights binary, places binary, vecs binary, dim int")


def batch_sinkhorn(costs: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float, rounds: int) -> np.ndarray:
    """Transport costs of problems `(p, n, m)` with weights `(p, n)` and `(p, m)`, all at once: so many rounds of scalings from
    ones, with 1e-9 added to what is divided by. Where all of an entry's costs are over 20 eps its kernel falls under that, and mass
    is lost: distances should be scaled to `eps`, or `eps` to them."""
    kernel = np.exp(-costs / eps)
    u, v = np.ones_like(a), np.ones_like(b)
    for _ in range(rounds):
        u = a / (np.matmul(kernel, v[:, :, None])[:, :, 0] + 1e-9)
        v = b / (np.matmul(u[:, None, :], kernel)[:, 0] + 1e-9)
    return np.einsum("pn,pnm,pm->p", u, kernel * costs, v, optimize=True)


def strip_sinkhorn(costs, a: np.ndarray, b: np.ndarray, eps: float, rounds: int) -> float:
    """batch_sinkhorn() of one large problem, whose rows `costs(rows)` gives: a round passes over the kernel once, by strips of rows that
    give their scalings and at once their share of the sums by column. The kernel is all that is held of its size."""
    step = max(1, STRIP // len(b))
    strips = [slice(at, at + step) for at in range(0, len(a), step)]
    kernel = np.empty((len(a), len(b)))
    for s in strips:
        kernel[s] = np.exp(-costs(s) / eps)
    u, v = np.ones_like(a), np.ones_like(b)
    for _ in range(rounds):
        total = np.zeros_like(b)
        for s in strips:
            u[s] = a[s] / (kernel[s] @ v + 1e-9)
            total += u[s] @ kernel[s]
        v = b / (total + 1e-9)
    return float(sum(u[s] @ ((kernel[s] * costs(s)) @ v) for s in strips))


def batched_wasserstein(left: DataFrame, right: DataFrame, vectors: DataFrame, eps: float = 0.05, rounds: int = 200) -> DataFrame:
    """`(i, j, cost)` of every entity of `left(entity, term[, w])` and `right`: the cost of the entropic transport of their terms'
    weights at the Poincare distances of `vectors(term, vec)`.

    Every block of `left` meets every block of `right`, as the answer has a row for each pair; a row that is shuffled is a
    block. The distances of two blocks' terms are computed once, and problems of one shape are solved in batches of BATCH
    numbers; a larger one is solved by itself, in strips."""
    kinds = dict(left.dtypes)["entity"], dict(right.dtypes)["entity"]
    a, b = materialise(support_blocks(left, vectors), "left"), materialise(support_blocks(right, vectors), "right")

    def side(r: dict, tail: str = ""):
        n = len(r["ids" + tail])
        return list(r["ids" + tail]), *(np.frombuffer(r[c + tail], t).reshape(n, -1) for c, t in (("weights", float), ("places", np.int64))), np.frombuffer(r["vecs" + tail]).reshape(-1, r["dim"])

    def solve(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                (i, wi, pi, vi), (j, wj, pj, vj) = side(r), side(r, "_b")
                n, m = pi.shape[1], pj.shape[1]
                if n * m > BATCH:
                    for x in range(len(i)):
                        for y in range(len(j)):
                            own, other = vi[pi[x]], vj[pj[y]]
                            cost = strip_sinkhorn(lambda s: block_distances(own[s], other), wi[x], wj[y], eps, rounds)
                            yield pd.DataFrame({"i": [i[x]], "j": [j[y]], "cost": [cost]})
                    continue
                d = block_distances(vi, vj)
                x, y = (k.ravel() for k in np.meshgrid(np.arange(len(i)), np.arange(len(j)), indexing="ij"))
                step = max(1, BATCH // (n * m))
                for at in range(0, len(x), step):
                    p, q = x[at : at + step], y[at : at + step]
                    cost = batch_sinkhorn(d[pi[p][:, :, None], pj[q][:, None, :]], wi[p], wj[q], eps, rounds)
                    yield pd.DataFrame({"i": [i[k] for k in p], "j": [j[k] for k in q], "cost": cost})

    # a task has one block, or some, and an eighth of the others: a few blocks of many terms would else be the work of a few tasks
    a, b = a.repartitionByRange(max(1, min(256, a.count())), "size", "ids"), b.repartitionByRange(max(1, min(8, b.count())), "size", "ids")
    both = a.crossJoin(b.select(*(F.col(c).alias(f"{c}_b") for c in b.columns)).hint("shuffle_replicate_nl"))
    return both.mapInPandas(solve, f"i {kinds[0]}, j {kinds[1]}, cost double")
