"""Neighbour graphs, batched transport and linear algebra against plain versions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from liaison.functions import hyperbolic as H
from liaison.operators import kernels as K
from liaison.operators import linear as L
from liaison.operators import neighbours as N
from liaison.operators import two_sided as Z
from liaison.operators import wasserstein as V
from liaison.operators.graphs import spanning_links

rng = np.random.default_rng(11)


def ball(n, dim=3, groups=5):
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] * 0.3 + rng.normal(size=(n, dim)) * 0.05
    return x / np.maximum(1.2, np.linalg.norm(x, axis=1, keepdims=True) * 1.1)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)


# --- around known pairs ---


def plain_pairs(d, pairs, k, mode):
    """The graph as a dense matrix, 0 where there is no link."""
    method, connect = mode.rsplit("_", 1)
    n = len(d)
    graph = np.zeros((n, n))
    order = lambda i, out: [j for j in sorted(range(n), key=lambda j: (round(d[i, j], 9), j)) if j not in out]
    for i in range(n):
        for j in order(i, {i})[:k]:
            graph[i, j] = d[i, j]
    nodes = sorted({x for p in pairs for x in p})
    graph[nodes] = 0
    graph[:, nodes] = 0
    for a, b in pairs:
        la, lb = ({x: d[e, x] for x in order(e, {a, b})[:k]} for e in (a, b))
        both = set(la) & set(lb) if method == "intersection" else set(la) | set(lb)
        least = lambda x: min(la.get(x, np.inf), lb.get(x, np.inf))
        both = sorted(both, key=lambda x: (round(least(x), 9), x))[: k if method == "closest" else None]
        for x in both:
            ends = [a, b] if connect == "both" else [a if la.get(x, np.inf) <= lb.get(x, np.inf) else b]
            for e in ends:
                for p, q in ((e, x), (x, e)):
                    graph[p, q] = d[e, x] if graph[p, q] == 0 else min(graph[p, q], d[e, x])
    return graph


@pytest.mark.parametrize("mode", ["union_both", "intersection_nearest", "closest_both"])  # all six have SQL
def test_paired_graph_against_plain_loops(spark, mode):
    x = ball(40)
    pairs = [(0, 1), (2, 7), (7, 9), (30, 31)]  # one node is in two pairs
    d = N.block_distances(x, x)
    found = N.paired_graph(frame(spark, x), spark.createDataFrame([*pairs, (5, 5), (0, 1)], "a long, b long"), 4, mode).collect()
    graph = np.zeros((40, 40))
    for r in found:
        graph[r["i"], r["j"]] = r["d"]
    assert len(found) == (graph > 0).sum()
    assert np.abs(graph - plain_pairs(d, pairs, 4, mode)).max() < 1e-9


# --- bridges ---


@pytest.mark.parametrize("block, pivots", [(5, 3)])
def test_bridges_equal_kruskal_on_all_distances(spark, monkeypatch, block, pivots):
    """With few pivots of several small blocks each, most of which need not meet."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PIVOTS", pivots)
    x = ball(30, groups=4)
    x[3] = x[4]  # a distance of zero between components
    linked = spark.createDataFrame([(i, i + 10) for i in range(0, 20, 2)], "i long, j long")
    d = N.block_distances(x, x)
    every = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(30) for j in range(i)], "i long, j long, d double")
    want = spanning_links(spark.range(30).withColumnRenamed("id", "node"), every, linked)
    assert sorted((r["i"], r["j"]) for r in N.bridge_links(frame(spark, x), linked).collect()) == sorted((r["i"], r["j"]) for r in want.select("i", "j").collect())


def kruskal(spark, x, linked):
    i, j = np.tril_indices(len(x), -1)
    every = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), N.ball_distances(x[i], x[j]).tolist())), "i long, j long, d double")
    want = spanning_links(spark.range(len(x)).withColumnRenamed("id", "node"), every, linked)
    return sorted((r["i"], r["j"]) for r in want.select("i", "j").collect())


def test_bridges_from_lists_search_no_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "_dealt", lambda rows: pytest.fail("blocks were searched"))
    x = ball(20)
    linked = spark.createDataFrame([(i, i + 10) for i in range(0, 10, 2)], "i long, j long")
    assert sorted((r["i"], r["j"]) for r in N.bridge_links(frame(spark, x), linked).collect()) == kruskal(spark, x, linked)


def test_bridges_beyond_the_lists_are_searched(spark, monkeypatch):
    """Groups that are far apart, whose lists have their own vectors alone."""
    monkeypatch.setattr(N, "NEAR", 2)
    monkeypatch.setattr(N, "BLOCK", 5)
    x = np.concatenate([ball(8) * 0.1 + at for at in ([0.5, 0, 0], [0, 0.5, 0], [-0.4, 0, 0.2])])
    x[[2, 9, 12, 17, 20, 23]] = x[0]  # more copies than a list holds
    linked = spark.createDataFrame([], "i long, j long")
    assert sorted((r["i"], r["j"]) for r in N.bridge_links(frame(spark, x), linked).collect()) == kruskal(spark, x, linked)


def test_nothing_to_bridge(spark):
    x = ball(6)
    linked = spark.createDataFrame([(i, i + 1) for i in range(5)], "i long, j long")
    assert N.bridge_links(frame(spark, x), linked).count() == 0


# --- transport in batches ---


def supports(spark, n, sizes, offset=0):
    own = [(f"e{k}", int(t)) for k in range(n) for t in rng.choice(30, sizes[k % len(sizes)], replace=False)]
    return own, spark.createDataFrame(own + own[:3], "entity string, term long")


def test_batches_against_exact_and_single_problems(spark, monkeypatch):
    """Repeated terms, terms without a vector, weights; the exact cost but for the entropy."""
    monkeypatch.setattr(V, "BATCH", 200)
    x = ball(29) * 0.3  # near each other; term 29 has no vector
    vectors = frame(spark, x).withColumnsRenamed({"id": "term"})
    a, left = supports(spark, 7, [2, 3, 5])
    b, right = supports(spark, 5, [3, 4])
    weights = {t: 1.0 + t % 4 for t in range(30)}
    heavy = right.withColumn("w", 1.0 + F.col("term") % 4)
    d = N.block_distances(x, x)
    eps, rounds = 0.05, 200
    found = {(r["i"], r["j"]): r["cost"] for r in V.batched_wasserstein(left, heavy, vectors, eps, rounds).collect()}
    assert len(found) == 35
    for (i, j), cost in found.items():
        p, q = (sorted(t for e, t in own if e == name and t < 29) for own, name in ((a, i), (b, j)))
        w = np.array([weights[t] for t in q])
        part, wp, wq = d[np.ix_(p, q)], np.full(len(p), 1 / len(p)), w / w.sum()
        assert cost == pytest.approx(V.batch_sinkhorn(part[None], wp[None], wq[None], eps, rounds)[0], abs=1e-9)
        assert abs(cost - K.emd(part, wp, wq)[1]) <= eps * np.log(len(p) * len(q))  # what the entropy is worth


def test_no_block_grows_with_the_catalogue(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_TERMS", 60)
    vectors = frame(spark, ball(30)).withColumnsRenamed({"id": "term"})
    for n in (40, 160):
        _, left = supports(spark, n, [2, 7, 11])
        blocks = V.support_blocks(left, vectors).collect()
        assert sum(len(r["ids"]) for r in blocks) == n
        assert max(len(r["ids"]) * r["size"] for r in blocks) <= 60


# --- linear algebra ---


def test_inverse_columns_against_numpy(spark):
    n = 25
    s = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.15), 1)
    s[:, 20:] = s[20:] = 0  # nodes of no edge
    edges = [(i, j, float(s[i, j])) for i in range(n) for j in range(n) if s[i, j]] + [(1, 1, 5.0)]
    both = s + s.T
    want = np.linalg.inv(np.diag(both.sum(axis=1)) - both + 0.5 * np.eye(n))
    doubled = edges + [(j, i, v) for i, j, v in edges if i != j]  # each link both ways
    found = L.inverse_columns(spark.createDataFrame(doubled, "i long, j long, s double"), spark.createDataFrame([(0,), (3,), (24,)], "c long"), shift=0.5).collect()
    got = np.zeros((n, n))
    for r in found:
        got[r["i"], r["c"]] = r["x"]
        assert r["residual"] < 1e-10
    assert np.abs(got[:, [0, 3, 24]] - want[:, [0, 3, 24]]).max() < 1e-9
    with pytest.raises(RuntimeError, match="not at"):
        L.inverse_columns(spark.createDataFrame(doubled, "i long, j long, s double"), spark.createDataFrame([(0,)], "c long"), limit=1)


def test_parts_of_an_inverse_ask_for_what_they_reach(spark, monkeypatch):
    monkeypatch.setattr(L, "WIDTH", 7)
    n = 40
    s = np.diag(rng.random(n - 1), 1)
    s[0, 20:30] = 0.3  # a hub
    both = s + s.T
    want = np.linalg.inv(np.diag(both.sum(axis=1)) - both + np.eye(n))
    edges = [(i, j, float(both[i, j])) for i in range(n) for j in range(n) if both[i, j]]
    found = L.inverse_columns(spark.createDataFrame(edges, "i long, j long, s double"), spark.createDataFrame([(i,) for i in range(n)], "c long"), over=1e-4).collect()
    got = {(r["i"], r["c"]): r["x"] for r in found}
    assert len(got) == len(found) == (want > 1e-4).sum() and all(abs(x - want[k]) < 1e-9 for k, x in got.items())


def test_block_products_against_numpy(spark):
    a, b = (rng.integers(-3, 4, s) * (rng.random(s) < 0.4) for s in ((23, 31), (31, 17)))
    cells = lambda x: spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if x[i, j]], "i long, j long, x double")
    p, q = (L.packed_blocks(cells(x), 8) for x in (a, b))
    for blocks, want in ((L.product(p, q), a @ b), (L.transposed(p), a.T)):
        got = np.zeros(want.shape)
        for r in L.cells_of(blocks, 8).collect():
            got[r["i"], r["j"]] = r["x"]
        assert (got == want).all()


def test_features_against_numpy(spark):
    x = rng.normal(size=(60, 6)) @ np.diag([5, 3, 2, 1, 1, 0.1]) + 4
    x[:, 5] = 2.0  # no variance
    df = frame(spark, x)
    found, values = L.principal_components(df, 3)
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(values, s[:3] ** 2 / 59)
    got = np.zeros((60, 3))
    for r in found.collect():
        got[r["id"], r["k"]] = r["x"]
    sign = np.sign(v[np.arange(3), np.abs(v[:3]).argmax(axis=1)])
    assert np.allclose(got, (u * s)[:, :3] * sign)
    cells = df.select("id", F.posexplode("vec").alias("j", "x"))
    z = np.zeros((60, 6))
    for r in L.standardised(cells, 60).collect():
        z[r["id"], r["j"]] = r["x"]
    assert np.allclose(z[:, :5], (x - x.mean(axis=0))[:, :5] / x.std(axis=0)[:5]) and not z[:, 5].any()
    with pytest.raises(ValueError, match="dimensions"):
        L.principal_components(df, 2, most=5)
    assert L.principal_components(df.limit(0), 2)[0].count() == 0


# --- transport that keeps both sides ---


def test_two_sided_plan_falls(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    n, m, p = 7, 6, 4
    xs, xt, cost = rng.random((n, p)), rng.random((m, p)), rng.random((n, m))
    ss, st = (x @ x.T for x in (xs, xt))
    cells = lambda x: spark.createDataFrame([(i, j, float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])], "i long, j long, x double")
    sides = Z.TwoSided.of(*(cells(x) for x in (xs, xt, ss, st)), alpha=0.3)
    lap = lambda s: np.diag(s.sum(axis=1)) - s
    term = lambda g: 0.3 * np.trace(xt.T @ g.T @ lap(ss) @ g @ xt) + 0.7 * np.trace(xs.T @ g @ lap(st) @ g.T @ xs)
    g = rng.random((n, m))
    found, value = sides.gradient(cells(g))
    got = np.zeros((n, m))
    for r in found.collect():
        got[r["i"], r["j"]] = r["x"]
    assert value == pytest.approx(term(g))
    assert np.allclose(got, 0.6 * lap(ss) @ g @ xt @ xt.T + 1.4 * xs @ xs.T @ g @ lap(st))
    plan, scores = Z.two_sided_plan(cells(cost).withColumnRenamed("x", "cost"), sides, 0.1, 0.3, tolerance=2e-3)
    own = np.zeros((n, m))
    for r in plan.collect():
        own[r["i"], r["j"]] = r["mass"]
    assert all(a >= b for a, b in zip(scores, scores[1:])) and scores[-1] < scores[0]
    assert np.abs(own.sum(axis=1) - 1 / n).max() < 1e-8 and np.abs(own.sum(axis=0) - 1 / m).max() < 1e-8
    start = K.log_sinkhorn(cost, np.full(n, 1 / n), np.full(m, 1 / m), 0.1, rounds=5000)[0]
    weight = 0.3 * (cost * start).sum() / term(start)
    whole = lambda g: (cost * g).sum() + 0.1 * (g * np.log(g)).sum() + weight * term(g)
    assert scores[-1] == pytest.approx(whole(own), abs=1e-9)
    assert whole(own) < whole(start)


# --- the hyperboloid ---


def test_hyperboloid_maps(spark):
    """A tangent vector's exponential is the point it was made for, equal points too; carried, it keeps its length and is tangent."""
    x = ball(20)
    rows = [(a.tolist(), b.tolist()) for a, b in zip(x[:10], x[10:])] + [(x[0].tolist(), x[0].tolist())]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").select(H.lorentz_from_poincare(F.col("a")).alias("p"), H.lorentz_from_poincare(F.col("b")).alias("q"))
    df = df.withColumn("u", H.lorentz_logmap(F.col("p"), F.col("q"))).withColumn("v", H.lorentz_transported(F.col("u"), F.col("p"), F.col("q")))
    for r in df.withColumn("e", H.lorentz_expmap(F.col("p"), F.col("u"))).collect():
        p, q, u, v, e = (np.array(r[n]) for n in "pquve")
        product = lambda s, t: s @ t - 2 * s[0] * t[0]
        assert np.allclose(e, q) and abs(product(p, u)) < 1e-8 and abs(product(q, v)) < 1e-8
        assert product(u, u) == pytest.approx(product(v, v), abs=1e-8)
        assert np.sqrt(max(product(u, u), 0)) == pytest.approx(np.arccosh(max(1, -product(p, q))), abs=1e-6)


def test_cells_whose_terms_cancel_stay(spark):
    """Two alike entities on each side: the Laplacians times the even plan are 0, and every cell has a term."""
    cells = spark.createDataFrame([(i, j, 1.0) for i in range(2) for j in range(2)], "i long, j long, x double")
    sides = Z.TwoSided.of(*[cells] * 4)
    plan = cells.withColumn("x", F.lit(0.25))
    assert sides.gradient(plan)[0].where("x <> 0").count() == 0
    assert {(r["i"], r["j"]) for r in sides.reached(plan).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    # and no cell where nothing meets: the second entities share nothing
    apart = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "i long, j long, x double")
    assert {(r["i"], r["j"]) for r in Z.TwoSided.of(*[apart] * 4).reached(apart).collect()} == {(0, 0), (1, 1)}


def test_sparse_product_lists_what_meets(spark):
    own = np.random.default_rng(5)
    a, b = (own.integers(-2, 3, (30, 40)) * (own.random((30, 40)) < 0.1) for _ in "ab")
    cells = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, x double")
    got = {(r["i"], r["j"]): r["x"] for r in L.sparse_product(cells(a), cells(b.T)).collect()}
    assert set(got) == set(zip(*(x.tolist() for x in np.nonzero((a != 0).astype(int) @ (b != 0).T.astype(int))))) and all(x == (a @ b.T)[k] for k, x in got.items())
    # few cells far apart: no block of zeros is made
    far = spark.createDataFrame([(10**12, 10**15, 2.0), (5, 10**15, 3.0)], "i long, j long, x double")
    assert {tuple(r) for r in L.sparse_product(far, far.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")).collect()} == {(10**12, 10**12, 4.0), (10**12, 5, 6.0), (5, 10**12, 6.0), (5, 5, 9.0)}


def test_large_transport_by_strips(spark, monkeypatch):
    """A problem that is over a batch is solved in strips, without a table of its distances, and to the same cost."""
    from liaison.operators import wasserstein

    rng = np.random.default_rng(5)
    u, v = rng.uniform(-0.2, 0.2, (70, 4)), rng.uniform(-0.2, 0.2, (50, 4))
    a, b = rng.dirichlet(np.ones(70)), rng.dirichlet(np.ones(50))
    d, asked = wasserstein.block_distances(u, v), []
    monkeypatch.setattr(wasserstein, "STRIP", 256)

    def costs(rows):
        asked.append(len(u[rows]))
        return d[rows]

    for rounds in (0, 1, 200):
        want = wasserstein.batch_sinkhorn(d[None], a[None], b[None], 0.05, rounds)[0]
        assert abs(wasserstein.strip_sinkhorn(costs, a, b, 0.05, rounds) - want) < 1e-12 * max(want, 1)
    assert max(asked) <= 256 // 50


def test_large_problems_equal_batches(spark, monkeypatch):
    vectors = frame(spark, ball(30) * 0.3).withColumnsRenamed({"id": "term"})
    (_, left), (_, right) = supports(spark, 5, [2, 5]), supports(spark, 4, [3, 4])
    cost = lambda: {(r["i"], r["j"]): r["cost"] for r in V.batched_wasserstein(left, right, vectors).collect()}
    one = cost()
    monkeypatch.setattr(V, "BATCH", 6)
    monkeypatch.setattr(V, "STRIP", 8)
    monkeypatch.setattr(V, "BLOCK_TERMS", 8)
    two = cost()
    assert one.keys() == two.keys() and len(one) == 20 and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_best_links_of_blocks_are_those_of_all_pairs():
    """Ties go to the least pair, components without a foreign vector have no link; all components of a block are found at once."""
    x = np.round(rng.uniform(-0.3, 0.3, (240, 2)), 1)  # many equal distances
    ids, roots = rng.permutation(240) * 3, rng.integers(0, 60, 240)
    a, b = ({"ids": ids[s], "roots": roots[s]} for s in (slice(0, 130), slice(130, 240)))
    d = N.block_distances(x[:130], x[130:])
    want = {}
    for p, q in itertools.product(range(130), range(110)):
        if a["roots"][p] != b["roots"][q]:
            e = (d[p, q], *sorted((int(a["ids"][p]), int(b["ids"][q]))))
            for side, root in ((0, a["roots"][p]), (1, b["roots"][q])):
                want[side, root] = min(want.get((side, root), (np.inf,)), e)
    found = N._best(d, a, b, False)
    assert sorted(found) == sorted((int(root), *e) for (_, root), e in want.items())
    alone = {"ids": ids[:5], "roots": np.zeros(5, int)}
    assert N._best(d[:5, :5], alone, alone, True) == []


def test_gram_is_the_product_with_the_transpose(spark):
    x = rng.integers(-2, 3, (7, 12)).astype(float)
    x[2], x[0, 3] = 0, 1
    cells = [(i, j, float(v) / 2) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(x))) for v in (x[i, j], x[i, j])]
    cells = spark.createDataFrame([*cells, (0, 3, None)], "i long, j long, x double")
    found = {(r["i"], r["j"]): r["x"] for r in L.gram(cells).collect()}
    shared = (np.abs(x) @ np.abs(x.T)) > 0  # a pair that shares a column has a cell, though its products cancel
    assert found == {(i, j): (x @ x.T)[i, j] for i, j in zip(*map(np.ndarray.tolist, np.nonzero(shared)))}
    plan = L.gram(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
