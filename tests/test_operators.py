"""Hand-checked fixtures and properties."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from liaison.functions import hyperbolic as H
from liaison.operators import costs, geometry, graphs, joins, kernels, matching, ontology, ranking, semantics, simulation, transport
from liaison.operators.components import connected_components

DIAMOND = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a")]


@pytest.fixture(scope="module")
def diamond(spark):
    return spark.createDataFrame(DIAMOND, "child string, parent string")


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame([(0, "X", "d"), (1, "Y", "b"), (1, "Y", "c")], "db int, entity string, term string")


def got(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_closure_depth_paths(spark, diamond):
    up = ontology.closure(diamond)
    assert got(up.where("term = 'd'"), "ancestor") == {("a",), ("b",), ("c",)}
    assert got(ontology.depth(diamond, spark.createDataFrame([("a",)], "term string")), "term", "depth") == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert ("d", "a", 2) in got(ontology.path_counts(diamond), "term", "ancestor", "n_paths")
    assert got(ontology.closure(diamond, 1), "term", "ancestor") == set(DIAMOND)


def test_closure_of_a_cycle_ends(spark):
    assert ontology.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")).count() == 4


def test_lca(spark, diamond):
    depth = ontology.depth(diamond, spark.createDataFrame([("a",)], "term string"))
    one = lambda *x: spark.createDataFrame([(t,) for t in x], "term string")
    assert got(ontology.lca(one("b", "d"), one("c", "d"), ontology.closure(diamond), depth), "t1", "t2", "lca", "depth") >= {("b", "c", "a", 0), ("d", "d", "d", 2)}


def test_information_content_counts_with_multiplicity(diamond, profiles):
    rows = semantics.information_content(profiles, ontology.with_self(ontology.closure(diamond)))
    assert got(rows, "term", "n") == {("a", 3), ("b", 2), ("c", 2), ("d", 1)}
    assert abs(rows.agg(F.sum("w")).first()[0] - 1) < 1e-12


def test_costs_of_fixture(profiles):
    rows = costs.overlaps(profiles).select(costs.jaccard().alias("j"), costs.hamming().alias("h")).collect()
    assert [(r["j"], r["h"]) for r in rows] == [(1.0, 3)]


def test_weighted_hamming_equals_the_plain_sum(spark):
    rng = random.Random(1)
    rows = [(db, f"e{e}", f"t{t}") for db in (0, 1) for e in range(5) for t in range(12) if rng.random() < 0.4]
    w = {f"t{t}": rng.random() for t in range(12)}
    found = costs.cost(spark.createDataFrame(rows, "db int, entity string, term string"), "weighted_hamming", spark.createDataFrame(list(w.items()), "term string, w double"))
    sets = {}
    for db, e, t in rows:
        sets.setdefault((db, e), set()).add(t)
    for r in found.collect():
        assert abs(r["cost"] - sum(w[t] for t in sets[0, r["i"]] ^ sets[1, r["j"]])) < 1e-9


def test_rank_ties_and_accuracy(spark):
    pairs = spark.createDataFrame([("x", str(j), m) for j, m in enumerate([0.0, 0.0, 1.0, 0.0])], "i string, j string, mass double")
    assert [r["j"] for r in matching.ranked(pairs, "mass", False).orderBy("rank").collect()] == ["2", "0", "1", "3"]


def test_quantiles_and_empty_lists(spark):
    cells = spark.range(100).select(F.lit("a").alias("i"), F.col("id").cast("string").alias("j"), F.col("id").cast("double").alias("value"))
    assert matching.above_quantiles(cells, [0.951]).count() == 5
    truth = spark.createDataFrame([("t", ["a"])], "target string, true_sources array<string>")
    none = spark.createDataFrame([], "target string, sources array<string>")
    assert matching.recall_precision(none, truth, ["target"]).first()[1:] == (0.0, 0.0)


def test_wilson(spark):
    p, low, high = spark.range(1).select(*matching.wilson(F.lit(8), F.lit(10))).first()
    assert (round(p, 3), round(low, 3), round(high, 3)) == (0.8, 0.49, 0.943)


def test_poincare(spark):
    u, v = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.5), F.lit(0.0))
    d, same, back = spark.range(1).select(H.distance(u, v), F.round(H.distance(v, v), 6), H.logmap0(H.expmap0(v))).first()
    assert abs(d - 2 * math.atanh(0.5)) < 1e-9 and same == 0.0 and abs(back[0] - 0.5) < 1e-9


def test_barycentre_of_one_vector_is_it(spark):
    rows = spark.createDataFrame([("a", 0, [0.3, 0.1])], "label string, id int, vec array<double>")
    assert np.allclose(geometry.barycentres(rows, "label").first()["vec"], [0.3, 0.1])


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, None), (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = {(x, root(x)) for x in up}
    assert got(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b"), "node", "root") == want


def test_spanning_links_and_geodesics(spark):
    rng = random.Random(5)
    edges = [(i, j, rng.random()) for i, j in itertools.combinations(range(12), 2)]
    e = spark.createDataFrame(edges, "i long, j long, d double")
    found = graphs.spanning_links(spark.range(12).withColumnRenamed("id", "node"), e)
    comp, total = list(range(12)), 0.0
    for i, j, d in sorted(edges, key=lambda x: (x[2], x[0], x[1])):
        if comp[i] != comp[j]:
            total, comp = total + d, [comp[i] if c == comp[j] else c for c in comp]
    assert found.count() == 11 and abs(found.agg(F.sum("d")).first()[0] - total) < 1e-9
    both = e.union(e.select("j", "i", "d"))
    dist = np.full((12, 12), np.inf)
    for i, j, d in edges:
        dist[i, j] = dist[j, i] = d
    np.fill_diagonal(dist, 0)
    for k in range(12):
        dist = np.minimum(dist, dist[:, [k]] + dist[[k]])
    ways = graphs.geodesics(both, spark.range(12).withColumnRenamed("id", "i"))
    assert all(abs(r["d"] - dist[r["i"], r["j"]]) < 1e-9 for r in ways.collect()) and ways.count() == 144


def test_walks_follow_edges_and_repeat(spark, diamond):
    e = diamond.select(F.col("child").alias("i"), F.col("parent").alias("j")).withColumn("w", F.lit(1.0))
    e = e.union(e.select("j", "i", "w"))
    one, two = (sorted(map(tuple, graphs.random_walks(e, 3, 4, q=0.5).collect())) for _ in range(2))
    assert one == two
    at = {(w, s): n for w, s, n in one}
    links = got(e, "i", "j")
    assert all((at[w, s], at[w, s + 1]) in links for w, s in at if (w, s + 1) in at)


@pytest.mark.parametrize("n", [2, 4, 6])
def test_emd_is_the_best_assignment(n):
    c = np.random.default_rng(n).random((n, n))
    plan, total = kernels.emd(c)
    assert abs(total - min(sum(c[i, s[i]] for i in range(n)) / n for s in itertools.permutations(range(n)))) < 1e-9
    assert np.allclose(plan.sum(0), 1 / n) and np.allclose(plan.sum(1), 1 / n)


def test_geodesics_of_over_fifty_edges(spark):
    path = spark.range(56).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("d"))
    ways = graphs.geodesics(path, spark.createDataFrame([(0,)], "i long"))
    assert {(r["j"], r["d"]) for r in ways.collect()} == {(k, float(k)) for k in range(57)}


def test_sinkhorn_meets_marginals_and_is_no_cheaper_than_emd(spark):
    c = np.random.default_rng(2).random((6, 8))
    cost = spark.createDataFrame([(str(i), str(j), float(c[i, j])) for i in range(6) for j in range(8)], "i string, j string, cost double")
    plan = transport.sinkhorn(cost, eps=0.2, rounds=24, tolerance=1e-9)
    sums = [r[0] for r in plan.groupBy("i").agg(F.sum("mass").alias("m")).select("m").collect()]
    assert np.allclose(sums, 1 / 6, atol=1e-6)
    assert transport.plan_cost(plan, cost).first()[0] >= kernels.emd(c)[1] - 1e-9
    dense, _, _ = kernels.log_sinkhorn(c, np.full(6, 1 / 6), np.full(8, 1 / 8), 0.2, 500)
    assert abs(transport.plan_cost(plan, cost).first()[0] - (dense * c).sum()) < 1e-5


def test_kernels_fall_or_hold():
    c = np.random.default_rng(0).random((12, 15))
    plan, values = kernels.low_rank(c, 5)
    assert values[-1] <= values[0] and abs(plan.sum() - 1) < 1e-6
    _, values = kernels.conditional_gradient(c, np.eye(12) - 1 / 12, 0.05, 1.0)
    assert all(b <= a + 1e-12 for a, b in zip(values, values[1:]))


def test_pairwise_wasserstein_matches_the_kernel(spark):
    d = spark.createDataFrame([("a", "x", 0.2), ("a", "y", 0.9), ("b", "x", 0.4), ("b", "y", 0.1)], "t1 string, t2 string, d double")
    pairs = spark.createDataFrame([("p", "q", t1, t2) for t1 in "ab" for t2 in "xy"], "i string, j string, t1 string, t2 string")
    assert abs(graphs.pairwise_wasserstein(pairs, d).first()["cost"] - 0.15) < 1e-12


def test_simulation_slots(spark):
    rows = simulation.simulate(spark.range(300).select(F.col("id").alias("entity")), 10, 25, 0.5)
    per = {r["target"]: (r["n"], r["d"]) for r in rows.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("source").alias("d")).collect()}
    assert set(per.values()) == {(25, 25)}
    uses = rows.groupBy("source").count().groupBy("count").agg(F.count("*")).collect()
    assert {tuple(r) for r in uses} == {(2, 62), (1, 126)}


def test_flip_counts(spark):
    p = spark.createDataFrame([(f"e{e}", f"t{t}") for e in range(10) for t in range(5)], "entity string, term string")
    terms = spark.createDataFrame([(f"t{t}",) for t in range(20)], "term string")
    out = simulation.flip(p, terms, 0.1)
    assert out.count() == 45 + 15 and out.join(p, ["entity", "term"], "left_semi").count() == 45


def test_tree_wasserstein(spark, diamond, profiles):
    up = ontology.closure(diamond).withColumn("n_paths", F.lit(1))
    # X = d: nodes d, b, c, a of mass 1; Y = b, c: b and c of 1/2, a of 1/2 + 1/2
    assert abs(costs.tree_wasserstein(profiles, up).first()["cost"] - (1 + 0.5 + 0.5 + 0)) < 1e-12


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    found = ranking.numbered(rows, F.col("x")).collect()
    assert all(r["x"] == r["n"] for r in found) and len(found) == 1000


def test_quantiles_and_order_statistics(spark):
    x = np.random.default_rng(0).integers(0, 50, 777).astype(float)
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
    found = {r["quantile"]: r["cut"] for r in ranking.quantiles(rows, "v", [0.0, 0.333, 0.9, 1.0]).collect()}
    assert all(abs(found[q] - np.quantile(x, q)) < 1e-8 for q in found) and len(found) == 4
    assert ranking.quantiles(rows.where("v > 100"), "v", [0.5]).count() == 0


def test_nearest_vectors_equal_nearest_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK", 40)
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, (rng.normal(0, 0.1, 4)).tolist()) for i in range(150)], "id long, vec array<double>")
    one, two = ({(r["i"], r["j"]): r["d"] for r in x.collect()} for x in (geometry.nearest_vectors(rows, 3), geometry.nearest(geometry.pair_distances(rows, rows), 3)))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_vectors_of_far_shells_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5))
    x *= (np.where(np.arange(200) % 2, 0.05, 0.9) / np.linalg.norm(x, axis=1))[:, None]
    x[-2:] *= 1.2 / 0.05  # outside the ball: nothing is known
    own = geometry.Closest(np.arange(99), x[1:198:2], 3, "poincare")
    own.see(np.arange(99), x[1:198:2])
    assert len(own.reached(x[:198:2])) == 0 and len(own.reached(x[197:])) == 99
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:198])], "id long, vec array<double>")
    one, two = ({(r["i"], r["j"]): r["d"] for r in x.collect()} for x in (geometry.nearest_vectors(rows, 3), geometry.nearest(geometry.pair_distances(rows, rows), 3)))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_heights_are_longest_ways_and_cycles_are_errors(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")], "child string, parent string")
    assert {r["term"]: r["depth"] for r in ontology.heights(e).collect()} == {"a": 0, "d": 0, "b": 1, "c": 2}
    bad = spark.createDataFrame([("x", "a"), ("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError):
        ontology.heights(bad)
    with pytest.raises(ValueError):
        ontology.path_counts(bad)


def test_epsilon_sweep_nears_the_exact_plan(spark):
    rng = np.random.default_rng(2)
    costs = spark.createDataFrame([(f"i{a}", f"j{b}", float(rng.random())) for a in range(6) for b in range(6)], "i string, j string, cost double")
    rows = sorted((r["eps"], r["gap"], r["excess_pct"]) for r in transport.epsilon_sweep(costs, [1.0, 0.2, 0.05]).collect())
    assert rows[0][1] < rows[1][1] < rows[2][1] and -1e-2 < rows[0][2] < rows[1][2] < rows[2][2] and rows[0][2] < rows[2][2] / 2


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "i string, j string, cost double")
    assert matching.conformal(none.select(F.col("cost").alias("score")), 0.1).count() == 0
    assert matching.above_quantiles(none.withColumnRenamed("cost", "value"), [0.5]).count() == 0
    assert geometry.nearest_vectors(spark.createDataFrame([], "id long, vec array<double>"), 3).count() == 0


@pytest.mark.parametrize("mode", ["sum", "mean", "max", "bma", "funSimAvg", "funSimMax"])
def test_resnik_modes(spark, mode):
    """Against matrices, with terms that share nothing and an entity without terms on either side."""
    rng = np.random.default_rng(6)
    sim = np.where(rng.random((5, 4)) < 0.6, rng.random((5, 4)) * 3, 0.0)
    x, y = rng.random((4, 5)) < 0.5, rng.random((3, 4)) < 0.5
    x[0], y[1], x[3], y[0] = False, False, True, True
    rows = [(db, f"e{i}", f"{t}{k}") for db, t, z in ((0, "a", x), (1, "b", y)) for i, k in zip(*np.nonzero(z))]
    profile = spark.createDataFrame(rows + rows[:2], "db int, entity string, term string")
    terms = spark.createDataFrame([(f"a{i}", f"b{j}", float(sim[i, j])) for i, j in zip(*np.nonzero(sim))], "t1 string, t2 string, sim double")
    entities = spark.createDataFrame([(db, f"e{i}") for db, n in ((0, 4), (1, 3)) for i in range(n)], "db int, entity string")
    m = np.exp(-sim)
    far = 2 * m.max()

    def plain(own, other):
        n, k = own.sum(), other.sum()
        cells = m[own][:, other]
        if mode in ("sum", "mean"):
            return cells.sum() / (1 if mode == "sum" else max(n * k, 1))
        if mode == "max":
            return cells.min() if cells.size else far
        one = cells.min(axis=1).sum() if cells.size else n * far
        two = cells.min(axis=0).sum() if cells.size else k * far
        if mode == "bma":
            return (one + two) / (n + k) if n + k else None
        means = one / max(n, 1), two / max(k, 1)
        return sum(means) / 2 if mode == "funSimAvg" else min(means)

    got = {(r["i"], r["j"]): r["score"] for r in semantics.resnik_dissimilarity(profile, terms, mode, entities).collect()}
    assert len(got) == 12
    for i in range(4):
        for j in range(3):
            want = plain(x[i], y[j])
            assert got[f"e{i}", f"e{j}"] == (None if want is None else pytest.approx(want, abs=1e-9))
    few = {(r["i"], r["j"]): r["score"] for r in semantics.resnik_dissimilarity(profile, terms, mode).collect()}
    assert few and all(v == pytest.approx(got[k], abs=1e-9) for k, v in few.items())


def test_partner_similarity_diagonals(spark):
    members = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("c", 3), ("c", 4), ("d", 9), ("e", None), (None, 2)], "entity string, protein int")
    partners = spark.createDataFrame([(1, 2, 0.4), (1, 2, 0.7), (2, 1, 0.5), (3, 4, 0.9), (2, 3, None), (None, 9, 1.0)], "protein int, partner int, score double")
    got = lambda kind: {(r["i"], r["j"]): r["s"] for r in joins.partner_similarity(members, partners, kind).collect()}
    apart = {("a", "b"): 0.7, ("b", "a"): 0.7}
    assert got("skipped") == apart
    assert got("data") == apart | {("c", "c"): 0.9}
    assert got("one") == apart | {(x, x): 1.0 for x in "abcde"}
    with pytest.raises(ValueError):
        joins.partner_similarity(members, partners, "two")
    assert joins.partner_similarity(members.limit(0), partners, "one").count() == 0


def test_prediction_sets_of_few_rows_hold_every_candidate(spark):
    """One source or none calibrates: no cost of theirs holds nine tenths of the truth."""
    held = [x for x in map(str, range(200)) if hashlib.md5(x.encode()).hexdigest() < "33"]
    others = [x for x in map(str, range(200)) if x not in held][:4]
    for ids in ([held[0], *others], others):
        pairs = spark.createDataFrame([(i, j, 0.0 if i == j else 0.5) for i in ids for j in ids], "i string, j string, cost double")
        truth = spark.createDataFrame([(i, i) for i in ids], "i string, j string")
        row = matching.prediction_sets(pairs, truth, 0.1).first()
        assert (row["threshold"], row["n"], row["coverage"], row["mean_size"]) == (math.inf, 4, 1.0, len(ids))
    ids = [*held[:12], *others]
    pairs = spark.createDataFrame([(i, j, k / 100 if i == j else 0.5) for k, i in enumerate(ids) for j in ids], "i string, j string, cost double")
    row = matching.prediction_sets(pairs, spark.createDataFrame([(i, i) for i in ids], "i string, j string"), 0.1).first()
    assert row["threshold"] == 0.11 and row["mean_size"] == 0.0  # the 12th of 12


@pytest.mark.parametrize("tau", [math.inf, 0.5])
def test_sinkhorn_of_a_flat_cost(spark, tau):
    cost = spark.createDataFrame([(i, j, 0.0) for i in "ab" for j in "xy"], "i string, j string, cost double")
    even = [r["mass"] for r in transport.sinkhorn(cost, rounds=3, tolerance=0, tau=tau).collect()]
    assert even == pytest.approx([0.25] * 4)
    none = transport.sinkhorn(cost, rounds=3, tolerance=0, tau=tau, flat=0.0)
    assert all(math.isnan(r["mass"]) for r in none.collect()) and none.count() == 4
    assert all(math.isnan(x) for r in matching.gap_features(none).collect() for x in (r["top_share"], r["log_gap"], r["entropy"]))


def labelled_vectors(spark, n=90):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.2, (n, 3))
    x[1], x[2] = x[0], x[0]  # ties go by id
    return spark.createDataFrame([(i, i % 4, v.tolist(), float(v[0])) for i, v in enumerate(x)], "id long, label int, vec array<double>, x double")


def test_ranks_shuffle_no_pairs_of_blocks(spark):
    rows = labelled_vectors(spark).select("id", "vec", F.col("label").alias("value"))
    plan = geometry.value_precision(rows)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan
    assert not any(x in plan[: plan.index("CartesianProduct")] for x in ("Exchange", "Sort"))


@pytest.mark.parametrize("held", [0, 1 << 29])
def test_ranks_are_the_same_where_vectors_pass_by(spark, monkeypatch, held):
    monkeypatch.setattr(geometry, "HELD", held)
    monkeypatch.setattr(geometry, "PASSED", 16)
    monkeypatch.setattr(geometry, "BLOCK", 20)
    monkeypatch.setattr(geometry, "STRIPE", 200)
    rows = labelled_vectors(spark)
    x = np.array([r["vec"] for r in rows.orderBy("id").collect()])
    d = np.round(geometry.ball_grid(x, x), 9)
    np.fill_diagonal(d, np.inf)
    rank = lambda d: np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable") + 1
    low = np.round(np.abs(x[:, :1] - x[:, 0]), 9)
    np.fill_diagonal(low, np.inf)
    p, q = rank(d), rank(low)
    off = ~np.eye(len(x), dtype=bool)
    got = {r["k"]: (r["q"], r["b"]) for r in geometry.value_coranking(rows.select("id", "vec", F.col("x").alias("value"))).collect()}
    near = lambda k: off & (np.maximum(p, q) <= k)
    want = {k: (near(k).sum() / k / 90, ((near(k) & (p > q)).sum() - (near(k) & (p < q)).sum()) / k / 90) for k in got}
    assert len(got) > 50 and 89 in got and all(got[k] == pytest.approx(want[k]) for k in got)


def test_ranks_of_blocks_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(geometry, "BLOCK", 20)
    monkeypatch.setattr(geometry, "STRIPE", 1000)
    rows = labelled_vectors(spark)
    pairs = geometry.pair_distances(rows, rows)
    a, b = (rows.select(F.col("id").alias(n), F.col("label").alias(f"l{n}"), F.col("x").alias(f"x{n}")) for n in "ij")
    both = a.crossJoin(b).where("i <> j")
    table = lambda df, key: {r[key]: pytest.approx(tuple(r), abs=1e-9) for r in df.collect()}
    got = {r["i"]: tuple(r) for r in geometry.value_precision(rows.select("id", "vec", F.col("label").alias("value"))).collect()}
    assert got == table(geometry.average_precision(pairs, both.where("li = lj")), "i") and len(got) == 90
    got = {r["k"]: tuple(r) for r in geometry.value_coranking(rows.select("id", "vec", F.col("x").alias("value"))).collect()}
    assert got == table(geometry.coranking(pairs, both.select("i", "j", F.abs(F.col("xi") - F.col("xj")).alias("d"))), "k") and len(got) > 50
    one = rows.select("id", F.array("x").alias("vec"))
    got = {(r["i"], r["j"]): r["d"] for r in geometry.nearest_vectors(one, 4, "absolute").collect()}
    want = {(r["i"], r["j"]): r["d"] for r in geometry.nearest(both.select("i", "j", F.abs(F.col("xi") - F.col("xj")).alias("d")), 4).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_dispersion_by_blocks(spark):
    rows = labelled_vectors(spark, 40)
    pairs = geometry.pair_distances(rows, rows).join(rows.select(F.col("id").alias("i"), "label"), "i").join(rows.select(F.col("id").alias("j"), F.col("label").alias("other")), "j")
    stats = (F.count("*"), F.sum("d"), F.avg("d"), F.max("d"), F.min("d"), F.stddev_pop("d"))
    want = {r[0]: pytest.approx(tuple(r), abs=1e-9) for r in pairs.where("i < j and label = other").groupBy("label").agg(*stats).collect()}
    assert {r["label"]: tuple(r) for r in geometry.dispersion(rows, "label").select("label", "n", "sum", "mean", "max", "min", "std").collect()} == want


def test_pair_distances_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(geometry, "SIDE", 3)
    monkeypatch.setattr(geometry, "ROWS", 5)
    x = np.random.default_rng(4).normal(0, 0.2, (7, 3))
    left = spark.createDataFrame([(f"a{n}", v.tolist()) for n, v in enumerate(x)] + [("null", None), ("part", [0.1, None, 0.1]), ("short", [0.1])], "id string, vec array<double>")
    right = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "id long, vec array<double>")
    got = {(r["i"], r["j"]): r["d"] for r in geometry.pair_distances(left, right, digits=6).collect()}
    assert len(got) == 70 and all(got[n, j] is None for n in ("null", "part", "short") for j in range(7))
    want = geometry.ball_grid(x, x)
    assert all(got[f"a{i}", j] == round(want[i, j], 6) for i in range(7) for j in range(7))
    assert geometry.pair_distances(left.where("id = 'none'"), right).count() == 0


def test_name_join_deals_frequent_names(spark, monkeypatch):
    """Copies of a name are joined by lists and shares: all pairs come out, once each, and ids that are null stay."""
    from liaison.operators import joins

    monkeypatch.setattr(joins, "LISTED", 3)
    monkeypatch.setattr(joins, "SHARE", 2)
    left = [(i, "Same-Name") for i in range(11)] + [(50, "own"), (50, "own"), (51, None), (None, "own")]
    right = [(i, " same  name") for i in range(100, 117)] + [(200, "OWN"), (None, "own"), (201, None), (202, "none")]
    schema = "id long, name string"
    made = joins.name_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    expected = {(i, j, "same name") for i in range(11) for j in range(100, 117)} | {(i, j, "own") for i in (50, None) for j in (200, None)}
    found = [tuple(r) for r in made.collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_closest_bounds_its_first_search():
    """The bound from one pass is not under the k-th nearest, is near it, and leaves out the vector itself; copies are kept."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x = x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0.05, 0.95, 600)[:, None]
    x[40:44] = x[40]
    ids, k = np.arange(600), 5
    own = geometry.Closest(ids[:200], x[:200], k, "poincare")
    d = geometry.ball_distances(np.repeat(x[:200], 600, axis=0), np.tile(x, (200, 1))).reshape(200, 600)
    d[ids[:200], ids[:200]] = np.inf
    kth = np.sort(d, axis=1)[:, k - 1]
    bound = own.bound(np.arange(200), ids, x, own.sides(x))
    assert (bound >= kth).all() and (d <= bound[:, None]).sum(axis=1).mean() < 3 * k
    own.see(ids, x)
    order = np.lexsort((np.broadcast_to(ids, d.shape), np.round(d, 9)))[:, :k]
    assert (own.js.reshape(200, k) == order).all()
