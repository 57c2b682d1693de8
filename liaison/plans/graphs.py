"""More registered queries: hierarchies, neighbour graphs, geometry, evaluation and transport."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hyperbolic as H
from ..operators import costs as C
from ..operators import geometry as G
from ..operators import graphs as R
from ..operators import matching as M
from ..operators import ontology as O
from ..operators import similarity as Y
from ..operators import transport as T
from ..shared import materialise
from .catalogue import edges, part_profile, profile, sql
from .queries import ALL_D, CUTS, EMB, KNN, PAIRS, _cells, _knn, _over, _poincare, embedded, query, roots, rounded, truth_of

# --- hierarchies ---

UPPER = "small_edges AS (SELECT * FROM edges WHERE child NOT LIKE 'P:%')"


def upper(spark, d) -> DataFrame:
    return edges(spark, d).where("not child like 'P:%'")


FROM_A = """walk AS (SELECT DISTINCT parent AS term, 0 AS level FROM edges WHERE parent LIKE 'A:%' UNION SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.term),
    near AS (SELECT term, min(level) AS depth FROM walk GROUP BY 1), nodes AS (SELECT child AS term FROM edges UNION SELECT parent FROM edges)"""


def _from_a(spark, d, unreachable: str) -> DataFrame:
    e = edges(spark, d)
    return O.depth(e, e.where("parent like 'A:%'").select(F.col("parent").alias("term")).distinct(), unreachable)


@query(f"WITH RECURSIVE {sql('edges', select='')[5:].strip()}, {FROM_A} SELECT term, CAST(coalesce(depth, -1) AS INTEGER) AS depth FROM nodes LEFT JOIN near USING (term)")
def depth_or_minus_one(spark, d):
    return _from_a(spark, d, "minus_one")


@query(f"WITH RECURSIVE {sql('edges', select='')[5:].strip()}, {FROM_A} SELECT term, CAST(coalesce(depth, (SELECT max(depth) FROM near)) AS INTEGER) AS depth FROM nodes LEFT JOIN near USING (term)")
def depth_or_max(spark, d):
    return _from_a(spark, d, "max")


@query(sql("edges", select="SELECT child AS term, parent AS ancestor FROM edges UNION SELECT a.child, b.parent FROM edges a JOIN edges b ON a.parent = b.child"))
def closure_two_levels(spark, d):
    return O.closure(edges(spark, d), 2)


@query(sql("edges", "closure", "depth", select="SELECT c.term, ancestor FROM closure c JOIN depth z ON z.term = c.ancestor WHERE z.depth = 1"))
def ancestors_at_level(spark, d):
    e = edges(spark, d)
    return O.closure(e).join(O.depth(e, roots(spark)).where("depth = 1").select(F.col("term").alias("ancestor")), "ancestor", "left_semi").select("term", "ancestor")


@query(sql("edges", select="SELECT child, parent FROM edges WHERE child LIKE 'N:%' AND parent LIKE 'A:%'"))
def induced_subgraph(spark, d):
    """The edges between chosen nodes, by a semi-join at either end."""
    e = edges(spark, d)
    nodes = e.select(F.col("child").alias("n")).union(e.select("parent")).distinct().where("n like 'N:%' or n like 'A:%'")
    return O.induced(e, nodes)


@query(sql("edges", select=f", {UPPER}, two AS (SELECT child AS term, parent AS ancestor FROM small_edges UNION SELECT a.child, b.parent FROM small_edges a JOIN small_edges b ON a.parent = b.child), three AS (SELECT * FROM two UNION SELECT t.term, e.parent FROM two t JOIN small_edges e ON e.child = t.ancestor) SELECT term, ancestor FROM three EXCEPT SELECT child, parent FROM small_edges"))
def hard_negatives(spark, d):
    """Terms within three steps up that are not neighbours."""
    return R.hard_negatives(upper(spark, d), 3)


BOTH_WAYS = f"{UPPER}, both_ways AS (SELECT child AS i, parent AS j FROM small_edges UNION SELECT parent, child FROM small_edges)"
STEPS = ", s2 AS (SELECT * FROM both_ways UNION SELECT a.i, b.j FROM both_ways a JOIN both_ways b ON a.j = b.i), s4 AS (SELECT * FROM s2 UNION SELECT a.i, b.j FROM s2 a JOIN s2 b ON a.j = b.i)"


@query(sql("edges", select=f", {BOTH_WAYS}{STEPS}, n AS (SELECT DISTINCT i AS node FROM both_ways) SELECT i, j FROM (SELECT a.node AS i, b.node AS j, row_number() OVER (ORDER BY md5(a.node || '|' || b.node || '|0'), a.node, b.node) AS r FROM n a JOIN n b ON a.node < b.node WHERE NOT EXISTS (SELECT 1 FROM s4 WHERE s4.i = a.node AND s4.j = b.node)) WHERE r <= 100"))
def negative_pairs(spark, d):
    """Pairs of terms five steps apart or more."""
    e = upper(spark, d).select(F.col("child").alias("i"), F.col("parent").alias("j"))
    return R.negative_pairs(e.select(F.col("i").alias("node")).union(e.select("j")).distinct(), e, 100)


VALUES = """val AS (SELECT DISTINCT term, entity, 1.0::DOUBLE AS value FROM part_profile WHERE db = 0), kids AS (SELECT parent, count(*) AS n FROM edges GROUP BY 1),
    mid AS (SELECT e.parent AS term, v.entity, sum(value) / any_value(n) AS value FROM val v JOIN edges e ON e.child = v.term JOIN kids k ON k.parent = e.parent GROUP BY 1, 2),
    top AS (SELECT e.parent AS term, v.entity, sum(value) / any_value(n) AS value FROM mid v JOIN edges e ON e.child = v.term JOIN kids k ON k.parent = e.parent GROUP BY 1, 2),
    filled AS (SELECT * FROM val UNION ALL SELECT * FROM mid UNION ALL SELECT * FROM top)"""


def _filled(spark, d) -> DataFrame:
    values = part_profile(spark, d).where("db = 0").select("term", "entity", F.lit(1.0).alias("value")).distinct()
    return materialise(O.imputed(values, edges(spark, d)), "filled")


@query(sql("part_profile", "edges", select=f", {VALUES} SELECT term, entity, round(value, 9) AS value FROM filled"))
def imputed_rows(spark, d):
    """Terms without rows take the mean of their children's, from the leaves up."""
    return rounded(_filled(spark, d), "value", digits=9)


@query(sql("part_profile", "edges", select=f", {VALUES}, n AS (SELECT count(DISTINCT entity) AS n FROM val), s AS (SELECT term, sum(value) AS s, sum(value * value) AS ss FROM filled GROUP BY 1), x AS (SELECT a.term AS t1, b.term AS t2, sum(a.value * b.value) AS xy FROM filled a JOIN filled b ON a.entity = b.entity AND a.term < b.term GROUP BY 1, 2), r AS (SELECT t1, t2, n * xy - p.s * q.s AS top, (n * p.ss - p.s * p.s) AS v1, (n * q.ss - q.s * q.s) AS v2 FROM x, n JOIN s p ON p.term = t1 JOIN s q ON q.term = t2) SELECT t1, t2, round(top / sqrt(v1 * v2), 5) + 0.0 AS r FROM r WHERE v1 > 1e-9 AND v2 > 1e-9"))
def term_correlation(spark, d):
    rows = _filled(spark, d)
    n = part_profile(spark, d).where("db = 0").select("entity").distinct().count()
    return rounded(Y.correlation_of_terms(rows, n), "r", digits=5).withColumn("r", F.col("r") + 0.0)


@query(sql("edges", select=", h AS (SELECT child, parent, md5(child || '|' || parent) AS h FROM edges) SELECT child, parent, CASE WHEN h < 'd9' THEN 'train' WHEN h < 'e6' THEN 'validation' ELSE 'test' END AS split FROM h"))
def edge_split(spark, d):
    """Edges for training (85 %), validation and test (5 % and 10 %), by their hash."""
    return R.edge_split(edges(spark, d))


# --- neighbours and geometry ---

FLAT = ", flat AS (SELECT a.id AS i, b.id AS j, abs(a.vec[1] - b.vec[1]) AS d FROM emb a JOIN emb b ON a.id <> b.id), k2 AS (SELECT i, j, CASE WHEN d = 0 THEN 1e-4 ELSE d END AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS r FROM flat) WHERE r <= 5)"


def _flat_knn(spark, d) -> DataFrame:
    one = embedded(spark, d).select("id", F.array(F.element_at("vec", 1)).alias("vec"))
    return materialise(G.nearest_vectors(one, 5, "absolute"), "flat")


@query(f"WITH {KNN}{FLAT} SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, round(least(a.d, b.d), 6) AS d FROM knn a FULL JOIN k2 b ON a.i = b.i AND a.j = b.j")
def neighbours_union(spark, d):
    return rounded(Y.merged_neighbours(_knn(spark, d), _flat_knn(spark, d), "union", 5), "d")


@query(f"WITH {KNN}{FLAT} SELECT a.i, a.j, round(least(a.d, b.d), 6) AS d FROM knn a JOIN k2 b ON a.i = b.i AND a.j = b.j")
def neighbours_intersection(spark, d):
    return rounded(Y.merged_neighbours(_knn(spark, d), _flat_knn(spark, d), "intersection", 5), "d")


@query(f"WITH {KNN}{FLAT}, m AS (SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, least(a.d, b.d) AS d FROM knn a FULL JOIN k2 b ON a.i = b.i AND a.j = b.j) SELECT i, j, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS r FROM m) WHERE r <= 5")
def neighbours_closest(spark, d):
    return rounded(Y.merged_neighbours(_knn(spark, d), _flat_knn(spark, d), "closest", 5), "d")


@query(f"WITH {ALL_D}, r AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS k FROM dist WHERE i <> j), h AS (SELECT r.i, k, CAST(a.label = b.label AS INTEGER) AS hit FROM r JOIN emb a ON a.id = r.i JOIN emb b ON b.id = r.j WHERE k <= 10), p AS (SELECT k, sum(hit) OVER (PARTITION BY i ORDER BY k) / CAST(k AS DOUBLE) AS p FROM h) SELECT CAST(k AS INTEGER) AS k, round(avg(p), 6) AS precision FROM p GROUP BY k")
def precision_at_k(spark, d):
    label = lambda end: embedded(spark, d).select(F.col("id").alias(end), F.col("label").alias(f"_{end}"))
    near = materialise(G.nearest_vectors(embedded(spark, d), 10), "near")
    same = near.join(label("i"), "i").join(label("j"), "j").where("_i = _j").select("i", "j")
    return rounded(G.precision_at(near, same, 10), "precision")


@query(
    f"WITH {ALL_D}, lo AS (SELECT a.id AS i, b.id AS j, abs(a.vec[1] - b.vec[1]) AS d FROM emb a, emb b), p AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS p FROM dist WHERE i <> j), q AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS q FROM lo WHERE i <> j),"
    " k AS (SELECT greatest(p, q) AS k, count(*) AS a FROM p JOIN q USING (i, j) GROUP BY 1), n AS (SELECT count(DISTINCT i) AS n FROM p), c AS (SELECT k, sum(a) OVER (ORDER BY k) / CAST(k * n AS DOUBLE) AS q, n FROM k, n), m AS (SELECT k AS k_max FROM c ORDER BY round(q - (k + 1) / CAST(n AS DOUBLE), 9) DESC, k LIMIT 1)"
    " SELECT CAST(k_max AS INTEGER) AS k_max, round(avg(CASE WHEN k <= k_max THEN q END), 6) AS q_local, round(avg(CASE WHEN k > k_max THEN q END), 6) AS q_global FROM c, m GROUP BY k_max"
)
def coranking_summary(spark, d):
    rows = embedded(spark, d).select("id", "vec", F.element_at("vec", 1).alias("value"))
    return rounded(G.quality_summary(materialise(G.value_coranking(rows), "curve"), rows.count()), "q_local", "q_global")


def _dots(u: str, v: str) -> str:
    return f"list_dot_product({u}, {u}) AS uu, list_dot_product({v}, {v}) AS vv, list_dot_product({u}, {v}) AS uv"


@query(f"""WITH {EMB}, p AS (SELECT a.id, {_dots('a.vec', 'b.vec')}, {_poincare('a.vec', 'b.vec')} AS d FROM emb a JOIN emb b ON b.id = a.id + 1),
    s AS (SELECT *, 1 + 2 * uv + uu * vv AS den, 2 / (1 - uu) AS lam, tanh(least(sqrt(vv) / (1 - uu), 15)) / sqrt(vv) AS e FROM p)
    SELECT id, round(sqrt(greatest((1 + 2 * uv + vv) ** 2 * uu + 2 * (1 + 2 * uv + vv) * (1 - uu) * uv + (1 - uu) ** 2 * vv, 0)) / den, 6) AS added,
    round(sqrt(greatest((1 + 2 * e * uv + e * e * vv) ** 2 * uu + 2 * (1 + 2 * e * uv + e * e * vv) * (1 - uu) * e * uv + (1 - uu) ** 2 * e * e * vv, 0)) / (1 + 2 * e * uv + e * e * uu * vv), 6) AS moved,
    round(d / lam, 5) AS back, round(sqrt(vv) / lam ** 2, 6) AS gradient, round(lam ** 2 * uv, 5) + 0.0 AS inner, round(sqrt(vv) * lam * (1 - vv) / 2, 6) AS carried, round(1 / (exp(d - 2) + 1), 6) AS linked,
    round(asin(least(1, 0.1 * (1 - uu) / sqrt(uu))), 6) AS aperture, round(acosh(greatest(1, ((1 + uu) * (1 + vv) - 4 * uv) / ((1 - uu) * (1 - vv)))), 5) AS lorentz FROM s""")
def hyperbolic_maps(spark, d):
    """Each vector with its successor: lengths of what the ball's and the hyperboloid's functions make of them."""
    e = materialise(embedded(spark, d), "embedded")
    u, v = F.col("u"), F.col("v")
    rows = e.select("id", F.col("vec").alias("u")).join(e.select((F.col("id") - 1).alias("id"), F.col("vec").alias("v")), "id")
    # functions of functions repeat their arguments, so what one makes is written before another takes it
    one = materialise(rows.select("id", "u", "v", H.mobius_add(u, v).alias("added"), H.expmap(u, v).alias("moved"), H.gyration(v, H.scaled(u, F.lit(-1.0)), v).alias("turned"), H.mobius_add(H.scaled(u, F.lit(-1.0)), v).alias("gap")), "maps")
    back = F.atanh(F.greatest(F.lit(H.LEAST), F.least(F.lit(H.MOST), H.norm(F.col("gap"))))) * 2 / H.conformal(u)
    return one.select(
        "id", F.round(H.norm(F.col("added")), 6).alias("added"), F.round(H.norm(F.col("moved")), 6).alias("moved"), F.round(back, 5).alias("back"),
        F.round(H.norm(v) / F.pow(H.conformal(u), 2), 6).alias("gradient"), (F.round(H.inner(u, u, v), 5) + 0.0).alias("inner"),
        F.round(H.norm(F.col("turned")) * H.conformal(u) / H.conformal(v), 6).alias("carried"), F.round(H.fermi_dirac(H.distance(u, v)), 6).alias("linked"),
        F.round(H.aperture(u), 6).alias("aperture"), F.round(H.lorentz_distance(H.lorentz_from_poincare(u), H.lorentz_from_poincare(v)), 5).alias("lorentz"),
    )


@query(f"""WITH {EMB}, p AS (SELECT a.id, {_dots('a.vec', 'b.vec')} FROM emb a JOIN emb b ON b.id = a.id + 1),
    h AS (SELECT id, vv, (1 + uu) / (1 - uu) AS x, (1 + vv) / (1 - vv) AS y, greatest(1, ((1 + uu) * (1 + vv) - 4 * uv) / ((1 - uu) * (1 - vv))) AS c FROM p), k AS (SELECT *, CASE WHEN sqrt(c * c - 1) > 1e-10 THEN acosh(c) / sqrt(c * c - 1) ELSE 1 END AS k FROM h)
    SELECT id, round(k * (y - c * x), 5) + 0.0 AS toward, round(y, 5) AS there, round(-k * (x - c * y), 5) + 0.0 AS carried, round(sqrt(vv), 6) AS norm FROM k""")
def lorentz_maps(spark, d):
    """Each vector x with its successor y on the hyperboloid, the times of: the tangent vector at x that leads to y, the point it
    leads to, and that vector carried to y; and the length of y back in the ball."""
    e = materialise(embedded(spark, d).select("id", H.lorentz_from_poincare(F.col("vec")).alias("x")), "lifted")
    x, y, u = F.col("x"), F.col("y"), F.col("u")
    rows = e.join(e.select((F.col("id") - 1).alias("id"), F.col("x").alias("y")), "id")
    rows = materialise(rows.withColumn("u", H.lorentz_logmap(x, y)), "tangents")
    time = lambda v: F.round(F.element_at(v, 1), 5) + 0.0
    return rows.select("id", time(u).alias("toward"), time(H.lorentz_expmap(x, u)).alias("there"), time(H.lorentz_transported(u, x, y)).alias("carried"), F.round(H.norm(H.lorentz_to_poincare(y)), 6).alias("norm"))


# --- evaluation ---


@query(sql(*PAIRS, "jaccard", select=CUTS + " SELECT j AS target, count(*) FILTER (quantile = 0.9) AS q90, count(*) FILTER (quantile = 0.95) AS q95, count(*) FILTER (quantile = 0.99) AS q99 FROM hit GROUP BY 1"))
def quantile_wide(spark, d):
    """Associations at each quantile side by side, a target that lacks one having 0."""
    counts = _over(spark, d).groupBy(F.col("j").alias("target")).pivot("quantile", [0.9, 0.95, 0.99]).agg(F.count("i"))
    return counts.toDF("target", "q90", "q95", "q99").na.fill(0)


@query(sql(*PAIRS, "jaccard", select=", t AS (SELECT round(round(1 - cost, 9), 6) AS s, CAST(i = j AS INTEGER) AS y FROM jaccard), g AS (SELECT s, sum(y) AS p, count(*) AS n FROM t GROUP BY 1), r AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS al, sum(p) OVER () AS pos, sum(n) OVER () AS tot FROM g), x AS (SELECT any_value(pos) AS pos, any_value(tot) AS tot, coalesce(sum(p) FILTER (s >= 0.2), 0) AS tp, coalesce(sum(n - p) FILTER (s >= 0.2), 0) AS fp, sum(p * ((tot - pos) - (al - tp - n + p) - 0.5 * (n - p))) AS auc, sum(p * tp / al) AS ap FROM r) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(pos - tp AS BIGINT) AS fn, CAST(tot - pos - fp AS BIGINT) AS tn, round((tp + tot - pos - fp) / tot, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / pos, 6) AS recall, round(auc / (pos * (tot - pos)), 6) AS roc_auc, round(ap / pos, 6) AS average_precision FROM x"))
def match_report(spark, d):
    """The costs as a classifier of true pairs: counts at a threshold, ROC-AUC and average precision."""
    rows = C.cost(profile(spark, d)).select(F.round(1 - F.col("cost"), 9).alias("s"), (F.col("i") == F.col("j")).cast("long").alias("y"))
    return rounded(M.binary_report(rows, "s", "y", 0.2), "accuracy", "precision", "recall", "roc_auc", "average_precision")


@query(sql(*PAIRS, "jaccard", select=", t AS (SELECT round(round(1 - cost, 9), 6) AS s, CAST(i = j AS INTEGER) AS y FROM jaccard), g AS (SELECT s, sum(y) AS p, count(*) AS n FROM t GROUP BY 1), r AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS al, sum(p) OVER () AS pos FROM g) SELECT s AS threshold, round(tp / al, 6) AS precision, round(tp / nullif(pos, 0), 6) AS recall FROM r WHERE tp >= 0.02::DOUBLE * al ORDER BY s LIMIT 1"))
def precision_threshold(spark, d):
    """The least similarity from which on a fiftieth of the pairs are true."""
    rows = C.cost(profile(spark, d)).select(F.round(1 - F.col("cost"), 9).alias("s"), (F.col("i") == F.col("j")).cast("long").alias("y"))
    return rounded(M.precision_threshold(rows, "s", "y", 0.02), "threshold", "precision", "recall")


@query(sql(*PAIRS, "jaccard", select=", t AS (SELECT i, j, round(cost, 9) AS v, md5(i) < '33' AS held FROM jaccard), h AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM t WHERE held AND i = j), c AS (SELECT coalesce(max(v), 'Infinity'::DOUBLE) AS threshold FROM h WHERE r = ceil((n + 1) * 0.9::DOUBLE)), z AS (SELECT i, count(*) AS size FROM t, c WHERE NOT held AND v <= threshold GROUP BY 1) SELECT round(threshold, 6) AS threshold, count(*) AS n, round(avg(CAST(v <= threshold AS INTEGER)), 6) AS coverage, round(avg(coalesce(size, 0)), 6) AS mean_size FROM t JOIN c ON true LEFT JOIN z ON z.i = t.i WHERE NOT held AND t.i = j GROUP BY threshold"))
def prediction_sets(spark, d):
    p = profile(spark, d)
    return rounded(M.prediction_sets(C.cost(p), truth_of(p), 0.1), "threshold", "coverage", "mean_size")


# --- transport ---


@query(sql("part_profile", select=", n AS (SELECT db, entity, count(*) OVER (PARTITION BY db) AS n FROM (SELECT DISTINCT db, entity FROM part_profile)) SELECT cell, db, entity, round(1.0::DOUBLE / n, 6) AS mass FROM n, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) v(cell)"))
def emd_marginals(spark, d):
    """What the exact plans of all cells send and receive: every entity an even share."""
    plan = materialise(T.by_cell(_cells(spark, d), "emd"), "plan")
    both = plan.select("cell", F.lit(0).alias("db"), F.col("i").alias("entity"), "mass").union(plan.select("cell", F.lit(1), "j", "mass"))
    return rounded(both.groupBy("cell", "db", "entity").agg(F.sum("mass").alias("mass")), "mass")


@query(sql("part_profile", select=", n AS (SELECT db, entity, count(*) OVER (PARTITION BY db) AS n FROM (SELECT DISTINCT db, entity FROM part_profile)) SELECT db, entity, round(1.0::DOUBLE / n, 6) AS mass FROM n"))
def sinkhorn_marginals(spark, d):
    """Sinkhorn run to its tolerance: every entity sends and receives an even share."""
    plan = materialise(T.sinkhorn(C.cost(part_profile(spark, d)), rounds=1000, tolerance=1e-9), "plan")
    both = plan.select(F.lit(0).alias("db"), F.col("i").alias("entity"), "mass").union(plan.select(F.lit(1), "j", "mass"))
    return rounded(both.groupBy("db", "entity").agg(F.sum("mass").alias("mass")), "mass")


@query()
def epsilon_sweep(spark, d):
    """For each strength of entropy the plan's distance from the exact one, and how much more it costs."""
    return rounded(T.epsilon_sweep(C.cost(part_profile(spark, d)), [0.5 * 0.8**k for k in range(16)]), "gap", "excess_pct")
