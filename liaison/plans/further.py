"""More registered queries: similarities, truths from cross references, reports, neighbour graphs and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hyperbolic as H
from ..operators import costs as C
from ..operators import geometry as G
from ..operators import graphs as R
from ..operators import matching as M
from ..operators import ontology as O
from ..operators import semantics as S
from ..operators import similarity as Y
from ..shared import materialise
from .catalogue import edges, part_profile, profile, purchases, sql, table
from .queries import DEGREES, EMB, LCA, PAIRS, _poincare, _weighted, embedded, names_of, query, roots, rounded, truth_of, up_of, weights_of

# --- similarities ---

@query("WITH serves AS (SELECT DISTINCT p_brand AS source, p_size AS target FROM part) SELECT DISTINCT a.source AS i, b.source AS j, 1.0::DOUBLE AS s FROM serves a JOIN serves b USING (target)")
def similarity_binary(spark, d):
    return Y.binary(table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_size").alias("target")))


TERM_S = """, own AS (SELECT DISTINCT p.entity, p.term, coalesce(-ln(w.w), 0) AS w FROM part_profile p LEFT JOIN weights w ON w.term = p.term WHERE p.db = 0),
    s AS (SELECT entity, count(*) AS n, sum(w) AS w, sum(w * w) AS ww FROM own GROUP BY 1), sh AS (SELECT a.entity AS i, b.entity AS j, count(*) AS c, sum(a.w) AS wc, sum(a.w * a.w) AS wwc FROM own a JOIN own b USING (term) GROUP BY 1, 2)
    SELECT i, j, round({s}, 6) AS s FROM sh JOIN s a ON a.entity = i JOIN s b ON b.entity = j"""
WEIGHED = ("part_profile", "edges", "closure", "self", "weights")


def _by_terms(spark, d, kind: str) -> DataFrame:
    p = part_profile(spark, d)
    return rounded(Y.by_terms(p.where("db = 0"), weights_of(spark, d, p).select("term", F.col("ic").alias("w")), kind), "s")


@query(sql(*WEIGHED, select=TERM_S.format(s="c / CAST(a.n + b.n - c AS DOUBLE)"), profile="part_profile"))
def similarity_jaccard(spark, d):
    return _by_terms(spark, d, "jaccard")


@query(sql(*WEIGHED, select=TERM_S.format(s="wwc / sqrt(a.ww * b.ww)"), profile="part_profile"))
def similarity_cosine(spark, d):
    return _by_terms(spark, d, "cosine")


@query(sql(*WEIGHED, select=TERM_S.format(s="wc / (a.w + b.w - wc)"), profile="part_profile"))
def similarity_weighted_jaccard(spark, d):
    return _by_terms(spark, d, "weighted_jaccard")


@query(f"""WITH serves AS (SELECT DISTINCT p_brand AS source, p_name AS target FROM part WHERE p_size = 1), s AS (SELECT DISTINCT a.source AS i, b.source AS j FROM serves a JOIN serves b USING (target)), n AS (SELECT DISTINCT source AS e FROM serves),
    r AS (SELECT a.e AS i, b.e AS j, row_number() OVER (ORDER BY md5('S|' || a.e || '|' || b.e), a.e, b.e) AS r FROM n a JOIN n b ON a.e < b.e),
    c AS (SELECT i, j FROM r WHERE r <= (SELECT (count(*) - (SELECT count(*) FROM n)) // 2 FROM s)) SELECT i, j, 1.0::DOUBLE AS s FROM (SELECT * FROM c UNION ALL SELECT j, i FROM c UNION ALL SELECT e, e FROM n)""")
def similarity_random(spark, d):
    part = table(spark, d, "part").where("p_size = 1")
    own = materialise(part.select(F.col("p_brand").alias("source"), F.col("p_name").alias("target")).distinct(), "serves")
    return Y.random_like(Y.binary(own), own.select(F.col("source").alias("entity")).distinct())


@query(sql(*WEIGHED, select=""", m AS (SELECT p.db, p.entity, avg(coalesce(-ln(w.w), 0)) AS m FROM part_profile p LEFT JOIN weights w ON w.term = p.term GROUP BY 1, 2) SELECT db, entity, round(m / sum(m) OVER (PARTITION BY db), 9) AS mass FROM m""", profile="part_profile"))
def marginals_ic(spark, d):
    p = part_profile(spark, d)
    return rounded(Y.marginals(p, weights_of(spark, d, p).select("term", F.col("ic").alias("w"))), "mass", digits=9)


# --- weights and costs ---

NORMS = ", tw AS (SELECT 'P:' || vec_id AS term, 2 * atanh(greatest(1e-10, least(1 - 1e-5, sqrt(list_dot_product(vec, vec))))) AS v FROM (SELECT id AS vec_id, vec FROM emb))"


@query(sql("purchases", "profile", select=f", {EMB}{NORMS}" + _weighted("tw.v")))
def cost_embedding_hamming(spark, d):
    """Weights are the distances of the terms' vectors to the origin; terms without a vector weigh 0."""
    e = embedded(spark, d).select(F.concat(F.lit("P:"), "id").alias("term"), H.distance_from(H.dot(F.col("vec"), F.col("vec")), F.lit(0.0), F.lit(0.0)).alias("w"))
    return rounded(C.cost(profile(spark, d), "weighted_hamming", materialise(e, "norms")), "cost", digits=4)


@query(sql("purchases", "profile", "edges", "closure", "self", "weights", select=", tw AS (SELECT term, CASE WHEN w < 1 THEN 1 / -ln(w) ELSE 0 END AS v FROM weights)" + _weighted("tw.v")))
def cost_weighted_hamming_inverse_ic(spark, d):
    w = weights_of(spark, d).select("term", F.when(F.col("ic") > 0, 1 / F.col("ic")).otherwise(0.0).alias("w"))
    return rounded(C.cost(profile(spark, d), "weighted_hamming", w), "cost", digits=4)


@query(sql(*PAIRS, select=", h AS (SELECT i, j, ni + nj - 2 * c AS h FROM pairs), s AS (SELECT i, j, (h / CAST(max(h) OVER () AS DOUBLE)) ** 2 AS s FROM h) SELECT i, j, round(CASE WHEN s < 0.01 THEN 0 ELSE s END, 6) AS cost FROM s"))
def cost_squared(spark, d):
    return rounded(C.squared(C.cost(profile(spark, d), "hamming"), 0.01), "cost")


@query(sql(*PAIRS, "jaccard", select="SELECT i, j, round(cost, 6) AS cost FROM jaccard WHERE i LIKE '%BUILDING' AND j LIKE '%MACHINERY'"))
def cost_submatrix(spark, d):
    p = profile(spark, d)
    rows = p.where("db = 0 and entity like '%BUILDING'").union(p.where("db = 1 and entity like '%MACHINERY'"))
    return rounded(C.cost(rows), "cost")


@query(sql("part_profile", "edges", "closure", "depth", select=LCA + " SELECT t1, t2, CAST(a.depth + b.depth - 2 * lca.depth AS INTEGER) AS cost FROM lca JOIN depth a ON a.term = t1 JOIN depth b ON b.term = t2"))
def cost_lca_path(spark, d):
    """Between terms: steps of depth up to the deepest common ancestor and down again."""
    e, p = edges(spark, d), part_profile(spark, d)
    depths = materialise(O.depth(e, roots(spark)), "depth")
    return C.path_distance(O.lca(names_of(p, 0), names_of(p, 1), O.closure(e), depths), depths)


@query(f"WITH {EMB} SELECT a.id AS i, b.id AS j, round({_poincare('a.vec', 'b.vec')}, 6) AS d FROM emb a JOIN emb b ON a.label = 3 AND b.label IN (4, 5)")
def vertical_distances(spark, d):
    """Distances between one entity's terms and those of several others, a row for each pair."""
    e = materialise(embedded(spark, d), "embedded")
    return G.pair_distances(e.where("label = 3"), e.where("label in (4, 5)"), digits=6)


@query(sql("purchases", "profile", "edges", "closure", "self", "weights", select=", m AS (SELECT p.db, p.entity, max(-ln(w.w)) AS m FROM profile p JOIN weights w ON w.term = p.term GROUP BY 1, 2) SELECT db, entity, round(m / max(m) OVER (), 6) AS share FROM m"))
def max_normalised_ic(spark, d):
    rows = profile(spark, d).join(weights_of(spark, d), "term").groupBy("db", "entity").agg(F.max("ic").alias("m"))
    most = rows.agg(F.max("m").alias("most"))
    return rounded(rows.crossJoin(F.broadcast(most)).select("db", "entity", (F.col("m") / F.col("most")).alias("share")), "share")


# --- truths from cross references ---

XREF = """xref AS (SELECT DISTINCT p_brand AS a, 'Brand#' || substr(p_brand, 8, 1) || substr(p_brand, 7, 1) AS b, CASE WHEN p_size % 3 = 0 THEN 'E' ELSE 'N' END AS kind FROM part
    UNION SELECT DISTINCT p_brand, p_brand, 'E' FROM part WHERE p_size < 40),
    gt AS (SELECT DISTINCT a AS i, b AS j FROM xref WHERE kind = 'E' AND a IN (SELECT entity FROM part_profile WHERE db = 0) AND b IN (SELECT entity FROM part_profile WHERE db = 1))"""


def xref(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    turned = F.concat(F.lit("Brand#"), F.substring("p_brand", 8, 1), F.substring("p_brand", 7, 1))
    kind = F.when(F.col("p_size") % 3 == 0, "E").otherwise("N")
    rows = part.select(F.col("p_brand").alias("a"), turned.alias("b"), kind.alias("kind")).union(part.where("p_size < 40").select("p_brand", "p_brand", F.lit("E")))
    return rows.distinct()


def _truth(spark, d) -> DataFrame:
    p = part_profile(spark, d)
    return M.truth_from(xref(spark, d).where("kind = 'E'"), p.where("db = 0"), p.where("db = 1"))


@query(sql("part_profile", select=f", {XREF} SELECT i, string_agg(j, ',' ORDER BY j) AS js, count(*) AS n FROM gt GROUP BY i"))
def ground_truth_xref(spark, d):
    return _truth(spark, d).groupBy("i").agg(F.array_join(F.array_sort(F.collect_list("j")), ",").alias("js"), F.count("*").alias("n"))


@query(sql("part_profile", "sizes", "shared", "jaccard", "ranked", select=f", {XREF}, x AS (SELECT g.i, min(rank) AS first, count(*) AS n, count(*) FILTER (rank <= 5) AS hits FROM gt g JOIN ranked r ON r.i = g.i AND r.j = g.j GROUP BY 1) SELECT count(*) AS n_sources, round(avg(CAST(first <= 1 AS INTEGER)), 6) AS any_1, round(avg(CAST(first <= 5 AS INTEGER)), 6) AS any_5, round(sum(hits) / sum(n), 6) AS recall_5, round(avg(first), 6) AS mean_first FROM x", profile="part_profile"))
def many_to_many_accuracy(spark, d):
    return rounded(M.many_to_many(C.cost(part_profile(spark, d)), _truth(spark, d), 5), "any_1", "any_5", "recall_5", "mean_first")


@query(sql("part_profile", "sizes", "shared", "jaccard", "ranked", select=f", {XREF} SELECT r.i, r.j, round(r.cost, 6) AS cost, r.rank, w.j AS j_w, round(w.cost, 6) AS cost_w FROM ranked r LEFT JOIN gt g ON g.i = r.i LEFT JOIN ranked w ON w.i = g.i AND w.j = g.j WHERE r.rank = 1", profile="part_profile"))
def truth_position(spark, d):
    """The best match of each source beside its true ones, whose columns end in `_w`."""
    ranks = materialise(M.ranked(C.cost(part_profile(spark, d))), "ranks")
    own = ranks.join(_truth(spark, d), ["i", "j"], "left_semi").select("i", F.col("j").alias("j_w"), F.col("cost").alias("cost_w"))
    return rounded(ranks.where("rank = 1").join(own, "i", "left"), "cost", "cost_w").select("i", "j", "cost", "rank", "j_w", "cost_w")


GENES = "genes AS (SELECT DISTINCT p_brand AS entity, CAST(p_partkey % 2 AS INTEGER) AS db, substr(p_type, 1, 2) AS gene FROM part WHERE p_size > 10)"


def genes(spark, d) -> DataFrame:
    return table(spark, d, "part").where("p_size > 10").select((F.col("p_partkey") % 2).cast("int").alias("db"), F.col("p_brand").alias("entity"), F.substring("p_type", 1, 2).alias("gene")).distinct()


@query(sql("part_profile", select=f", {XREF}, {GENES}, g AS (SELECT db, entity, string_agg(gene, ',' ORDER BY gene) AS genes FROM genes GROUP BY 1, 2) SELECT gt.i, gt.j, coalesce(a.genes, '') AS genes_i, coalesce(b.genes, '') AS genes_j, CASE WHEN a.genes IS NULL OR b.genes IS NULL THEN 'missing' WHEN a.genes = b.genes THEN 'equal' ELSE 'differ' END AS verdict FROM gt LEFT JOIN g a ON a.db = 0 AND a.entity = gt.i LEFT JOIN g b ON b.db = 1 AND b.entity = gt.j"))
def gene_agreement(spark, d):
    return M.agreement(_truth(spark, d), genes(spark, d))


@query(f"WITH {GENES} SELECT p_partkey AS id, p_brand AS entity, gene FROM part LEFT JOIN genes ON genes.db = p_partkey % 2 AND genes.entity = p_brand WHERE p_size <= 3")
def entity_genes(spark, d):
    """Entities joined with their genes under another key name; those without any stay."""
    part = table(spark, d, "part").where("p_size <= 3").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("entity"), (F.col("p_partkey") % 2).alias("k"))
    g = genes(spark, d).select(F.col("entity").alias("disease_id"), "db", "gene")
    return part.join(g, (F.col("entity") == F.col("disease_id")) & (F.col("k") == F.col("db")), "left").select("id", "entity", "gene")


@query(sql("purchases", "profile", "edges", "depth", select=", a AS (SELECT DISTINCT term FROM profile WHERE db = 0), b AS (SELECT DISTINCT term FROM profile WHERE db = 1) SELECT (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM b) AS n_right, (SELECT count(*) FROM a JOIN b USING (term)) AS n_both, (SELECT count(*) FROM (SELECT term FROM a UNION SELECT term FROM b) JOIN depth USING (term)) AS n_known, (SELECT count(*) FROM depth) AS n_terms"))
def catalogue_coverage(spark, d):
    return M.term_coverage(profile(spark, d), O.depth(edges(spark, d), roots(spark)).select("term"))


# --- reports ---


@query(sql("purchases", "profile", "sizes", select=" SELECT db, count(*) AS n, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS max FROM sizes GROUP BY db"))
def describe_profiles(spark, d):
    rows = profile(spark, d).groupBy("db", "entity").agg(F.count("*").alias("n"))
    cut = [F.percentile("n", F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return rounded(rows.groupBy("db").agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.stddev("n").alias("std"), F.min("n").alias("min"), *cut, F.max("n").alias("max")), "mean", "std")


@query(sql("edges", "depth", select="SELECT depth, count(*) AS n FROM depth GROUP BY depth"))
def depth_histogram(spark, d):
    return O.depth(edges(spark, d), roots(spark)).groupBy("depth").agg(F.count("*").alias("n"))


@query(sql("purchases", "profile", select=", n AS (SELECT count(DISTINCT db || '|' || entity) AS n FROM profile), c AS (SELECT term, count(*) AS c FROM profile GROUP BY 1) SELECT term, c AS n_entities FROM c, n WHERE c < n"))
def varying_terms(spark, d):
    """Terms whose 0/1 column varies: neither none nor all of the entities have them."""
    return M.varying(profile(spark, d))


@query(sql(*PAIRS, select="SELECT count(*) AS n_cells, count(*) FILTER (c > 0) AS n_shared, round(count(*) FILTER (c > 0) / count(*), 6) AS density, round(avg(c), 6) AS mean_degree FROM pairs"))
def overlap_density(spark, d):
    rows, some = C.overlaps(profile(spark, d)), (F.col("c") > 0).cast("long")
    return rounded(rows.agg(F.count("*").alias("n_cells"), F.sum(some).alias("n_shared"), F.avg(some).alias("density"), F.avg("c").alias("mean_degree")), "density", "mean_degree")


@query(sql("purchases", "profile", "edges", "closure", select="SELECT db, entity, count(*) AS n_terms FROM profile WHERE term IN (SELECT term FROM closure WHERE ancestor LIKE 'A:b%') GROUP BY 1, 2"))
def sub_ontology(spark, d):
    """Profiles on the terms below some branches only."""
    below = O.closure(edges(spark, d)).where("ancestor like 'A:b%'").select("term").distinct()
    return profile(spark, d).join(below, "term", "left_semi").groupBy("db", "entity").agg(F.count("*").alias("n_terms"))


@query(sql("purchases", "profile", "edges", "closure", "self", "weights", select="SELECT term, n, row_number() OVER (ORDER BY n DESC, term) AS place FROM weights QUALIFY place <= 50"))
def heaviest_terms(spark, d):
    """The 50 terms of the largest counts, in order."""
    top = weights_of(spark, d).select("term", "n").orderBy(F.desc("n"), "term").limit(50)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "term")).cast("long"))  # 50 rows


@query("SELECT id, label, round(sum(w), 6) AS weight, row_number() OVER (ORDER BY abs(round(sum(w), 6)) DESC, id) AS place FROM (SELECT vec_id AS id, label, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS w FROM embeddings) GROUP BY 1, 2 QUALIFY place <= 20")
def strongest_weights(spark, d):
    """The 20 largest sums by absolute value, signs kept."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("weight"))
    top = e.orderBy(F.abs("weight").desc(), "id").limit(20)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.abs("weight").desc(), "id")).cast("long"))  # 20 rows


@query(sql("part_profile", "sizes", "shared", "jaccard", select="SELECT i, string_agg(CAST(CAST(round(cost * 1000) AS INTEGER) AS VARCHAR), ' ' ORDER BY substr(j, 8), j) AS row FROM jaccard GROUP BY i", profile="part_profile"))
def heat_map_rows(spark, d):
    """Cost rows with their columns in the order of the labels' last figure."""
    cells = C.cost(part_profile(spark, d)).select("i", F.struct(F.substring("j", 8, 1), "j", F.round(F.col("cost") * 1000).cast("int").alias("v")).alias("x"))
    return cells.groupBy("i").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"].cast("string")), " ").alias("row"))


@query(f"WITH {EMB}, n AS (SELECT label, sqrt(list_dot_product(vec, vec)) AS n FROM emb) SELECT label, round(min(n), 6) AS min, round(avg(n), 6) AS mean, round(max(n), 6) AS max FROM n GROUP BY label")
def norm_report(spark, d):
    n = embedded(spark, d).select("label", H.norm(F.col("vec")).alias("n")).groupBy("label").agg(F.min("n").alias("min"), F.avg("n").alias("mean"), F.max("n").alias("max"))
    return rounded(n, "min", "mean", "max")
