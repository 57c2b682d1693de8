"""Operators on a term hierarchy, a relation `edges(child, parent)` without cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise


def build_edges(terms: DataFrame, patch: DataFrame | None = None) -> DataFrame:
    """From `(term, parents array)`: an edge for each parent that is a known term, and those of `patch`."""
    found = terms.select(F.col("term").alias("child"), F.explode("parents").alias("parent"))
    found = found.join(terms.select(F.col("term").alias("parent")), "parent", "left_semi").select("child", "parent")
    return (found.union(patch.select("child", "parent")) if patch is not None else found).distinct()


def closure(edges: DataFrame, max_level: int | None = None) -> DataFrame:
    """`(term, ancestor)`, a term not being its own ancestor; at most `max_level` steps up. Semi-naive: a round joins only
    the pairs that are new, and is cut from the plan, so cycles end and the plan stays small."""
    edges = materialise(edges.select("child", "parent").distinct(), "edges")
    found = new = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"))
    level = 1
    while (max_level is None or level < max_level) and not new.isEmpty():
        step = new.join(edges, new["ancestor"] == edges["child"]).select("term", F.col("parent").alias("ancestor")).distinct()
        new = materialise(step.join(found, ["term", "ancestor"], "left_anti"), "closure")
        found = found.union(new)
        level += 1
    return found


def with_self(up: DataFrame) -> DataFrame:
    """The closure and each term as its own ancestor."""
    terms = up.select("term").union(up.select("ancestor")).distinct()
    return up.union(terms.select("term", F.col("term").alias("ancestor")))


def path_counts(edges: DataFrame) -> DataFrame:
    """`(term, ancestor, n_paths)`: along how many ways a term's mass comes to an ancestor in a hierarchy of many parents. Ways
    have an end only without cycles: as many rounds as there are terms mean a cycle, which is an error."""
    edges = materialise(edges.select("child", "parent").distinct(), "edges")
    new = edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("n_paths"))
    found, most = new, edges.select("child").distinct().count()
    for level in range(most + 1):
        if level == most and not new.isEmpty():
            raise ValueError("path_counts: the hierarchy has a cycle")
        step = new.join(edges, new["ancestor"] == edges["child"]).groupBy("term", F.col("parent").alias("ancestor")).agg(F.sum("n_paths").alias("n_paths"))
        new = materialise(step, "paths")
        if new.isEmpty():
            break
        found = found.union(new)
    return found.groupBy("term", "ancestor").agg(F.sum("n_paths").alias("n_paths"))


def depth(edges: DataFrame, roots: DataFrame, unreachable: str | None = None) -> DataFrame:
    """`(term, depth)`: steps from the nearest of `roots(term)`. Terms out of reach are left out, or given -1 ("minus_one") or
    the largest depth ("max")."""
    edges = materialise(edges.select("child", "parent").distinct(), "edges")
    found = new = roots.select("term", F.lit(0).alias("depth"))
    level = 0
    while not new.isEmpty():
        level += 1
        step = new.join(edges, new["term"] == edges["parent"]).select(F.col("child").alias("term")).distinct()
        new = materialise(step.join(found, "term", "left_anti").select("term", F.lit(level).alias("depth")), "depth")
        found = found.union(new)
    if unreachable:
        nodes = edges.select(F.col("child").alias("term")).union(edges.select("parent")).distinct()
        other = F.lit(-1) if unreachable == "minus_one" else F.lit(found.agg(F.max("depth")).first()[0])
        found = nodes.join(found, "term", "left").select("term", F.coalesce("depth", other).alias("depth"))
    return found


def degrees(edges: DataFrame) -> DataFrame:
    """`(term, n_children, n_parents)`."""
    ends = edges.select(F.col("parent").alias("term"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("child", F.lit(0), F.lit(1)))
    return ends.groupBy("term").agg(F.sum("down").alias("n_children"), F.sum("up").alias("n_parents"))


def structural_features(edges: DataFrame, up: DataFrame, depths: DataFrame) -> DataFrame:
    """Degree, depth and number of descendants, each over its maximum."""
    below = up.groupBy(F.col("ancestor").alias("term")).agg(F.count("*").alias("n_desc"))
    rows = degrees(edges).select("term", (F.col("n_children") + F.col("n_parents")).alias("degree")).join(depths, "term", "left").join(below, "term", "left")
    rows = rows.select("term", "degree", F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce("n_desc", F.lit(0)).alias("n_desc"))
    most = rows.agg(*(F.max(c).alias(f"max_{c}") for c in ("degree", "depth", "n_desc")))
    scaled = [(F.col(c) / (F.col(f"max_{c}") + 1e-8)).alias(c) for c in ("degree", "depth", "n_desc")]
    return rows.crossJoin(F.broadcast(most)).select("term", *scaled)  # one row is broadcast


def propagate(profile: DataFrame, up: DataFrame, depths: DataFrame | None = None, levels: int | None = None) -> DataFrame:
    """The profile and the ancestors of its terms; with `levels`, only those so many steps of depth above at most."""
    more = profile.join(up, "term")
    if levels is not None:
        own = depths.select("term", F.col("depth").alias("own"))
        above = depths.select(F.col("term").alias("ancestor"), F.col("depth").alias("above"))
        more = more.join(own, "term").join(above, "ancestor").where(F.col("own") - F.col("above") <= levels)
    return profile.union(more.select("db", "entity", F.col("ancestor").alias("term"))).distinct()


def cooccurrence_edges(profile: DataFrame, depths: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from the deeper to the shallower of two terms of one entity (ties: from the later name), unless they are there."""
    rows = profile.join(depths, "term").select("db", "entity", "term", "depth").distinct()
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.db") == F.col("b.db")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.term") < F.col("b.term")))
    late = F.col("b.depth") >= F.col("a.depth")
    found = pairs.select(F.when(late, F.col("b.term")).otherwise(F.col("a.term")).alias("child"), F.when(late, F.col("a.term")).otherwise(F.col("b.term")).alias("parent"))
    return found.distinct().join(edges, ["child", "parent"], "left_anti")


def coverage(profile: DataFrame, up: DataFrame, categories: DataFrame) -> DataFrame:
    """`(category, pct)`: the share of entities with a term in or below each of `categories(category)`, to one decimal."""
    all_of = profile.select("db", "entity").distinct().count()
    own = profile.join(with_self(up), "term").join(categories, F.col("ancestor") == F.col("category"))
    n = own.select("category", "db", "entity").distinct().groupBy("category").agg(F.count("*").alias("n"))
    return categories.join(n, "category", "left").select("category", F.round(100.0 * F.coalesce("n", F.lit(0)) / max(1, all_of), 1).alias("pct"))


def lca(left: DataFrame, right: DataFrame, up: DataFrame, depths: DataFrame) -> DataFrame:
    """`(t1, t2, lca, depth)`: the deepest common strict ancestor (ties: the first name); a term with itself is its own.
    Pairs with no common ancestor are left out."""
    with_depth = up.join(depths.withColumnRenamed("term", "ancestor"), "ancestor")
    a = with_depth.join(left.select(F.col("term")), "term", "left_semi").select(F.col("term").alias("t1"), "ancestor", "depth")
    b = with_depth.join(right.select(F.col("term")), "term", "left_semi").select(F.col("term").alias("t2"), "ancestor")
    best = a.join(b, "ancestor").where("t1 <> t2").groupBy("t1", "t2").agg(F.min(F.struct((-F.col("depth")).alias("d"), "ancestor")).alias("x"))
    same = left.join(right, "term", "left_semi").join(depths, "term").select(F.col("term").alias("t1"), F.col("term").alias("t2"), F.col("term").alias("lca"), "depth")
    return best.select("t1", "t2", F.col("x.ancestor").alias("lca"), (-F.col("x.d")).alias("depth")).union(same)


def entity_lca(profile: DataFrame, pairs: DataFrame) -> DataFrame:
    """`(i, j, avg_depth)`: for each term the best LCA depth against the other entity, averaged in both directions."""
    a = profile.where("db = 0").select(F.col("entity").alias("i"), F.col("term").alias("t1"))
    b = profile.where("db = 1").select(F.col("entity").alias("j"), F.col("term").alias("t2"))
    rows = a.join(pairs, "t1").join(b, "t2").select("i", "j", "t1", "t2", "depth")
    one = rows.groupBy("i", "j", "t1").agg(F.max("depth").alias("d")).groupBy("i", "j").agg(F.avg("d").alias("x"))
    two = rows.groupBy("i", "j", "t2").agg(F.max("depth").alias("d")).groupBy("i", "j").agg(F.avg("d").alias("y"))
    return one.join(two, ["i", "j"]).select("i", "j", ((F.col("x") + F.col("y")) / 2).alias("avg_depth"))


def resolve(profile: DataFrame, replaced: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Terms under their current ids: `replaced(old, new)`; then only those in `known(term)`."""
    rows = profile.join(replaced, F.col("term") == F.col("old"), "left").withColumn("term", F.coalesce("new", "term")).select(profile.columns).distinct()
    return rows.join(known, "term", "left_semi").select(profile.columns) if known is not None else rows


def heights(edges: DataFrame) -> DataFrame:
    """`(term, depth)`: the steps of the longest way from a leaf up to each term; a cycle is an error."""
    edges = materialise(edges.select("child", "parent").distinct(), "edges")
    found = new = _leaves(edges).select("term", F.lit(0).alias("depth"))
    level, most = 0, edges.select("child").distinct().count()
    while not new.isEmpty():
        level += 1
        if level > most + 1:
            raise ValueError("heights: the hierarchy has a cycle")
        step = new.join(edges, new["term"] == edges["child"]).select(F.col("parent").alias("term")).distinct()
        new = materialise(step.select("term", F.lit(level).alias("depth")), "heights")
        found = found.union(new)
    return found.groupBy("term").agg(F.max("depth").alias("depth"))


def imputed(values: DataFrame, edges: DataFrame) -> DataFrame:
    """`(term, entity, value)`: a term without values takes the mean of its children's, level by level from the leaves."""
    height = heights(edges)
    most = height.agg(F.max("depth")).first()[0] or 0
    own = values.select("term", "entity", "value")
    for level in range(1, most + 1):
        missing = height.where(F.col("depth") == level).join(own.select("term").distinct(), "term", "left_anti")
        below = edges.join(missing, F.col("parent") == F.col("term")).select("parent", "child")
        n = below.groupBy("parent").agg(F.count("*").alias("n"))
        new = below.join(own, F.col("child") == F.col("term")).groupBy("parent", "entity").agg(F.sum("value").alias("s"))
        new = new.join(n, "parent").select(F.col("parent").alias("term"), "entity", (F.col("s") / F.col("n")).alias("value"))
        own = materialise(own.union(new), "imputed")
    return own


def _leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("term")).distinct().join(edges.select(F.col("parent").alias("term")), "term", "left_anti")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends are both among `nodes(n)`."""
    own = nodes.select("n")
    return edges.join(own.withColumnRenamed("n", "child"), "child", "left_semi").join(own.withColumnRenamed("n", "parent"), "parent", "left_semi").select("child", "parent")
