"""The engine's relations, derived from the star-schema tables, each with the same relation as SQL.

Two catalogues `db` 0 and 1 hold the same entities seen in orders of even and odd key; an entity is a market segment of a
nation, its terms are the parts it bought. `part_profile` is the like for brands and part names, by parity of the part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(db, entity, o_orderkey, l_partkey, l_suppkey)`; the small tables are joined last, on pruned columns."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.select("c_custkey", F.concat_ws("/", "n_name", "c_mktsegment").alias("entity"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select((F.col("o_orderkey") % 2).cast("int").alias("db"), "entity", "o_orderkey", "l_partkey", "l_suppkey")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases(spark, sf_dir).select("db", "entity", F.concat(F.lit("P:"), "l_partkey").alias("term")).distinct()


def part_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select((F.col("p_partkey") % 2).cast("int").alias("db"), F.col("p_brand").alias("entity"), F.concat(F.lit("N:"), "p_name").alias("term")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(child, parent)`: part -> name -> its two words -> ROOT, and small brands -> their types -> ROOT."""
    part = table(spark, sf_dir, "part")
    word = F.split("p_name", " ")
    name = F.concat(F.lit("N:"), "p_name")
    pairs = [
        part.select(F.concat(F.lit("P:"), "p_partkey").alias("child"), name.alias("parent")),
        part.select(name, F.concat(F.lit("A:"), word[0])),
        part.select(name, F.concat(F.lit("O:"), word[1])),
        part.select(F.concat(F.lit("A:"), word[0]), F.lit("ROOT")),
        part.select(F.concat(F.lit("O:"), word[1]), F.lit("ROOT")),
        part.where("p_size <= 5").select(F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("T:"), "p_type")),
        part.where("p_size <= 5").select(F.concat(F.lit("T:"), "p_type"), F.lit("ROOT")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.union(p)
    return out.distinct()


SQL = {
    "purchases": """purchases AS (SELECT CAST(o_orderkey % 2 AS INTEGER) AS db, n_name || '/' || c_mktsegment AS entity, o_orderkey, l_partkey, l_suppkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "profile": "profile AS (SELECT DISTINCT db, entity, 'P:' || l_partkey AS term FROM purchases)",
    "part_profile": "part_profile AS (SELECT DISTINCT CAST(p_partkey % 2 AS INTEGER) AS db, p_brand AS entity, 'N:' || p_name AS term FROM part)",
    "edges": """edges AS (
        SELECT 'P:' || p_partkey AS child, 'N:' || p_name AS parent FROM part UNION SELECT 'N:' || p_name, 'A:' || split_part(p_name, ' ', 1) FROM part
        UNION SELECT 'N:' || p_name, 'O:' || split_part(p_name, ' ', 2) FROM part UNION SELECT 'A:' || split_part(p_name, ' ', 1), 'ROOT' FROM part
        UNION SELECT 'O:' || split_part(p_name, ' ', 2), 'ROOT' FROM part UNION SELECT 'B:' || p_brand, 'T:' || p_type FROM part WHERE p_size <= 5
        UNION SELECT 'T:' || p_type, 'ROOT' FROM part WHERE p_size <= 5)""",
    "closure": """closure AS (SELECT child AS term, parent AS ancestor FROM edges
        UNION SELECT c.term, e.parent FROM closure c JOIN edges e ON c.ancestor = e.child)""",
    "depth": """walk AS (SELECT 'ROOT' AS term, 0 AS level UNION SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.term),
        depth AS (SELECT term, CAST(min(level) AS INTEGER) AS depth FROM walk GROUP BY term)""",
    "self": "up AS (SELECT term, ancestor FROM closure UNION SELECT child, child FROM edges UNION SELECT parent, parent FROM edges)",
    "weights": """counted AS (SELECT u.ancestor AS term, count(*) AS n, count(DISTINCT p.entity) AS n_entities FROM {profile} p JOIN up u ON p.term = u.term GROUP BY 1),
        weights AS (SELECT term, n, n_entities, n / CAST(sum(n) OVER () AS DOUBLE) AS w FROM counted)""",
    "sizes": "sizes AS (SELECT db, entity, count(*) AS n FROM {profile} GROUP BY db, entity)",
    "shared": """shared AS (SELECT a.entity AS i, b.entity AS j, count(*) AS c FROM {profile} a JOIN {profile} b ON a.term = b.term AND a.db = 0 AND b.db = 1 GROUP BY 1, 2),
        pairs AS (SELECT a.entity AS i, b.entity AS j, a.n AS ni, b.n AS nj, coalesce(c, 0) AS c FROM sizes a JOIN sizes b ON a.db = 0 AND b.db = 1
          LEFT JOIN shared s ON s.i = a.entity AND s.j = b.entity)""",
    "jaccard": "jaccard AS (SELECT i, j, CASE WHEN ni + nj - c = 0 THEN 0.0 ELSE 1.0 - c / CAST(ni + nj - c AS DOUBLE) END AS cost FROM pairs)",
    "ranked": "ranked AS (SELECT i, j, cost, row_number() OVER (PARTITION BY i ORDER BY round(cost, 9), j) AS rank FROM jaccard)",
}


def sql(*names: str, select: str, profile: str = "profile") -> str:
    """A statement on the named relations, in order."""
    parts = ", ".join(SQL[n].replace("{profile}", profile) for n in names)
    return f"WITH RECURSIVE {parts} {select}" if {"closure", "depth"} & set(names) else f"WITH {parts} {select}"
