"""Queries that write the engine's relations as files of its formats and read them back."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import costs as C
from ..shared import shared_path
from ..sources import arrays, readers
from .catalogue import part_profile, sql, table
from .queries import query, rounded


@query("SELECT row, CAST(c - 1 AS INTEGER) AS c, round(CAST(embedding[c] AS DOUBLE), 6) AS x FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, embedding FROM embeddings), (SELECT unnest([1, 3, 8]) AS c)")
def array_components(spark, d):
    """Three components of the vectors, written as binary arrays by ascending id."""
    path = shared_path(spark, "arrays")
    arrays.write_arrays(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec")), path, "vec_id")
    chosen = [0, 2, 7]
    rows = arrays.read_arrays(spark, path, chosen).select("row", F.posexplode("vec").alias("k", "x"))
    return rounded(rows.select("row", F.element_at(F.array(*map(F.lit, chosen)), F.col("k") + 1).alias("c"), "x"), "x")


@query("SELECT CAST(vec_id AS VARCHAR) AS term, CAST(c - 1 AS INTEGER) AS c, round(CAST(embedding[c] AS DOUBLE), 6) AS x FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS c FROM embeddings)")
def text_vectors(spark, d):
    """Vectors written as lines of text."""
    path = shared_path(spark, "vectors")
    readers.write_embeddings(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec")), path, "vec_id")
    return rounded(readers.text_embeddings(spark, path).select("term", F.posexplode("vec").alias("c", "x")), "x")


@query(sql("part_profile", select="SELECT DISTINCT entity, term FROM part_profile WHERE db = 0", profile="part_profile"))
def matrix_file(spark, d):
    """The profiles of a catalogue as a 0/1 matrix file with a column for each term."""
    path = shared_path(spark, "matrix")
    rows = part_profile(spark, d).where("db = 0").select("entity", "term")
    rows.groupBy("entity").pivot("term").agg(F.lit(1)).fillna(0).write.option("compression", "gzip").csv(path, header=True)
    return readers.profile_matrix(spark, path, prefix="N:")


RESULTS = """, k AS (SELECT i, list(j ORDER BY round(cost, 9), j)[1:3] AS top, round(min(cost), 6) AS cost FROM jaccard GROUP BY i) SELECT i, cost, CAST(r AS INTEGER) AS place, top[r + 1] AS source FROM k, (SELECT unnest(range(3)) AS r) WHERE r < len(top)"""


@query(sql("part_profile", "sizes", "shared", "jaccard", select=RESULTS, profile="part_profile"))
def result_file(spark, d):
    """Each entity's three nearest, in a result file as a list joined by pipes, and taken from it again."""
    path = shared_path(spark, "results")
    order = W.partitionBy("i").orderBy(F.round("cost", 9), "j")
    near = C.cost(part_profile(spark, d)).withColumn("r", F.row_number().over(order)).where("r <= 3")
    near = near.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("r", "j"))).alias("x"), F.min("cost").alias("cost"))
    near = near.select("i", F.col("x.j").alias("sources"), "cost")
    readers.write_results(near, path)
    rows = readers.results(spark, path).select("i", F.col("cost").cast("double").alias("cost"), F.posexplode(readers.pipe_list("sources")).alias("place", "source"))
    return rounded(rows, "cost")
