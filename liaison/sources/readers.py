"""Readers of the catalogue files as long relations, and the matching writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def profile_matrix(spark: SparkSession, path: str, prefix: str = "HP:", sep: str = ",") -> DataFrame:
    """`(entity, term)` from a 0/1 matrix with the entity in its first column; the wide table is unpivoted, never kept."""
    wide = spark.read.csv(path, header=True, sep=sep)
    terms = [c for c in wide.columns[1:] if c.startswith(prefix)]
    long = wide.withColumnRenamed(wide.columns[0], "entity").unpivot(["entity"], terms, "term", "v")
    return long.where(F.col("v").cast("double") > 0).select("entity", "term")


def ontology_lines(spark: SparkSession, path: str) -> DataFrame:
    """`(term, name, parents)` of lines `id;name;...['HP:0000001', ...]`; lines of other kinds are left out."""
    lines = spark.read.text(path).where(F.col("value").startswith("HP:"))
    part = F.split("value", ";")
    listed = F.regexp_extract("value", r"\[([^\]]*'HP:\d{7}'[^\]]*)\]", 1)
    return lines.select(part[0].alias("term"), F.get(part, F.lit(1)).alias("name"), F.regexp_extract_all(listed, F.lit(r"HP:\d{7}"), F.lit(0)).alias("parents"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """`(entity, name, term)` of a tab-separated file with a preamble of `#` lines."""
    rows = spark.read.csv(path, header=True, sep="\t", comment="#")
    name = F.regexp_replace(F.trim(F.lower("disease_name")), r"[\s\-]+", " ")
    return rows.select(F.col("database_id").alias("entity"), name.alias("name"), F.col("hpo_id").alias("term"))


def names(spark: SparkSession, path: str, key: str = "hp_id", name: str = "name") -> DataFrame:
    """`(term, name)` of a `;`-separated file, one row for each id that has one: the first name by order where several are given."""
    rows = spark.read.csv(path, header=True, sep=";").where(F.col(key).isNotNull())
    return rows.groupBy(F.col(key).alias("term")).agg(F.min(name).alias("name"))


def cost_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """`(i, j, cost)` of a written matrix whose first column, named or not, numbers its rows; i and j count from 0."""
    wide = spark.read.csv(path, header=True, sep=sep)
    wide = wide.withColumnRenamed(wide.columns[0], "_i")
    long = wide.unpivot(["_i"], wide.columns[1:], "j", "cost")
    return long.select(F.col("_i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("cost").cast("double").alias("cost"))


def gene_associations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep="\t").drop("source")


def protein_links(spark: SparkSession, path: str, sep: str = " ", least: int = 0) -> DataFrame:
    """`(protein1, protein2, combined_score)` of at least `least`; published links of high confidence have 700."""
    rows = spark.read.csv(path, header=True, sep=sep).select("protein1", "protein2", F.col("combined_score").cast("int").alias("combined_score"))
    return rows.where(F.col("combined_score") >= least) if least else rows


def protein_info(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, sep="\t")
    return rows.select(F.col("#string_protein_id").alias("protein"), F.col("preferred_name").alias("gene_symbol"), "annotation")


def cross_references(spark: SparkSession, path: str, source: str = "OMIM") -> DataFrame:
    """`(src_id, tgt_id, mapping_type)` of an XML catalogue: one row for each external reference to `source`."""
    reference = "struct<Source: string, Reference: string, DisorderMappingRelation: struct<Name: string>>"
    kinds = f"OrphaCode string, ExternalReferenceList struct<ExternalReference: array<{reference}>>"
    rows = spark.read.format("xml").option("rowTag", "Disorder").schema(kinds).load(path)
    refs = rows.select("OrphaCode", F.explode("ExternalReferenceList.ExternalReference").alias("r")).where(F.col("r.Source") == source)
    return refs.select(F.concat(F.lit("ORPHA:"), "OrphaCode").alias("src_id"), F.concat(F.lit(f"{source}:"), "r.Reference").alias("tgt_id"), F.col("r.DisorderMappingRelation.Name").alias("mapping_type"))


def text_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """`(term, vec)` of lines `label v1 v2 ...`; the header and lines that are not numbers throughout are left out."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(part[0].alias("term"), F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(1))).alias("raw"))
    rows = rows.where(F.size("raw") > 1).withColumn("vec", F.transform("raw", lambda x: x.try_cast("double")))
    return rows.where(~F.exists("vec", lambda x: x.isNull())).select("term", "vec")


def results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, sep=";", inferSchema=True)


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """`(file, metric, value)` of files that hold one JSON object of numbers each; what is no number is null."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    return rows.select("file", F.explode("m").alias("metric", "value")).withColumn("value", F.col("value").try_cast("double"))


def pipe_list(column: str):
    """A pipe-joined cell as an array; null is an empty one."""
    return F.coalesce(F.filter(F.split(column, r"\|"), lambda x: x != ""), F.array().cast("array<string>"))


def write_results(rows: DataFrame, path: str) -> None:
    """gz CSV with `;`, arrays joined by pipes, without an index column."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.option("compression", "gzip").csv(path, sep=";", header=True, mode="overwrite")


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws("\t", *edges.columns).alias("value")).write.mode("overwrite").text(path)


def write_embeddings(rows: DataFrame, path: str, key: str = "term", vec: str = "vec") -> None:
    """Lines `label v1 v2 ...`, as `text_embeddings` reads them; labels must be without white space."""
    line = F.concat_ws(" ", F.col(key).cast("string"), F.array_join(F.transform(vec, lambda x: x.cast("string")), " "))
    rows.select(line.alias("value")).write.mode("overwrite").text(path)


def run_directory(spark: SparkSession, folder: str) -> str:
    """A new numbered folder in `folder`, made on its own file system: 0 if `folder` is new, else one over the largest number
    (1 where there is none)."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    base = path_of(folder.rstrip("/"))
    files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = 0
    if files.exists(base):
        taken = [x.getPath().getName() for x in files.listStatus(base) if x.isDirectory()]
        n = max((int(x) for x in taken if x.isdecimal()), default=0) + 1
    files.mkdirs(path_of(f"{base}/{n}"))
    return f"{folder.rstrip('/')}/{n}"


def cached(spark: SparkSession, folder: str, parameters: dict, build) -> DataFrame:
    """The table that `build()` gives, kept under the hash of its parameters: a second call reads it."""
    import hashlib
    import json

    path = f"{folder.rstrip('/')}/{hashlib.md5(json.dumps(parameters, sort_keys=True).encode()).hexdigest()}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
