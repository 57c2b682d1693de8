"""A training corpus from `documents`: five stages, each given the rows that the stage before has kept.

run() writes each stage's rows as Parquet in the shared folder and reads them again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liaison.llm import decontamination, mixing, quality, simhash, token_output
from liaison.shared import materialise

STAGES = [
    ("quality classifier", quality.stage),
    ("SimHash near-dedup", simhash.stage),
    ("benchmark decontamination", decontamination.stage),
    ("mixing to target weights", mixing.stage),
    ("token ids", token_output.stage),
]

#: Scores, mixing rates and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
