"""Corpus preparation in stages, each a whole pass over what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vertexflow.llm import line_dedup, mixing, packing, simhash, toxicity
from vertexflow.llm.storage import new_path

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("source_mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Classifier, fingerprints, draws and packing have no SQL form; tests/llm compares the stages and their
#: chain with brute force on planted tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet in the shared folder and read again."""
    folder = new_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
