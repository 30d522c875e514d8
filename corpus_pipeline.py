"""The training-data pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineforge.llm import bpe, decontaminate, quality_model, secrets, simhash
from lineforge.session import run_dir

STAGES = [
    ("quality_classifier", quality_model.keep_good),
    ("simhash_near_dedup", simhash.keep_one),
    ("decontamination", decontaminate.drop_contaminated),
    ("secret_scan", secrets.redact),
    ("bpe_encoding", bpe.tokenize),
]

# The classifier's and the forest's decisions have no SQL form; tests hold the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to what its predecessor kept and wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_dir(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
