"""The corpus pipeline: toxic documents out, lines de-duplicated, one document of each near-duplicate group, sources
mixed to target weights, packed into token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import stages
from strata.llm.shared import fresh_path

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line_dedup", stages.dedup_lines),
    ("ngram_jaccard", stages.keep_one_of_each_group),
    ("mix_sources", stages.mix_sources),
    ("best_fit_packing", stages.pack),
]

#: The learned scores, fuzzy lines and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
