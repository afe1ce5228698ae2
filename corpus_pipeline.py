"""The corpus pipeline: each stage applies one operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import pipeline
from leafmill.llm.base import Scratch

STAGES = pipeline.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, f"{i}_{name}")
            if i:
                scratch.drop(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs
