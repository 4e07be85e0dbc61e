"""Training-data pipeline: five stages over ``documents``, each one operator of ``commune.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of documents.
Models are fitted on bounded samples of the labelled rows of ``sf_dir``, not on a stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from commune.llm import decontaminate, pieces, quality, simhash, toxicity
from commune.llm.common import scratch_path, table

STAGES = [
    ("quality_classifier", quality.stage),
    ("toxicity", toxicity.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("sentencepiece", pieces.stage),
]

# Compression lengths, XXH64 and piece encoding are beyond SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
