"""A corpus pipeline of the operators in skyloom.llm: each stage takes and returns documents.

Rejected documents go, one document of each group of near copies stays, documents with leaked
benchmark items go, secrets are blanked out, and what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import decontaminate, ngram_join, packing, quality_classifier, secret_scan
from skyloom.llm.common import written

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("ngram_join", ngram_join.stage),
    ("decontaminate", decontaminate.stage),
    ("secret_scan", secret_scan.stage),
    ("packing", packing.stage),
]

#: Trained weights and token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
