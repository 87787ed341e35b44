"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, SentencePiece ids.

Each stage is written as Parquet to the shared folder and read again by the
next, so a lost executor costs no more than tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chalkline.llm import line_dedup, mixing, near_dedup, sentencepiece_fst, toxicity
from chalkline.llm.storage import drop, fresh, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", line_dedup.stage),
    ("minhash_near_dedup", near_dedup.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", sentencepiece_fst.stage),
]
#: Classifiers, edit distances and tokenizers are not for SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
