"""Documents to training sequences in five stages; each works on all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared
folder and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorumstat.llm import decontaminate, jaccard_join, packing, pii, quality_rules, store

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: Token ids come from a tokenizer file, which SQL can't read.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
