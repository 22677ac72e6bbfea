"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netquarry.llm import bpe, decontaminate, pii, simhash, toxicity
from netquarry.llm.common import shared_path

STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("near_duplicates", simhash.keep_one),
    ("decontamination", decontaminate.drop_contaminated),
    ("personal_data", pii.mask),
    ("encoding", bpe.encode_stage),
]

#: SQL can't express the models and hashes of these stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := shared_path(spark, f"pipeline-{name}"))
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
