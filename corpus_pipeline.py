"""Corpus pipeline: language ID, near-duplicate removal, decontamination, mixing and sharding of the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm import decontaminate, langid, mixing, near, shards
from sparkveil.llm.common import Scratch

STAGES = [
    ("language_id", langid.stage),
    ("near_dedup", near.stage),
    ("decontaminate", decontaminate.stage),
    ("mix_sources", mixing.stage),
    ("shard", shards.stage),
]

#: Trained models, min-hashes and hash draws are not SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after all stages, with the shard of each. Stages are cut by tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        made = scratch.table(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        docs = before = made
    return STAGES[-1][1](spark, docs, sf_dir)
