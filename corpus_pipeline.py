"""The corpus pipeline: each stage works on all that the one before kept, and is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import Scratch
from quillgraph.llm.decontaminate import decontamination_stage
from quillgraph.llm.mixing import mixing_stage
from quillgraph.llm.neardup import neardup_stage
from quillgraph.llm.quality import quality_stage
from quillgraph.llm.sharding import sharding_stage

#: Name and function (spark, docs, sf_dir) of each stage; all but the last return the columns of documents.
STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the near-duplicate components; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the documents kept, with shard and slot. A stage's table goes when the next one's is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
