"""A graph kept up to date from a stream of files: each micro-batch parses what it brings and replaces it by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.lookups import first_of
from quillgraph.plans.build import parse_files
from quillgraph.plans.parse import Rules


def follow(files: DataFrame, rules: Rules, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends parsed files, stamped by batch, under ``folder``; ``current`` reads the latest of each path.

    ``files`` streams (path, content, content_hash). A batch that runs again overwrites its own partition.
    """

    def put(batch: DataFrame, number: int) -> None:
        parse_files(batch, rules).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(parsed: DataFrame) -> DataFrame:
    """The latest parse of each path."""
    return first_of(parsed, ["path"], [F.desc("batch")]).drop("batch")
