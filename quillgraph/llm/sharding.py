"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

How many rows go from each input partition to each block of the output is drawn exactly as a uniform permutation of
all rows would have it (a multivariate hypergeometric matrix with fixed row and column sums). Then each partition
permutes its rows locally and deals them out by its row of the matrix, the blocks are exchanged, and each block
permutes again. The outcome is a uniform permutation of all rows, with shard sizes at most one apart (law ``rows``).

A shard consists of blocks of bounded size, each a range of its slots, so that no task holds a whole shard. No task
needs the whole matrix: it is drawn by halving the partitions, with a seed for each half, and a task follows only the
halves it lies in. The driver holds one count per input partition and one size per block.

The input's own columns ``shard`` and ``slot``, in any case, give way to the new ones; all others stay, whatever their names.
Rows keep their place by (partition, position), so repeated rows, ties and null identifiers are rows as any other.
The frame is read twice and must come from files or a checkpoint, whose partitions don't change between reads. An
empty frame has no rows in any shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillgraph.llm.common import fresh, own, table

SHARDS = 24
#: Rows of a block, unless there would be more than MAX_BLOCKS blocks.
BLOCK_ROWS = 4096
MAX_BLOCKS = 1 << 14


def block_sizes(rows: int, shards: int, block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each block, and each block's first slot; blocks of a shard are consecutive and as many for every shard."""
    per = max(1, min(-(-rows // (shards * block_rows)), max_blocks // shards))
    size = np.full(shards, rows // shards, np.int64)
    size[: rows % shards] += 1
    sizes = size[:, None] // per + (np.arange(per) < size[:, None] % per)
    return sizes.ravel(), (np.cumsum(sizes, 1) - sizes).ravel()


def matrix_row(counts: np.ndarray, sizes: np.ndarray, at: int, seed: int) -> np.ndarray:
    """Rows that partition ``at`` sends to each block; the rows for all partitions together are one draw of the matrix."""
    before = np.concatenate([[0], np.cumsum(counts)])
    low, high, have = 0, len(counts), sizes
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(have, int(before[mid] - before[low]), method="marginals")
        low, high, have = (low, mid, left) if at < mid else (mid, high, have - left)
    return have


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    held = dict(docs.groupBy(F.spark_partition_id().alias("p")).count().collect())
    counts = np.zeros(max(held, default=0) + 1, np.int64)
    for p, n in held.items():
        counts[p] = n
    sizes, first = block_sizes(int(counts.sum()), shards)
    per = len(sizes) // shards
    docs = docs.select(*[c for c, name in zip(own(docs), docs.columns, strict=True) if name.lower() not in ("shard", "slot")])  # those of before give way
    block, came, place = fresh(docs, "_block", "_from", "_place")
    plan = spark.sparkContext.broadcast((counts, sizes))
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in (block, came, place))])

    def deal(batches):
        counts, sizes = plan.value
        p, at, to = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if to is None:
                if p >= len(counts):
                    raise ValueError("the partitions changed between two reads: give a frame read from files or a checkpoint")
                to = np.random.default_rng([seed, 1, p]).permutation(np.repeat(np.arange(len(sizes)), matrix_row(counts, sizes, p, seed)))
            n = batch.num_rows
            if at + n > len(to):
                raise ValueError("the rows changed between two reads: give a frame read from files or a checkpoint")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[at : at + n], pa.int64()), pa.array(np.full(n, p), pa.int64()), pa.array(np.arange(at, at + n), pa.int64())], schema=_arrow(batch.schema))
            at += n

    def _arrow(schema: pa.Schema) -> pa.Schema:
        return pa.schema([*schema, *(pa.field(c, pa.int64()) for c in (block, came, place))])

    dealt = docs.mapInArrow(deal, schema)
    within = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed), came, place), came, place)
    starts = F.element_at(F.array(*[F.lit(int(x)) for x in first[:per]]), (F.col(block) % per + 1).cast("int")) if per * shards == len(first) and len(set(map(tuple, first.reshape(shards, per).tolist()))) == 1 else None
    if starts is None:  # shards of two sizes: the larger ones come first
        big, small = first[:per], first[-per:]
        n_big = next((s for s in range(shards) if first[s * per : s * per + per].tolist() != big.tolist()), shards)
        pick = lambda xs: F.element_at(F.array(*[F.lit(int(x)) for x in xs]), (F.col(block) % per + 1).cast("int"))
        starts = F.when(F.col(block) < n_big * per, pick(big)).otherwise(pick(small))
    slot = (F.row_number().over(within) - 1 + starts).cast("long")
    return dealt.withColumn("slot", slot).withColumn("shard", F.floor(F.col(block) / per).cast("int")).drop(block, came, place)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and slot; null and empty texts, ties and repeated rows are rows as any other."""
    return shard_rows(docs)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = shard_rows(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
SQL: dict[str, str] = {}
