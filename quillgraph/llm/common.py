"""What the operators here share: a folder all machines see, and columns that can't clash."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where the session names none and runs on this machine alone."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        at = tempfile.mkdtemp(prefix="quillgraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def arrow_uri(spark: SparkSession, folder: str) -> str:
    """``folder`` as Arrow's file systems name it on any machine: with the scheme of the cluster's default store where it has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = store.makeQualified(path)
    if uri.toUri().getScheme() == "viewfs":
        uri = spark._jvm.org.apache.hadoop.fs.Path(store.resolvePath(uri.getParent()), uri.getName())
    return re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", uri.toString()))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> None:
    """Under a name of this attempt first, so that a task that runs again leaves one whole file."""
    fs, root = open_store(folder)
    fs.create_dir(root, recursive=True)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
        fs.delete_file(f"{root}/{name}")
    fs.move(own, f"{root}/{name}")


def read_file(folder: str, name: str) -> bytes | None:
    fs, root = open_store(folder)
    if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_file(f"{root}/{name}") as file:
        return file.read()


class Scratch:
    """Tables written under the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """``df``, written and read back, under ``name`` or a number."""
        self.n += 1
        at = f"{self.root}/{name or self.n}"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Deletes the tables named, or all."""
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        for path in [path_of(f"{self.root}/{x}") for x in names] or [path_of(self.root)]:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def own(df: DataFrame) -> list:
    """The columns of ``df``, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int):
    """crc32 of the identifier as text, modulo n; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n
