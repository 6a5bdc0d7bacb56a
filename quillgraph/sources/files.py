"""Files of a tree as a frame, by Spark's binary reader or a listing of the driver's own file system."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.columns import matches_glob

PRUNED = ("node_modules", "__pycache__", "target", ".git", ".venv")


def scan(spark: SparkSession, root: str, include=("**/*.md",), exclude=(), prune=PRUNED) -> DataFrame:
    """path (from the root), content (null: not UTF-8) and content_hash of every file in scope.

    Works on any store Spark reads. Hidden files and files in hidden folders are out unless one include pattern names every
    dot; those in pruned folders always are. Where all patterns end in one extension, no other file is opened.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    ends = {m[0] if (m := re.search(r"\.\w+$", g)) else "" for g in include}
    if len(ends) == 1 and "" not in ends:
        reader = reader.option("pathGlobFilter", f"*{ends.pop()}")
    files = reader.load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath()
    path = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:/*", "/"), "^\\Q" + full.rstrip("/") + "\\E/", "")
    rows = files.select(path.alias("path"), "content")
    return _in_scope(rows, include, exclude, prune).select("path", F.expr("try_validate_utf8(CAST(content AS STRING))").alias("content"), F.sha2("content", 256).alias("content_hash"))


def _in_scope(rows: DataFrame, include, exclude, prune) -> DataFrame:
    any_of = lambda globs: F.array_contains(F.array(*[matches_glob(F.col("path"), g) for g in globs]), True) if globs else F.lit(False)
    parts = F.split("path", "/")
    rows = rows.where(any_of(include) & ~any_of(exclude) & ~F.arrays_overlap(parts, F.array(*map(F.lit, prune))))
    hidden = F.exists(parts, lambda x: x.startswith("."))
    asked = F.lit(False)
    for g in include:
        asked = asked | (matches_glob(F.col("path"), g) & _insists_on_dots(parts, g))
    return rows.where(~hidden | asked)


def _insists_on_dots(parts: Column, glob: str) -> Column:
    """Whether the glob matches the path no longer when any hidden part's dot is another character: one glob names every dot."""

    def other(i: Column, mark: str) -> Column:
        return F.array_join(F.transform(parts, lambda x, j: F.when(j == i, F.concat(F.lit(mark), F.substring(x, 2, 1 << 30))).otherwise(x)), "/")

    places = F.sequence(F.lit(0), F.size(parts) - 1)
    shown = lambda i: ~F.element_at(parts, i + 1).startswith(".")
    return F.forall(places, lambda i: shown(i) | ~(matches_glob(other(i, "\x01"), glob) | matches_glob(other(i, "\x02"), glob)))


def one_name_each(files: DataFrame, real: DataFrame) -> DataFrame:
    """Files without further names of the same file: ``real`` maps path to real_path, and the first path by order stays."""
    kept = files.select("path").join(real, "path", "left").groupBy(F.coalesce("real_path", "path").alias("real_path")).agg(F.min("path").alias("path"))
    return files.join(kept.select("path"), "path", "left_semi")


def real_paths(spark: SparkSession, root: str) -> DataFrame:
    """path and real_path of what is below a folder of the driver's machine, for ``one_name_each``."""
    rows = [(os.path.relpath(at, root).replace(os.sep, "/"), os.path.realpath(at)) for d, _, names in os.walk(root) for at in (os.path.join(d, x) for x in names)]
    return spark.createDataFrame(rows, "path string, real_path string")


def overlay(files: DataFrame, proposed: DataFrame) -> DataFrame:
    """The files with proposed contents in place of theirs; a null content removes a file."""
    kept = files.join(proposed.select("path"), "path", "left_anti")
    new = proposed.where("content IS NOT NULL").select("path", "content", F.sha2("content", 256).alias("content_hash"))
    return kept.unionByName(new)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path and is_dir of all that exists below a folder of the driver's machine."""
    rows = [(os.path.relpath(os.path.join(d, x), root).replace(os.sep, "/"), kind) for d, dirs, names in os.walk(root) for kind, group in ((True, dirs), (False, names)) for x in group]
    return spark.createDataFrame(rows, "path string, is_dir boolean")


def git_ref(root: str, ref: str) -> str:
    """A temporary folder with the tree as it was at a ref."""
    to = tempfile.mkdtemp(prefix="quillgraph-ref-")
    data = subprocess.run(["git", "-C", root, "archive", ref], check=True, capture_output=True).stdout
    subprocess.run(["tar", "-x", "-C", to], input=data, check=True)
    return to


def git_commits(spark: SparkSession, root: str) -> DataFrame:
    """commit, path and date of every change in the history, for drift."""
    out = subprocess.run(["git", "-C", root, "log", "--relative", "--format=@%H %cs", "--name-only"], check=True, capture_output=True, text=True).stdout
    rows, commit, date = [], None, None
    for line in out.splitlines():
        if m := re.fullmatch(r"@([0-9a-f]{40,}) (\S+)", line):
            commit, date = m.groups()
        elif line:
            rows.append((commit, line, date))
    return spark.createDataFrame(rows, "commit string, path string, date string").withColumn("date", F.to_date("date"))


def conditional_exclude(files: DataFrame, status: DataFrame, parent_glob: str, child_glob: str, terminal: tuple[str, ...]) -> DataFrame:
    """Files without the children of terminal parents; ``status`` is (path, status), and parents themselves stay."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    closed = status.where(matches_glob(F.col("path"), parent_glob) & F.col("status").isin(*terminal)).select(folder.alias("dir")).distinct()
    children = files.select("path").where(matches_glob(F.col("path"), child_glob) & ~matches_glob(F.col("path"), parent_glob))
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    gone = children.select("path", F.explode(ancestors).alias("dir")).join(closed, "dir", "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti")
