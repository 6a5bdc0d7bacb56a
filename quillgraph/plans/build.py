"""Files to graph: read in Arrow batches, resolve by joins, number edges in canonical order, write and read snapshots."""

from __future__ import annotations

import dataclasses
import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from quillgraph.functions.columns import matches_glob
from quillgraph.model import EDGES, NODES, Graph, Settings
from quillgraph.operators.walks import _cut, _stored, topological
from quillgraph.plans.parse import ParseError, Rules, read_document
from quillgraph.plans.resolve import canonical, mirrored, resolve

FORMAT_VERSION = 1
#: Files parsed between two batches that a reader hands on.
ROWS = 2000
_S = StringType()
PARSED = StructType(
    [
        StructField("path", _S),
        StructField("content_hash", _S),
        StructField("error", _S),
        StructField("node", NODES),
        StructField("raw_edges", ArrayType(StructType([StructField(c, _S) for c in ("target", "relation", "location")]))),
        StructField("annotations", ArrayType(StructType([StructField("name", _S), StructField("key", _S), StructField("line", IntegerType())]))),
        StructField("body_lines", ArrayType(StructType([StructField("name", _S), StructField("line", IntegerType()), StructField("captures", MapType(_S, _S))]))),
    ]
)


class DuplicateId(ValueError):
    """Two files with one id."""


class SupersessionCycle(ValueError):
    """Documents that supersede each other in a ring."""


def parse_files(files: DataFrame, rules: Rules) -> DataFrame:
    """One row per file: its document, or the error that left none."""

    names = tuple(f.name for f in NODES.fields)

    def read(batches):
        types = to_arrow_schema(PARSED)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for path, content, digest in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    row = {"path": path, "content_hash": digest, "raw_edges": [], "annotations": [], "body_lines": []}
                    try:
                        if content is None:
                            raise ParseError("not UTF-8")
                        doc = read_document(path, content, rules)
                        node = {n: doc.fields.get(n) for n in names}
                        node["path"], node["content_hash"], node["parse_issues"], node["inferred_fields"] = path, digest, doc.issues, doc.inferred
                        node["attrs"] = list(node["attrs"].items())
                        row["node"] = node
                        row["raw_edges"] = [{"target": t, "relation": r, "location": l} for t, r, l in doc.raw_edges]
                        row["annotations"] = [{"name": n, "key": k, "line": i} for n, k, i in doc.annotations]
                        row["body_lines"] = [{"name": n, "line": i, "captures": list(c.items())} for n, i, c in doc.body_lines]
                    except ParseError as e:
                        row["error"] = str(e)
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=types)

    return files.select("path", "content", "content_hash").mapInArrow(read, PARSED)


def config_hash(*parts) -> str:
    """A digest of what reading depends on (reading rules, scope, this format's version): parsed files of another are not reused."""
    plain = json.dumps([FORMAT_VERSION, *(dataclasses.asdict(p) if dataclasses.is_dataclass(p) else p for p in parts)], sort_keys=True, default=list)
    return hashlib.sha256(plain.encode()).hexdigest()


class ParseCache:
    """Parsed files kept as a table under ``folder``, for one configuration; each save holds the paths there are now alone."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.root = spark, folder, f"{folder}/{key[:32]}"

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._fs(self.root)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        whole = [n for n in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(int(n) for n in whole if n.isdigit())

    def load(self) -> DataFrame | None:
        held = self._numbers()
        return self.spark.read.schema(PARSED).parquet(f"{self.root}/{held[-1]}") if held else None

    def parse(self, files: DataFrame, rules: Rules) -> tuple[DataFrame, int]:
        """The parsed files, saved again, and how many of them were held before."""
        held, cached = self._numbers(), self.load()
        to = f"{self.root}/{held[-1] + 1 if held else 0}"
        parse_changed(files, rules, cached).write.mode("overwrite").parquet(to)
        now = self.spark.read.schema(PARSED).parquet(to)
        reused = now.select("path", "content_hash").join(cached.select("path", "content_hash"), ["path", "content_hash"], "left_semi").count() if cached is not None else 0
        for n in held:
            fs, path = self._fs(f"{self.root}/{n}")
            fs.delete(path, True)
        return now, reused


def parse_changed(files: DataFrame, rules: Rules, cached: DataFrame | None) -> DataFrame:
    """The parsed files, those of the same path and content taken from ``cached``."""
    if cached is None:
        return parse_files(files, rules)
    key = ["path", "content_hash"]
    kept = cached.join(files.select(*key).hint("merge"), key, "left_semi").select(*[f.name for f in PARSED.fields])
    return kept.unionByName(parse_files(files.join(cached.select(*key).hint("merge"), key, "left_anti"), rules))


def assemble(parsed: DataFrame, settings: Settings, files: DataFrame | None = None, commits: DataFrame | None = None) -> Graph:
    """The graph of parsed files; ids must be unique and supersession free of rings."""
    parsed = _stored(parsed)
    nodes = parsed.where("node IS NOT NULL").select("node.*")
    # Digests alone are counted; ids are only compared where two digests are equal.
    if not nodes.groupBy(F.xxhash64("id")).count().where("count > 1").isEmpty() and (twice := duplicate_ids(nodes).orderBy("id").first()):
        raise DuplicateId(f"{twice.id}: {twice.first} and {twice.second}")
    raw = parsed.where("node IS NOT NULL").select(F.col("node.id").alias("source"), F.col("path").alias("source_path"), F.posexplode("raw_edges").alias("ordinal", "e"))
    raw = raw.select("source", "source_path", F.col("e.target").alias("target_raw"), F.col("e.relation").alias("relation"), F.col("e.location").alias("location"), "ordinal")
    edges = canonical(resolve(raw, nodes, settings.extensions).unionByName(mirrored(nodes)))
    check_supersession(edges)
    exploded = lambda c: parsed.where("node IS NOT NULL").select(F.col("node.id").alias("source"), F.explode(c).alias("x")).select("source", "x.*")
    return Graph(nodes, edges, settings, exploded("annotations").select("source", "name", "key", "line"), exploded("body_lines"), parsed.where("node IS NULL").select("path", F.col("error").alias("message"), "content_hash"), files, commits)


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """id, first and second path of ids that several files have; partial aggregates alone are shuffled, never all paths."""
    least = nodes.groupBy("id").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")
    return nodes.join(least, "id").where("path > first").groupBy("id", "first").agg(F.min("path").alias("second"))


def check_supersession(edges: DataFrame) -> None:
    """Peels documents that supersede nothing left, round by round, until nothing or a ring remains."""
    e = edges.where("relation = 'supersedes' AND target_id IS NOT NULL").select(F.col("source").alias("a"), F.col("target_id").alias("b")).distinct()
    n = e.count()
    while n:
        e = _cut(e.join(e.select(F.col("a").alias("b")), "b", "left_semi").join(e.select(F.col("b").alias("a")), "a", "left_semi").select("a", "b"))
        left = e.count()
        if left == n:
            rows = e.orderBy("a", "b").limit(1000).collect()
            ring = sorted({r.a for r in rows})
            raise SupersessionCycle(" → ".join(topological(set(ring), [(r.a, r.b) for r in rows])[:20]))
        n = left


def scope_advisories(paths: DataFrame, nodes: DataFrame, include=(), rules: Rules = Rules(), conditional=()) -> list[str]:
    """What a project declares that selects nothing, and documents that slip through its kinds; one pass over paths and one over nodes."""
    asked = [(f"scope.include pattern {g!r} matched no files", g) for g in include]
    asked += [(f"identity.kind_rules glob {g!r} (kind {k!r}) matched no files", g) for g, k in rules.kind_rules]
    asked += [(f"scope.conditional_exclude glob {g!r} matched no files, so the rule drops nothing", g) for pair in conditional for g in pair]
    any_path = lambda c: F.coalesce(F.max(c), F.lit(False))
    found = paths.agg(F.count("*").alias("n"), *[any_path(matches_glob(F.col("path"), g)).alias(f"p{i}") for i, (_, g) in enumerate(asked)]).first()
    if not found.n:
        return ["the scope holds no files"]
    out = [text for i, (text, _) in enumerate(asked) if not found[f"p{i}"]]
    if rules.id_rules:
        applies = [any_path((F.lit(k == "*") | (F.col("kind") == k)) & matches_glob(F.col("path"), g)).alias(f"r{i}") for i, (k, g, _) in enumerate(rules.id_rules)]
        row = nodes.agg(F.count("*").alias("n"), *applies).first()
        out += [f"identity.id_rules entry (kind {k!r}, glob {g!r}) applied to no node" for i, (k, g, _) in enumerate(rules.id_rules) if row.n and not row[f"r{i}"]]
    if rules.kind_rules:
        slipped = F.lit(True)
        for g, _ in rules.kind_rules:
            slipped = slipped & ~matches_glob(F.col("path"), g)
        rest = nodes.where((F.col("kind") == rules.fallback_kind) & slipped).agg(F.count("*").alias("n"), F.min("path").alias("least")).first()
        if rest.n:
            out.append(f"{rest.n} documents have kind {rules.fallback_kind!r} but match no identity.kind_rules glob, {rest.least!r} the first")
    return out


def statistics(graph: Graph) -> DataFrame:
    """measure and value: documents, failures, and edges by relation and by whether they are resolved."""
    one = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
    resolved = F.when(F.col("target_id").isNull(), "unresolved:").otherwise("edges:")
    by = graph.edges.groupBy(F.concat(resolved, "relation").alias("measure")).agg(F.count("*").alias("value"))
    out = one("nodes", graph.nodes).union(by)
    return out.union(one("parse_failures", graph.parse_failures)) if graph.parse_failures is not None else out


def write_json(graph: Graph, folder: str) -> None:
    """Nodes and edges as JSON lines, nodes by id and path and edges in canonical order, file after file."""
    for name, order in (("nodes", ["id", "path"]), ("edges", ["edge_idx"])):
        frame = getattr(graph, name)
        frame.orderBy(*order).select(F.to_json(F.struct(*frame.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/{name}.json")


def write_snapshot(graph: Graph, folder: str) -> None:
    """The relations as Parquet tables, and their format's version beside them."""
    spark = graph.nodes.sparkSession
    for name in ("nodes", "edges", "annotations", "body_lines", "parse_failures"):
        frame = getattr(graph, name)
        if frame is not None:
            frame.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps({"version": FORMAT_VERSION}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/meta")


def read_snapshot(spark: SparkSession, folder: str, settings: Settings) -> Graph:
    """A written graph; another version of the format is refused."""
    version = json.loads(spark.read.text(f"{folder}/meta").first()[0])["version"]
    if version != FORMAT_VERSION:
        raise ValueError(f"the snapshot has format {version}; this reads {FORMAT_VERSION}")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return Graph(spark.read.schema(NODES).parquet(f"{folder}/nodes"), spark.read.schema(EDGES).parquet(f"{folder}/edges"), settings, read("annotations"), read("body_lines"), read("parse_failures"))


def status(graph: Graph, files: DataFrame) -> DataFrame:
    """path and state (added, removed, changed) of files that differ from what the graph was built from."""
    had = graph.nodes.select("path", F.col("content_hash").alias("had")).unionByName(graph.parse_failures.select("path", F.col("content_hash").alias("had")))
    both = had.join(files.select("path", F.col("content_hash").alias("has")), "path", "full_outer")
    state = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.col("had") != F.col("has"), "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL").orderBy("path")
