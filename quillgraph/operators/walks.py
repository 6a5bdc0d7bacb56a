"""Walks over edges: level by level with joins, each level cut from its lineage at the cluster's checkpoint folder."""

from __future__ import annotations

import heapq
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.model import REF, Graph

#: Documents of one lineage, or of a cyclic rest, that the driver may order.
DRIVER_NODES = 100_000
#: Edges of codes (16 bytes each) that one task holds at once, about.
FOREST = 2_000_000
#: Steps from one document after which whole lineages are labelled instead.
STEPS = 8


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder, which all machines see."""
    if not spark.sparkContext.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines see")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="quillgraph-"))
    return spark.sparkContext.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder, without the plan that made them."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _stored(df: DataFrame) -> DataFrame:
    """The same as a table of columns: compressed, of known size, and each use reads what it asks for alone."""
    spark = df.sparkSession
    at = f"{_shared(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place in the order, from 0: each range numbers its rows from where the ranges before it end."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = _stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_k": within}))
    counts = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=0) + 1):
        starts.append(F.lit(total).cast("long"))
        total += counts.get(p, 0)
    return rows.withColumn(name, F.element_at(F.array(*starts), F.col("_p") + 1) + F.col("_k")).drop("_p", "_k")


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b: long) with each task's as stars (a: code, b: the least code that it reaches there), so never more than ids."""

    def forest(a, b):
        ids, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
        u, v = np.split(at, 2)
        label = np.arange(len(ids))
        while True:
            lu, lv = label[u], label[v]
            between = lu != lv
            if not between.any():
                break
            u, v, lu, lv = u[between], v[between], lu[between], lv[between]
            np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
            while not np.array_equal(up := label[label], label):
                label = up
        moved = label != np.arange(len(ids))
        return ids[moved], ids[label[moved]]

    def given(a, b):
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["a", "b"])

    def contract(batches):
        a, b, n = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy(zero_copy_only=False))
            b.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n > 2 * FOREST:
                x, y = forest(a, b)
                a, b, n = [x], [y], len(x)
                if n > FOREST:
                    yield from given(x, y)
                    a, b, n = [], [], 0
        if n:
            yield from given(*forest(a, b))

    return edges.select("a", "b").mapInArrow(contract, "a long, b long")


def component_codes(edges: DataFrame) -> DataFrame:
    """(a, b): the codes of the edges (a, b: long) and the least code that each reaches.

    Each round sends every code to the least around it, twice over, and the edges go on between where their ends came to; so the
    graph shrinks by a factor each round, and what one task can hold is finished in one.
    """
    e, sent = _stored(_contracted(edges)), []
    while e.count() > FOREST:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = _stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        to = _stored(to.join(to.select(F.col("a").alias("m"), F.col("m").alias("r")), "m").select("a", F.col("r").alias("m")))
        sent.append(to)
        e = e.join(to, "a").select(F.col("m").alias("x"), "b").join(to.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        e = _stored(_contracted(e.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))))
    labels = _stored(_contracted(e.coalesce(1)))
    for to in reversed(sent):
        labels = to.join(labels.select(F.col("a").alias("m"), "b"), "m", "left").select("a", F.coalesce("b", "m").alias("b"))
    return labels


def _code(ids: DataFrame):
    """A function of an id's column to its 64-bit code, such that no two of the ids (id) share one."""

    def clash(salt: int) -> bool:
        code = F.xxhash64("id", F.lit(salt))
        if ids.groupBy(code.alias("c")).count().where("count > 1").isEmpty():
            return False
        return not ids.groupBy(code.alias("c")).agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").isEmpty()

    salt = next(s for s in itertools.count() if not clash(s))
    return lambda c: F.xxhash64(c, F.lit(salt))


def component_labels(edges: DataFrame) -> DataFrame:
    """(id, component) for the nodes of ``edges`` (a, b): the least id that each reaches."""
    e = _stored(edges.select("a", "b").where("a <> b"))
    ids = _stored(e.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    code = _code(ids)
    labels = component_codes(e.select(code("a").alias("a"), code("b").alias("b")))
    rows = ids.withColumn("a", code("id")).join(labels, "a", "left").select("id", F.coalesce("b", "a").alias("root"))
    return rows.join(rows.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def components(g: Graph, relations=()) -> DataFrame:
    """id and component_id (1 for the largest, ties by least member) and size, every document included."""
    edges = g.edges.where("target_id IS NOT NULL")
    if relations:
        edges = edges.where(F.col("relation").isin(*relations))
    ids = g.nodes.select("id")
    code = _code(ids)
    labels = component_codes(edges.where("source <> target_id").select(code("source").alias("a"), code("target_id").alias("b")))
    rows = _stored(ids.withColumn("a", code("id")).join(labels, "a", "left").select("id", F.coalesce("b", "a").alias("root")))
    sizes = rows.groupBy("root").agg(F.count("*").alias("size"), F.min("id").alias("component"))
    ranked = numbered(sizes, [F.desc("size"), F.col("component")], "place").select("root", "size", (F.col("place") + 1).alias("component_id"))
    # A component that holds most documents would be one key of a join: the hundred largest are sent to their members instead.
    large = F.broadcast(ranked.where("component_id <= 100"))
    rest = rows.join(large.select("root"), "root", "left_anti").join(ranked, "root")
    return rows.join(large, "root").unionByName(rest).select("component_id", "size", "id")


def neighborhood(g: Graph, node_id: str, depth: int = 1) -> DataFrame:
    """Documents within ``depth`` edges of one, whichever way they point, with their distance."""
    e = g.edges.where("target_id IS NOT NULL")
    both = e.select(F.col("source").alias("a"), F.col("target_id").alias("id")).union(e.select(F.col("target_id").alias("a"), F.col("source").alias("id")))
    seen = g.nodes.where(F.col("id") == node_id).select("id", F.lit(0).alias("depth"))
    for k in range(1, depth + 1):
        step = both.join(seen.where(F.col("depth") == k - 1).select(F.col("id").alias("a")), "a").select("id").distinct().join(seen, "id", "left_anti")
        seen = seen.union(step.select("id", F.lit(k).alias("depth")))
        if k > 2:
            seen = _cut(seen)
    return seen.join(g.nodes.select(*REF), "id").select(*REF, "depth").orderBy("depth", "id")


def dependents(g: Graph, roots: DataFrame | str, max_depth: int | None = None, relations=()) -> DataFrame:
    """root, id, hops and via: what reaches each root against the edges, with the path that a breadth-first walk finds first.

    A level's candidates are ordered by their parent's place in the walk and the edge's index, so the witness is the
    same however rows are dealt out.
    """
    spark = g.nodes.sparkSession
    if isinstance(roots, str):
        roots = g.nodes.where(F.col("id") == roots).select(F.col("id").alias("root"))
    e = g.external
    if relations:
        e = e.where(F.col("relation").isin(*relations))
    e = e.select("edge_idx", "source", F.col("target_id").alias("parent"), "relation")
    level = _cut(roots.select("root", F.col("root").alias("id"), F.lit(0).cast("long").alias("rank")))
    seen = level.select("root", "id")
    via = F.array().cast("array<struct<source:string,target:string,relation:string>>")
    paths, out, k = level.select("root", "id", via.alias("via")), None, 0
    while max_depth is None or k < max_depth:
        k += 1
        step = e.join(level.select("root", F.col("id").alias("parent"), "rank"), "parent").join(seen.select("root", F.col("id").alias("source")), ["root", "source"], "left_anti")
        step = step.groupBy("root", F.col("source").alias("id")).agg(F.min(F.struct("rank", "edge_idx", "parent", "relation")).alias("f"))
        level = numbered(step.select("root", "id", "f.rank", "f.edge_idx", "f.parent", "f.relation"), [F.col("root"), F.col("rank"), F.col("edge_idx")], "place")
        level = level.select("root", "id", F.col("place").alias("rank"), "parent", "relation")
        if level.isEmpty():
            break
        seen = seen.union(level.select("root", "id"))
        hop = F.struct(F.col("id").alias("source"), F.col("parent").alias("target"), "relation")
        paths = _cut(level.join(paths.select("root", F.col("id").alias("parent"), "via"), ["root", "parent"]).select("root", "id", F.lit(k).alias("hops"), F.concat(F.array(hop), "via").alias("via")))
        out = paths if out is None else out.union(paths)
    if out is None:
        out = _nothing(spark, "root string, id string, hops int, via array<struct<source:string,target:string,relation:string>>")
    return out.select("root", "id", "hops", "via").orderBy("root", "hops", "id")


def chain(g: Graph, node_id: str) -> DataFrame:
    """The whole lineage of a document, old before new, ties by least id; what a cycle holds back comes last by id.

    The lineage is found in Spark; its order, which is sequential by nature, is made on the driver below DRIVER_NODES.
    """
    e = g.edges.where("relation = 'supersedes' AND target_id IS NOT NULL").select(F.col("source").alias("new"), F.col("target_id").alias("old"))
    both = e.select(F.col("new").alias("a"), F.col("old").alias("id")).union(e.select(F.col("old").alias("a"), F.col("new").alias("id")))
    seen = level = _cut(g.nodes.where(F.col("id") == node_id).select("id"))
    for _ in range(STEPS):
        level = _cut(both.join(level.select(F.col("id").alias("a")), "a").select("id").distinct().join(seen, "id", "left_anti"))
        if level.isEmpty():
            break
        seen = seen.union(level)
    else:  # a long one: all lineages at once, in rounds that grow with the logarithm of their length
        labels = _cut(component_labels(e.select(F.col("new").alias("a"), F.col("old").alias("b"))))
        seen = labels.join(labels.where(F.col("id") == node_id).select("component"), "component", "left_semi").select("id")
    if seen.count() > DRIVER_NODES:
        raise ValueError(f"a lineage of more than {DRIVER_NODES} documents")
    ids = {r.id for r in seen.collect()}
    links = e.join(seen.select(F.col("id").alias("new")), "new", "left_semi").collect()
    order = topological(ids, [(r.old, r.new) for r in links])
    rows = g.nodes.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(order)], "position int, id string")
    return rows.join(g.nodes.select(*REF), "id").select("position", *REF).orderBy("position")


def topological(ids: set[str], links: list[tuple[str, str]]) -> list[str]:
    """Ids with each link's first before its second, the least ready id first; ids in cycles last."""
    after: dict[str, set[str]] = {x: set() for x in ids}
    count = dict.fromkeys(ids, 0)
    for a, b in set(links):
        if a in ids and b in ids and b not in after[a]:
            after[a].add(b)
            count[b] += 1
    ready = [x for x in ids if not count[x]]
    heapq.heapify(ready)
    out = []
    while ready:
        out.append(x := heapq.heappop(ready))
        for y in after[x]:
            count[y] -= 1
            if not count[y]:
                heapq.heappush(ready, y)
    return out + sorted(ids - set(out))


def cyclic_members(g: Graph, relation: str, driver_links: int = DRIVER_NODES) -> DataFrame:
    """id, region (least id of its cycle) and via (its least successor inside) of documents in cycles of the relation.

    Components with fewer links than documents are trees and have none; they leave at once, however long their paths. What
    remains, small in a healthy graph, is split on the driver, or where it has more than ``driver_links`` links peeled of
    documents without predecessor or successor and split by colouring in Spark.
    """
    e = _stored(g.edges.where((F.col("relation") == relation) & F.col("target_id").isNotNull()).select(F.col("source").alias("a"), F.col("target_id").alias("b")).distinct())
    labels = component_labels(e)
    ids = labels.groupBy("component").agg(F.count("*").alias("ids"))
    at = e.join(labels.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))  # self-links have no label
    counts = at.groupBy("component").agg(F.count("*").alias("links")).join(ids, "component", "left").where("links >= coalesce(ids, 1)").select("component")
    e = _stored(at.join(counts, "component", "left_semi").select("a", "b"))
    n = e.count()
    if n > driver_links:
        e, n = _trimmed(e)
    if n > driver_links:
        regions = coloured_components(e)
        inside = e.join(regions.select(F.col("id").alias("a"), "region"), "a").join(regions.select(F.col("id").alias("b"), F.col("region").alias("other")), "b").where("region = other")
        return inside.groupBy(F.col("a").alias("id"), "region").agg(F.min("b").alias("via"))
    links: dict[str, list[str]] = {}
    for r in e.collect() if n else []:
        links.setdefault(r.a, []).append(r.b)
    rows = [(x, min(c), min(y for y in links[x] if y in c)) for c in strong_components(links) if len(c) > 1 or next(iter(c)) in links.get(next(iter(c)), ()) for x in sorted(c)]
    return g.nodes.sparkSession.createDataFrame(rows, "id string, region string, via string")


def _trimmed(e: DataFrame) -> tuple[DataFrame, int]:
    """The links (a, b) that are left when ends without predecessor or successor are peeled off, and their number."""
    n = e.count()
    while n:
        e = _cut(e.join(e.select(F.col("b").alias("a")), "a", "left_semi").join(e.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"))
        if (left := e.count()) == n:
            break
        n = left
    return e, n


def _spread(label: DataFrame, e: DataFrame) -> DataFrame:
    """label (id, m) with each id's m lowered to the least that reaches it along the links (a, b), until nothing moves."""
    while True:
        came = e.join(label.select(F.col("id").alias("a"), "m"), "a").groupBy(F.col("b").alias("id")).agg(F.min("m").alias("c"))
        step = _cut(label.join(came, "id", "left").select("id", F.least("m", F.coalesce("c", "m")).alias("m"), (F.coalesce("c", "m") < F.col("m")).alias("moved")))
        label = step.select("id", "m")
        if not step.where("moved").limit(1).count():
            return label


def coloured_components(e: DataFrame) -> DataFrame:
    """(id, region) of the strong components of the links (a, b), region being the least id of each; an id between cycles may
    be a region of its own. Nothing gathers on the driver.

    Each round colours every id by the least id that reaches it. The ids of a colour that reach its first id form that
    id's strong component; they leave, what can't be in a cycle is peeled off, and the rest goes round again.
    """
    found = _nothing(e.sparkSession, "id string, region string")
    while True:
        e, n = _trimmed(e)
        if not n:
            return found
        ids = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
        colour = _spread(ids.select("id", F.col("id").alias("m")), e)
        same = e.join(colour.select(F.col("id").alias("a"), F.col("m").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("m").alias("cb")), "b").where("ca = cb")
        back = _cut(same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Within a colour an id's own name is above its colour's, so only those that reach the first id come down to it.
        region = _spread(colour.select("id", F.col("id").alias("m")), back).join(colour.withColumnRenamed("m", "colour"), "id").where("m = colour").select("id", F.col("colour").alias("region"))
        region = _cut(region)
        found = found.union(region)
        gone = region.select("id")
        e = _cut(e.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"))


def strong_components(links: dict[str, list[str]]) -> list[set[str]]:
    """Tarjan's strongly connected components, without recursion."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out = []
    for root in sorted(links):
        if root in index:
            continue
        work = [(root, iter(sorted(links.get(root, ()))))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(sorted(links.get(to, ())))))
                    break
                if to in on:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = set()
                    while True:
                        group.add(x := stack.pop())
                        on.discard(x)
                        if x == node:
                            break
                    out.append(group)
    return out
