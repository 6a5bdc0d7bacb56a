"""The driver's tables as a document graph: entities are documents, their keys are references."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.model import Graph, Settings

TODAY = dt.date(2001, 9, 1)
SETTINGS = Settings(
    today=TODAY,
    kinds=("region", "nation", "customer", "supplier", "part", "order"),
    statuses=("active", "draft", "superseded"),
    terminal=("superseded",),
    stale_days=1500,
    orphan_ok_kinds=("region", "nation"),
    acyclic_relations=("related", "supersedes"),
    required=("reviewed",),
    enums={"status": ("active", "superseded")},
    cross_field=(("status=superseded", "superseded_by"),),
    types={"size": "integer", "segment": "string"},
)
_STRINGS = "array<string>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, kind: str, key: str, title, status=None, created=None, reviewed=None, tags=(), attrs: dict | None = None, folder=None) -> DataFrame:
    k = F.col(key).cast("string")
    null = F.lit(None)
    where = F.concat(F.lit(f"{kind}/"), folder, F.lit("/")) if folder is not None else F.lit(f"{kind}/")
    held = F.create_map(*[x for n, c in (attrs or {}).items() for x in (F.lit(n), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))]) if attrs else F.create_map()
    return df.select(
        F.concat(F.lit(f"{kind}-"), k).alias("id"),
        F.concat(where, k, F.lit(".md")).alias("path"),
        title.alias("title"),
        F.lit(kind).alias("kind"),
        (F.lit("active") if status is None else status).alias("status"),
        (null if created is None else created).cast("date").alias("created"),
        null.cast("date").alias("updated"),
        (null if reviewed is None else reviewed).cast("date").alias("reviewed"),
        null.cast("string").alias("owner"),
        null.cast("string").alias("superseded_by"),
        F.array(*tags).cast(_STRINGS).alias("tags"),
        F.lit(False).alias("orphan_ok"),
        held.cast("map<string,string>").alias("attrs"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    c = F.col
    date = c("o_orderdate").cast("date")
    status = F.when(c("o_orderstatus") == "F", "superseded").when(c("o_orderstatus") == "O", "active").otherwise("draft")
    parts = [
        _nodes(t("region"), "region", "r_regionkey", c("r_name")),
        _nodes(t("nation"), "nation", "n_nationkey", c("n_name")),
        _nodes(t("customer"), "customer", "c_custkey", c("c_name"), tags=[c("c_mktsegment")], attrs={"segment": c("c_mktsegment")}),
        _nodes(t("supplier"), "supplier", "s_suppkey", c("s_name")),
        _nodes(t("part"), "part", "p_partkey", c("p_name"), tags=[c("p_brand"), c("p_type")], attrs={"size": c("p_size")}),
        _nodes(t("orders"), "order", "o_orderkey", F.concat(F.lit("Order "), c("o_orderkey").cast("string")), status, date, F.when(c("o_orderstatus") != "P", F.date_add(date, (c("o_orderkey") % 90).cast("int"))), [c("o_orderpriority")], folder=(c("o_orderkey") % 10).cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target_id, relation, location and ordinal of every reference, repeats included."""
    t = lambda name: read(spark, sf_dir, name)

    def edge(df, source, key, target, to, relation, location=None, ordinal=None):
        name = lambda kind, k: F.concat(F.lit(f"{kind}-"), F.col(k).cast("string"))
        return df.select(name(source, key).alias("source"), name(target, to).alias("target_id"), F.lit(relation).alias("relation"), (F.lit(f"frontmatter:{relation}") if location is None else location).alias("location"), (F.lit(0) if ordinal is None else ordinal).cast("int").alias("ordinal"))

    line = F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))
    items, orders = t("lineitem"), t("orders")
    from pyspark.sql import Window

    older = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return (
        edge(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "related")
        .union(edge(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "related"))
        .union(edge(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "related"))
        .union(edge(orders, "order", "o_orderkey", "customer", "o_custkey", "implements"))
        .union(edge(orders.withColumn("older", older).where("older IS NOT NULL"), "order", "o_orderkey", "order", "older", "supersedes"))
        .union(edge(items, "order", "l_orderkey", "part", "l_partkey", "references", line, F.col("l_linenumber")))
        .union(edge(items, "order", "l_orderkey", "supplier", "l_suppkey", "references", line, F.col("l_linenumber")))
    )


def edges(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] | None = None) -> DataFrame:
    """Distinct references, the first of each kept; ``edge_idx`` orders them as the canonical order does."""
    raw = raw_edges(spark, sf_dir)
    if relations:
        raw = raw.where(F.col("relation").isin(*relations))
    # Numbers alone are aggregated, before the exchange; where a reference stands follows from its ordinal.
    rows = raw.groupBy("source", "relation", "target_id").agg(F.min("ordinal").alias("ordinal"))
    rows = rows.withColumn("location", F.when(F.col("ordinal") == 0, F.concat(F.lit("frontmatter:"), F.col("relation"))).otherwise(F.concat(F.lit("L"), F.col("ordinal").cast("string"))))
    order = F.struct("source", "relation", "location", "ordinal", "target_id")
    null = F.lit(None).cast("string")
    return rows.select(order.alias("edge_idx"), "source", "target_id", null.alias("target_raw"), null.alias("cause"), "relation", "location")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes to their customer's document."""
    return read(spark, sf_dir, "events").select(F.concat(F.lit("customer/"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.col("ts").cast("date").alias("date"))


def graph(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] | None = None, settings: Settings = SETTINGS) -> Graph:
    return Graph(nodes(spark, sf_dir), edges(spark, sf_dir, relations), settings, commits=commits(spark, sf_dir))


#: The same view for DuckDB: CTEs ``nodes`` and ``edges``.
VIEW_SQL = """
nodes AS (
  SELECT 'region-' || r_regionkey AS id, 'region/' || r_regionkey || '.md' AS path, r_name AS title, 'region' AS kind, 'active' AS status, NULL::DATE AS created, NULL::DATE AS reviewed, []::VARCHAR[] AS tags, NULL::VARCHAR AS segment, NULL::VARCHAR AS size FROM region
  UNION ALL SELECT 'nation-' || n_nationkey, 'nation/' || n_nationkey || '.md', n_name, 'nation', 'active', NULL, NULL, []::VARCHAR[], NULL, NULL FROM nation
  UNION ALL SELECT 'customer-' || c_custkey, 'customer/' || c_custkey || '.md', c_name, 'customer', 'active', NULL, NULL, [c_mktsegment], c_mktsegment, NULL FROM customer
  UNION ALL SELECT 'supplier-' || s_suppkey, 'supplier/' || s_suppkey || '.md', s_name, 'supplier', 'active', NULL, NULL, []::VARCHAR[], NULL, NULL FROM supplier
  UNION ALL SELECT 'part-' || p_partkey, 'part/' || p_partkey || '.md', p_name, 'part', 'active', NULL, NULL, [p_brand, p_type], NULL, p_size::VARCHAR FROM part
  UNION ALL SELECT 'order-' || o_orderkey, 'order/' || (o_orderkey % 10) || '/' || o_orderkey || '.md', 'Order ' || o_orderkey, 'order', CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'O' THEN 'active' ELSE 'draft' END,
    o_orderdate::DATE, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE + (o_orderkey % 90)::INTEGER END, [o_orderpriority], NULL, NULL FROM orders),
raw_edges AS (
  SELECT 'nation-' || n_nationkey AS source, 'region-' || n_regionkey AS target_id, 'related' AS relation, 'frontmatter:related' AS location, 0 AS ordinal FROM nation
  UNION ALL SELECT 'customer-' || c_custkey, 'nation-' || c_nationkey, 'related', 'frontmatter:related', 0 FROM customer
  UNION ALL SELECT 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'related', 'frontmatter:related', 0 FROM supplier
  UNION ALL SELECT 'order-' || o_orderkey, 'customer-' || o_custkey, 'implements', 'frontmatter:implements', 0 FROM orders
  UNION ALL SELECT 'order-' || o_orderkey, 'order-' || older, 'supersedes', 'frontmatter:supersedes', 0 FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS older FROM orders) WHERE older IS NOT NULL
  UNION ALL SELECT 'order-' || l_orderkey, 'part-' || l_partkey, 'references', 'L' || l_linenumber, l_linenumber FROM lineitem
  UNION ALL SELECT 'order-' || l_orderkey, 'supplier-' || l_suppkey, 'references', 'L' || l_linenumber, l_linenumber FROM lineitem),
edges AS (SELECT source, target_id, relation, arg_min(location, ordinal) AS location, min(ordinal) AS ordinal FROM raw_edges GROUP BY source, target_id, relation)
"""
