"""Queries through the whole reading of files: Markdown made from the tables, parsed, resolved and assembled; with SQL of the outcome.

Every order is a file, every customer another. What an order's file looks like goes by its key modulo twelve: byte order mark
and CRLF, three ways not to parse, wrong types, no frontmatter, code, wikilinks, links by definition and over lines, links that
name nothing, succession, and lists of the frontmatter.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.model import Graph, Settings
from quillgraph.operators import rules
from quillgraph.operators.deltas import Delta
from quillgraph.operators.walks import _stored
from quillgraph.plans import build, view
from quillgraph.plans.parse import Rules
from quillgraph.registry import registry

QUERIES, SQL, _query = registry()
RULES = Rules(
    kind_rules=(("docs/orders/**", "order"), ("docs/customers/**", "customer")),
    id_rules=(("*", "**", "{kind}-{stem}"),),
    wikilinks=True,
    annotations=(("priority", r"\[PRIO: (?P<id>\d)-", "id", ()),),
    body_lines=(("amount", r"^AMOUNT: (?P<units>\d+)\.(?P<cents>\d+)$", ("order",)),),
)
SETTINGS = Settings(today=dt.date(2001, 9, 1), kinds=("order", "customer"), statuses=("active", "superseded"), terminal=("superseded",))

def _lines(*parts: str) -> str:
    return " || ".join(f"{p} || chr(10)" for p in parts)


#: SQL that Spark and DuckDB read alike, over n (order), c (customer), day, units, prio and v (n modulo 12).
_BODY = _lines("''", "'# Order ' || n", "''", "'See [the customer](../../customers/' || c || '.md).'", "''", "'AMOUNT: ' || units || '.' || (n % 100)", "'[PRIO: ' || prio || '-x]'")
_MORE = {
    6: _lines("''", "'```'", "'[no](../../customers/1.md) [PRIO: 9-x]'", "'```'", "''", "'`[no](../../customers/2.md)` and ``[no`](../../customers/3.md)``'"),
    7: _lines("''", "'[[customer-1]] and [[customer-1|again]], [[ghost-' || c || ']] `[[customer-2]]`'"),
    8: _lines("''", "'Both [the'", "'first][f] and [a [nested] one](../../customers/2.md'", "'\"title\").'", "''", "'[F]: ../../customers/1.md'"),
    9: _lines("''", "'[u](https://x.org/a.md) [p](img.png) [f](#frag) [g](../../customers/1.md#part) [m](missing-' || c || '.md)'"),
}
_HEAD = _lines("'id: order-' || n", "'title: Order ' || n", "'kind: order'", "'status: ' || CASE WHEN v = 10 THEN 'superseded' ELSE 'active' END", "'created: ' || day")
_FRONT = {
    1: _lines("'tags: [a'"),
    3: _lines("'title: again'"),
    10: _lines("'superseded_by: customer-' || c"),
    11: _lines("'related: [customer-' || c || ', nobody-' || n || ']'", "'covers: ../../customers/' || c || '.md'", "'implements:'", "'  - customer-1'", "'stage: {a: [1, true], b: ~}'"),
}
_TYPES = _lines("'id: order-' || n", "'title: Order ' || n", "'kind: order'", "'status: active'", "'created: 20'", "'tags: 5'", "'orphan_ok: \"yes\"'", "'owner: [a]'")
_BODY_OF = f"({_BODY} || CASE v {' '.join(f'WHEN {v} THEN {x}' for v, x in _MORE.items())} ELSE '' END)"
_CONTENT = f"""CASE WHEN v = 5 THEN {_BODY_OF} WHEN v = 4 THEN '---' || chr(10) || {_TYPES} || '---' || chr(10) || {_BODY_OF}
  WHEN v = 2 THEN '---' || chr(10) || {_HEAD} || {_BODY_OF}
  ELSE '---' || chr(10) || {_HEAD} || CASE v {' '.join(f'WHEN {v} THEN {x}' for v, x in _FRONT.items())} ELSE '' END || '---' || chr(10) || {_BODY_OF} END"""
_ORDERS = "SELECT o_orderkey AS n, o_custkey AS c, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, CAST(floor(o_totalprice) AS BIGINT) AS units, substr(o_orderpriority, 1, 1) AS prio, o_orderkey % 12 AS v FROM orders"


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows over all machines: a few packed bytes of a table become long texts, whose reading takes far longer than theirs."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def files(spark: SparkSession, sf: str) -> DataFrame:
    """path, content and content_hash of all files."""
    orders = view.read(spark, sf, "orders").selectExpr("o_orderkey AS n", "o_custkey AS c", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS day", "CAST(floor(o_totalprice) AS BIGINT) AS units", "substr(o_orderpriority, 1, 1) AS prio", "o_orderkey % 12 AS v")
    orders = _dealt(orders, "n")
    text = F.expr(_CONTENT)
    marked = F.concat(F.expr("decode(unhex('EFBBBF'), 'UTF-8')"), F.regexp_replace(text, "\n", "\r\n"))
    docs = orders.select(F.expr("'docs/orders/' || (n % 10) || '/' || n || '.md'").alias("path"), F.when(F.col("v") == 0, marked).otherwise(text).alias("content"))
    customers = _dealt(view.read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select(
        F.expr("'docs/customers/' || c_custkey || '.md'").alias("path"), F.expr("'---' || chr(10) || 'id: customer-' || c_custkey || chr(10) || 'title: \"' || c_name || '\"' || chr(10) || 'tags: [' || c_mktsegment || ']' || chr(10) || '---' || chr(10)").alias("content")
    )
    return docs.union(customers).withColumn("content_hash", F.sha2("content", 256))


def _graph(spark: SparkSession, sf: str) -> Graph:
    return build.assemble(build.parse_files(files(spark, sf), RULES), SETTINGS)


_ALL = f"o AS ({_ORDERS}), good AS (SELECT * FROM o WHERE v NOT IN (1, 2, 3)), q AS (SELECT *, {_BODY_OF} AS body FROM good)"


@_query("etl_nodes", f"""WITH {_ALL}
SELECT 'order-' || n AS id, 'docs/orders/' || (n % 10) || '/' || n || '.md' AS path, 'Order ' || n AS title, 'order' AS kind, CASE WHEN v = 10 THEN 'superseded' ELSE 'active' END AS status,
  CASE WHEN v NOT IN (4, 5) THEN day::DATE END AS created, CASE WHEN v = 10 THEN 'customer-' || c END AS superseded_by, '' AS tags, sha256(body) AS body_hash, CAST(len(string_split(body, chr(10))) - 1 AS BIGINT) AS n_lines,
  CASE WHEN v = 4 THEN 'created:date:integer,orphan_ok:bool:string,owner:string:array,tags:list of strings:integer' ELSE '' END AS issues, CASE WHEN v = 5 THEN 'id,title,kind,status' ELSE '' END AS inferred,
  CASE WHEN v = 11 THEN '{{"a": [1, true], "b": null}}' END AS stage
FROM q
UNION ALL SELECT 'customer-' || c_custkey, 'docs/customers/' || c_custkey || '.md', c_name, 'customer', 'active', NULL, NULL, c_mktsegment, sha256(''), 0, '', 'kind,status', NULL FROM customer""", with_view=False)
def etl_nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _graph(spark, sf).nodes
    issues = F.array_join(F.array_sort(F.transform("parse_issues", lambda x: F.concat_ws(":", x["field"], x["expected"], x["found"]))), ",")
    return rows.select("id", "path", "title", "kind", "status", "created", "superseded_by", F.array_join("tags", ",").alias("tags"), "body_hash", F.size("body_lines_hash").cast("long").alias("n_lines"), issues.alias("issues"), F.array_join("inferred_fields", ",").alias("inferred"), F.col("attrs")["stage"].alias("stage"))


_EDGES = f"""WITH {_ALL},
raw AS (
  SELECT 'order-' || n AS source, 'customer-' || c AS target_id, NULL AS target_raw, NULL AS cause, 'references' AS relation, 'L4' AS location, 0 AS ordinal FROM good
  UNION ALL SELECT 'order-' || n, 'customer-1', NULL, NULL, 'references', 'L9', 1 FROM good WHERE v IN (7, 8, 9)
  UNION ALL SELECT 'order-' || n, 'customer-2', NULL, NULL, 'references', 'L10', 2 FROM good WHERE v = 8
  UNION ALL SELECT 'order-' || n, NULL, 'ghost-' || c, 'missing', 'references', 'L9', 3 FROM good WHERE v = 7
  UNION ALL SELECT 'order-' || n, NULL, 'missing-' || c || '.md', 'missing', 'references', 'L9', 2 FROM good WHERE v = 9
  UNION ALL SELECT 'customer-' || c, 'order-' || n, NULL, NULL, 'supersedes', 'frontmatter:superseded_by', 9 FROM good WHERE v = 10
  UNION ALL SELECT 'order-' || n, 'customer-' || c, NULL, NULL, 'related', 'frontmatter:related', 4 FROM good WHERE v = 11
  UNION ALL SELECT 'order-' || n, NULL, 'nobody-' || n, 'id_not_found', 'related', 'frontmatter:related', 5 FROM good WHERE v = 11
  UNION ALL SELECT 'order-' || n, 'customer-1', NULL, NULL, 'implements', 'frontmatter:implements', 3 FROM good WHERE v = 11
  UNION ALL SELECT 'order-' || n, 'customer-' || c, NULL, NULL, 'covers', 'frontmatter:covers', 6 FROM good WHERE v = 11),
kept AS (SELECT source, target_id, target_raw, relation, any_value(cause) AS cause, arg_min(location, ordinal) AS location, min(ordinal) AS ordinal FROM raw GROUP BY source, target_id, target_raw, relation)"""


@_query("etl_edges", _EDGES + " SELECT row_number() OVER (ORDER BY source, relation, location, ordinal, target_id) - 1 AS edge_idx, source, target_id, target_raw, cause, relation, location FROM kept", with_view=False)
def etl_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).edges


@_query("etl_annotations", f"WITH {_ALL} SELECT 'order-' || n AS source, 'priority' AS name, prio AS key, CAST(7 AS INTEGER) AS line FROM good", with_view=False)
def etl_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).annotations


@_query("etl_body_lines", f"WITH {_ALL} SELECT 'order-' || n AS source, 'amount' AS name, CAST(6 AS INTEGER) AS line, CAST(units AS VARCHAR) AS units, CAST(n % 100 AS VARCHAR) AS cents FROM good", with_view=False)
def etl_body_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).body_lines.select("source", "name", "line", F.col("captures")["units"].alias("units"), F.col("captures")["cents"].alias("cents"))


@_query("etl_failures", f"WITH o AS ({_ORDERS}) SELECT 'docs/orders/' || (n % 10) || '/' || n || '.md' AS path, CASE v WHEN 1 THEN 'frontmatter' WHEN 2 THEN 'the frontmatter is not closed' ELSE 'duplicate key ''title''' END AS reason FROM o WHERE v IN (1, 2, 3)", with_view=False)
def etl_failures(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf).parse_failures.select("path", F.regexp_extract("message", r"^[^:\n]*", 0).alias("reason"))


@_query("etl_statistics", _EDGES + ", counted AS (SELECT CASE WHEN target_id IS NULL THEN 'unresolved:' ELSE 'edges:' END || relation AS measure, count(*) AS value FROM kept GROUP BY ALL UNION ALL SELECT 'nodes', (SELECT count(*) FROM good) + (SELECT count(*) FROM customer) UNION ALL SELECT 'parse_failures', (SELECT count(*) FROM o) - (SELECT count(*) FROM good)) SELECT * FROM counted", with_view=False)
def etl_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return build.statistics(_graph(spark, sf))


@_query("etl_cached", f"WITH {_ALL} SELECT 'docs/orders/' || (n % 10) || '/' || n || '.md' AS path, 'Order ' || n || CASE WHEN n % 7 = 0 THEN ' now' ELSE '' END AS title FROM good UNION ALL SELECT 'docs/customers/' || c_custkey || '.md', c_name FROM customer", with_view=False)
def etl_cached(spark: SparkSession, sf: str) -> DataFrame:
    """Files parsed once, some of them changed, and parsed again with what is cached: only those changed are read anew."""
    now = files(spark, sf)
    first = _stored(build.parse_files(now, RULES))
    changed = F.expr("path LIKE 'docs/orders/%' AND try_cast(regexp_extract(path, '([0-9]+)[.]md$', 1) AS BIGINT) % 7 = 0")
    content = F.when(changed, F.regexp_replace(F.regexp_replace("content", r"title: (Order \d+)", "title: $1 now"), r"# (Order \d+)", "# $1 now")).otherwise(F.col("content"))
    again = build.parse_changed(now.select("path", content.alias("content")).withColumn("content_hash", F.sha2("content", 256)), RULES, first)
    return again.where("node IS NOT NULL").select("path", "node.title")


def _later(spark: SparkSession, sf: str) -> Delta:
    """The files, and the same with priorities of every seventh order raised, every fifth gone, and a reference line moved."""
    now = files(spark, sf)
    key = F.expr("try_cast(regexp_extract(path, 'orders/[0-9]+/([0-9]+)[.]md$', 1) AS BIGINT)")
    raised = F.when(key % 7 == 0, F.regexp_replace("content", r"\[PRIO: \d-", "[PRIO: 9-")).when(key % 11 == 0, F.regexp_replace("content", r"\[PRIO: ", "\n[PRIO: ")).otherwise(F.col("content"))
    new = now.where(~F.coalesce(key % 5 == 0, F.lit(False))).select("path", raised.alias("content")).withColumn("content_hash", F.sha2("content", 256))
    return Delta(build.assemble(build.parse_files(now, RULES), SETTINGS), build.assemble(build.parse_files(new, RULES), SETTINGS))


_LATER = f"""WITH {_ALL}, was AS (SELECT n, prio AS key, 7 AS line FROM good),
will AS (SELECT n, CASE WHEN n % 7 = 0 THEN '9' ELSE prio END AS key, CASE WHEN n % 7 <> 0 AND n % 11 = 0 THEN 8 ELSE 7 END AS line FROM good WHERE n % 5 <> 0)"""


@_query("etl_diff_annotations", f"""{_LATER} SELECT 'added' AS change, 'priority' AS name, key, 'order-' || n AS source, CAST(line AS INTEGER) AS line FROM (SELECT * FROM will EXCEPT SELECT * FROM was)
UNION ALL SELECT 'removed', 'priority', key, 'order-' || n, CAST(line AS INTEGER) FROM (SELECT * FROM was EXCEPT SELECT * FROM will)""", with_view=False)
def etl_diff_annotations(spark: SparkSession, sf: str) -> DataFrame:
    d = _later(spark, sf)
    return d.added_annotations().select(F.lit("added").alias("change"), "*").union(d.removed_annotations().select(F.lit("removed").alias("change"), "*"))


@_query("etl_diff_bodies", f"""{_LATER} SELECT 'body' AS change, 'order-' || n AS id FROM good WHERE n % 5 <> 0 AND ((n % 7 = 0 AND prio <> '9') OR (n % 7 <> 0 AND n % 11 = 0)) UNION ALL SELECT 'removed', 'order-' || n FROM good WHERE n % 5 = 0""", with_view=False)
def etl_diff_bodies(spark: SparkSession, sf: str) -> DataFrame:
    d = _later(spark, sf)
    return d.body_changes().select(F.lit("body").alias("change"), "id").union(d.removed_nodes().select(F.lit("removed"), "id"))


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the cluster's shared one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="quillgraph-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@_query("etl_snapshot", _EDGES + " SELECT source, target_id, target_raw, relation FROM kept", with_view=False)
def etl_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The edges of a graph that was written and read back."""
    at = _folder(spark, "snapshot")
    build.write_snapshot(_graph(spark, sf), at)
    return build.read_snapshot(spark, at, SETTINGS).edges.select("source", "target_id", "target_raw", "relation")


@_query("etl_json", f"WITH {_ALL} SELECT 'order-' || n AS id, 'Order ' || n AS title FROM good UNION ALL SELECT 'customer-' || c_custkey, c_name FROM customer", with_view=False)
def etl_json(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of a graph written as JSON lines and read as such."""
    at = _folder(spark, "json")
    build.write_json(_graph(spark, sf), at)
    return spark.read.schema("id string, title string").json(f"{at}/nodes.json")


@_query("etl_status", f"""WITH {_ALL} SELECT 'docs/orders/' || (n % 10) || '/' || n || '.md' AS path, CASE WHEN n % 5 = 0 THEN 'removed' ELSE 'changed' END AS state FROM o WHERE n % 5 = 0 OR n % 7 = 0""", with_view=False)
def etl_status(spark: SparkSession, sf: str) -> DataFrame:
    """Files that differ from what a graph was built from, failures included."""
    now = files(spark, sf)
    key = F.expr("try_cast(regexp_extract(path, 'orders/[0-9]+/([0-9]+)[.]md$', 1) AS BIGINT)")
    new = now.where(~F.coalesce(key % 5 == 0, F.lit(False))).withColumn("content_hash", F.when(key % 7 == 0, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("content_hash")))
    return build.status(_graph(spark, sf), new)


@_query("etl_rule_body_line", f"WITH {_ALL} SELECT 'body_line/amount' AS rule_id, 'order-' || n AS node_id, 'docs/orders/' || (n % 10) || '/' || n || '.md' AS path FROM good WHERE n % 100 NOT IN (0, 25, 50, 75)", with_view=False)
def etl_rule_body_line(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts whose cents are not quarters."""
    g = _graph(spark, sf)
    s = dataclasses.replace(g.settings, body_lines=({"name": "amount", "capture": "cents", "allowed": ("0", "25", "50", "75"), "kinds": ("order",)},))
    return rules.body_line(dataclasses.replace(g, settings=s)).findings.select("rule_id", "node_id", "path")
