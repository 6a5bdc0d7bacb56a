"""Single operators over the driver's tables, each with DuckDB SQL that says the same."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.model import Graph
from quillgraph.operators import lookups, report, rules, scores
from quillgraph.operators.deltas import Delta, impact, likely_breaking
from quillgraph.plans import build, resolve, view
from quillgraph.queries import _DELTA, _LIVE, _REF, _delta
from quillgraph.registry import registry
from quillgraph.sources import files as sources

QUERIES, SQL, _query = registry()
_STRINGS = "array<string>"


def _number(column: str = "id") -> F.Column:
    return F.regexp_extract(column, r"(\d+)$", 1).cast("long")


def _with(g: Graph, **settings) -> Graph:
    return dataclasses.replace(g, settings=dataclasses.replace(g.settings, **settings))


def _only_nodes(spark, sf, **settings) -> Graph:
    nodes = view.nodes(spark, sf)
    return _with(Graph(nodes, nodes.select("id").where(F.lit(False)), view.SETTINGS), **settings)


# Sources


def _tree(spark, sf) -> DataFrame:
    """Documents as files: by source, with their text as content."""
    d = view.read(spark, sf, "documents")
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(path.alias("path"), F.col("text").alias("content"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "doc_id")


_TREE = "q AS (SELECT 'docs/' || source || '/' || doc_id || '.md' AS path, doc_id, source, lang, text FROM documents)"


@_query("s01_scope", f"WITH {_TREE} SELECT path FROM q WHERE (source = 'src1' OR doc_id BETWEEN 10 AND 19) AND doc_id <> 11 AND source <> 'src3'", with_view=False)
def s01_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Globs admit paths: one folder, or any two-digit name that begins with 1, without one file and a pruned folder."""
    return sources._in_scope(_tree(spark, sf).select("path"), ("docs/src1/**", "**/1?.md"), ("**/11.md",), ("src3",))


@_query("s02_conditional_exclude", f"""WITH {_TREE} SELECT path FROM q WHERE NOT (doc_id >= 100 AND source IN (SELECT source FROM q WHERE doc_id < 10 AND lang = 'fr'))""", with_view=False)
def s02_conditional_exclude(spark, sf):
    """Files of one-digit name are parents, closed where they are French; then files of three digits or more in their folder go."""
    tree = _tree(spark, sf).select("path", "doc_id")
    lang = view.read(spark, sf, "documents").select("doc_id", F.col("lang").alias("status"))
    status = tree.join(lang, "doc_id").select("path", "status")
    return sources.conditional_exclude(tree.select("path"), status, "docs/*/?.md", "docs/*/*???.md", ("fr",))


@_query("s03_one_name", f"WITH {_TREE} SELECT min(path) AS path FROM q GROUP BY doc_id // 2", with_view=False)
def s03_one_name(spark, sf):
    """Each two files are names of one: the first path of each stays."""
    tree = _tree(spark, sf)
    real = tree.select("path", F.floor(F.col("doc_id") / 2).cast("string").alias("real_path"))
    return sources.one_name_each(tree.select("path"), real)


@_query("s04_overlay", f"""WITH {_TREE} SELECT path, sha256(CASE WHEN doc_id % 10 = 1 THEN 'new ' || doc_id ELSE coalesce(text, '') END) AS content_hash FROM q WHERE doc_id % 10 <> 2
UNION ALL SELECT 'docs/added.md', sha256('x')""", with_view=False)
def s04_overlay(spark, sf):
    """Every tenth file gets new content, every tenth goes, and one is added."""
    tree = _tree(spark, sf)
    new = tree.where("doc_id % 10 = 1").select("path", F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("content"))
    gone = tree.where("doc_id % 10 = 2").select("path", F.lit(None).cast("string").alias("content"))
    one = spark.range(1).select(F.lit("docs/added.md").alias("path"), F.lit("x").alias("content"))
    return sources.overlay(tree.select("path", "content", "content_hash"), new.union(gone).union(one)).select("path", "content_hash")


@_query("q17_status", f"""WITH {_TREE} SELECT path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 7 = 1 THEN 'removed' ELSE 'changed' END AS state FROM q WHERE doc_id % 7 <= 2""", with_view=False)
def q17_status(spark, sf):
    """A snapshot without every seventh file, over files without the next seventh and with a third one changed."""
    tree = _tree(spark, sf)
    had = tree.where("doc_id % 7 <> 0").select("path", "content_hash")
    has = tree.where("doc_id % 7 <> 1").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 2, "changed").otherwise(F.col("content_hash")))
    g = Graph(had, had.select("path").where(F.lit(False)), view.SETTINGS, parse_failures=had.where(F.lit(False)))
    return build.status(g, has)


# Reading and building


@_query("p01_canonical_text", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(10), chr(13) || chr(10)), '^' || chr(65279), ''), chr(13) || chr(10) || '?', chr(10), 'g')) AS h FROM documents""", with_view=False)
def p01_canonical_text(spark, sf):
    dos = F.concat(F.lit("﻿"), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\r\n"))
    return view.read(spark, sf, "documents").select("doc_id", F.sha2(C.canonical_text(dos), 256).alias("h"))


@_query("b02_duplicate_ids", """WITH q AS (SELECT 'text-' || md5(coalesce(text, '')) AS id, 'docs/' || doc_id || '.md' AS path FROM documents),
r AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY path) AS n FROM q)
SELECT a.id, a.path AS first, b.path AS second FROM r a JOIN r b ON a.id = b.id AND a.n = 1 AND b.n = 2""", with_view=False)
def b02_duplicate_ids(spark, sf):
    d = view.read(spark, sf, "documents")
    return build.duplicate_ids(d.select(F.concat(F.lit("text-"), F.md5(F.coalesce("text", F.lit("")))).alias("id"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")))


_LATER = "q AS (SELECT o_orderkey AS k, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM orders)"


@_query("b03_mirrored", f"""WITH {_LATER}
SELECT 'order-' || later AS source, 'order-' || k AS target_id, NULL AS target_raw, NULL AS cause, 'supersedes' AS relation FROM q WHERE later IS NOT NULL AND later % 9 <> 0
UNION ALL SELECT 'order-' || k, NULL, 'order-' || later, 'id_not_found', 'superseded_by' FROM q WHERE later IS NOT NULL AND later % 9 = 0 AND k % 9 <> 0""", with_view=False)
def b03_mirrored(spark, sf):
    """Orders name the same customer's next order as their successor; every ninth order isn't there."""
    from pyspark.sql import Window

    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    name = lambda c: F.concat(F.lit("order-"), c.cast("string"))
    o = view.read(spark, sf, "orders").select("o_orderkey", later.alias("later"))
    nodes = o.where("o_orderkey % 9 <> 0").select(name(F.col("o_orderkey")).alias("id"), name(F.col("later")).alias("superseded_by"))
    return resolve.mirrored(nodes).select("source", "target_id", "target_raw", "cause", "relation")


SQL["b03_mirrored"] = SQL["b03_mirrored"].replace("AND later % 9 <> 0\n", "AND later % 9 <> 0 AND k % 9 <> 0\n")


@_query("b05_edge_order", "SELECT row_number() OVER (ORDER BY source, relation, location, target_id) - 1 AS edge_idx, source, target_id, relation, location FROM edges WHERE relation IN ('related', 'implements')")
def b05_edge_order(spark, sf):
    rows = view.raw_edges(spark, sf).where("relation IN ('related', 'implements')").withColumns({"target_raw": F.lit(None).cast("string"), "cause": F.lit(None).cast("string")})
    return resolve.canonical(rows).select("edge_idx", "source", "target_id", "relation", "location")


@_query("b09_advisories", """SELECT * FROM (VALUES ('scope.include pattern ''nowhere/**'' matched no files'), ('identity.kind_rules glob ''ghost/**'' (kind ''ghost'') matched no files'), ('identity.id_rules entry (kind ''ghost'', glob ''**'') applied to no node')) AS v(advice)""", with_view=False)
def b09_advisories(spark, sf):
    from quillgraph.plans.parse import Rules

    nodes = view.nodes(spark, sf)
    found = build.scope_advisories(nodes.select("path"), nodes, ("part/**", "nowhere/**"), Rules(kind_rules=(("order/**", "order"), ("ghost/**", "ghost")), id_rules=(("*", "**", "{stem}"), ("ghost", "**", "{stem}"))))
    return spark.createDataFrame([(x,) for x in found], "advice string")


@_query("b10_statistics", "SELECT 'edges:' || relation AS measure, count(*) AS value FROM edges GROUP BY relation UNION ALL SELECT 'nodes', count(*) FROM nodes")
def b10_statistics(spark, sf):
    return build.statistics(view.graph(spark, sf))


# Filters and projections


@_query("f02_tags", f"SELECT {_REF} FROM nodes WHERE list_contains(list_transform(tags, lambda t: lower(t)), 'brand#4') AND list_contains(list_transform(tags, lambda t: lower(t)), 'large')")
def f02_tags(spark, sf):
    return lookups.listing(_only_nodes(spark, sf), tags=("BRAND#4", "Large"), all_tags=True)


@_query("f04_predicates", """SELECT id, coalesce(kind = 'part', false) AS equal, coalesce(size IN ('1', '7', '11'), false) AS among, segment IS NOT NULL AS there, reviewed IS NULL AS missing FROM nodes""")
def f04_predicates(spark, sf):
    p = C.predicate
    return view.nodes(spark, sf).select("id", p("kind = part").alias("equal"), p('size in [1, "7", 11]').alias("among"), p("segment exists").alias("there"), p("reviewed not_exists").alias("missing"))


@_query("f06_missing", "SELECT id, created IS NULL AS created, len(tags) = 0 AS tags, true AS owner, size IS NULL AS size FROM nodes")
def f06_missing(spark, sf):
    return view.nodes(spark, sf).select("id", *(C.field_missing(f).alias(f) for f in ("created", "tags", "owner", "size")))


@_query("f09_projection", "SELECT id, path, size, reviewed::VARCHAR AS reviewed FROM nodes WHERE kind IN ('part', 'order')")
def f09_projection(spark, sf):
    return lookups.listing(_only_nodes(spark, sf), kinds=("part", "order"), fields=("id", "path", "size", "reviewed"))


@_query("f10_frontmatter", """SELECT id, CASE WHEN size IS NOT NULL THEN '{"kind":"' || kind || '","size":"' || size || '"}' WHEN segment IS NOT NULL THEN '{"kind":"' || kind || '","segment":"' || segment || '"}' ELSE '{"kind":"' || kind || '"}' END AS frontmatter FROM nodes""")
def f10_frontmatter(spark, sf):
    fields = ("kind", "size", "segment")
    made = F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), C.field_text(f))]), lambda k, v: v.isNotNull())
    return view.nodes(spark, sf).select("id", F.to_json(made).alias("frontmatter"))


# Aggregates, windows and sets


@_query("a03_linkers", "SELECT target_id AS id, count(DISTINCT source) AS linkers FROM edges WHERE source <> target_id GROUP BY target_id")
def a03_linkers(spark, sf):
    return scores.linkers(view.graph(spark, sf))


@_query("a05_most_linked", f"q AS (SELECT target_id AS id, count(*) AS incoming FROM edges WHERE source <> target_id GROUP BY target_id) SELECT id, title, kind, status, path, incoming FROM q JOIN nodes USING (id) WHERE {_LIVE} ORDER BY incoming DESC, id LIMIT 25")
def a05_most_linked(spark, sf):
    return report.gods(view.graph(spark, sf), 25).select(*_REF.split(", "), "incoming")


@_query("a09_hottest", """WITH target AS (SELECT o_orderkey, 'customer-' || o_custkey AS label, o_custkey AS u, o_orderdate::DATE + (o_orderkey % 90)::INTEGER AS r FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT o_orderkey, 'customer-' || ((o_custkey + 1) % 10), (o_custkey + 1) % 10, o_orderdate::DATE + (o_orderkey % 90)::INTEGER FROM orders WHERE o_orderstatus = 'O' AND o_custkey <> (o_custkey + 1) % 10),
q AS (SELECT o_orderkey, label, count(ev.d) AS n FROM target LEFT JOIN (SELECT user_id, ts::DATE AS d FROM events) ev ON user_id = u AND d > r GROUP BY ALL)
SELECT 'order-' || o_orderkey AS id, sum(n)::BIGINT AS commits, arg_min(label, (-n, label)) AS hottest, count(*) AS measured FROM q GROUP BY o_orderkey""", with_view=False)
def a09_hottest(spark, sf):
    """Orders lean on their customer and on one of ten others; the one whose document changed most since the review."""
    o = view.read(spark, sf, "orders")
    name = lambda kind, c: F.concat(F.lit(f"{kind}-"), c.cast("string"))
    own = o.select(name("order", F.col("o_orderkey")).alias("source"), name("customer", F.col("o_custkey")).alias("target_id"))
    other = o.select(name("order", F.col("o_orderkey")).alias("source"), name("customer", (F.col("o_custkey") + 1) % 10).alias("target_id"))
    null = F.lit(None).cast("string")
    edges = own.union(other).distinct().select(F.struct("source", "target_id").alias("edge_idx"), "source", "target_id", null.alias("target_raw"), null.alias("cause"), F.lit("implements").alias("relation"), F.lit("x").alias("location"))
    g = Graph(view.nodes(spark, sf), edges, dataclasses.replace(view.SETTINGS, drift_threshold=50, drift_relations=("implements",)), commits=view.commits(spark, sf))
    return scores.drift(g).select("id", "commits", "hottest", "measured")


@_query("w02_next_number", "SELECT max(o_orderkey) + 1 AS next, greatest(4, max(length(o_orderkey::VARCHAR)))::INTEGER AS width FROM orders", with_view=False)
def w02_next_number(spark, sf):
    return rules.next_number(rules.numbered(_only_nodes(spark, sf), {"glob": "order/**"}))


@_query("q12_lineages", f"""WITH {_LATER.replace("lead(o_orderkey)", "count(*)").replace(" AS later", " AS position").replace("PARTITION BY o_custkey ORDER BY", "PARTITION BY o_custkey ORDER BY")}
SELECT lineage, position, id FROM (SELECT min('order-' || k) OVER (PARTITION BY c) AS lineage, position::INTEGER AS position, 'order-' || k AS id, count(*) OVER (PARTITION BY c) AS n FROM (SELECT q.*, o_custkey AS c FROM q JOIN orders ON o_orderkey = k)) WHERE n > 1""", with_view=False)
def q12_lineages(spark, sf):
    return report.lineages(view.graph(spark, sf, ("supersedes",)))


_TOUCHED = """touched AS (SELECT id FROM new WHERE id NOT IN (SELECT id FROM old) UNION SELECT id FROM old WHERE id NOT IN (SELECT id FROM new)
  UNION SELECT id FROM old o JOIN new n USING (id) WHERE o.status <> n.status OR o.path <> n.path OR o.title <> n.title),
both_ends AS (SELECT source, target_id, source IN (SELECT id FROM new) AND target_id IN (SELECT id FROM new) AS now, source IN (SELECT id FROM old) AND target_id IN (SELECT id FROM old) AS was FROM e)"""


@_query("u05_touched", f"{_DELTA}, {_TOUCHED} SELECT id FROM touched UNION SELECT source FROM both_ends WHERE now <> was")
def u05_touched(spark, sf):
    return _delta(spark, sf).touched()


@_query("u06_relinked", f"{_DELTA}, {_TOUCHED} SELECT DISTINCT target_id AS id FROM both_ends WHERE now <> was")
def u06_relinked(spark, sf):
    return _delta(spark, sf).relinked()


@_query("u08_replaced", """SELECT p_partkey, array_to_string(CASE WHEN p_brand = 'Brand#4' THEN ['Brand#5', p_type] ELSE [p_brand, p_type, 'Brand#5'] END, ',') AS tags FROM part WHERE p_brand <> 'Brand#5'
UNION ALL SELECT p_partkey, 'Brand#5,' || p_type FROM part WHERE p_brand = 'Brand#5'""", with_view=False)
def u08_replaced(spark, sf):
    tags = F.array("p_brand", "p_type", F.lit("Brand#4"))
    return view.read(spark, sf, "part").select("p_partkey", F.array_join(C.replaced(tags, "Brand#4", "Brand#5"), ",").alias("tags"))


def _dangling(spark, sf) -> Delta:
    """Every seventh customer goes, every seventh moves; orders still name the former by id, and suppliers the latter by path."""
    g = view.graph(spark, sf, ("implements",))
    k, customer = _number(), F.col("kind") == "customer"
    new = g.nodes.where(~(customer & (k % 7 == 0))).withColumn("path", F.when(customer & (k % 7 == 1), F.concat(F.lit("new/"), "path")).otherwise(F.col("path")))
    gone = _number("target_id") % 7 == 0
    ids = g.edges.withColumns({"target_raw": F.when(gone, F.col("target_id")), "cause": F.when(gone, "id_not_found")}).withColumn("target_id", F.when(~gone, F.col("target_id")))
    key = view.read(spark, sf, "supplier").select("s_suppkey")
    names = key.select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("source_path"), F.concat(F.lit("../customer/"), F.col("s_suppkey").cast("string")).alias("target_raw"), F.lit("references").alias("relation"), F.lit("L1").alias("location"), F.lit(0).alias("ordinal"))
    order = F.struct("source", "relation", "location", "ordinal", "target_id")
    links = lambda nodes: resolve.resolve(names, nodes).withColumn("edge_idx", order).select(*ids.columns)
    return Delta(dataclasses.replace(g, edges=g.edges.select(*ids.columns).unionByName(links(g.nodes))), dataclasses.replace(g, nodes=new, edges=ids.unionByName(links(new))))


@_query("q19_dangling", """SELECT 'customer-' || o_custkey AS root, 'removed' AS change, 'order-' || o_orderkey AS id, 1 AS hops, true AS breaking FROM orders WHERE o_custkey % 7 = 0
UNION ALL SELECT 'customer-' || s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'removed' ELSE 'moved' END, 'supplier-' || s_suppkey, 1, true FROM supplier WHERE s_suppkey % 7 IN (0, 1) AND s_suppkey <= (SELECT max(c_custkey) FROM customer)
UNION ALL SELECT 'customer-' || o_custkey, 'moved', 'order-' || o_orderkey, 1, false FROM orders WHERE o_custkey % 7 = 1""", with_view=False)
def q19_dangling(spark, sf):
    return impact(_dangling(spark, sf), max_depth=1)


@_query("q19_likely_breaking", """SELECT DISTINCT 'customer-' || k AS id FROM (SELECT o_custkey AS k FROM orders WHERE o_custkey % 7 = 0 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 IN (0, 1) AND s_suppkey <= (SELECT max(c_custkey) FROM customer))""", with_view=False)
def q19_likely_breaking(spark, sf):
    return likely_breaking(impact(_dangling(spark, sf), max_depth=1))


# Scalar functions


@_query("x03_tokens", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2 AND x NOT IN ('the', 'of')))), ' ') AS tokens FROM documents", with_view=False)
def x03_tokens(spark, sf):
    return view.read(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(C.title_tokens(F.coalesce("text", F.lit("")), ("the", "of"))), " ").alias("tokens"))


@_query("x06_path_parts", "SELECT id, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') AS stem FROM nodes")
def x06_path_parts(spark, sf):
    p = F.col("path")
    return view.nodes(spark, sf).select("id", C.directory(p).alias("folder"), C.file_name(p).alias("name"), C.stem(p).alias("stem"))


@_query("x13_newest", "SELECT 'order-' || o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'reviewed' WHEN o_orderkey % 4 = 3 THEN 'updated' ELSE 'created' END AS field, o_orderdate::DATE + CASE WHEN o_orderkey % 4 = 0 THEN 5 WHEN o_orderkey % 4 = 3 THEN 9 ELSE 0 END AS date FROM orders", with_view=False)
def x13_newest(spark, sf):
    k, c = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    reviewed = F.when(k == 0, F.date_add(c, 5)).when(k == 1, c)
    date, field = C.newest(c, reviewed, F.when(k == 3, F.date_add(c, 9)).otherwise(reviewed))
    return view.read(spark, sf, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("id"), field.alias("field"), date.alias("date"))


@_query("x15_normalized", """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'a/' || s_suppkey WHEN 1 THEN s_suppkey || '.md' WHEN 2 THEN 'b/c' END AS path FROM supplier""", with_view=False)
def x15_normalized(spark, sf):
    k, n = F.col("s_suppkey") % 4, F.col("s_suppkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("./a//"), n, F.lit("/"))).when(k == 1, F.concat(F.lit("x/y/../../"), n, F.lit(".md"))).when(k == 2, F.lit("b\\c")).otherwise(F.concat(F.lit("z/../../"), n))
    return view.read(spark, sf, "supplier").select("s_suppkey", C.normalized_path(raw).alias("path"))


@_query("x17_candidates", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'nation/1,nation/1.md,supplier/nation/1,supplier/nation/1.md' ELSE 'supplier/n.md' END AS sought FROM supplier""", with_view=False)
def x17_candidates(spark, sf):
    k = F.col("s_suppkey")
    rows = view.read(spark, sf, "supplier").select("s_suppkey", F.lit("references").alias("relation"), F.concat(F.lit("supplier/"), k.cast("string"), F.lit(".md")).alias("source_path"), F.when(k % 2 == 0, "nation/1").otherwise("./n.md").alias("target_raw"))
    return resolve.candidates_of(rows, (".md",)).select("s_suppkey", F.array_join("sought", ",").alias("sought"))


@_query("x18_globs", """SELECT id, kind = 'order' AS deep, regexp_matches(path, '^(order/[0-4]/.*|part/.*)$') AS class, regexp_matches(path, '^[a-z]+/[0-9][0-9][.]md$') AS question, kind IN ('region', 'nation') AS either FROM nodes""")
def x18_globs(spark, sf):
    m = lambda g: C.matches_glob(F.col("path"), g)
    return view.nodes(spark, sf).select("id", m("order/**/*.md").alias("deep"), m("{order/[0-4]/*,part/*}").alias("class"), (m("*/??.md") & ~m("*/?/*")).alias("question"), m("{region,nation}/**").alias("either"))


@_query("x19_numbers", "SELECT id, regexp_extract(id, '[0-9]+$')::BIGINT AS number FROM nodes")
def x19_numbers(spark, sf):
    return view.nodes(spark, sf).select("id", C.sequence_number(F.col("path")).cast("long").alias("number"))


@_query("x20_one_line", r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'))) AS h FROM documents", with_view=False)
def x20_one_line(spark, sf):
    return view.read(spark, sf, "documents").select("doc_id", F.sha2(C.one_line(F.coalesce("text", F.lit(""))), 256).alias("h"))


@_query("x24_begins_with", r"""WITH q AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations)
SELECT conv_id, turn, coalesce(after, '') = coalesce(text, '') OR starts_with(coalesce(after, ''), coalesce(text, '') || chr(10)) AS kept FROM q""", with_view=False)
def x24_begins_with(spark, sf):
    from pyspark.sql import Window

    text = F.split(F.coalesce("text", F.lit("")), "\n")
    after = F.split(F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")), "\n")
    return view.read(spark, sf, "conversations").select("conv_id", "turn", text.alias("a"), after.alias("b")).select("conv_id", "turn", C.begins_with(F.col("b"), F.col("a")).alias("kept"))


# Rules


def _findings(out: rules.Outcome) -> DataFrame:
    return out.findings.select("rule_id", "severity", "node_id", "details")


@_query("v01_parse_failure", """SELECT 'parse_failure' AS rule_id, 'error' AS severity, NULL::VARCHAR AS node_id, 'docs/' || doc_id || '.md' AS path FROM documents""", with_view=False)
def v01_parse_failure(spark, sf):
    d = view.read(spark, sf, "documents")
    failed = d.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit("not UTF-8").alias("message"))
    return rules.parse_failure(dataclasses.replace(_only_nodes(spark, sf), parse_failures=failed)).findings.select("rule_id", "severity", "node_id", "path")


@_query("v02_field_parse", """SELECT 'field_parse' AS rule_id, 'error' AS severity, 'customer-' || c_custkey AS node_id, '{"expected":"date","field":"created","found":"integer"}' AS details FROM customer WHERE c_custkey % 10 = 3""", with_view=False)
def v02_field_parse(spark, sf):
    bad = F.array(F.struct(F.lit("created").alias("field"), F.lit("date").alias("expected"), F.lit("integer").alias("found")))
    g = _only_nodes(spark, sf)
    nodes = g.nodes.withColumn("parse_issues", F.when((F.col("kind") == "customer") & (_number() % 10 == 3), bad).otherwise(F.slice(bad, 1, 0)))
    return _findings(rules.field_parse(dataclasses.replace(g, nodes=nodes)))


@_query("v04_field_type", """SELECT 'field_type' AS rule_id, 'error' AS severity, 'part-' || p_partkey AS node_id, '{"expected":"string","field":"size"}' AS details FROM part""", with_view=False)
def v04_field_type(spark, sf):
    return _findings(rules.field_type(_only_nodes(spark, sf, types={"size": "string", "segment": "string"})))


@_query("v07_unknown_field", """SELECT 'unknown_field' AS rule_id, 'error' AS severity, 'customer-' || c_custkey AS node_id, '{"field":"segment"}' AS details FROM customer""", with_view=False)
def v07_unknown_field(spark, sf):
    return _findings(rules.unknown_field(_only_nodes(spark, sf, strict=True, types={"size": "integer"})))


@_query("v08_explicit_field", """SELECT 'explicit_field' AS rule_id, 'error' AS severity, 'part-' || p_partkey AS node_id, '{"field":"title"}' AS details FROM part WHERE p_size > 25""", with_view=False)
def v08_explicit_field(spark, sf):
    g = _only_nodes(spark, sf, require_explicit=("title", "status"))
    inferred = F.when((F.col("kind") == "part") & (C.field_text("size").cast("int") > 25), F.array(F.lit("title"), F.lit("kind"))).otherwise(F.array(F.lit("id")))
    return _findings(rules.explicit_field(dataclasses.replace(g, nodes=g.nodes.withColumn("inferred_fields", inferred))))


@_query("v11_git_drift", """WITH q AS (SELECT o_orderkey, count(ev.d) AS n FROM orders JOIN (SELECT user_id, ts::DATE AS d FROM events) ev ON ev.user_id = o_custkey AND ev.d > o_orderdate::DATE + (o_orderkey % 90)::INTEGER WHERE o_orderstatus = 'O' GROUP BY o_orderkey)
SELECT 'git_drift' AS rule_id, 'warning' AS severity, 'order-' || o_orderkey AS node_id FROM q WHERE n > 3""", with_view=False)
def v11_git_drift(spark, sf):
    g = view.graph(spark, sf, ("implements",))
    return rules.git_drift(_with(g, drift_threshold=3, drift_relations=("implements",))).findings.select("rule_id", "severity", "node_id")


@_query("v15_frontmatter_immutable", f"""{_DELTA} SELECT 'frontmatter_immutable/titles' AS rule_id, 'error' AS severity, id AS node_id, '{{"field":"' || f || '"}}' AS details FROM (
  SELECT id, 'title' AS f FROM old o JOIN new n USING (id) WHERE o.title <> n.title AND o.kind IN ('order', 'part', 'nation') AND o.status IN ('draft', 'superseded')
  UNION ALL SELECT id, 'status' FROM old o JOIN new n USING (id) WHERE o.status <> n.status AND o.status IN ('draft', 'superseded'))""")
def v15_frontmatter_immutable(spark, sf):
    d = _delta(spark, sf)
    s = dataclasses.replace(view.SETTINGS, terminal=("draft", "superseded"), frontmatter_immutable=({"name": "titles", "kinds": ("order", "part", "nation"), "fields": ("title",)},))
    d = Delta(dataclasses.replace(d.before, settings=s), dataclasses.replace(d.after, settings=s))
    return _findings(rules.frontmatter_immutable(d.after, d))


@_query("v16_body_immutable", """SELECT 'body_immutable/' || m AS rule_id, 'error' AS severity, 'doc-' || doc_id AS node_id, '{"mode":"' || m || '"}' AS details FROM documents, (VALUES ('append_only'), ('frozen')) AS v(m)
WHERE doc_id % 5 = 2 OR (doc_id % 5 = 1 AND m = 'frozen')""", with_view=False)
def v16_body_immutable(spark, sf):
    """Documents before and after: every fifth with a line more at its end, every fifth with one more at its start."""
    d = view.read(spark, sf, "documents")
    k, lines = F.col("doc_id") % 5, F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.sha2(x, 256))
    more = F.array(F.sha2(F.lit("one line more"), 256))
    now = F.when(k == 1, F.concat(lines, more)).when(k == 2, F.concat(more, lines)).otherwise(lines)

    def graph(body) -> Graph:
        rows = d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.lit("x").alias("path"), F.lit("doc").alias("kind"), F.lit("active").alias("status"), body.alias("body_lines_hash"))
        rows = rows.withColumn("body_hash", F.sha2(F.array_join("body_lines_hash", ""), 256))
        return Graph(rows, rows.select("id").where(F.lit(False)), dataclasses.replace(view.SETTINGS, body_immutable=tuple({"name": m, "mode": m, "trigger": "creation"} for m in ("frozen", "append_only"))))

    delta = Delta(graph(lines), graph(now))
    return _findings(rules.body_immutable(delta.after, delta))


@_query("v17_body_line", r"""SELECT 'body_line/secrets' AS rule_id, 'error' AS severity, 'doc-' || doc_id AS node_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '([a-z]+) [|]', 1)) AS k FROM documents) WHERE k <> 'the' GROUP BY doc_id""", with_view=False)
def v17_body_line(spark, sf):
    """Words before a bar in a line: they must be ``the``."""
    d = view.read(spark, sf, "documents")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    lines = d.select(name.alias("source"), F.posexplode(F.split("text", "\n")).alias("n", "line_text"))
    found = lines.select("source", F.lit("secrets").alias("name"), (F.col("n") + 1).cast("int").alias("line"), F.explode(F.expr("""regexp_extract_all(line_text, '([a-z]+) [|]', 1)""")).alias("k"))
    found = found.select("source", "name", "line", F.create_map(F.lit("key"), F.col("k")).alias("captures"))
    nodes = d.select(name.alias("id"), F.lit("x").alias("path"), F.lit("doc").alias("kind"))
    s = dataclasses.replace(view.SETTINGS, body_lines=({"name": "secrets", "capture": "key", "allowed": ("the",), "kinds": ("doc",)},))
    out = rules.body_line(Graph(nodes, nodes.select("id").where(F.lit(False)), s, body_lines=found))
    return out.findings.groupBy("rule_id", "severity", "node_id").agg(F.count("*").alias("n"))


def _probed(spark, sf) -> Graph:
    """Suppliers refer to files: one that isn't read, one out of scope, a folder, and none at all."""
    k = F.col("s_suppkey")
    key = view.read(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), k.cast("string")).alias("source"), F.concat(F.lit("supplier/"), k.cast("string"), F.lit(".md")).alias("source_path"), "s_suppkey")
    raw = F.when(k % 4 == 0, "bad").when(k % 4 == 1, "../src/tool.md").when(k % 4 == 2, "src").otherwise("nothing.md")
    rows = key.select("source", "source_path", raw.alias("target_raw"), F.when(k % 8 == 2, "covers").otherwise("references").alias("relation"), F.lit("L1").alias("location"), F.lit(0).alias("ordinal"))
    nodes = view.nodes(spark, sf)
    there = spark.createDataFrame([("src", True), ("src/tool.md", False), ("supplier/bad.md", False)], "path string, is_dir boolean")
    failed = spark.createDataFrame([("supplier/bad.md", "x", "h")], "path string, message string, content_hash string")
    s = dataclasses.replace(view.SETTINGS, unresolved_policy=(("unread", "target_unparsed", "error", (), None), ("tools", "excluded_from_scope", "info", ("references",), "src/**"), ("gone", "missing", "error", (), "**/nothing*")))
    return Graph(nodes, resolve.resolve(rows, nodes), s, files=there, parse_failures=failed)


@_query("j09_causes", """SELECT 'supplier-' || s_suppkey AS source, CASE s_suppkey % 8 WHEN 0 THEN 'target_unparsed' WHEN 4 THEN 'target_unparsed' WHEN 1 THEN 'excluded_from_scope' WHEN 5 THEN 'excluded_from_scope' WHEN 2 THEN 'excluded_from_scope' ELSE 'missing' END AS cause,
CASE s_suppkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'info' WHEN 3 THEN 'error' ELSE 'warning' END AS severity, CASE s_suppkey % 4 WHEN 0 THEN 'unread' WHEN 1 THEN 'tools' WHEN 3 THEN 'gone' END AS policy_name FROM supplier""", with_view=False)
def j09_causes(spark, sf):
    return rules.unresolved_edges(_probed(spark, sf)).select("source", "cause", "severity", "policy_name")


@_query("v18_unresolved_reference", """SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'unresolved_reference/unread' ELSE 'unresolved_reference/gone' END AS rule_id, 'error' AS severity, 'supplier-' || s_suppkey AS node_id FROM supplier WHERE s_suppkey % 4 IN (0, 3)""", with_view=False)
def v18_unresolved_reference(spark, sf):
    return rules.unresolved_reference(_probed(spark, sf)).findings.select("rule_id", "severity", "node_id")


@_query("check_narrowed", f"""{_DELTA}, {_TOUCHED}, now AS (SELECT n.*, nodes.reviewed, nodes.created FROM new n JOIN nodes USING (id)), t AS (SELECT id FROM touched UNION SELECT source FROM both_ends WHERE now <> was)
SELECT rule_id, id AS node_id FROM (SELECT 'required_field' AS rule_id, id FROM now WHERE reviewed IS NULL UNION ALL SELECT 'field_enum', id FROM now WHERE status = 'draft'
  UNION ALL SELECT 'cross_field', id FROM now WHERE status = 'superseded' UNION ALL SELECT 'stale_review', id FROM now WHERE {_LIVE} AND reviewed <= DATE '{view.TODAY}' - 1500) WHERE id IN (SELECT id FROM t)""")
def check_narrowed(spark, sf):
    """Findings after a change that the change answers for; orphans, which it widens, are left out here."""
    d = _delta(spark, sf)
    return rules.check(d.after, d, narrow=True)[0].where("rule_id <> 'orphan'").select("rule_id", "node_id")
