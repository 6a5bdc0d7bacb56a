"""The library's operators over the driver's tables, each with DuckDB SQL that says the same."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.model import Graph
from quillgraph.operators import lookups, report, rules, scores, walks
from quillgraph.operators.deltas import Delta, impact
from quillgraph.plans import view
from quillgraph.registry import registry

QUERIES, SQL, _query = registry()
_TODAY = f"DATE '{view.TODAY}'"
_REF = "id, title, kind, status, path"
ROOT = "region-1"


_LIVE = "status <> 'superseded'"
_LINKERS = "linkers AS (SELECT target_id AS id, count(DISTINCT source) AS n FROM edges WHERE source <> target_id GROUP BY target_id)"
_TRUST = f"""q AS (SELECT 1), {_LINKERS}, most AS (SELECT coalesce(max(n), 0) AS m FROM linkers),
parts AS (SELECT {", ".join("nodes." + c for c in _REF.split(", "))}, reviewed, CASE WHEN {_LIVE} THEN 1e0 ELSE 0e0 END AS st,
  CASE WHEN {_LIVE} AND reviewed IS NOT NULL THEN greatest(0e0, least(1e0, 1e0 - greatest(date_diff('day', reviewed, {_TODAY}), 0)::DOUBLE / 1500e0)) END AS fr,
  CASE WHEN m > 0 THEN greatest(0e0, least(1e0, ln(coalesce(n, 0) + 1e0) / ln(m + 1e0))) END AS ba
  FROM nodes LEFT JOIN linkers USING (id) CROSS JOIN most),
trust AS (SELECT *, CASE WHEN NOT ({_LIVE} AND reviewed IS NULL) THEN greatest(0e0, least(1e0, (st * 4e-1 + coalesce(fr * 3e-1, 0e0) + coalesce(ba * 1e-1, 0e0)) / (4e-1 + CASE WHEN fr IS NULL THEN 0e0 ELSE 3e-1 END + CASE WHEN ba IS NULL THEN 0e0 ELSE 1e-1 END))) END AS score FROM parts)
"""


def _no_drift(g: Graph) -> Graph:
    return dataclasses.replace(g, commits=None)


def _trust_columns(df: DataFrame, *more) -> DataFrame:
    return df.select(*more, "id", "kind", "status", F.round("status_score", 6).alias("status_score"), F.round("freshness", 6).alias("freshness"), F.round("backlinks", 6).alias("backlinks"), F.round("score", 6).alias("score"))


_TRUST_COLUMNS = "id, kind, status, round(st, 6) AS status_score, round(fr, 6) AS freshness, round(ba, 6) AS backlinks, round(score, 6) AS score"


@_query("q01_search", f"""
SELECT {_REF}, round(coalesce(i, 0) + coalesce(t, 0) + coalesce(g, 0), 6)::DOUBLE AS score FROM (
  SELECT *, CASE WHEN lower(id) = 'red' THEN 3e0 WHEN contains(lower(id), 'red') THEN 15e-1 END AS i,
    CASE WHEN lower(title) = 'red' THEN 25e-1 WHEN contains(lower(title), 'red') THEN 1e0 END AS t,
    CASE WHEN contains(lower(array_to_string(tags, chr(0))), 'red') THEN 5e-1 END AS g FROM nodes) WHERE coalesce(i, t, g) IS NOT NULL""")
def q01_search(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.search(view.graph(spark, sf), "Red").select(*_REF.split(", "), F.round("score", 6).alias("score"))


@_query("q02_nodes", f"SELECT {_REF} FROM nodes WHERE kind IN ('customer', 'part') AND status = 'active' AND (segment = 'BUILDING' OR list_contains(list_transform(tags, lambda t: lower(t)), 'brand#11'))")
def q02_nodes(spark, sf):
    g = view.graph(spark, sf)
    a = lookups.listing(g, kinds=("customer", "part"), statuses=("active",), where={"segment": "BUILDING"})
    return a.unionByName(lookups.listing(g, kinds=("customer", "part"), statuses=("active",), tags=("BRAND#11",)))


@_query("q03_backlinks", "SELECT n.id, n.title, n.kind, n.status, n.path, relation, location FROM edges JOIN nodes n ON n.id = source WHERE target_id = 'nation-7' AND source <> target_id")
def q03_backlinks(spark, sf):
    return lookups.backlinks(view.graph(spark, sf, ("related",)), "nation-7")



@_query("q04_chain", """
q AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position FROM orders)
SELECT CAST(position AS INTEGER) AS position, id, title, kind, status, path FROM q JOIN nodes ON id = 'order-' || o_orderkey WHERE o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders))""")
def q04_chain(spark, sf):
    first = view.read(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    return walks.chain(view.graph(spark, sf, ("supersedes",)), f"order-{first}")


@_query("q05_node", """
SELECT id, title, kind, status, path, (SELECT string_agg(source || ':' || relation, ',' ORDER BY source || ':' || relation) FROM edges WHERE target_id = 'nation-7' AND relation = 'related') AS incoming,
  (SELECT string_agg(target_id || ':' || relation, ',' ORDER BY target_id || ':' || relation) FROM edges WHERE source = 'nation-7') AS outgoing FROM nodes WHERE id = 'nation-7'""")
def q05_node(spark, sf):
    d = lookups.node_detail(view.graph(spark, sf, ("related",)), "nation-7")
    flat = lambda c, k: F.array_join(F.array_sort(F.transform(c, lambda x: F.concat(x[k], F.lit(":"), x["relation"]))), ",").alias(c)
    return d.select(*_REF.split(", "), flat("incoming", "source"), flat("outgoing", "target"))


def _covering(spark, sf) -> Graph:
    """Suppliers cover the path of their nation."""
    g = view.graph(spark, sf, ("related",))
    s = view.read(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("source"), F.concat(F.lit("../nation/./"), F.col("s_nationkey").cast("string"), F.lit(".md")).alias("target_raw"))
    from quillgraph.plans.resolve import resolve

    raw = s.join(g.nodes.select(F.col("id").alias("source"), F.col("path").alias("source_path")), "source").withColumns({"relation": F.lit("covers"), "location": F.lit("frontmatter:covers"), "ordinal": F.lit(0)})
    e = resolve(raw, g.nodes).withColumn("edge_idx", F.struct("source", "relation", "location", "ordinal", "target_id"))
    return dataclasses.replace(g, edges=e)


@_query("q06_covered_by", "SELECT id, title, kind, status, path, 'covers' AS relation FROM nodes JOIN supplier ON id = 'supplier-' || s_suppkey WHERE s_nationkey = 3")
def q06_covered_by(spark, sf):
    return lookups.covered_by(_covering(spark, sf), "nation/3.md")


_ORPHANS = f"""q AS (SELECT * FROM nodes WHERE {_LIVE} AND kind NOT IN ('region', 'nation') AND (created IS NULL OR created <= {_TODAY} - 14)),
orphan AS (SELECT * FROM q WHERE id NOT IN (SELECT target_id FROM edges WHERE source <> target_id))"""


@_query("q07_orphans", f"{_ORPHANS} SELECT {_REF}, created FROM orphan")
def q07_orphans(spark, sf):
    return lookups.orphans(dataclasses.replace(view.graph(spark, sf), edges=view.raw_edges(spark, sf)))  # repeats link nobody more


@_query("q08_stale", f"SELECT {_REF}, reviewed, CAST(greatest(date_diff('day', reviewed, {_TODAY}), 0) AS INTEGER) AS days_since FROM nodes WHERE {_LIVE} AND reviewed <= {_TODAY} - 1500")
def q08_stale(spark, sf):
    return lookups.stale(view.graph(spark, sf))


@_query("q09_recent", f"""SELECT * FROM (SELECT {_REF}, CASE WHEN created = greatest(created, reviewed) THEN 'created' ELSE 'reviewed' END AS field, greatest(created, reviewed) AS date,
  CAST(greatest(date_diff('day', greatest(created, reviewed), {_TODAY}), 0) AS INTEGER) AS days_ago FROM nodes) WHERE date >= {_TODAY} - 60 ORDER BY date DESC, id LIMIT 50""")
def q09_recent(spark, sf):
    return lookups.recent(view.graph(spark, sf), days=60, limit=50)


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in view.SETTINGS.stop_words) + ")))"


@_query("q10_similar", f"""
q AS (SELECT {_TOKENS.format(t="title")} AS tt, tags AS tg, 'part' AS tk, 'part' AS td FROM nodes WHERE id = 'part-1'),
near AS (SELECT DISTINCT id, n FROM (SELECT source AS id, target_id AS n FROM edges UNION ALL SELECT target_id, source FROM edges)),
goal AS (SELECT n FROM near WHERE id = 'part-1'),
reach AS (SELECT id, count(*) AS degree, count(goal.n) AS shared FROM near LEFT JOIN goal USING (n) GROUP BY id),
part_of AS (SELECT {_REF}, {_TOKENS.format(t="title")} AS ct, tags, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM nodes WHERE id <> 'part-1'),
s AS (SELECT part_of.*, CASE WHEN len(tt) > 0 THEN len(list_intersect(tt, ct))::DOUBLE / len(list_distinct(list_concat(tt, ct))) END AS a,
  CASE WHEN len(tg) > 0 THEN len(list_intersect(tg, tags))::DOUBLE / len(list_distinct(list_concat(tg, tags))) END AS b,
  CASE WHEN kind = tk THEN 1e0 ELSE 0e0 END AS c, CASE WHEN dir = td THEN 1e0 ELSE 0e0 END AS d,
  CASE WHEN (SELECT count(*) FROM goal) > 0 THEN coalesce(shared::DOUBLE / ((SELECT count(*) FROM goal) + degree - shared), 0e0) END AS e
  FROM part_of CROSS JOIN q LEFT JOIN reach USING (id))
SELECT id, title, kind, status, path, round((coalesce(a * 4e-1, 0) + coalesce(b * 2e-1, 0) + c * 1e-1 + d * 1e-1 + coalesce(e * 2e-1, 0)) /
  (CASE WHEN a IS NULL THEN 0 ELSE 4e-1 END + CASE WHEN b IS NULL THEN 0 ELSE 2e-1 END + 1e-1 + 1e-1 + CASE WHEN e IS NULL THEN 0 ELSE 2e-1 END), 6)::DOUBLE AS score
FROM s ORDER BY (coalesce(a * 4e-1, 0) + coalesce(b * 2e-1, 0) + c * 1e-1 + d * 1e-1 + coalesce(e * 2e-1, 0)) DESC, id LIMIT 25""")
def q10_similar(spark, sf):
    g = view.graph(spark, sf)
    g = dataclasses.replace(g, edges=view.raw_edges(spark, sf).where("relation = 'references'"))  # neighbours are made distinct there
    return scores.similar(g, "part-1", limit=25).select(*_REF.split(", "), F.round("score", 6).alias("score"))


SQL["q10_similar"] = SQL["q10_similar"].replace("FROM edges UNION", "FROM edges WHERE relation = 'references' UNION").replace("SELECT target_id, source FROM edges)", "SELECT target_id, source FROM edges WHERE relation = 'references')")


@_query("q11_trust", f"{_TRUST} SELECT {_TRUST_COLUMNS} FROM trust")
def q11_trust(spark, sf):
    return _trust_columns(scores.trust(_no_drift(view.graph(spark, sf))))


@_query("q11_trust_bottom", f"{_TRUST} SELECT {_TRUST_COLUMNS} FROM trust WHERE score IS NOT NULL AND status <> 'superseded' ORDER BY round(score, 12), id LIMIT 100")
def q11_trust_bottom(spark, sf):
    return _trust_columns(scores.trust_ranking(_no_drift(view.graph(spark, sf)), 100, statuses=("active", "draft")))


@_query("q11_drift", """
SELECT 'order-' || o_orderkey AS id, count(ev.d) AS commits FROM orders LEFT JOIN (SELECT user_id, ts::DATE AS d FROM events) ev ON ev.user_id = o_custkey AND ev.d > o_orderdate::DATE + (o_orderkey % 90)::INTEGER
WHERE o_orderstatus = 'O' GROUP BY o_orderkey""", with_view=False)
def q11_drift(spark, sf):
    g = view.graph(spark, sf, ("implements",))
    g = dataclasses.replace(g, settings=dataclasses.replace(g.settings, drift_threshold=50, drift_relations=("implements",)))
    return scores.drift(g).select("id", "commits")


@_query("q11_trust_drift", f"""{_TRUST},
moved AS (SELECT 'order-' || o_orderkey AS id, count(ev.d) AS commits FROM orders LEFT JOIN (SELECT user_id, ts::DATE AS d FROM events) ev ON ev.user_id = o_custkey AND ev.d > o_orderdate::DATE + (o_orderkey % 90)::INTEGER
  WHERE o_orderstatus = 'O' GROUP BY o_orderkey),
scored AS (SELECT trust.*, CASE WHEN commits IS NOT NULL THEN greatest(0e0, least(1e0, 1e0 - commits::DOUBLE / 50e0)) END AS dr FROM trust LEFT JOIN moved USING (id))
SELECT {_TRUST_COLUMNS.replace("round(score, 6) AS score", "round(dr, 6) AS drift")},
  round(CASE WHEN score IS NOT NULL THEN greatest(0e0, least(1e0, (st * 4e-1 + coalesce(fr * 3e-1, 0e0) + coalesce(dr * 2e-1, 0e0) + coalesce(ba * 1e-1, 0e0)) / (4e-1 + CASE WHEN fr IS NULL THEN 0e0 ELSE 3e-1 END + CASE WHEN dr IS NULL THEN 0e0 ELSE 2e-1 END + CASE WHEN ba IS NULL THEN 0e0 ELSE 1e-1 END))) END, 6) AS score,
  CASE WHEN score IS NULL THEN CASE WHEN kind = 'order' THEN 'freshness,drift' ELSE 'freshness' END ELSE '' END AS undeclared_parts FROM scored""")
def q11_trust_drift(spark, sf):
    """Trust with all four parts: changes to the customer of an open order since its review count against it."""
    g = view.graph(spark, sf)
    g = dataclasses.replace(g, settings=dataclasses.replace(g.settings, drift_threshold=50, drift_relations=("implements",)))
    rows = scores.trust(g)
    return _trust_columns(rows.withColumn("_d", F.round("drift", 6)), F.col("_d").alias("drift"), F.array_join("undeclared_parts", ",").alias("undeclared_parts"))


@_query("q12_components", """
q AS (SELECT source AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source FROM edges),
walk(id) AS (SELECT 'region-0' UNION SELECT b FROM walk JOIN q ON a = id),
all_of AS (SELECT id, CASE WHEN id IN (SELECT id FROM walk) THEN 'reached' WHEN id NOT IN (SELECT a FROM q) THEN id ELSE error('a second component') END AS c FROM nodes),
sizes AS (SELECT c, count(*) AS size, min(id) AS least FROM all_of GROUP BY c)
SELECT dense_rank() OVER (ORDER BY size DESC, least) AS component_id, size, id FROM all_of JOIN sizes USING (c)""")
def q12_components(spark, sf):
    """Over all relations: one component that holds the first region, and parts that nobody ordered."""
    return walks.components(dataclasses.replace(view.graph(spark, sf), edges=view.raw_edges(spark, sf)))  # repeats join nothing more


@_query("q12_components_related", """
q AS (SELECT 'customer-' || c_custkey AS id, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier-' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'nation-' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'region-' || r_regionkey, r_regionkey FROM region),
all_of AS (SELECT id, 'r' || r AS c FROM q UNION ALL SELECT id, id FROM nodes WHERE kind IN ('part', 'order')),
sizes AS (SELECT c, count(*) AS size, min(id) AS least FROM all_of GROUP BY c)
SELECT dense_rank() OVER (ORDER BY size DESC, least) AS component_id, size, id FROM all_of JOIN sizes USING (c)""")
def q12_components_related(spark, sf):
    return walks.components(view.graph(spark, sf), ("related",))


@_query("q13_neighborhood", f"""
q AS (SELECT source AS a, target_id AS b FROM edges WHERE relation = 'related' UNION ALL SELECT target_id, source FROM edges WHERE relation = 'related'),
walk(id, depth) AS (SELECT '{ROOT}', 0 UNION SELECT b, depth + 1 FROM walk JOIN q ON a = id WHERE depth < 2)
SELECT id, title, kind, status, path, CAST(min(depth) AS INTEGER) AS depth FROM walk JOIN nodes USING (id) GROUP BY ALL""")
def q13_neighborhood(spark, sf):
    return walks.neighborhood(view.graph(spark, sf, ("related",)), ROOT, 2)


@_query("q14_dependents", f"""
q AS (SELECT source, target_id FROM edges WHERE relation = 'related' AND source <> target_id),
walk(id, hops, via) AS (SELECT '{ROOT}', 0, '' UNION SELECT source, hops + 1, source || '>' || target_id || CASE WHEN via = '' THEN '' ELSE ';' || via END FROM walk JOIN q ON target_id = id)
SELECT '{ROOT}' AS root, id, CAST(hops AS INTEGER) AS hops, via FROM walk WHERE hops > 0""")
def q14_dependents(spark, sf):
    rows = walks.dependents(view.graph(spark, sf, ("related",)), ROOT)
    return rows.select("root", "id", "hops", F.array_join(F.transform("via", lambda x: F.concat(x["source"], F.lit(">"), x["target"])), ";").alias("via"))


def _markers(spark, sf) -> Graph:
    """Documents as nodes, and the words in capitals with two exclamation marks as annotations of their lines."""
    d = view.read(spark, sf, "documents").where("doc_id IS NOT NULL")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    nodes = d.select(name.alias("id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("lang").alias("kind"))
    lines = d.select(name.alias("source"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    found = lines.select("source", (F.col("n") + 1).cast("int").alias("line"), F.explode(F.expr(r"regexp_extract_all(text, '([a-z]+ = \"[0-9a-f]+)', 0)")).alias("key"))
    found = found.select("source", F.lit("secret").alias("name"), F.split("key", " ")[0].alias("key"), "line")
    return Graph(nodes, nodes.select("id").where(F.lit(False)), view.SETTINGS, annotations=found)


@_query("q15_annotations", """
SELECT 'secret' AS name, split_part(k, ' ', 1) AS key, count(*) AS count, string_agg('doc-' || doc_id || ':L' || line, ',' ORDER BY 'doc-' || doc_id, line) AS sources
FROM (SELECT doc_id, line, unnest(regexp_extract_all(t, '[a-z]+ = "[0-9a-f]+')) AS k FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))
GROUP BY ALL""", with_view=False)
def q15_annotations(spark, sf):
    rows = lookups.annotations(_markers(spark, sf))
    return rows.select("name", "key", "count", F.array_join(F.transform("sources", lambda x: F.concat(x["source"], F.lit(":L"), x["line"].cast("string"))), ",").alias("sources"))


def _pages(spark, sf) -> Graph:
    """Pages as nodes and their links as references; none of the links names a page."""
    from quillgraph.plans.resolve import resolve

    p = view.read(spark, sf, "pages")
    nodes = p.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))
    raw = p.select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("source"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("source_path"), F.posexplode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")).alias("ordinal", "target_raw"))
    raw = raw.withColumns({"relation": F.lit("references"), "location": F.concat(F.lit("L"), (F.col("ordinal") + 1).cast("string"))})
    s = dataclasses.replace(view.SETTINGS, unresolved_policy=(("site_link", "absolute", "info", ("references",), None),))
    return Graph(nodes, resolve(raw, nodes), s)


@_query("q16_unresolved", r"""
SELECT 'page-' || page_id AS source, 'references' AS relation, h AS raw_target, CASE WHEN h[1] = '/' THEN 'absolute' ELSE 'missing' END AS cause, CASE WHEN h[1] = '/' THEN 'info' ELSE 'warning' END AS severity, CASE WHEN h[1] = '/' THEN 'site_link' END AS policy_name
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages)""", with_view=False)
def q16_unresolved(spark, sf):
    return rules.unresolved_edges(_pages(spark, sf)).select("source", "relation", "raw_target", "cause", "severity", "policy_name")


@_query("q16_issues", f"""{_ORPHANS}
SELECT category, count(*) AS count FROM (
  SELECT 'violation_orphan' AS category FROM orphan
  UNION ALL SELECT 'violation_stale_review' FROM nodes WHERE {_LIVE} AND reviewed <= {_TODAY} - 1500
  UNION ALL SELECT 'violation_required_field' FROM nodes WHERE reviewed IS NULL
  UNION ALL SELECT 'violation_field_enum' FROM nodes WHERE status NOT IN ('active', 'superseded')
  UNION ALL SELECT 'violation_cross_field' FROM nodes WHERE status = 'superseded') GROUP BY category""")
def q16_issues(spark, sf):
    return rules.issues(view.graph(spark, sf))


@_query("check_findings", f"""{_ORPHANS}
SELECT rule_id, severity, node_id, path FROM (
  SELECT 'orphan' AS rule_id, 'warning' AS severity, id AS node_id, path FROM orphan
  UNION ALL SELECT 'stale_review', 'warning', id, path FROM nodes WHERE {_LIVE} AND reviewed <= {_TODAY} - 1500
  UNION ALL SELECT 'required_field', 'error', id, path FROM nodes WHERE reviewed IS NULL
  UNION ALL SELECT 'field_enum', 'error', id, path FROM nodes WHERE status NOT IN ('active', 'superseded')
  UNION ALL SELECT 'cross_field', 'error', id, path FROM nodes WHERE status = 'superseded')""")
def check_findings(spark, sf):
    return rules.check(view.graph(spark, sf))[0].select("rule_id", "severity", "node_id", "path")


@_query("check_coverage", f"""{_ORPHANS}
SELECT 'acyclic_relation' AS rule_id, (SELECT count(*) FROM edges WHERE relation IN ('related', 'supersedes')) AS subjects
UNION ALL SELECT r, (SELECT count(*) FROM nodes) FROM (VALUES ('parse_failure'), ('field_parse'), ('required_field'), ('field_type'), ('field_enum'), ('cross_field')) AS v(r)
UNION ALL SELECT 'orphan', (SELECT count(*) FROM q) UNION ALL SELECT 'stale_review', (SELECT count(*) FROM nodes WHERE {_LIVE} AND reviewed IS NOT NULL)""")
def check_coverage(spark, sf):
    return rules.check(view.graph(spark, sf))[1].select("rule_id", "subjects")


def _turns(spark, sf) -> Graph:
    """Turns as numbered files; every seventh conversation lacks its turn 1, and every fifth has its turn 0 twice."""
    c = view.read(spark, sf, "conversations").where("NOT (conv_id % 7 = 0 AND turn = 1)").select("conv_id", "turn")
    twice = c.where("conv_id % 5 = 0 AND turn = 0").withColumn("copy", F.lit("-b"))
    rows = c.withColumn("copy", F.lit("")).union(twice)
    number = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    name = F.concat(number, F.col("copy"))
    nodes = rows.select(F.concat(F.lit("turn-"), name).alias("id"), F.concat(F.lit("turns/"), name, F.lit(".md")).alias("path"))
    return Graph(nodes, nodes.select("id").where(F.lit(False)), dataclasses.replace(view.SETTINGS, naming=({"glob": "turns/**", "pattern": r"^\d+\.md$", "sequential": True, "unique": True},)))


_TURNS = """q AS (SELECT conv_id * 100 + turn AS n, '' AS c FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1) UNION ALL SELECT conv_id * 100 + turn, '-b' FROM conversations WHERE conv_id % 5 = 0 AND turn = 0)"""


@_query("rule_numbering", f"""WITH {_TURNS}
SELECT 'sequential_numbering' AS rule_id, min('turn-' || n || c) AS node_id FROM q JOIN (SELECT n, lag(n) OVER (ORDER BY n) AS p FROM (SELECT DISTINCT n FROM q)) USING (n) WHERE n > p + 1 GROUP BY n
UNION ALL SELECT 'unique_numbering', min('turn-' || n || c) FROM q GROUP BY n HAVING count(*) > 1
UNION ALL SELECT 'filename_pattern', 'turn-' || n || c FROM q WHERE c <> ''""", with_view=False)
def rule_numbering(spark, sf):
    g = _turns(spark, sf)
    out = rules.sequential_numbering(g).findings.union(rules.unique_numbering(g).findings).union(rules.filename_pattern(g).findings)
    return out.select("rule_id", "node_id")


@_query("rule_cycles", """
SELECT 'customer-' || o_custkey AS id, 'customer-' || (o_custkey - o_custkey % 3) AS region FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 9 < 3 AND o_custkey - o_custkey % 3 + 2 <= (SELECT max(c_custkey) FROM customer)
""", with_view=False)
def rule_cycles(spark, sf):
    """Customers in rings of three, every third ring closed, with a path leading in."""
    c = view.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    most = c.agg(F.max("k")).first()[0]
    name = lambda k: F.concat(F.lit("customer-"), k.cast("string"))
    k = F.col("k")
    to = F.when(k % 3 < 2, k + 1).when(k % 9 < 3, k - 2)
    e = c.where(k - k % 3 + 2 <= most).select(name(k).alias("source"), name(to).alias("target_id"), F.lit("implements").alias("relation")).where("target_id IS NOT NULL")
    lead = c.where((k % 9 == 4) & (k >= 4)).select(name(k).alias("source"), name(k - 4).alias("target_id"), F.lit("implements").alias("relation"))
    return walks.cyclic_members(Graph(view.nodes(spark, sf), e.union(lead), view.SETTINGS), "implements").select("id", "region")


SQL["rule_cycles"] = """
SELECT 'customer-' || c_custkey AS id, least('customer-' || b, 'customer-' || (b + 1), 'customer-' || (b + 2)) AS region FROM (SELECT c_custkey, c_custkey - c_custkey % 3 AS b FROM customer)
WHERE c_custkey % 9 < 3 AND b + 2 <= (SELECT max(c_custkey) FROM customer) AND b >= (SELECT min(c_custkey) FROM customer)"""


def _delta(spark, sf) -> Delta:
    """Before: without every tenth customer, and with statuses and titles as they were."""
    g = view.graph(spark, sf, ("related", "implements"))
    k = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    old = g.nodes.where(~((F.col("kind") == "customer") & (k % 10 == 0)))
    old = old.withColumn("title", F.when(((F.col("kind") == "part") & (k % 50 == 0)) | ((F.col("kind") == "nation") & (k % 5 == 0)), F.concat(F.lit("Old "), "title")).otherwise(F.col("title")))
    old = old.withColumn("status", F.when((F.col("kind") == "order") & (k % 40 == 0), "draft").otherwise(F.col("status")))
    old = old.withColumn("path", F.when((F.col("kind") == "supplier") & (k % 4 == 0), F.concat(F.lit("old/"), "path")).otherwise(F.col("path")))
    new = g.nodes.where(~((F.col("kind") == "supplier") & (k % 7 == 0)))
    alive = lambda e, n: e.join(n.select(F.col("id").alias("source")), "source", "left_semi").join(n.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return Delta(dataclasses.replace(g, nodes=old, edges=alive(g.edges, old)), dataclasses.replace(g, nodes=new, edges=alive(g.edges, new)))


_DELTA = """q AS (SELECT *, regexp_extract(id, '([0-9]+)$', 1)::BIGINT AS k FROM nodes),
old AS (SELECT id, k, kind, CASE WHEN (kind = 'part' AND k % 50 = 0) OR (kind = 'nation' AND k % 5 = 0) THEN 'Old ' || title ELSE title END AS title, CASE WHEN kind = 'order' AND k % 40 = 0 THEN 'draft' ELSE status END AS status,
  CASE WHEN kind = 'supplier' AND k % 4 = 0 THEN 'old/' || path ELSE path END AS path FROM q WHERE NOT (kind = 'customer' AND k % 10 = 0)),
new AS (SELECT id, k, kind, title, status, path FROM q WHERE NOT (kind = 'supplier' AND k % 7 = 0)),
e AS (SELECT source, target_id, relation FROM edges WHERE relation IN ('related', 'implements'))"""


@_query("q18_diff", f"""{_DELTA}
SELECT 'added_node' AS change, id, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM new WHERE id NOT IN (SELECT id FROM old)
UNION ALL SELECT 'removed_node', id, NULL, NULL FROM old WHERE id NOT IN (SELECT id FROM new)
UNION ALL SELECT 'status', id, o.status, n.status FROM old o JOIN new n USING (id) WHERE o.status <> n.status
UNION ALL SELECT 'path', id, o.path, n.path FROM old o JOIN new n USING (id) WHERE o.path <> n.path
UNION ALL SELECT 'title', id, o.title, n.title FROM old o JOIN new n USING (id) WHERE o.title <> n.title
UNION ALL SELECT 'added_edge', source, NULL, target_id FROM e WHERE source IN (SELECT id FROM new) AND target_id IN (SELECT id FROM new) AND NOT (source IN (SELECT id FROM old) AND target_id IN (SELECT id FROM old))
UNION ALL SELECT 'removed_edge', source, target_id, NULL FROM e WHERE source IN (SELECT id FROM old) AND target_id IN (SELECT id FROM old) AND NOT (source IN (SELECT id FROM new) AND target_id IN (SELECT id FROM new))""")
def q18_diff(spark, sf):
    d = _delta(spark, sf)
    none = F.lit(None).cast("string")
    row = lambda df, change, key="id", before=none, after=none: df.select(change.alias("change"), F.col(key).alias("id"), before.alias("before"), after.alias("after"))
    out = row(d.added_nodes(), F.lit("added_node"))
    for more in (
        row(d.removed_nodes(), F.lit("removed_node")),
        row(d.status_transitions(), F.lit("status"), before=F.col("before"), after=F.col("after")),
        row(d.path_changes(), F.lit("path"), before=F.col("before"), after=F.col("after")),
        row(d.field_changes(), F.col("field"), before=F.col("before"), after=F.col("after")),
        row(d.added_edges(), F.lit("added_edge"), "source", after=F.col("target_id")),
        row(d.removed_edges(), F.lit("removed_edge"), "source", before=F.col("target_id")),
    ):
        out = out.union(more)
    return out


@_query("q19_impact", f"""{_DELTA},
change AS (SELECT id, CASE WHEN kind = 'supplier' AND k % 4 = 0 THEN 'moved' ELSE 'modified' END AS change FROM q WHERE (kind = 'supplier' AND k % 4 = 0 AND k % 7 <> 0) OR (kind = 'part' AND k % 50 = 0) OR (kind = 'nation' AND k % 5 = 0)
  OR (kind = 'order' AND k % 40 = 0 AND status <> 'draft')
  OR (id IN (SELECT source FROM e WHERE target_id IN (SELECT id FROM q WHERE kind = 'customer' AND k % 10 = 0)) )),
walk(root, id, hops) AS (SELECT id, id, 0 FROM change UNION SELECT root, source, hops + 1 FROM walk JOIN e ON e.target_id = walk.id WHERE hops < 2 AND source IN (SELECT id FROM new))
SELECT root, change.change, walk.id, CAST(min(hops) AS INTEGER) AS hops FROM walk JOIN change ON change.id = root WHERE hops > 0 GROUP BY ALL""")
def q19_impact(spark, sf):
    return impact(_delta(spark, sf), max_depth=2).select("root", "change", "id", "hops")


@_query("q20_report", f"""
q AS (SELECT target_id AS id, count(*) AS n FROM edges WHERE source <> target_id GROUP BY target_id)
SELECT 'status' AS section, status AS key, count(*) AS value FROM nodes GROUP BY status UNION ALL SELECT 'kind', kind, count(*) FROM nodes GROUP BY kind
UNION ALL SELECT * FROM (SELECT 'god', id, n FROM q JOIN nodes USING (id) WHERE {_LIVE} ORDER BY n DESC, id LIMIT 10)""")
def q20_report(spark, sf):
    return report.tallies(view.graph(spark, sf))


@_query("b4_edges", "SELECT source, target_id, relation, location FROM edges")
def b4_edges(spark, sf):
    return view.edges(spark, sf).select("source", "target_id", "relation", "location")


@_query("j2_resolution", r"""
SELECT 'supplier-' || s_suppkey AS source, CASE s_suppkey % 5 WHEN 0 THEN 'nation-' || s_nationkey WHEN 1 THEN 'nation-' || s_nationkey WHEN 2 THEN 'nation-' || s_nationkey END AS target_id,
  CASE s_suppkey % 5 WHEN 3 THEN 'escapes_source' WHEN 4 THEN 'absolute' END AS cause FROM supplier""", with_view=False)
def j2_resolution(spark, sf):
    """Suppliers refer to their nation from the root, from their own folder, by bare id, beyond the root and absolutely."""
    from quillgraph.plans.resolve import resolve

    nodes = view.nodes(spark, sf)
    k, n = F.col("s_suppkey") % 5, F.col("s_nationkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("nation/"), n)).when(k == 1, F.concat(F.lit("../nation//"), n, F.lit(".md"))).when(k == 2, F.concat(F.lit("nation-"), n)).when(k == 3, F.concat(F.lit("../../nation/"), n)).otherwise(F.concat(F.lit("/nation/"), n, F.lit(".md")))
    key = F.col("s_suppkey").cast("string")
    rows = view.read(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), key).alias("source"), F.concat(F.lit("supplier/"), key, F.lit(".md")).alias("source_path"), raw.alias("target_raw"), F.lit("references").alias("relation"), F.lit("L1").alias("location"), F.lit(0).alias("ordinal"))
    return resolve(rows, nodes).select("source", "target_id", "cause")


@_query("p17_fingerprints", r"""
SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, CAST(len(string_split(coalesce(text, ''), chr(10))) AS INTEGER) AS n_lines, (SELECT sha256(string_agg(sha256(x), '' ORDER BY i)) FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i)) AS lines_digest FROM documents""", with_view=False)
def p17_fingerprints(spark, sf):
    t = F.coalesce("text", F.lit(""))
    lines = F.split(t, "\n")
    return view.read(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("content_hash"), F.size(lines).alias("n_lines"), F.sha2(F.array_join(F.transform(lines, lambda x: F.sha2(x, 256)), ""), 256).alias("lines_digest"))


@_query("x08_slugs", r"""
SELECT DISTINCT p_name AS title, regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, string_split(regexp_replace(lower(p_name), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')[1] AS first_token FROM part""", with_view=False)
def x08_slugs(spark, sf):
    return view.read(spark, sf, "part").select(F.col("p_name").alias("title"), C.slug(F.col("p_name")).alias("slug"), C.title_tokens(F.col("p_name"), ())[0].alias("first_token")).distinct()


@_query("a10_introduced", f"""
SELECT 'required_field' AS rule_id, id AS node_id FROM nodes WHERE reviewed IS NULL AND kind = 'customer' AND regexp_extract(id, '([0-9]+)$', 1)::BIGINT % 3 = 0""")
def a10_introduced(spark, sf):
    g = view.graph(spark, sf, ("related",))
    after = rules.required_field(g).findings
    k = F.regexp_extract("node_id", r"(\d+)$", 1).cast("long")
    before = after.where(~(F.col("node_id").startswith("customer-") & (k % 3 == 0)))
    return rules.introduced(after, before).select("rule_id", "node_id")


