"""Searches, listings, one-hop questions and detections; each returns one plan without an action."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.columns import days_since, field_text, newest, normalized_path
from quillgraph.model import REF, Graph


def _ref(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}").alias(c) for c in REF]


def search(g: Graph, keyword: str, statuses: tuple[str, ...] = ()) -> DataFrame:
    """Nodes whose id, title or a tag holds the keyword, scored by the best tier of each; case doesn't count."""
    if not keyword.strip():
        raise ValueError("the keyword is empty")
    kw, w = F.lower(F.lit(keyword)), g.settings.search_weights
    tier = lambda c, exact, part: F.when(F.lower(c) == kw, F.lit(w[exact])).when(F.contains(F.lower(c), kw), F.lit(w[part]))
    tags = F.when(F.exists("tags", lambda t: F.contains(F.lower(t), kw)), F.lit(w["tag"]))
    rows = g.nodes.where(F.col("status").isin(*statuses)) if statuses else g.nodes
    rows = rows.select(*_ref(), tier(F.col("id"), "id_exact", "id_partial").alias("in_id"), tier(F.col("title"), "title_exact", "title_partial").alias("in_title"), tags.alias("in_tags"))
    score = sum((F.coalesce(c, F.lit(0.0)) for c in ("in_title", "in_tags")), F.coalesce("in_id", F.lit(0.0)))
    return rows.where("coalesce(in_id, in_title, in_tags) IS NOT NULL").withColumn("score", score).orderBy(F.desc("score"), "id")


def listing(g: Graph, kinds=(), statuses=(), tags=(), all_tags: bool = False, where: dict[str, str] | None = None, fields=()) -> DataFrame:
    """Nodes that pass every filter given, any value of one filter being enough (tags: all of them on request)."""
    rows = g.nodes
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if statuses:
        rows = rows.where(F.col("status").isin(*statuses))
    if tags:
        own, asked = F.transform("tags", F.lower), [t.lower() for t in tags]
        rows = rows.where(F.forall(F.array(*map(F.lit, asked)), lambda t: F.array_contains(own, t)) if all_tags else F.arrays_overlap(own, F.array(*map(F.lit, asked))))
    for name, value in (where or {}).items():
        rows = rows.where(field_text(name) == value)
    spine = [c for c in REF if c in fields] if fields else list(REF)
    return rows.select(*spine, *(field_text(f).alias(f) for f in fields if f not in REF)).orderBy("id")


def node_detail(g: Graph, node_id: str | None = None, path: str | None = None) -> DataFrame:
    """One node with what points to it and what it points to, self-links included, in edge order."""
    found = g.nodes.where(F.col("id") == node_id) if node_id is not None else g.nodes.where(F.col("path") == path)

    def listed(rows: DataFrame, key: str, other: str, name: str) -> DataFrame:
        each = F.array_sort(F.collect_list(F.struct("edge_idx", other, "relation")))
        return rows.groupBy(F.col(key).alias("id")).agg(F.transform(each, lambda x: F.struct(x[other].alias(other), x["relation"].alias("relation"))).alias(name))

    key = found.select("id")
    inward = g.edges.join(F.broadcast(key.withColumnRenamed("id", "target_id")), "target_id", "left_semi")  # one row
    outward = g.edges.join(F.broadcast(key.withColumnRenamed("id", "source")), "source", "left_semi").withColumn("target", F.coalesce("target_id", "target_raw"))
    return found.join(listed(inward, "target_id", "source", "incoming"), "id", "left").join(listed(outward, "source", "target", "outgoing"), "id", "left")


def backlinks(g: Graph, node_id: str) -> DataFrame:
    """Edges from other documents to this one, with their sources."""
    rows = g.edges.where((F.col("target_id") == node_id) & (F.col("source") != node_id)).select(F.col("source").alias("id"), "relation", "location", "edge_idx")
    return rows.join(g.nodes.select(*REF), "id").orderBy("edge_idx").select(*REF, "relation", "location")


def covered_by(g: Graph, path: str) -> DataFrame:
    """Documents whose ``covers`` names the path."""
    from quillgraph.plans.resolve import candidates_of

    needle = normalized_path(F.lit(path))
    rows = g.edges.where("relation = 'covers'").join(g.nodes.select(F.col("id").alias("target_id"), F.col("path").alias("target_path")), "target_id", "left")
    rows = candidates_of(rows.join(g.nodes.select(*REF, F.col("path").alias("source_path")), F.col("source") == F.col("id")), g.settings.extensions)
    names = F.when(F.col("target_path").isNotNull(), F.array("target_path")).otherwise(F.coalesce("sought", F.array().cast("array<string>")))
    return rows.where(F.coalesce(F.array_contains(names, needle), F.lit(False))).select(*REF, "relation").distinct().orderBy("id")


#: Days from year 1 back to where project calendars end: a horizon beyond turns detection off.
CALENDAR = 95_746_130


def _before(today: dt.date, days: int) -> dt.date | None:
    """``days`` before today; None where no calendar reaches that far."""
    try:
        return today - dt.timedelta(days=days)
    except OverflowError:
        return None


def _until(column: Column, cutoff: dt.date | None) -> Column:
    return column <= _day(cutoff) if cutoff else F.lit(False)


def _day(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("date")  # years before 1000 as well


def orphan_population(g: Graph) -> DataFrame:
    s = g.settings
    cutoff = _before(s.today, s.orphan_grace_days)
    if s.orphan_grace_days > s.today.toordinal() + CALENDAR:
        return g.nodes.where(F.lit(False))
    live = g.nodes.where(~F.col("status").isin(*s.terminal)) if s.terminal else g.nodes
    if s.orphan_ok_kinds:
        live = live.where(~F.col("kind").isin(*s.orphan_ok_kinds))
    return live.where(~F.coalesce("orphan_ok", F.lit(False)) & (F.col("created").isNull() | _until(F.col("created"), cutoff)))


def orphans(g: Graph) -> DataFrame:
    """Live documents past their grace that no other document links to or names as its successor."""
    linked = g.external.select(F.col("target_id").alias("id")).union(g.nodes.where("superseded_by IS NOT NULL AND superseded_by <> id").select(F.col("superseded_by").alias("id")))
    # Each id once before the join, which would sort as many rows as there are edges otherwise.
    return orphan_population(g).join(linked.distinct(), "id", "left_anti").select(*REF, "created").orderBy("id")


def stale(g: Graph) -> DataFrame:
    """Live documents last reviewed ``stale_days`` ago or earlier; none where no horizon is set."""
    s = g.settings
    cutoff = _before(s.today, s.stale_days or 0)
    rows = g.nodes.where(~F.col("status").isin(*s.terminal) & _until(F.col("reviewed"), cutoff) & F.lit(s.stale_days is not None))
    return rows.select(*REF, "reviewed", days_since(s.today, F.col("reviewed")).alias("days_since")).orderBy("reviewed", "id")


def recent(g: Graph, days: int = 7, since: dt.date | None = None, field: str | None = None, kind: str | None = None, limit: int | None = 20) -> DataFrame:
    """Documents by their newest date (or one field's), newest first; on equal dates created counts before reviewed and updated."""
    cutoff = since or _before(g.settings.today, days)
    date, name = (F.col(field), F.lit(field)) if field else newest(F.col("created"), F.col("reviewed"), F.col("updated"))
    rows = g.nodes.where(F.col("kind") == kind) if kind else g.nodes
    rows = rows.select(*REF, name.alias("field"), date.alias("date")).where(F.col("date") >= _day(cutoff) if cutoff else F.col("date").isNotNull())
    rows = rows.withColumn("days_ago", days_since(g.settings.today, F.col("date"))).orderBy(F.desc("date"), "id")
    return rows.limit(limit) if limit is not None else rows


def annotations(g: Graph, name: str | None = None, min_count: int = 1, fields: tuple[str, ...] = ()) -> DataFrame:
    """name, key, count and sources (by source and line) of body markers; ``fields`` adds frontmatter of each source."""
    rows = g.annotations.where(F.col("name") == name) if name else g.annotations
    extra = [F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), field_text(f))]), lambda k, v: v.isNotNull()).alias("frontmatter")] if fields else []
    rows = rows.join(g.nodes.select(F.col("id").alias("source"), "path", *extra), "source")
    one = F.struct("source", "line", "path", *(["frontmatter"] if fields else [])) if not fields else F.struct("source", "line", "path", F.to_json("frontmatter").alias("frontmatter"))
    return rows.groupBy("name", "key").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(one)).alias("sources")).where(F.col("count") >= min_count).orderBy("name", "key")


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")
