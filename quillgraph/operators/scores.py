"""Composite rankings: trust of documents, and similarity to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.columns import directory, jaccard, title_tokens, weighted_mean
from quillgraph.model import REF, Graph
from quillgraph.plans.resolve import BY_ID, candidates_of


def linkers(g: Graph) -> DataFrame:
    """id and the number of other documents that link to it."""
    return g.external.select(F.col("target_id").alias("id"), "source").distinct().groupBy("id").agg(F.count("*").alias("linkers"))


def drift_targets(g: Graph, declared: bool = True) -> DataFrame:
    """id, reviewed, edge_idx, label and path (null: nothing to measure) of each reference whose target's changes count.

    ``declared`` asks for documents with a review date, else those without. A reference without a document counts for the first file or folder, of those it was looked up under, that exists.
    """
    s = g.settings
    live = g.nodes.where(~F.col("status").isin(*s.terminal) & F.col("reviewed").isNotNull() == F.lit(declared)).select(F.col("id").alias("source"), F.col("path").alias("source_path"), "reviewed")
    edges = g.edges.where(F.col("relation").isin(*s.drift_relations)).join(live, "source")
    to = g.nodes.select(F.col("id").alias("target_id"), F.col("path").alias("target_path"))
    bound = edges.where("target_id IS NOT NULL").join(to, "target_id", "left").select("source", "reviewed", "edge_idx", F.col("target_id").alias("label"), F.col("target_path").alias("path"))
    loose = candidates_of(edges.where("target_id IS NULL"), s.extensions)
    by_path = ~F.col("relation").isin(*BY_ID)
    if g.files is None:
        loose = loose.withColumn("path", F.when(F.col("relation") == "covers", F.element_at(F.filter("sought", lambda x: x.isNotNull()), 1)))
    else:
        sought = loose.where(by_path).select("source", "edge_idx", F.posexplode("sought").alias("place", "path"))
        first = sought.join(g.files.select("path").distinct(), "path", "left_semi").groupBy("source", "edge_idx").agg(F.min_by("path", "place").alias("path"))
        loose = loose.join(first, ["source", "edge_idx"], "left")
    loose = loose.select("source", "reviewed", "edge_idx", F.col("target_raw").alias("label"), "path")
    return bound.unionByName(loose).withColumnRenamed("source", "id")


def drift(g: Graph) -> DataFrame:
    """id, commits, hottest (the target with most changes, the first of equals), offered and measured references, and the
    labels of those unmeasured: changes to the targets of live documents since the day after their review."""
    targets = drift_targets(g)
    changes = g.commits.select("path", "date")
    if "commit" in g.commits.columns and g.files is not None:
        folders = g.files.where("is_dir").select("path")
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        inside = g.commits.where(F.size(parts) > 1).select("commit", "date", F.explode(above).alias("path")).distinct()
        changes = changes.union(inside.join(folders, "path", "left_semi").select("path", "date"))
    # Both sides meet on the path; the date is a residual condition of the hash join.
    each = targets.join(changes, (targets["path"] == changes["path"]) & (changes["date"] >= F.date_add(targets["reviewed"], 1)), "left")
    each = each.groupBy("id", "edge_idx", "label", targets["path"].alias("at")).agg(F.count(changes["date"]).alias("n"))
    measured = F.col("at").isNotNull()
    return each.groupBy("id").agg(
        F.sum("n").alias("commits"),
        F.min_by(F.when(measured, F.col("label")), F.struct(~measured, -F.col("n"), "edge_idx")).alias("hottest"),
        F.count("*").alias("offered"),
        F.count("at").alias("measured"),
        F.array_sort(F.collect_set(F.when(~measured, F.col("label")))).alias("unmeasured"),
    )


def trust(g: Graph) -> DataFrame:
    """Every node's score, its parts, and the names of those undeclared; a part is null where it doesn't apply or isn't declared.

    A positively weighted part that a live document ought to declare but doesn't (its review date) leaves no score: freshness
    where there is a horizon, drift where there are changes to count from it.
    """
    s = g.settings
    rows = g.nodes.select(*REF, "reviewed").join(linkers(g), "id", "left").withColumn("linkers", F.coalesce("linkers", F.lit(0)))
    most = linkers(g).agg(F.coalesce(F.max("linkers"), F.lit(0)).alias("most"))
    rows = rows.join(F.broadcast(most))  # one row
    terminal = F.col("status").isin(*s.terminal) if s.terminal else F.lit(False)
    status = F.when(terminal, F.lit(0.0)).otherwise(F.lit(1.0))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    elapsed = F.greatest(F.datediff(F.lit(s.today), "reviewed"), F.lit(0)).cast("double")
    fresh = F.when(~terminal & F.col("reviewed").isNotNull(), unit(F.lit(1.0) - elapsed / F.lit(float(s.stale_days)))) if s.stale_days else F.lit(None).cast("double")
    back = F.when(F.col("most") > 0, unit(F.log(F.col("linkers") + F.lit(1.0)) / F.log(F.col("most") + F.lit(1.0))))
    undeclared = ~terminal & F.col("reviewed").isNull()
    if s.drift_threshold and g.commits is not None:
        rows = rows.join(drift(g).where("measured > 0").select("id", "commits"), "id", "left")
        asked = drift_targets(g, declared=False).where("path IS NOT NULL").select("id", F.lit(True).alias("moves")).distinct()
        rows = rows.join(asked, "id", "left").withColumn("moves", F.coalesce("moves", F.lit(False)))
        moved = F.when(~terminal & F.col("commits").isNotNull(), unit(F.lit(1.0) - F.col("commits") / F.lit(float(s.drift_threshold))))
    else:
        rows, moved = rows.withColumn("moves", F.lit(False)), F.lit(None).cast("double")
    w = {k: _weight(s, k) for k in ("status", "freshness", "drift", "backlinks")}
    rows = rows.select(*REF, status.alias("status_score"), fresh.alias("freshness"), moved.alias("drift"), back.alias("backlinks"), F.filter(F.array(*[F.when(undeclared & on & (w[k] > 0), F.lit(k)) for k, on in (("freshness", F.lit(s.stale_days is not None)), ("drift", F.col("moves")))]), lambda x: x.isNotNull()).alias("undeclared_parts"))
    rows = rows.withColumn("undeclared", F.size("undeclared_parts") > 0)
    mean = weighted_mean([(w[k], F.col("status_score" if k == "status" else k)) for k in w])
    return rows.withColumn("score", F.when(~F.col("undeclared"), mean))


def _weight(s, part: str):
    out = F.lit(s.trust_weights[part])
    for kind, own in s.trust_by_kind.items():
        out = F.when(F.col("kind") == kind, F.lit(own.get(part, s.trust_weights[part]))).otherwise(out)
    return out


def trust_ranking(g: Graph, n: int, top: bool = False, kinds=(), statuses=(), below: float | None = None) -> DataFrame:
    """The n most or least trusted documents that have a score."""
    rows = trust(g).where("score IS NOT NULL")
    if kinds:
        rows = rows.where(F.col("kind").isin(*kinds))
    if statuses:
        rows = rows.where(F.col("status").isin(*statuses))
    if below is not None:
        rows = rows.where(F.col("score") < below)
    return rows.orderBy(F.desc("score") if top else F.asc("score"), "id").limit(n)


def similar(g: Graph, node_id: str | None = None, title: str | None = None, tags=(), kind: str | None = None, path: str | None = None, limit: int | None = None, min_score: float | None = None) -> DataFrame:
    """Documents most like one that exists or is proposed: parts that the target has are compared, the rest don't count."""
    s = g.settings
    bound = g.edges.where("target_id IS NOT NULL")
    neighbours = bound.select(F.col("source").alias("id"), F.col("target_id").alias("n")).union(bound.select(F.col("target_id").alias("id"), F.col("source").alias("n")))
    strings = "array<string>"
    if node_id is not None:
        target = g.nodes.where(F.col("id") == node_id).select(F.col("title").alias("t_title"), F.col("tags").alias("t_tags"), F.col("kind").alias("t_kind"), directory(F.col("path")).alias("t_dir"))
        rows = g.nodes.where(F.col("id") != node_id)
        # Only documents that share a neighbour with the target need their own counted; hubs make many, so nothing is hinted here.
        mine = neighbours.where(F.col("id") == node_id).select("n").distinct()
        shared = neighbours.join(mine, "n").select("id", "n").distinct().groupBy("id").agg(F.count("*").alias("shared"))
        degree = neighbours.join(shared.select("id"), "id", "left_semi").distinct().groupBy("id").agg(F.count("*").alias("degree"))
        target = target.join(F.broadcast(mine.agg(F.count("*").alias("t_linked"))))  # one row
        rows = rows.join(shared.join(degree, "id"), "id", "left")
    else:
        one = [F.lit(title or "").alias("t_title"), F.array(*map(F.lit, tags)).cast(strings).alias("t_tags"), F.lit(kind).cast("string").alias("t_kind"), (directory(F.lit(path)) if path else F.lit(None).cast("string")).alias("t_dir"), F.lit(0).alias("t_linked")]
        target = g.nodes.sparkSession.range(1).select(*one)
        rows = g.nodes.withColumns({"shared": F.lit(None).cast("long"), "degree": F.lit(None).cast("long")})
    rows = rows.join(F.broadcast(target))  # one row
    linked = F.when(F.col("t_linked") > 0, F.coalesce(F.col("shared") / (F.col("t_linked") + F.col("degree") - F.col("shared")), F.lit(0.0)))
    same = lambda a, b: F.when(a.isNotNull(), F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0)))
    parts = {
        "in_title": jaccard(title_tokens(F.col("t_title"), s.stop_words), title_tokens(F.col("title"), s.stop_words)),
        "in_tags": jaccard(F.array_distinct("t_tags"), F.array_distinct(F.coalesce("tags", F.array().cast(strings)))),
        "in_kind": same(F.col("t_kind"), F.col("kind")),
        "in_directory": same(F.col("t_dir"), directory(F.col("path"))),
        "in_linked": linked,
    }
    rows = rows.select(*REF, *(c.alias(k) for k, c in parts.items()))
    w = s.similarity_weights
    rows = rows.withColumn("score", F.coalesce(weighted_mean([(F.lit(w[k[3:]]), F.col(k)) for k in parts]), F.lit(0.0)))
    rows = rows.orderBy(F.desc("score"), "id").limit(limit or s.similarity_limit)
    return rows.where(F.col("score") >= min_score) if min_score is not None else rows
