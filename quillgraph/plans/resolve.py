"""Resolution of raw references to documents, by joins in order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.columns import directory, normalized_path

#: Relations that name documents by id alone.
BY_ID = ("supersedes", "superseded_by", "implements", "related")


def _framed(raw: Column) -> Column:
    """The path without empty and ``.`` parts, null where it begins at a root."""
    parts = F.filter(F.split(F.regexp_replace(raw, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    return F.when(~raw.rlike(r"^[/\\]"), F.array_join(parts, "/"))


def candidates_of(rows: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Rows (relation, target_raw, source_path) with ``sought``: the names that a reference is looked up under, in order."""
    raw, folder = F.col("target_raw"), directory(F.col("source_path"))
    # Columns of their own, since an expression used in many places would be worked out in each.
    rows = rows.withColumn("_framed", _framed(raw))
    framed = F.col("_framed")
    rows = rows.withColumn("_relative", normalized_path(F.when(folder == "", framed).otherwise(F.concat_ws("/", folder, framed))))
    relative = F.col("_relative")
    has = F.lit(False)
    for e in extensions:
        has = has | framed.endswith(e)

    def spelled(base: Column) -> Column:
        plain = F.array(base)
        more = F.array(base, *[F.concat(base, F.lit(e)) for e in extensions])
        return F.when(base.isNull(), F.array().cast("array<string>")).when((F.col("relation") == "covers") | has, plain).otherwise(more)

    here = raw.rlike(r"^\./")
    root = F.when(here | framed.rlike(r"(^|/)\.\.(/|$)"), F.array().cast("array<string>")).otherwise(spelled(framed))
    sought = F.when(F.col("relation").isin(*BY_ID), F.array(raw)).otherwise(F.array_distinct(F.concat(root, spelled(relative))))
    return rows.withColumn("sought", sought).withColumn("_absolute", framed.isNull()).withColumn("_escapes", framed.isNotNull() & relative.isNull()).drop("_framed", "_relative")


def resolve(raw: DataFrame, nodes: DataFrame, extensions: tuple[str, ...] = (".md",)) -> DataFrame:
    """raw (source, source_path, target_raw, relation, location, ordinal) with target_id, or target_raw and cause.

    Candidates are exploded with their place and joined on path; the first that is a document wins, then a bare id.
    """
    rows = candidates_of(raw, extensions).withColumn("_e", F.monotonically_increasing_id())
    # The documents' own names are never broadcast: sizes guessed from packed tables would send millions to the driver.
    paths = nodes.select(F.col("path").alias("name"), F.col("id").alias("by_path")).hint("merge")
    sought = rows.where(~F.col("relation").isin(*BY_ID)).select("_e", F.posexplode("sought").alias("place", "name"))
    hit = sought.join(paths, "name").groupBy("_e").agg(F.min_by("by_path", "place").alias("by_path"))
    ids = nodes.select(F.col("id").alias("by_id")).hint("merge")
    rows = rows.join(hit, "_e", "left").join(ids, rows["target_raw"] == ids["by_id"], "left")
    by_id = F.col("relation").isin(*BY_ID)
    target = F.when(by_id, F.col("by_id")).otherwise(F.coalesce("by_path", F.when((F.col("relation") != "covers") & ~F.col("_absolute") & ~F.col("_escapes"), F.col("by_id"))))
    cause = F.when(by_id, "id_not_found").when(F.col("_absolute"), "absolute").when(F.col("_escapes"), "escapes_source").otherwise("missing")
    rows = rows.withColumn("target_id", target)
    return rows.select("source", "target_id", F.when(F.col("target_id").isNull(), F.col("target_raw")).alias("target_raw"), F.when(F.col("target_id").isNull(), cause).alias("cause"), "relation", "location", "ordinal")


def mirrored(nodes: DataFrame) -> DataFrame:
    """What ``superseded_by`` says as edges: successor to predecessor, or unresolved from the document that names nobody."""
    ids = nodes.select(F.col("id").alias("successor")).hint("merge")
    rows = nodes.where("superseded_by IS NOT NULL").select("id", "superseded_by").join(ids, F.col("superseded_by") == F.col("successor"), "left")
    known = F.col("successor").isNotNull()
    return rows.select(F.when(known, F.col("successor")).otherwise(F.col("id")).alias("source"), F.when(known, F.col("id")).alias("target_id"), F.when(~known, F.col("superseded_by")).alias("target_raw"), F.when(~known, "id_not_found").alias("cause"), F.when(known, "supersedes").otherwise("superseded_by").alias("relation"), F.lit("frontmatter:superseded_by").alias("location"), F.lit(1 << 30).alias("ordinal"))


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with the first of each (source, target, relation) kept, and ``edge_idx`` by source, relation and location."""
    from quillgraph.operators.lookups import first_of
    from quillgraph.operators.walks import numbered

    kept = first_of(edges, ["source", "target_id", "target_raw", "relation"], ["ordinal"])
    order = [F.col(c) for c in ("source", "relation", "location", "ordinal", "target_id")]  # successions said by several documents tie but for these
    return numbered(kept, order, "edge_idx").select("edge_idx", "source", "target_id", "target_raw", "cause", "relation", "location")
