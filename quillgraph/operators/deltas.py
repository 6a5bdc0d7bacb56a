"""What changed between two graphs, and whom it touches."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.columns import field_text
from quillgraph.model import LISTS, REF, Graph
from quillgraph.operators.walks import _stored, dependents
from quillgraph.plans.resolve import BY_ID, candidates_of

#: Fields compared one by one; status and path have streams of their own.
FIELDS = ("title", "kind", "created", "updated", "reviewed", "owner", "superseded_by", "orphan_ok")
EDGE_KEY = ("source", "target_id", "target_raw", "relation")


@dataclass(frozen=True)
class Delta:
    before: Graph
    after: Graph

    def added_nodes(self) -> DataFrame:
        return self.after.nodes.join(self.before.nodes.select("id"), "id", "left_anti").select(*REF)

    def removed_nodes(self) -> DataFrame:
        return self.before.nodes.join(self.after.nodes.select("id"), "id", "left_anti").select(*REF)

    @staticmethod
    def _edges_beyond(a: Graph, b: Graph) -> DataFrame:
        """Edges of a whose key b has not; where a line stands doesn't count."""
        other = b.edges.select(*[F.col(c).alias(f"o_{c}") for c in EDGE_KEY])
        same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in EDGE_KEY]
        return a.edges.join(other, same, "left_anti").select(*EDGE_KEY, "location")

    def added_edges(self) -> DataFrame:
        return self._edges_beyond(self.after, self.before)

    def removed_edges(self) -> DataFrame:
        return self._edges_beyond(self.before, self.after)

    def _annotations(self, a: Graph, b: Graph) -> DataFrame:
        cols = ["name", "key", "source", "line"]
        return a.annotations.select(*cols).distinct().join(b.annotations.select(*cols).distinct(), cols, "left_anti")

    def added_annotations(self) -> DataFrame:
        return self._annotations(self.after, self.before)

    def removed_annotations(self) -> DataFrame:
        return self._annotations(self.before, self.after)

    def _both(self, *cols) -> DataFrame:
        old = self.before.nodes.select("id", *[c.alias(f"o_{n}") for n, c in cols])
        return old.join(self.after.nodes.select("id", *[c.alias(f"n_{n}") for n, c in cols]), "id")

    def status_transitions(self) -> DataFrame:
        rows = self._both(("status", F.col("status"))).where("NOT (o_status <=> n_status)")
        return rows.select("id", F.col("o_status").alias("before"), F.col("n_status").alias("after"))

    def path_changes(self) -> DataFrame:
        return self._both(("path", F.col("path"))).where("NOT (o_path <=> n_path)").select("id", F.col("o_path").alias("before"), F.col("n_path").alias("after"))

    def body_changes(self) -> DataFrame:
        return self._both(("h", F.col("body_hash"))).where("NOT (o_h <=> n_h)").select("id")

    def field_changes(self) -> DataFrame:
        """id, field, before and after of every field that differs, attributes included; a list reads as JSON."""
        lists = [c for c in LISTS if c in self.after.nodes.columns]
        text = {f: field_text(f) for f in FIELDS if f in self.after.nodes.columns} | {f: F.when(F.size(f) > 0, F.to_json(f)) for f in lists}
        fields = F.map_filter(F.create_map(*[x for k, c in text.items() for x in (F.lit(k), c)]), lambda k, v: v.isNotNull())
        rows = self._both(("f", fields), ("a", F.coalesce("attrs", F.create_map().cast("map<string,string>"))))
        rows = rows.select("id", F.explode(F.array(F.struct(F.col("o_f").alias("o"), F.col("n_f").alias("n")), F.struct(F.col("o_a").alias("o"), F.col("n_a").alias("n")))).alias("m"))
        keys = F.array_union(F.map_keys("m.o"), F.map_keys("m.n"))
        rows = rows.select("id", F.explode(keys).alias("field"), F.col("m.o").alias("o"), F.col("m.n").alias("n"))
        return rows.select("id", "field", F.col("o")[F.col("field")].alias("before"), F.col("n")[F.col("field")].alias("after")).where("NOT (before <=> after)")

    def relinked(self) -> DataFrame:
        """Ids whose incoming links may have changed."""
        ends = self.added_edges().select(F.col("target_id").alias("id")).union(self.removed_edges().select("target_id"))
        named = self.field_changes().where("field = 'superseded_by'")
        return ends.union(named.select("before")).union(named.select("after")).where("id IS NOT NULL").distinct()

    def touched(self) -> DataFrame:
        """Ids that any change names."""
        parts = [self.added_nodes(), self.removed_nodes(), self.status_transitions(), self.path_changes(), self.field_changes()]
        if "body_hash" in self.after.nodes.columns:
            parts.append(self.body_changes())
        out = parts[0].select("id")
        for p in parts[1:]:
            out = out.union(p.select("id"))
        for p in (self.added_edges(), self.removed_edges()):
            out = out.union(p.select(F.col("source").alias("id")))
        if self.after.annotations is not None and self.before.annotations is not None:
            for p in (self.added_annotations(), self.removed_annotations()):
                out = out.union(p.select(F.col("source").alias("id")))
        return out.distinct()


def dangling(after: Graph, gone: DataFrame, relations=()) -> DataFrame:
    """root and id: documents of ``after`` whose unresolved references still seek what is gone (id, path), by id or by path."""
    rows = after.edges.where("target_id IS NULL")
    if relations:
        rows = rows.where(F.col("relation").isin(*relations))
    rows = rows.join(after.nodes.select(F.col("id").alias("source"), F.col("path").alias("source_path")), "source")
    rows = candidates_of(rows, after.settings.extensions)
    by_path = rows.where(~F.col("relation").isin(*BY_ID)).select("source", F.explode("sought").alias("path")).join(gone.select("path", F.col("id").alias("root")), "path")
    by_id = rows.where("relation <> 'covers'").join(gone.select(F.col("id").alias("root")), F.col("target_raw") == F.col("root"))
    return by_path.select("root", F.col("source").alias("id")).union(by_id.select("root", F.col("source").alias("id"))).distinct()


def impact(delta: Delta, max_depth: int | None = None, relations=()) -> DataFrame:
    """root, change, id, hops and breaking: documents that depend on one that was modified or moved, or that still refer to
    where one was before it was removed or moved; the latter references dangle, which is breaking."""
    # What many parts ask for is worked out once: the edges of both graphs, what is gone, and who changed. Nothing here is
    # broadcast, since sizes guessed from packed tables would send millions of ids to the driver.
    delta = Delta(*(dataclasses.replace(g, nodes=g.nodes.hint("merge"), edges=_stored(g.edges).hint("merge")) for g in (delta.before, delta.after)))
    changed = delta.touched().join(delta.added_nodes().select("id"), "id", "left_anti")
    removed = delta.removed_nodes().select("id", "path", F.lit("removed").alias("change"))
    moved = delta.path_changes().select("id", F.col("before").alias("path"), F.lit("moved").alias("change"))
    gone = _stored(removed.union(moved)).hint("merge")
    removed, moved = gone.where("change = 'removed'"), gone.where("change = 'moved'")
    loose = dangling(delta.after, gone, relations).join(gone.select(F.col("id").alias("root"), "change"), "root")
    loose = loose.select("root", "change", "id", F.lit(1).alias("hops"), F.lit(True).alias("breaking"))
    live = changed.join(removed.select("id"), "id", "left_anti").join(moved.select("id", F.col("change").alias("m")), "id", "left").select(F.col("id").alias("root"), F.coalesce("m", F.lit("modified")).alias("change"))
    live = _stored(live).hint("merge")
    reach = dependents(delta.after, live.select("root"), max_depth, relations).join(live, "root").select("root", "change", "id", "hops", F.lit(False).alias("breaking"))
    # A document that is bound and stranded at once is listed under the reference that still binds it; the other breaks all the same.
    both = reach.unionByName(loose).groupBy("root", "change", "id")
    return both.agg(F.coalesce(F.min(F.when(~F.col("breaking"), F.col("hops"))), F.lit(1)).alias("hops"), F.max("breaking").alias("breaking"))


def likely_breaking(found: DataFrame) -> DataFrame:
    """Roots of an ``impact`` to which a reference dangles."""
    return found.where("breaking").select(F.col("root").alias("id")).distinct().orderBy("id")
