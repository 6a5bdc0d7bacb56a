"""The report: tallies, the most linked documents, lineages, orphans and stale documents."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.columns import days_since
from quillgraph.model import REF, Graph
from quillgraph.operators import lookups
from quillgraph.operators.walks import _stored, component_labels, topological


def gods(g: Graph, limit: int | None = None) -> DataFrame:
    """Live documents with the most edges from other documents."""
    n = g.external.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("incoming"))
    return n.join(g.nodes.where(~F.col("status").isin(*g.settings.terminal)).select(*REF), "id").orderBy(F.desc("incoming"), "id").limit(limit or g.settings.god_limit)


def tallies(g: Graph) -> DataFrame:
    """section, key and value: documents by status and kind, and incoming edges of the most linked."""
    by = lambda c: g.nodes.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("value")).select(F.lit(c).alias("section"), "key", "value")
    return by("status").union(by("kind")).union(gods(g).select(F.lit("god"), "id", "incoming"))


def lineages(g: Graph) -> DataFrame:
    """lineage (least member), position and id of every supersession lineage of two or more, old before new.

    Each lineage is ordered in a task of its own; a lineage is a document's history, not a share of the corpus.
    """
    e = g.edges.where("relation = 'supersedes' AND target_id IS NOT NULL AND source <> target_id").select(F.col("target_id").alias("old"), F.col("source").alias("new"))
    e = _stored(e)
    labels = component_labels(e.select(F.col("old").alias("a"), F.col("new").alias("b")))

    def order(batches):
        """Rows come by lineage; each lineage's are ordered when the next one's begin."""
        links, done = [], []

        def close():
            if links:
                ids = topological({x for link in links for x in link[1:]}, [link[1:] for link in links])
                done.extend({"lineage": links[0][0], "position": i, "id": x} for i, x in enumerate(ids, 1))
                links.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if links and row[0] != links[0][0]:
                    close()
                links.append(row)
            yield pa.RecordBatch.from_pylist(done, schema=out)
            done.clear()
        close()
        yield pa.RecordBatch.from_pylist(done, schema=out)

    out = pa.schema([("lineage", pa.string()), ("position", pa.int32()), ("id", pa.string())])
    rows = e.join(labels.select(F.col("id").alias("old"), F.col("component").alias("lineage")), "old").select("lineage", "old", "new")
    return rows.repartition("lineage").sortWithinPartitions("lineage").mapInArrow(order, "lineage string, position int, id string")


def _inline(x) -> str:
    return " ".join(str(x).split())


def markdown(g: Graph) -> str:
    """The report as Markdown; what it lists is bounded by the settings, and its last line signs the rest."""
    s = g.settings
    out = ["# Document graph", "", "## Summary", ""]
    rows = tallies(g).orderBy("section", "key").collect()
    for part in ("status", "kind"):
        out += [f"- {part} {_inline(r.key)}: {r.value}" for r in rows if r.section == part]
    out += ["", "## Most linked", ""] + [f"- {_inline(r.title)} ({r.id}): {r.incoming}" for r in gods(g).collect()]
    w = Window.partitionBy("lineage").orderBy("position")
    chains = lineages(g).join(g.nodes.select("id", "status"), "id").withColumn("n", F.row_number().over(w)).where(f"n <= {s.god_limit}").orderBy("lineage", "position").limit(s.god_limit * s.god_limit).collect()
    by_line: dict[str, list[str]] = {}
    for r in chains:
        by_line.setdefault(r.lineage, []).append(f"~~{r.id}~~" if r.status in s.terminal else r.id)
    out += ["", "## Lineages", ""] + [f"- {' → '.join(x)}" for x in by_line.values()]
    out += ["", "## Orphans", ""] + [f"- {_inline(r.title)} ({r.id})" for r in lookups.orphans(g).limit(s.orphan_limit).collect()]
    out += ["", "## Stale", ""] + [f"- {_inline(r.title)} ({r.id}): {r.days_since} days" for r in lookups.stale(g).limit(s.stale_limit).collect()]
    text = "\n".join(out) + "\n"
    return text + f"\n<!-- {hashlib.sha256(text.encode()).hexdigest()[:16]} -->\n"


def oldest(g: Graph, n: int) -> DataFrame:
    """The n documents reviewed longest ago."""
    return g.nodes.where("reviewed IS NOT NULL").select(*REF, "reviewed", days_since(g.settings.today, F.col("reviewed")).alias("days_since")).orderBy("reviewed", "id").limit(n)
