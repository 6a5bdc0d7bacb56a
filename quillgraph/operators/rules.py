"""Data-quality rules: each gives findings and how many subjects it judged.

A rule is a function of the graph (and, for rules on change, of a delta) to findings (rule_id, severity, node_id, path,
details as JSON) and subjects (a count frame). Identity of a finding is rule, severity, node and details.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.columns import begins_with, field_missing, field_text, file_name, matches_glob, predicate, sequence_number
from quillgraph.model import LISTS, SCALARS, Graph
from quillgraph.operators import lookups
from quillgraph.operators.scores import drift
from quillgraph.operators.walks import _cut, cyclic_members

FINDING = ("rule_id", "severity", "node_id", "path", "details")


@dataclass(frozen=True)
class Outcome:
    """Findings, subjects (one row n), the reason why the rule declined, and those that couldn't be judged (one row n)."""

    findings: DataFrame
    subjects: DataFrame
    skipped: str | None = None
    unjudged: DataFrame | None = None


def _details(**parts: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(parts.items())]))


def _found(rows: DataFrame, rule: str, severity: str, node="id", path="path", **details: Column) -> DataFrame:
    pick = lambda c: F.lit(None).cast("string") if c is None else F.col(c)
    return rows.select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), pick(node).alias("node_id"), pick(path).alias("path"), _details(**details).alias("details"))


def _count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"))


def _by_kind(g: Graph, part: str) -> list[tuple[tuple[str, ...], object]]:
    """What each group of kinds declares of one part: the base for all, and the first override that holds a kind besides."""
    s = g.settings
    base = getattr(s, part)
    out, taken = [], set()
    for kinds, more in s.overrides:
        own = tuple(k for k in kinds if k not in taken)
        taken |= set(own)
        if own:
            extra = more.get(part)
            out.append((own, base if extra is None else {**base, **extra} if isinstance(base, dict) else tuple(dict.fromkeys([*base, *extra]))))
    rest = tuple(k for k in s.kinds if k not in taken)
    return [(k, v) for k, v in [(rest, base), *out] if k and v]


def _union(frames: list[DataFrame], g: Graph) -> DataFrame:
    if not frames:
        return g.nodes.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in FINDING))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _of_kinds(g: Graph, groups) -> DataFrame:
    kinds = [k for ks, _ in groups for k in ks]
    return g.nodes.where(F.col("kind").isin(*kinds)) if kinds else g.nodes.where(F.lit(False))


def parse_failure(g: Graph) -> Outcome:
    failed = g.parse_failures if g.parse_failures is not None else g.nodes.select("path", F.lit("").alias("message")).where(F.lit(False))
    return Outcome(_found(failed, "parse_failure", "error", None, message=F.col("message")), _count(g.nodes.select("path").union(failed.select("path"))))


def field_parse(g: Graph) -> Outcome:
    if "parse_issues" not in g.nodes.columns:
        return Outcome(_union([], g), _count(g.nodes))
    rows = g.nodes.select("id", "path", F.explode("parse_issues").alias("p"))
    return Outcome(_found(rows, "field_parse", "error", field=F.col("p.field"), expected=F.col("p.expected"), found=F.col("p.found")), _count(g.nodes))


def _exploded(rows: DataFrame, conditions: list[tuple[Column, Column]]) -> DataFrame:
    """A row for each (condition, value) whose condition holds: one pass whatever their number."""
    return rows.withColumn("x", F.explode(F.filter(F.array(*[F.when(c, v) for c, v in conditions]), lambda x: x.isNotNull())))


def required_field(g: Graph) -> Outcome:
    groups = _by_kind(g, "required")
    checks = [(F.col("kind").isin(*ks) & field_missing(f), F.lit(f)) for ks, fs in groups for f in fs]
    if not checks:
        return Outcome(_union([], g), _count(_of_kinds(g, groups)))
    return Outcome(_found(_exploded(g.nodes, checks), "required_field", "error", field=F.col("x")), _count(_of_kinds(g, groups)))


_JSON_TYPE = {"string": r'^"', "integer": r"^-?\d+$", "bool": r"^(true|false)$", "date": r'^"\d{4}-\d{1,2}-\d{1,2}"$'}


def field_type(g: Graph) -> Outcome:
    groups = _by_kind(g, "types")
    checks = [(F.col("kind").isin(*ks) & F.coalesce(F.col("attrs")[f] != "null", F.lit(False)) & ~F.col("attrs")[f].rlike(_JSON_TYPE[t]), F.struct(F.lit(f).alias("f"), F.lit(t).alias("t"))) for ks, ts in groups for f, t in ts.items()]
    if not checks:
        return Outcome(_union([], g), _count(_of_kinds(g, groups)))
    return Outcome(_found(_exploded(g.nodes, checks), "field_type", "error", field=F.col("x.f"), expected=F.col("x.t")), _count(_of_kinds(g, groups)))


def field_enum(g: Graph) -> Outcome:
    base = {"kind": g.settings.kinds, "status": g.settings.statuses}
    groups = [(ks, {**base, **vs}) for ks, vs in _by_kind(g, "enums")]
    held = {k for ks, _ in groups for k in ks}
    checks = []
    for ks, enums in [*groups, (None, base)]:
        at = F.col("kind").isin(*ks) if ks else ~F.coalesce(F.col("kind").isin(*held), F.lit(False)) if held else F.lit(True)
        for f, allowed in enums.items():
            value = field_text(f)
            checks.append((at & F.coalesce(~value.isin(*allowed), F.lit(False)), F.struct(F.lit(f).alias("f"), value.alias("v"))))
    return Outcome(_found(_exploded(g.nodes, checks), "field_enum", "error", field=F.col("x.f"), value=F.col("x.v")), _count(g.nodes))


def cross_field(g: Graph) -> Outcome:
    groups = _by_kind(g, "cross_field")
    checks = [(F.col("kind").isin(*ks) & predicate(when) & field_missing(f), F.struct(F.lit(when).alias("w"), F.lit(f).alias("f"))) for ks, pairs in groups for when, f in pairs]
    if not checks:
        return Outcome(_union([], g), _count(_of_kinds(g, groups)))
    return Outcome(_found(_exploded(g.nodes, checks), "cross_field", "error", when=F.col("x.w"), field=F.col("x.f")), _count(_of_kinds(g, groups)))


def unknown_field(g: Graph) -> Outcome:
    s = g.settings
    known = {*SCALARS, *LISTS, *s.required, *s.types, *s.enums, *(f for _, f in s.cross_field)} | {f for _, o in s.overrides for p in ("required", "types", "enums") for f in o.get(p, ())}
    rows = g.nodes.select("id", "path", F.explode(F.map_keys("attrs")).alias("f"))
    held = g.nodes.where(F.size("attrs") > 0)
    return Outcome(_found(rows.where(~F.col("f").isin(*known)), "unknown_field", "error", field=F.col("f")), _count(held))


def explicit_field(g: Graph) -> Outcome:
    checks = [(F.array_contains("inferred_fields", f), F.lit(f)) for f in g.settings.require_explicit]
    return Outcome(_found(_exploded(g.nodes, checks), "explicit_field", "error", field=F.col("x")), _count(g.nodes))


def stale_review(g: Graph) -> Outcome:
    live = g.nodes.where(~F.col("status").isin(*g.settings.terminal) & F.col("reviewed").isNotNull())
    return Outcome(_found(lookups.stale(g), "stale_review", "warning", reviewed=F.col("reviewed"), threshold=F.lit(g.settings.stale_days)), _count(live), None if g.settings.stale_days else "stale_days")


def orphan(g: Graph) -> Outcome:
    return Outcome(_found(lookups.orphans(g), "orphan", "warning", kind=F.col("kind")), _count(lookups.orphan_population(g)))


def git_drift(g: Graph) -> Outcome:
    """More changes to a document's targets since its review than the threshold; one of whose targets none can be measured
    is reported as such."""
    limit = g.settings.drift_threshold
    rows = drift(g).join(g.nodes.select("id", "path", "reviewed"), "id")
    live = g.nodes.where(~F.col("status").isin(*g.settings.terminal) & F.col("reviewed").isNotNull())
    blind = rows.where("measured = 0")
    moved = _found(rows.where((F.col("measured") > 0) & (F.col("commits") > limit)), "git_drift", "warning", threshold=F.lit(limit), reviewed=F.col("reviewed"), evidence=F.struct("commits", "hottest"))
    unseen = _found(blind, "git_drift", "warning", targets=F.col("unmeasured"), reviewed=F.col("reviewed"))
    return Outcome(moved.union(unseen), _count(live.join(blind.select("id"), "id", "left_anti")), None, _count(blind))


def filename_pattern(g: Graph) -> Outcome:
    blocks = [b for b in g.settings.naming if b.get("pattern")]
    rows = [(g.nodes.where(matches_glob(F.col("path"), b["glob"])), b) for b in blocks]
    bad = [_found(r.where(~file_name(F.col("path")).rlike(b["pattern"])), "filename_pattern", "error", pattern=F.lit(b["pattern"])) for r, b in rows]
    return Outcome(_union(bad, g), _count(_paths(rows, g)))


def _paths(rows, g: Graph) -> DataFrame:
    out = g.nodes.select("path").where(F.lit(False))
    for r, _ in rows:
        out = out.union(r.select("path"))
    return out


def numbered(g: Graph, b: dict) -> DataFrame:
    return g.nodes.where(matches_glob(F.col("path"), b["glob"])).withColumn("number", sequence_number(F.col("path"))).where("number IS NOT NULL")


def next_number(rows: DataFrame) -> DataFrame:
    """One row: the number after the highest, and how many digits it is padded to (the longest there is, four at least)."""
    digits = F.regexp_extract(file_name(F.col("path")), r"^(\d+)", 1)
    return rows.agg((F.coalesce(F.max("number"), F.lit(0)) + 1).cast("long").alias("next"), F.greatest(F.lit(4), F.coalesce(F.max(F.length(digits)), F.lit(4))).alias("width"))


def number_gaps(rows: DataFrame) -> DataFrame:
    """Rows whose number leaves a gap to the one before.

    A number looks for its predecessor by an anti join; those without one, and the last numbers of runs, are sorted into
    ranges, and each range learns the last number before it, one value for each range, so no task sees all numbers.
    """
    numbers = rows.groupBy("number").agg(F.min(F.struct("id", "path")).alias("at"))
    before = numbers.select((F.col("number") + 1).alias("number"))
    first = numbers.agg(F.min("number").alias("least"))
    open_ = numbers.join(before, "number", "left_anti").join(F.broadcast(first)).where("number > least")
    last = numbers.select(F.col("number").alias("previous")).join(numbers.select((F.col("number") - 1).alias("previous")), "previous", "left_anti")
    both = open_.select("number", F.lit(True).alias("gap"), F.col("at.id").alias("id"), F.col("at.path").alias("path")).unionByName(last.select(F.col("previous").alias("number"), F.lit(False).alias("gap"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("path")))
    both = _cut(both.repartitionByRange("number", F.col("gap").desc())).withColumn("_p", F.spark_partition_id())
    ended = F.when(~F.col("gap"), F.col("number"))
    most = {r["_p"]: r.m for r in both.groupBy("_p").agg(F.max(ended).alias("m")).collect()}
    carried, so_far = [], None
    for p in range(max(most, default=0) + 1):
        carried.append(F.lit(so_far).cast("decimal(38,0)"))
        so_far = max((x for x in (so_far, most.get(p)) if x is not None), default=None)
    w = Window.partitionBy("_p").orderBy("number", F.col("gap").desc()).rowsBetween(Window.unboundedPreceding, -1)
    previous = F.coalesce(F.max(ended).over(w).cast("decimal(38,0)"), F.element_at(F.array(*carried), F.col("_p") + 1))
    return both.withColumn("previous", previous).where("gap").select("id", "path", "number", "previous")


def sequential_numbering(g: Graph) -> Outcome:
    blocks = [(numbered(g, b), b) for b in g.settings.naming if b.get("sequential")]
    bad = [_found(number_gaps(r), "sequential_numbering", "warning", glob=F.lit(b["glob"]), number=F.col("number"), previous=F.col("previous")) for r, b in blocks]
    return Outcome(_union(bad, g), _count(_paths(blocks, g)))


def unique_numbering(g: Graph) -> Outcome:
    blocks = [(numbered(g, b), b) for b in g.settings.naming if b.get("unique")]
    bad = []
    for r, b in blocks:
        twice = r.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("id", "path"))).alias("all")).where("size(all) > 1")
        rows = twice.select(F.col("all")[0]["id"].alias("id"), F.col("all")[0]["path"].alias("path"), "number", F.col("all.id").alias("ids"))
        bad.append(_found(rows, "unique_numbering", "error", glob=F.lit(b["glob"]), number=F.col("number"), ids=F.col("ids")))
    return Outcome(_union(bad, g), _count(_paths(blocks, g)))


def _added(g: Graph, delta, blocks) -> DataFrame:
    """Documents that a block selects but that weren't there before: nothing to compare them with."""
    out = g.nodes.select("path").where(F.lit(False))
    new = g.nodes.join(delta.before.nodes.select("id"), "id", "left_anti")
    for b in blocks:
        out = out.union((new.where(F.col("kind").isin(*b["kinds"])) if b.get("kinds") else new).select("path"))
    return out


def frontmatter_immutable(g: Graph, delta) -> Outcome:
    """Fields locked once a document's status was terminal before the change."""
    bad, judged = [], []
    for b in g.settings.frontmatter_immutable:
        was = delta.before.nodes.where(F.col("status").isin(*g.settings.terminal))
        if b.get("kinds"):
            was = was.where(F.col("kind").isin(*b["kinds"]))
        was = was.join(g.nodes.select("id"), "id", "left_semi").select("id", "path")
        changed = delta.field_changes().where(F.col("field").isin(*b["fields"])).select("id", "field")
        moved = delta.status_transitions().select("id", F.lit("status").alias("field"))
        bad.append(_found(changed.union(moved).distinct().join(was, "id"), f"frontmatter_immutable/{b['name']}", "error", field=F.col("field")))
        judged.append((was, b))
    return Outcome(_union(bad, g), _count(_paths(judged, g)), None, _count(_added(g, delta, g.settings.frontmatter_immutable)))


def body_immutable(g: Graph, delta) -> Outcome:
    """Bodies frozen, or open to additions at the end alone, from creation or from a terminal status on."""
    bad, judged = [], []
    for b in g.settings.body_immutable:
        was = delta.before.nodes
        if b.get("trigger", "terminal") == "terminal":
            was = was.where(F.col("status").isin(*g.settings.terminal))
        if b.get("kinds"):
            was = was.where(F.col("kind").isin(*b["kinds"]))
        both = was.select("id", "path", F.col("body_hash").alias("h0"), F.col("body_lines_hash").alias("l0")).join(g.nodes.select("id", F.col("body_hash").alias("h1"), F.col("body_lines_hash").alias("l1")), "id")
        changed = ~F.col("h0").eqNullSafe(F.col("h1"))
        if b.get("mode") == "append_only":
            changed = changed & ~begins_with(F.col("l1"), F.col("l0"))
        bad.append(_found(both.where(changed), f"body_immutable/{b['name']}", "error", mode=F.lit(b.get("mode", "frozen"))))
        judged.append((both, b))
    return Outcome(_union(bad, g), _count(_paths(judged, g)), None, _count(_added(g, delta, g.settings.body_immutable)))


def body_line(g: Graph) -> Outcome:
    bad, judged = [], []
    for b in g.settings.body_lines:
        nodes = g.nodes.where(F.col("kind").isin(*b["kinds"])) if b.get("kinds") else g.nodes
        rows = g.body_lines.where(F.col("name") == b["name"]).select(F.col("source").alias("id"), "line", F.col("captures")[b["capture"]].alias("value")).join(nodes.select("id", "path"), "id")
        bad.append(_found(rows.where(~F.col("value").isin(*b["allowed"])), f"body_line/{b['name']}", "error", line=F.col("line"), value=F.col("value")))
        judged.append((nodes, b))
    return Outcome(_union(bad, g), _count(_paths(judged, g)))


def _matching(glob: str):
    return lambda x: matches_glob(x, glob)


def unresolved_edges(g: Graph) -> DataFrame:
    """Edges without a target, their cause refined by what exists, with the severity of the first policy row that admits them."""
    from quillgraph.plans.resolve import candidates_of

    rows = g.edges.where("target_id IS NULL").join(g.nodes.select(F.col("id").alias("source"), F.col("path").alias("source_path")), "source", "left")
    rows = candidates_of(rows, g.settings.extensions).withColumn("_u", F.monotonically_increasing_id())
    cause = F.col("cause")
    if g.files is not None or g.parse_failures is not None:
        sought = rows.where("cause = 'missing'").select("_u", "relation", F.explode("sought").alias("path"))
        flags = sought
        failed = g.parse_failures.select("path", F.lit(True).alias("failed")).distinct() if g.parse_failures is not None else sought.select("path", F.lit(True).alias("failed")).where(F.lit(False))
        there = g.files.select("path", "is_dir").distinct() if g.files is not None else sought.select("path", F.lit(False).alias("is_dir")).where(F.lit(False))
        flags = flags.join(failed, "path", "left").join(there, "path", "left")
        flags = flags.groupBy("_u").agg(F.max(F.coalesce("failed", F.lit(False))).alias("failed"), F.max(F.coalesce(~F.col("is_dir") | (F.col("relation") == "covers"), F.lit(False))).alias("there"))
        rows = rows.join(flags, "_u", "left")
        cause = F.when((cause == "missing") & F.col("failed"), "target_unparsed").when((cause == "missing") & F.col("there"), "excluded_from_scope").otherwise(cause)
    rows = rows.withColumn("cause", cause)
    severity, name = F.lit(None), F.lit(None)
    for policy, of, level, relations, glob in reversed(g.settings.unresolved_policy):
        at = F.col("cause") == of
        if relations:
            at = at & F.col("relation").isin(*relations)
        if glob:
            at = at & F.exists("sought", _matching(glob))
        severity, name = F.when(at, level).otherwise(severity), F.when(at, policy).otherwise(name)
    return rows.select("source", "source_path", "relation", F.col("target_raw").alias("raw_target"), "cause", "location", F.coalesce(severity, F.lit("warning")).alias("severity"), name.cast("string").alias("policy_name")).orderBy("source", "relation", "raw_target")


def unresolved_reference(g: Graph) -> Outcome:
    rows = unresolved_edges(g)
    bad = rows.where("severity = 'error'")
    found = bad.select(F.concat(F.lit("unresolved_reference/"), "policy_name").alias("rule_id"), "severity", F.col("source").alias("node_id"), F.col("source_path").alias("path"), _details(relation=F.col("relation"), target=F.col("raw_target"), cause=F.col("cause")).alias("details"))
    return Outcome(found, _count(rows))


def acyclic_relation(g: Graph) -> Outcome:
    bad = [_found(cyclic_members(g, r).join(g.nodes.select("id", "path"), "id"), "acyclic_relation", "error", relation=F.lit(r), region=F.col("region"), via=F.col("via")) for r in g.settings.acyclic_relations]
    return Outcome(_union(bad, g), _count(g.edges.where(F.col("relation").isin(*g.settings.acyclic_relations) & F.col("target_id").isNotNull())))


#: Rule name, function, whether a graph registers it, whether it needs a delta.
REGISTRY: list[tuple[str, Callable, Callable[[Graph], bool], bool]] = [
    ("parse_failure", parse_failure, lambda g: True, False),
    ("field_parse", field_parse, lambda g: True, False),
    ("required_field", required_field, lambda g: True, False),
    ("field_type", field_type, lambda g: True, False),
    ("field_enum", field_enum, lambda g: True, False),
    ("cross_field", cross_field, lambda g: True, False),
    ("unknown_field", unknown_field, lambda g: g.settings.strict, False),
    ("explicit_field", explicit_field, lambda g: bool(g.settings.require_explicit), False),
    ("stale_review", stale_review, lambda g: True, False),
    ("orphan", orphan, lambda g: True, False),
    ("git_drift", git_drift, lambda g: g.settings.drift_threshold is not None and g.commits is not None, False),
    ("filename_pattern", filename_pattern, lambda g: any(b.get("pattern") for b in g.settings.naming), False),
    ("sequential_numbering", sequential_numbering, lambda g: any(b.get("sequential") for b in g.settings.naming), False),
    ("unique_numbering", unique_numbering, lambda g: any(b.get("unique") for b in g.settings.naming), False),
    ("frontmatter_immutable", frontmatter_immutable, lambda g: bool(g.settings.frontmatter_immutable), True),
    ("body_immutable", body_immutable, lambda g: bool(g.settings.body_immutable), True),
    ("body_line", body_line, lambda g: bool(g.settings.body_lines) and g.body_lines is not None, False),
    ("unresolved_reference", unresolved_reference, lambda g: any(p[2] == "error" for p in g.settings.unresolved_policy), False),
    ("acyclic_relation", acyclic_relation, lambda g: True, False),
]


def _narrowed(name: str, findings: DataFrame, delta) -> DataFrame:
    """Findings that a change answers for: about no document or one it touched; an orphan also by its links."""
    ids = delta.touched()
    if name == "orphan":
        ids = ids.union(delta.relinked())
    ids = ids.select(F.col("id").alias("node_id")).distinct()
    return findings.join(ids, "node_id", "left_semi").select(*FINDING).union(findings.where("node_id IS NULL").select(*FINDING))


def check(g: Graph, delta=None, narrow: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """All findings, coverage (rule_id, subjects, unjudged), and the names of rules that could not run.

    ``narrow`` leaves the findings that the delta answers for; coverage stays whole.
    """
    found, covered, skipped = [], [], []
    for name, rule, registered, on_change in REGISTRY:
        if not registered(g):
            continue
        if on_change and delta is None:
            skipped.append(name)
            continue
        out = rule(g, delta) if on_change else rule(g)
        if out.skipped:
            skipped.append(name)
            continue
        found.append(_narrowed(name, out.findings, delta) if narrow and delta is not None else out.findings)
        none = out.subjects.select(F.lit(0).cast("long").alias("u"))
        unjudged = none if out.unjudged is None else out.unjudged.select(F.col("n").cast("long").alias("u"))
        covered.append(out.subjects.select(F.lit(name).alias("rule_id"), F.col("n").cast("long").alias("subjects")).join(F.broadcast(unjudged)))  # one row
    coverage = covered[0]
    for c in covered[1:]:
        coverage = coverage.union(c)
    return _union(found, g).orderBy("rule_id", F.col("node_id").asc_nulls_first(), "details"), coverage.select("rule_id", "subjects", F.col("u").alias("unjudged")).orderBy("rule_id"), skipped


def introduced(after: DataFrame, before: DataFrame) -> DataFrame:
    """Findings beyond those that were there before, each counted as often as it occurs."""
    key = ["rule_id", "severity", "node_id", "cause"]
    cause = F.regexp_replace("details", r',?"evidence":\{[^{}]*\}', "")  # evidence says where things stand, not which finding it is
    after, before = after.withColumn("cause", cause), before.withColumn("cause", cause)
    number = F.row_number().over(Window.partitionBy(*key).orderBy("path"))
    had = before.groupBy(*key).agg(F.count("*").alias("had"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    rows = after.withColumn("nth", number).alias("a").join(had.alias("b"), same, "left").where("nth > coalesce(had, 0)")
    return rows.select(*[F.col(f"a.{c}") for c in FINDING])


def proposed(before: Graph, after: Graph, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a proposal adds: findings introduced, warnings that stand on the proposed documents, and each path's verdict."""
    now = check(after)[0]
    new = introduced(now, check(before)[0])
    scope = after.nodes.select("path")
    if after.parse_failures is not None:
        scope = scope.union(after.parse_failures.select("path"))
    asked = after.nodes.sparkSession.createDataFrame([(p,) for p in paths], "path string")
    standing = now.where("severity = 'warning'").join(F.broadcast(asked), "path", "left_semi").select(*FINDING)  # the paths of one proposal
    bad = new.where("severity = 'error'").select("path", F.lit(True).alias("bad")).distinct()
    verdicts = asked.join(scope.distinct().withColumn("there", F.lit(True)), "path", "left").join(bad, "path", "left")
    return new, standing, verdicts.select("path", F.coalesce("there", F.lit(False)).alias("in_scope"), F.coalesce("bad", F.lit(False)).alias("has_path_errors")).orderBy("path")


def issues(g: Graph, delta=None) -> DataFrame:
    """category and count: findings by rule, unresolved edges that warn, and informative ones by policy."""
    findings, _, _ = check(g, delta)
    loose = unresolved_edges(g)
    rows = findings.select(F.concat(F.lit("violation_"), "rule_id").alias("category"))
    rows = rows.union(loose.where("severity = 'warning'").select(F.lit("unresolved_edge"))).union(loose.where("severity = 'info'").select("policy_name"))
    return rows.groupBy("category").agg(F.count("*").alias("count"))
