"""Command line: answers as one JSON envelope, ``{"ok": true, "data": ..., "warnings": ...}`` or ``{"ok": false, "error": ...}``."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import math
import os
import sys

from quillgraph import mutate
from quillgraph.config import ConfigError, frontmatter_schema, load, manifest

CONFIG = "quillgraph.toml"
EXITS = {0: "no finding of severity error", 1: "findings of severity error", 2: "the command failed"}
ERRORS = ("CONFIG", "CYCLE", "DUPLICATE_ID", "EXISTS", "FAILED", "GATE", "NOT_FOUND", "NO_FRONTMATTER", "OUTSIDE_ROOT", "SNAPSHOT", "TRANSITION", "USAGE")
WARNINGS = ("evicted", "scope_coverage", "similar_document", "unscored")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise mutate.Refused("USAGE", message)


def _csv(text: str) -> tuple[str, ...]:
    out = tuple(x.strip() for x in text.split(","))
    if not all(out):
        raise mutate.Refused("USAGE", f"an empty entry in {text!r}")
    return out


def _count(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def _unit(text: str) -> float:
    x = float(text)
    if not math.isfinite(x) or not 0 <= x <= 1:
        raise argparse.ArgumentTypeError("must be from 0 to 1")
    return x


def _equality(text: str) -> tuple[str, str]:
    name, mark, value = text.partition("=")
    if not mark or not name:
        raise argparse.ArgumentTypeError("must be field=value")
    return name, value


#: Arguments of each query: (flags, options of add_argument).
_LIMIT = (("--limit",), {"type": _count})
_ID = (("value",), {})
_KIND, _STATUS, _RELATIONS = (("--kind",), {"type": _csv, "default": ()}), (("--status",), {"type": _csv, "default": ()}), (("--relations",), {"type": _csv, "default": ()})
LEAVES = {
    "search": [(("value",), {"nargs": "?", "default": ""}), _STATUS, _LIMIT],
    "nodes": [_KIND, _STATUS, (("--tag",), {"type": _csv, "default": ()}), (("--all-tags",), {"action": "store_true"}), (("--where",), {"type": _equality, "action": "append", "default": []}), (("--fields",), {"type": _csv, "default": ()}), _LIMIT],
    "backlinks": [_ID],
    "chain": [_ID],
    "node": [(("value",), {"nargs": "?"}), (("--path",), {}), (("--with-body",), {"action": "store_true"})],
    "covered-by": [_ID],
    "orphans": [_LIMIT],
    "stale": [_LIMIT],
    "recent": [(("--days",), {"type": _count, "default": 7}), (("--since",), {"type": dt.date.fromisoformat}), (("--field",), {"choices": ("created", "updated", "reviewed")}), (("--kind",), {}), (("--limit",), {"type": _count, "default": 20})],
    "similar": [(("--id",), {"dest": "value"}), (("--title",), {}), (("--tags",), {"type": _csv, "default": ()}), (("--kind",), {}), (("--path",), {}), _LIMIT, (("--min-score",), {"type": _unit})],
    "trust": [(("value",), {"nargs": "?"}), (("--top",), {"type": _count}), (("--bottom",), {"type": _count}), _KIND, _STATUS, (("--below",), {"type": _unit})],
    "components": [_RELATIONS],
    "neighborhood": [_ID, (("--depth",), {"type": _count, "default": 1})],
    "dependents": [_ID, (("--depth",), {"type": _count}), _RELATIONS],
    "annotations": [(("--name",), {}), (("--min-count",), {"type": _count, "default": 1}), (("--with-frontmatter",), {"type": _csv, "default": ()})],
    "issues": [],
}


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="quillgraph")
    p.add_argument("--root", default=".")
    p.add_argument("--today", type=dt.date.fromisoformat, default=None)
    sub = p.add_subparsers(dest="command", required=True, parser_class=_Parser)
    for name in ("build", "status", "report", "init"):
        sub.add_parser(name)
    c = sub.add_parser("check")
    c.add_argument("--since", help="a git ref: findings that the change since then answers for")
    c.add_argument("--severity", choices=("error", "warning", "info"))
    c.add_argument("--content", action="append", default=[], metavar="PATH=FILE", help="a proposed document; FILE may be -, the standard input")
    leaves = sub.add_parser("query").add_subparsers(dest="leaf", required=True, parser_class=_Parser)
    for leaf, args in LEAVES.items():
        q = leaves.add_parser(leaf)
        for flags, options in args:
            q.add_argument(*flags, **options)
    for name in ("diff", "impact"):
        d = sub.add_parser(name)
        d.add_argument("before")
        d.add_argument("after", nargs="?", default="HEAD")
        if name == "impact":
            d.add_argument("--depth", type=_count)
            d.add_argument("--relations", type=_csv, default=())
    e = sub.add_parser("export")
    e.add_argument("what", choices=("schema", "enums", "rules", "config", "commands", "diagnostics", "envelope"))
    m = sub.add_parser("migrate")
    m.add_argument("--apply", action="store_true")
    for name, extra in (("rename", ("old", "new")), ("retarget", ("old", "new")), ("scaffold", ("kind", "title")), ("lifecycle", ("action", "path"))):
        c = sub.add_parser(name)
        for x in extra:
            c.add_argument(x)
        if name == "lifecycle":
            c.add_argument("value", nargs="?")
        c.add_argument("--dry-run", action="store_true")
        c.add_argument("--baseline", help="a git ref whose locked records must stay as they were")
    return p


def grammar() -> dict:
    """Commands and what each takes, as the parser has it."""

    def of(p) -> dict:
        subs = [a for a in p._actions if isinstance(a, argparse._SubParsersAction)]
        own = [{"name": a.option_strings[-1] if a.option_strings else a.dest, "required": a.required} | ({"choices": list(a.choices)} if a.choices else {}) for a in p._actions if not isinstance(a, (argparse._SubParsersAction, argparse._HelpAction))]
        return {"arguments": own} | ({"commands": {k: of(v) for s in subs for k, v in s.choices.items()}} if subs else {})

    return of(parser())


class Session:
    """A project on disk, and the graphs of its files as they are, were, or would be."""

    def __init__(self, spark, root: str, project):
        self.spark, self.root, self.project = spark, os.path.abspath(root), project
        self.out = os.path.join(self.root, project.output)
        self.reused = 0

    def files(self, root: str | None = None):
        from quillgraph.sources.files import one_name_each, real_paths, scan

        at = root or self.root
        return one_name_each(scan(self.spark, at, self.project.include, self.project.exclude), real_paths(self.spark, at))

    def graph(self, files, cache: bool = False, root: str | None = None):
        from quillgraph.operators.walks import _cut
        from quillgraph.plans.build import ParseCache, assemble, config_hash, parse_files
        from quillgraph.sources.files import conditional_exclude, git_commits, listed

        p = self.project
        if cache:
            key = config_hash(p.rules, p.include, p.exclude, p.conditional_exclude)
            parsed, self.reused = ParseCache(self.spark, f"{self.out}/cache", key).parse(files, p.rules)
        else:
            parsed = _cut(parse_files(files, p.rules))
        for parent, child in p.conditional_exclude:
            parsed = conditional_exclude(parsed, parsed.selectExpr("path", "node.status AS status"), parent, child, p.settings.terminal)
        commits = git_commits(self.spark, self.root) if p.settings.drift_threshold is not None else None
        return assemble(parsed, p.settings, listed(self.spark, root or self.root), commits)

    def at(self, ref: str):
        from quillgraph.sources.files import git_ref

        root = git_ref(self.root, ref)
        return self.graph(self.files(root), root=root)

    def proposed(self, files, rows: list[tuple[str, str | None]]):
        from quillgraph.sources.files import overlay

        return overlay(files, self.spark.createDataFrame(rows, "path string, content string"))


def _rows(df, limit: int | None = None) -> dict:
    items = [json.loads(x) for x in (df if limit is None else df.limit(limit)).toJSON().collect()]
    if limit is None:
        return {"items": items, "total": len(items)}
    return {"items": items, "total": df.count(), "returned": len(items)}


def _known(g, node_id: str | None) -> str:
    if not node_id:
        raise mutate.Refused("USAGE", "an id is needed")
    if not g.nodes.where(g.nodes["id"] == node_id).limit(1).count():
        raise mutate.Refused("NOT_FOUND", node_id)
    return node_id


def _vocabulary(g, args) -> None:
    """Refuses kinds and statuses that the project doesn't have."""
    for name, allowed in (("kind", g.settings.kinds), ("status", g.settings.statuses)):
        asked = getattr(args, name, None) or ()
        for x in (asked,) if isinstance(asked, str) else asked:
            if x not in allowed:
                raise mutate.Refused("USAGE", f"unknown {name} {x!r}")


def frames(g, args):
    """The frame that answers a query, and the display limit that still has to be applied."""
    from quillgraph.operators import lookups, rules, scores, walks

    _vocabulary(g, args)
    leaf, limit = args.leaf, getattr(args, "limit", None)
    if leaf == "search":
        return lookups.search(g, args.value, args.status), limit
    if leaf == "nodes":
        return lookups.listing(g, args.kind, args.status, args.tag, args.all_tags, dict(args.where), args.fields), limit
    if leaf in ("orphans", "stale"):
        return getattr(lookups, leaf)(g), limit
    if leaf == "recent":
        return lookups.recent(g, args.days, args.since, args.field, args.kind, limit), None
    if leaf == "covered-by":
        return lookups.covered_by(g, args.value), None
    if leaf == "annotations":
        return lookups.annotations(g, args.name, args.min_count, args.with_frontmatter), None
    if leaf == "components":
        return walks.components(g, args.relations), None
    if leaf == "issues":
        return rules.issues(g), None
    if leaf == "similar":
        if (args.value is None) == (args.title is None):
            raise mutate.Refused("USAGE", "either --id or --title")
        return scores.similar(g, args.value and _known(g, args.value), args.title, args.tags, args.kind, args.path, limit, args.min_score), None
    if leaf == "trust" and not args.value:
        if args.top and args.bottom:
            raise mutate.Refused("USAGE", "either --top or --bottom")
        return scores.trust_ranking(g, args.top or args.bottom or 10, bool(args.top), args.kind, args.status, args.below), None
    if leaf == "node" and args.path:
        found = lookups.node_detail(g, path=args.path)
        if not found.limit(1).count():
            raise mutate.Refused("NOT_FOUND", args.path)
        return found, None
    key = _known(g, args.value)
    return {
        "trust": lambda: scores.trust(g).where(f"id = '{key.replace(chr(39), chr(39) * 2)}'"),
        "node": lambda: lookups.node_detail(g, key),
        "backlinks": lambda: lookups.backlinks(g, key),
        "chain": lambda: walks.chain(g, key),
        "neighborhood": lambda: walks.neighborhood(g, key, args.depth),
        "dependents": lambda: walks.dependents(g, key, args.depth, args.relations),
    }[leaf](), None


def _issues(g) -> dict:
    """Everything there is to look at, in lists, and its summary."""
    from quillgraph.operators import lookups, rules

    found, coverage, skipped = rules.check(g)
    counts = {r.category: r["count"] for r in rules.issues(g).collect()}
    total = sum(n for k, n in counts.items() if k == "unresolved_edge" or k.startswith("violation_"))
    lists = {"orphans": lookups.orphans(g), "stale": lookups.stale(g), "unresolved_edges": rules.unresolved_edges(g).orderBy("source", "relation", "raw_target"), "violations": found, "rule_coverage": coverage}
    return {k: _rows(v)["items"] for k, v in lists.items()} | {"skipped_rules": skipped, "summary": {"total": total, "by_category": counts}}


def _check(session: Session, args) -> tuple[int, dict]:
    from quillgraph.operators import rules
    from quillgraph.operators.deltas import Delta

    files = session.files()
    extra = {}
    if args.content:
        pairs = [x.partition("=")[::2] for x in args.content]
        rows = [(path, sys.stdin.read() if at == "-" else open(at, encoding="utf-8").read() if at else None) for path, at in pairs]
        before, after = session.graph(files), session.graph(session.proposed(files, rows))
        found, standing, verdicts = rules.proposed(before, after, [p for p, _ in rows])
        extra = {"standing": _rows(standing)["items"], "proposals": _rows(verdicts)["items"]}
    elif args.since:
        g = session.graph(files)
        found, coverage, skipped = rules.check(g, Delta(session.at(args.since), g), narrow=True)
    else:
        found, coverage, skipped = rules.check(session.graph(files))
    errors = found.where("severity = 'error'").limit(1).count() > 0  # the verdict is of all findings, whatever is shown
    data = _rows(found.where(f"severity = '{args.severity}'") if args.severity else found)
    if not args.content:
        extra = {"rule_coverage": {r.rule_id: {"subjects": r.subjects, "unjudged": r.unjudged} for r in coverage.collect()}, "skipped_rules": skipped}
    return int(errors), data | extra | {"has_errors": errors}


def _mutation(session: Session, args, today: dt.date) -> tuple[dict, list[str]]:
    """Plans a change, holds it against the rules as the tree would be, and writes it unless asked not to."""
    from quillgraph.operators import rules, scores
    from quillgraph.operators.deltas import Delta

    project, files, warnings = session.project, session.files(), []
    held = [(r.path, r.content) for r in files.where("content IS NOT NULL").select("path", "content").toLocalIterator()]
    g = session.graph(files)
    dry = getattr(args, "dry_run", False)
    if args.command == "migrate":
        plan, dry = mutate.migrate(project, held), not args.apply
    elif args.command in ("rename", "retarget"):
        plan = getattr(mutate, args.command)(project, held, args.old, args.new)
    elif args.command == "scaffold":
        made = mutate.scaffold(project, args.kind, args.title, {r.id: r.path for r in g.nodes.select("id", "path").toLocalIterator()}, today)
        plan = [(made["path"], made["content"], None)]
        near = scores.similar(g, title=args.title, kind=args.kind, path=made["path"], limit=1, min_score=0.3).first()
        warnings += [f"similar_document: {near.id} ({near.score:.2f})"] if near else []
    else:
        texts = dict(held)
        if args.path not in texts:
            raise mutate.Refused("NOT_FOUND", args.path)
        if args.action == "supersede":
            links = [(r.source, r.target_id) for r in g.edges.where("relation = 'supersedes' AND target_id IS NOT NULL").toLocalIterator()]
            mutate.supersede_safe(links, mutate.read_document(args.path, texts[args.path], project.rules).fields["id"], args.value)
        plan = mutate.lifecycle(project, args.path, texts[args.path], args.action, today, args.value)
    if plan:
        after = session.proposed(files, mutate.overlay_rows(plan))
        new = session.graph(after)
        if args.command != "migrate":
            mutate.gate(rules.introduced(rules.check(new)[0], rules.check(g)[0]))
        if getattr(args, "baseline", None):
            was = session.at(args.baseline)
            locked = lambda x: rules.frontmatter_immutable(x, Delta(was, x)).findings.union(rules.body_immutable(x, Delta(was, x)).findings)
            mutate.gate(rules.introduced(locked(new), locked(g)))
        warnings += [f"evicted: {p}" for p in mutate.evicted(g.nodes, new.nodes, plan)]
    return {"applied": not dry, "paths": [p for p, _, _ in plan] if dry else mutate.commit(session.root, plan), "total": len(plan)}, warnings


def run(args, spark=None) -> tuple[int, dict, list[str]]:
    root, today = args.root, args.today or dt.date.today()
    at = os.path.join(root, CONFIG)
    if args.command == "init":
        if os.path.exists(at):
            raise mutate.Refused("EXISTS", at)
        with open(at, "w", encoding="utf-8") as f:
            f.write('[scope]\ninclude = ["**/*.md"]\n\n[kinds]\nallowed = ["generic", "guide", "readme"]\n\n[detection]\n# stale_days = 180\norphan_grace_days = 14\n')
        return 0, {"written": at}, []
    text = open(at, encoding="utf-8").read() if os.path.exists(at) else ""
    project = load(text, today)
    if args.command == "export" and args.what != "envelope":
        m = manifest(project)
        made = {"schema": lambda: frontmatter_schema(project), "enums": lambda: m["enums"], "rules": lambda: m["rules"], "config": lambda: m, "commands": grammar, "diagnostics": lambda: {"exits": EXITS, "errors": list(ERRORS), "warnings": list(WARNINGS)}}
        return 0, made[args.what](), []
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quillgraph").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    from quillgraph.contract import envelope_schema
    from quillgraph.operators import report
    from quillgraph.operators.deltas import Delta, impact, likely_breaking
    from quillgraph.plans import build

    session = Session(spark, root, project)
    if args.command == "export":
        g = session.graph(session.files().limit(0))
        plain = {"search": ["x"], "similar": ["--title", "x"], "trust": [], "nodes": [], "orphans": [], "stale": [], "recent": [], "covered-by": ["x"], "annotations": [], "components": [], "issues": []}
        return 0, envelope_schema({leaf: frames(g, parser().parse_args(["query", leaf, *more]))[0].schema for leaf, more in plain.items()}), []
    if args.command in ("diff", "impact"):
        d = Delta(session.at(args.before), session.at(args.after))
        if args.command == "impact":
            found = impact(d, args.depth, args.relations)
            return 0, _rows(found.orderBy("root", "hops", "id")) | {"likely_breaking": [r.id for r in likely_breaking(found).collect()]}, []
        return 0, {k: _rows(getattr(d, k)()) for k in ("added_nodes", "removed_nodes", "added_edges", "removed_edges", "status_transitions", "field_changes", "path_changes", "added_annotations", "removed_annotations")}, []
    if args.command == "check":
        return *_check(session, args), []
    if args.command not in ("build", "status", "report", "query"):
        return 0, *_mutation(session, args, today)
    files = session.files()
    if args.command == "status":
        if not os.path.isdir(f"{session.out}/meta"):
            return 0, {"state": "absent"}, []
        try:
            had = build.read_snapshot(spark, session.out, project.settings)
        except ValueError as e:
            return 0, {"state": "schema_mismatch", "message": str(e)}, []
        rows = _rows(build.status(had, files))
        return 0, {"state": "outdated" if rows["total"] else "current", "divergence": rows}, []
    g = session.graph(files, cache=args.command == "build")
    advice = [f"scope_coverage: {x}" for x in build.scope_advisories(files, g.nodes, project.include, project.rules, project.conditional_exclude)]
    if args.command == "build":
        build.write_snapshot(g, session.out)
        stats = {r.measure: r.value for r in build.statistics(g).collect()}
        n = stats["nodes"] + stats.get("parse_failures", 0)
        return 0, stats | {"edges": g.edges.count(), "annotations": g.annotations.count(), "cached": session.reused, "parsed": n - session.reused}, advice
    if args.command == "report":
        os.makedirs(session.out, exist_ok=True)
        build.write_json(g, f"{session.out}/json")
        mutate.commit(session.root, [(f"{project.output}/GRAPH.md", report.markdown(g), None)])
        return 0, {"generated": ["json/nodes.json", "json/edges.json", "GRAPH.md"], "output_dir": session.out}, advice
    if args.leaf == "issues":
        return 0, _issues(g), []
    frame, limit = frames(g, args)
    data = _rows(frame, limit)
    if args.leaf == "node" and args.with_body:
        for item in data["items"]:
            text = files.where(files["path"] == item["path"]).first().content
            item["body"] = mutate.split_frontmatter(mutate.canonical_text(text))[1]
    return 0, data, []


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        code, data, warnings = run(parser().parse_args(argv), spark)
        print(json.dumps({"ok": True, "data": data} | ({"warnings": warnings} if warnings else {}), ensure_ascii=False, default=str))
        return code
    except (mutate.Refused, ConfigError, ValueError, KeyError, OSError) as e:
        code = getattr(e, "code", None) or {"ConfigError": "CONFIG", "DuplicateId": "DUPLICATE_ID", "SupersessionCycle": "CYCLE"}.get(type(e).__name__, "FAILED")
        print(json.dumps({"ok": False, "error": {"code": code, "message": str(e)}}, ensure_ascii=False))
        return 2


if __name__ == "__main__":
    sys.exit(main())
