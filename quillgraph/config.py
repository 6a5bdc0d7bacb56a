"""Project files (TOML) to settings and reading rules; what can't be meant is refused by name."""

from __future__ import annotations

import datetime as dt
import re
import tomllib
from dataclasses import dataclass

from quillgraph.functions.columns import predicate
from quillgraph.model import Settings
from quillgraph.operators import rules as checks
from quillgraph.plans.parse import Rules


class ConfigError(ValueError):
    """A setting that is unknown, of the wrong type, or at odds with another."""


@dataclass(frozen=True)
class Project:
    settings: Settings
    rules: Rules
    include: tuple[str, ...]
    exclude: tuple[str, ...]
    conditional_exclude: tuple[tuple[str, str], ...]
    output: str


SECTIONS = {
    "scope": {"include", "exclude", "conditional_exclude"},
    "kinds": {"allowed"},
    "statuses": {"allowed", "terminal", "initial"},
    "identity": {"id_rules", "kind_rules"},
    "schema": {"required", "types", "enums", "cross_field", "overrides", "require_explicit", "mode"},
    "detection": {"stale_days", "orphan_grace_days", "orphan_ok_kinds", "git_drift_threshold", "git_drift_relations", "unresolved_policy"},
    "rules": {"acyclic_relations", "naming", "frontmatter_immutable", "body_immutable", "body_line"},
    "trust": {"weights", "kinds"},
    "similarity": {"weights", "limit", "title_stop_words"},
    "search": {"weights"},
    "parser": {"extensions", "wikilinks", "link_patterns"},
    "report": {"god_node_display_limit", "orphan_display_limit", "stale_display_limit"},
    "output": {"dir"},
    "annotations": None,
}
CAUSES = ("id_not_found", "missing", "target_unparsed", "excluded_from_scope", "escapes_source", "absolute")


def _refuse(test: bool, why: str) -> None:
    if test:
        raise ConfigError(why)


def _regex(pattern: str) -> re.Pattern:
    _refuse(bool(re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern)), f"look-around and back-references are not supported: {pattern!r}")
    try:
        return re.compile(pattern)
    except re.error as e:
        raise ConfigError(f"not a pattern: {pattern!r}: {e}") from None


def load(text: str, today: dt.date) -> Project:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from None
    for section, values in raw.items():
        _refuse(section not in SECTIONS, f"unknown section {section!r}")
        if SECTIONS[section] is not None:
            for key in values:
                _refuse(key not in SECTIONS[section], f"unknown key {section}.{key}")
    get = lambda section, key, default=None: raw.get(section, {}).get(key, default)
    base = Settings(today)
    kinds = tuple(get("kinds", "allowed", base.kinds))
    statuses = tuple(get("statuses", "allowed", base.statuses))
    terminal = tuple(get("statuses", "terminal", [s for s in base.terminal if s in statuses]))
    _refuse("generic" not in kinds, "kinds.allowed must hold generic, the kind of files that match no rule")
    _refuse(not statuses or not set(terminal) <= set(statuses), "statuses.terminal must be among statuses.allowed")
    initial = get("statuses", "initial", statuses[0])
    _refuse(initial not in statuses, f"statuses.initial {initial!r} is not allowed")
    for name in ("stale_days", "orphan_grace_days", "git_drift_threshold"):
        value = get("detection", name)
        _refuse(value is not None and (not isinstance(value, int) or value < 0), f"detection.{name} must be a whole number")
    pairs = tuple((c["when"], c["require"]) for c in get("schema", "cross_field", []))
    for when, _ in pairs:
        try:
            predicate_of(when)
        except ValueError as e:
            raise ConfigError(str(e)) from None
    types = dict(get("schema", "types", {}))
    _refuse(not set(types.values()) <= {"string", "integer", "bool", "date"}, "schema.types knows string, integer, bool and date")
    policy = tuple((p["name"], p["cause"], p.get("severity", "warning"), tuple(p.get("relations", ())), p.get("glob")) for p in get("detection", "unresolved_policy", [])) or base.unresolved_policy
    for name, cause, severity, _, glob in policy:
        _refuse(cause not in CAUSES, f"policy {name!r}: unknown cause {cause!r}")
        _refuse(severity not in ("info", "warning", "error"), f"policy {name!r}: unknown severity {severity!r}")
        _refuse(glob is not None and cause in ("absolute", "escapes_source"), f"policy {name!r}: nothing was looked up for {cause}, so no glob can match")
    weights = {}
    for section, default in (("trust", base.trust_weights), ("similarity", base.similarity_weights), ("search", base.search_weights)):
        own = get(section, "weights", {})
        _refuse(not set(own) <= set(default), f"unknown weight in {section}.weights")
        _refuse(any(not isinstance(x, (int, float)) or not 0 <= x < float("inf") for x in own.values()), f"{section}.weights must be finite and not negative")
        weights[section] = {**default, **{k: float(v) for k, v in own.items()}}
    patterns = []
    for p in get("parser", "link_patterns", []):
        _refuse(_regex(p["pattern"]).groups != 1, f"link pattern {p['pattern']!r} must have one group")
        _refuse(p["relation"] in ("supersedes", "superseded_by", "implements", "related", "covers"), f"relation {p['relation']!r} belongs to the frontmatter")
        patterns.append((p["pattern"], p["relation"], bool(p.get("code_spans"))))
    marks = []
    for a in raw.get("annotations", []):
        _refuse(a["key"] not in _regex(a["pattern"]).groupindex, f"annotation {a['name']!r}: no group {a['key']!r}")
        marks.append((a["name"], a["pattern"], a["key"], tuple(a.get("kinds", ()))))
    lines, blocks = [], tuple(get("rules", "body_line", []))
    for b in blocks:
        _refuse(b["capture"] not in _regex(b["pattern"]).groupindex, f"body_line {b['name']!r}: no group {b['capture']!r}")
        lines.append((b["name"], b["pattern"], tuple(b.get("kinds", ()))))
    for b in get("rules", "naming", []):
        if b.get("pattern"):
            _regex(b["pattern"])
    settings = Settings(
        today=today,
        kinds=kinds,
        statuses=statuses,
        terminal=terminal,
        initial=initial,
        stale_days=get("detection", "stale_days"),
        orphan_grace_days=get("detection", "orphan_grace_days", base.orphan_grace_days),
        orphan_ok_kinds=tuple(get("detection", "orphan_ok_kinds", ())),
        drift_threshold=get("detection", "git_drift_threshold"),
        drift_relations=tuple(get("detection", "git_drift_relations", base.drift_relations)),
        unresolved_policy=policy,
        acyclic_relations=tuple(get("rules", "acyclic_relations", base.acyclic_relations)),
        trust_weights=weights["trust"],
        trust_by_kind={k: {n: float(x) for n, x in v.items()} for k, v in get("trust", "kinds", {}).items()},
        similarity_weights=weights["similarity"],
        similarity_limit=get("similarity", "limit", base.similarity_limit),
        stop_words=tuple(get("similarity", "title_stop_words", base.stop_words)),
        search_weights=weights["search"],
        extensions=tuple(get("parser", "extensions", base.extensions)),
        required=tuple(get("schema", "required", ())),
        types=types,
        enums={k: tuple(v) for k, v in get("schema", "enums", {}).items()},
        cross_field=pairs,
        overrides=tuple((tuple(o["kinds"]), {k: tuple((c["when"], c["require"]) for c in v) if k == "cross_field" else {n: tuple(x) for n, x in v.items()} if k == "enums" else v for k, v in o.items() if k != "kinds"}) for o in get("schema", "overrides", [])),
        strict=get("schema", "mode", "lenient") == "strict",
        require_explicit=tuple(get("schema", "require_explicit", ())),
        naming=tuple(get("rules", "naming", ())),
        frontmatter_immutable=tuple(get("rules", "frontmatter_immutable", ())),
        body_immutable=tuple(get("rules", "body_immutable", ())),
        body_lines=blocks,
        god_limit=get("report", "god_node_display_limit", base.god_limit),
        orphan_limit=get("report", "orphan_display_limit", base.orphan_limit),
        stale_limit=get("report", "stale_display_limit", base.stale_limit),
    )
    _refuse(not set(settings.orphan_ok_kinds) <= set(kinds), "detection.orphan_ok_kinds must be among kinds.allowed")
    rules = Rules(
        kind_rules=tuple((r["glob"], r["kind"]) for r in get("identity", "kind_rules", [])),
        id_rules=tuple((r.get("kind", "*"), r.get("glob", "**"), r["template"]) for r in get("identity", "id_rules", [])),
        initial_status=initial,
        extensions=settings.extensions,
        wikilinks=bool(get("parser", "wikilinks", False)),
        link_patterns=tuple(patterns),
        annotations=tuple(marks),
        body_lines=tuple(lines),
    )
    _refuse(not {k for _, k in rules.kind_rules} <= set(kinds), "identity.kind_rules name a kind that is not allowed")
    output = get("output", "dir", "_index")
    excluded = (*get("scope", "exclude", ()), f"{output}/**")
    closed = tuple((c["parent_glob"], c["child_glob"]) for c in get("scope", "conditional_exclude", []))
    return Project(settings, rules, tuple(get("scope", "include", ("**/*.md",))), excluded, closed, output)


_SHAPE = re.compile(r"\w+\s+(?:exists|not_exists)|\w+\s+in\s+\[.*\]|\w+\s*={1,2}\s*.+")


def predicate_of(text: str) -> str:
    """The predicate, if it is one; needs no session."""
    if not _SHAPE.fullmatch(text.strip()):
        raise ValueError(f"not a predicate: {text!r}")
    return text


def manifest(project: Project) -> dict:
    """Everything that was resolved, for export."""
    s = project.settings
    return {
        "kinds": list(s.kinds),
        "statuses": {"allowed": list(s.statuses), "terminal": list(s.terminal), "initial": s.initial},
        "enums": {"kind": list(s.kinds), "status": list(s.statuses)} | {k: list(v) for k, v in s.enums.items()},
        "rules": [name for name, _, _, _ in checks.REGISTRY],
        "scope": {"include": list(project.include), "exclude": list(project.exclude)},
        "weights": {"trust": s.trust_weights, "similarity": s.similarity_weights, "search": s.search_weights},
    }


def frontmatter_schema(project: Project) -> dict:
    """JSON Schema of the frontmatter, one branch for each group of kinds that overrides the rest."""
    s = project.settings

    def branch(kinds, required, types, enums) -> dict:
        shape = {"string": {"type": "string"}, "integer": {"type": "integer"}, "bool": {"type": "boolean"}, "date": {"type": "string", "format": "date"}}
        props = {k: {"type": "string"} for k in ("id", "title", "owner", "superseded_by")} | {k: shape["date"] for k in ("created", "updated", "reviewed")}
        props |= {k: {"type": "array", "items": {"type": "string"}} for k in ("supersedes", "implements", "related", "tags", "covers")} | {"orphan_ok": {"type": "boolean"}}
        props |= {"kind": {"enum": list(kinds)}, "status": {"enum": list(s.statuses)}} | {k: shape[t] for k, t in types.items()} | {k: {"enum": list(v)} for k, v in enums.items() if k != "kind"}
        return {"type": "object", "properties": props, "required": sorted(required), "additionalProperties": not s.strict}

    taken, branches = set(), []
    for kinds, more in s.overrides:
        own = [k for k in kinds if k not in taken]
        taken |= set(own)
        branches.append(branch(own, {*s.required, *more.get("required", ())}, {**s.types, **more.get("types", {})}, {**s.enums, **more.get("enums", {})}))
    rest = branch([k for k in s.kinds if k not in taken], s.required, s.types, s.enums)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **({"oneOf": [*branches, rest]} if branches else rest)}
