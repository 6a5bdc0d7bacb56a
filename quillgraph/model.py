"""The document graph as DataFrames, and the settings that its questions depend on."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DateType, IntegerType, LongType, MapType, StringType, StructField, StructType

_S, _L = StringType(), ArrayType(StringType())

NODES = StructType(
    [StructField(c, _S) for c in ("id", "path", "title", "kind", "status")]
    + [StructField(c, DateType()) for c in ("created", "updated", "reviewed")]
    + [StructField("owner", _S), StructField("supersedes", _L), StructField("superseded_by", _S)]
    + [StructField(c, _L) for c in ("implements", "related", "tags", "covers")]
    + [StructField("orphan_ok", BooleanType()), StructField("attrs", MapType(_S, _S)), StructField("body_hash", _S), StructField("body_lines_hash", _L), StructField("content_hash", _S)]
    + [StructField("parse_issues", ArrayType(StructType([StructField(c, _S) for c in ("field", "expected", "found")]))), StructField("inferred_fields", _L)]
)
EDGES = StructType([StructField("edge_idx", LongType())] + [StructField(c, _S) for c in ("source", "target_id", "target_raw", "cause", "relation", "location")])
ANNOTATIONS = StructType([StructField(c, _S) for c in ("source", "name", "key")] + [StructField("line", IntegerType())])
BODY_LINES = StructType([StructField("source", _S), StructField("name", _S), StructField("line", IntegerType()), StructField("captures", MapType(_S, _S))])
PARSE_FAILURES = StructType([StructField(c, _S) for c in ("path", "message", "content_hash")])

#: Identity columns that most answers begin with.
REF = ("id", "title", "kind", "status", "path")
SCALARS = ("id", "title", "kind", "status", "created", "updated", "reviewed", "owner", "superseded_by", "orphan_ok")
LISTS = ("supersedes", "implements", "related", "tags", "covers")
#: The words that titles are compared without, unless a project says otherwise.
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "for", "in", "on", "with", "is", "are", "be", "by", "as", "at", "from")


@dataclass(frozen=True)
class Settings:
    """What a project declares; a missing limit turns its check off."""

    today: dt.date
    kinds: tuple[str, ...] = ("generic", "guide", "readme")
    statuses: tuple[str, ...] = ("active", "superseded", "archived", "deprecated", "abandoned")
    terminal: tuple[str, ...] = ("superseded", "archived", "deprecated", "abandoned")
    initial: str | None = None
    stale_days: int | None = None
    orphan_grace_days: int = 14
    orphan_ok_kinds: tuple[str, ...] = ()
    drift_threshold: int | None = None
    drift_relations: tuple[str, ...] = ("references", "implements", "covers")
    #: (name, cause, severity, relations, glob): the first row that admits an unresolved edge decides.
    unresolved_policy: tuple[tuple[str, str, str, tuple[str, ...], str | None], ...] = (("excluded_target", "excluded_from_scope", "info", (), None),)
    acyclic_relations: tuple[str, ...] = ("implements",)
    trust_weights: dict[str, float] = field(default_factory=lambda: {"status": 0.4, "freshness": 0.3, "drift": 0.2, "backlinks": 0.1})
    trust_by_kind: dict[str, dict[str, float]] = field(default_factory=dict)
    similarity_weights: dict[str, float] = field(default_factory=lambda: {"title": 0.4, "tags": 0.2, "kind": 0.1, "directory": 0.1, "linked": 0.2})
    similarity_limit: int = 10
    stop_words: tuple[str, ...] = STOP_WORDS
    search_weights: dict[str, float] = field(default_factory=lambda: {"id_exact": 3.0, "id_partial": 1.5, "title_exact": 2.5, "title_partial": 1.0, "tag": 0.5})
    extensions: tuple[str, ...] = (".md",)
    required: tuple[str, ...] = ()
    types: dict[str, str] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: (when, field): the field must be there where the predicate holds.
    cross_field: tuple[tuple[str, str], ...] = ()
    #: Overrides by kind: each (kinds, {required, types, enums, cross_field}); the first whose kinds hold the kind adds to the above.
    overrides: tuple[tuple[tuple[str, ...], dict], ...] = ()
    strict: bool = False
    require_explicit: tuple[str, ...] = ()
    #: Blocks: glob, optional pattern, sequential, unique.
    naming: tuple[dict, ...] = ()
    #: Blocks: name, kinds, fields (frontmatter) or mode and trigger (body).
    frontmatter_immutable: tuple[dict, ...] = ()
    body_immutable: tuple[dict, ...] = ()
    #: Blocks: name, capture, allowed, kinds.
    body_lines: tuple[dict, ...] = ()
    god_limit: int = 10
    orphan_limit: int = 20
    stale_limit: int = 20


@dataclass(frozen=True)
class Graph:
    """The five relations; ``files`` (path, is_dir) is what exists, ``commits`` (path, date) what changed, where known."""

    nodes: DataFrame
    edges: DataFrame
    settings: Settings
    annotations: DataFrame | None = None
    body_lines: DataFrame | None = None
    parse_failures: DataFrame | None = None
    files: DataFrame | None = None
    commits: DataFrame | None = None

    @property
    def external(self) -> DataFrame:
        """Resolved edges between different documents."""
        return self.edges.where("target_id IS NOT NULL AND source <> target_id")
