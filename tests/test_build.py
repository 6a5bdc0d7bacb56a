"""A small project from files to answers."""

import dataclasses
import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.model import Settings
from quillgraph.operators import lookups, report, rules, scores, walks
from quillgraph.operators.deltas import Delta
from quillgraph.plans import build
from quillgraph.plans.parse import ParseError, Rules, code_lines, link_path, read_document, slugify, split_frontmatter
from quillgraph.sources.files import listed, overlay, scan
from quillgraph.streaming.incremental import current, follow


def doc(head: str, body: str = "") -> str:
    return f"---\n{head.strip()}\n---\n{body}"


FILES = {
    "docs/decisions/alpha.md": doc("id: adr-alpha\ntitle: Alpha\nkind: adr\nstatus: superseded\ncreated: 2026-01-03\nreviewed: 2026-01-03\ntags: [storage]\nsuperseded_by: adr-beta", "\n# Alpha\n"),
    "docs/decisions/beta.md": doc("id: adr-beta\ntitle: Beta\nkind: adr\nstatus: active\ncreated: 2026-02-14\nupdated: 2026-05-20\nreviewed: 2026-05-20\ntags: [storage]\nsupersedes: [adr-alpha]", "\n# Beta\n\nAfter [alpha](alpha.md).\n"),
    "docs/decisions/gamma.md": doc("id: adr-gamma\ntitle: Gamma\nkind: adr\nstatus: active\ncreated: 2026-01-04\nreviewed: 2026-01-04\ntags: transport", "\n# Gamma\n\n\nSee [x](../does-not-exist.md).\n"),
    "docs/index.md": doc("id: guide-index\ntitle: Index\nkind: guide\nstatus: active\ncreated: 2026-01-02\nupdated: 2026-06-01\nreviewed: 2026-06-01\ntags: [entry, hub]\ncovers: [project.toml]", "\n# Index\n\n[b](decisions/beta.md) and [g](decisions/gamma.md)\n[n](notes.md) `[not](alpha.md)`\n"),
    "docs/notes.md": doc("id: guide-notes\ntitle: Notes\nkind: guide\nstatus: active\ncreated: 2026-04-11\nupdated: 2026-04-11\nreviewed: 2026-04-11\ntags: [entry]", "\n# Notes\n\n[PROMOTES: one]\n\n[PROMOTES: two]\n"),
    "docs/readme.md": doc("id: readme-readme\ntitle: Readme\nkind: readme\nstatus: active\ncreated: 2026-01-02\nreviewed: 2026-01-02", "\n# Readme\n"),
    "docs/runbooks/deploy.md": doc("id: runbook-deploy\ntitle: Deploy\nkind: runbook\nstatus: active\ncreated: 2026-03-01\nreviewed: 2026-03-01", "\n# Deploy\n"),
    "docs/legacy.md": "# Legacy note\n\nNo frontmatter.\n",
    "docs/.hidden/x.md": "# Hidden\n",
    "project.toml": "",
}
RULES = Rules(kind_rules=(("docs/decisions/**", "adr"), ("docs/runbooks/**", "runbook")), id_rules=(("*", "**", "{kind}-{stem}"),), annotations=(("promotes", r"\[PROMOTES:\s*(?P<id>[\w-]+)\]", "id", ()),))
SETTINGS = Settings(
    today=dt.date(2026, 6, 15), kinds=("generic", "adr", "guide", "readme", "runbook"), stale_days=90, orphan_grace_days=7, orphan_ok_kinds=("readme",), required=("created",), cross_field=(("status=superseded", "superseded_by"),)
)


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def files(spark, project):
    return scan(spark, project, include=("docs/**/*.md",))


@pytest.fixture(scope="module")
def graph(spark, project, files):
    return build.assemble(build.parse_files(files, RULES), SETTINGS, listed(spark, project))


def test_canonical_edges(graph):
    rows = [(r.edge_idx, r.source, r.relation, r.target_id or r.target_raw, r.cause, r.location) for r in graph.edges.orderBy("edge_idx").collect()]
    assert rows == [
        (0, "adr-beta", "references", "adr-alpha", None, "L4"),
        (1, "adr-beta", "supersedes", "adr-alpha", None, "frontmatter:supersedes"),
        (2, "adr-gamma", "references", "../does-not-exist.md", "missing", "L5"),
        (3, "guide-index", "covers", "project.toml", "missing", "frontmatter:covers"),
        (4, "guide-index", "references", "adr-beta", None, "L4"),
        (5, "guide-index", "references", "adr-gamma", None, "L4"),
        (6, "guide-index", "references", "guide-notes", None, "L5"),
    ]


def test_lookups(graph):
    legacy = graph.nodes.where("path = 'docs/legacy.md'").first()
    assert (legacy.id, legacy.title, legacy.kind, legacy.status, sorted(legacy.inferred_fields)) == ("generic-legacy", "Legacy note", "generic", "active", ["id", "kind", "status", "title"])
    assert [r.id for r in lookups.orphans(graph).collect()] == ["generic-legacy", "guide-index", "runbook-deploy"]
    far = dataclasses.replace(graph, settings=dataclasses.replace(SETTINGS, stale_days=4_000_000_000, orphan_grace_days=4_000_000_000))
    assert lookups.stale(far).count() == lookups.orphans(far).count() == 0 and lookups.recent(far, days=4_000_000_000, limit=None).count() == lookups.recent(graph, days=700_000, limit=None).count() > 0
    assert lookups.orphans(dataclasses.replace(graph, settings=dataclasses.replace(SETTINGS, orphan_grace_days=900_000))).select("id").collect() == [("generic-legacy",)]
    assert [(r.id, r.days_since) for r in lookups.stale(graph).collect()] == [("readme-readme", 164), ("adr-gamma", 162), ("runbook-deploy", 106)]
    assert [(r.id, r.field, r.days_ago) for r in lookups.recent(graph, days=365).collect()][:3] == [("guide-index", "reviewed", 14), ("adr-beta", "reviewed", 26), ("guide-notes", "created", 65)]
    assert [(r.id, r.score, r.in_id, r.in_title) for r in lookups.search(graph, "BETA").collect()] == [("adr-beta", 4.0, 1.5, 2.5)]
    assert [(r.id, r.location) for r in lookups.backlinks(graph, "adr-beta").collect()] == [("guide-index", "L4")]
    assert [r.id for r in lookups.covered_by(graph, "./project.toml").collect()] == ["guide-index"]
    assert [(r.key, r["count"], r.sources[0].line) for r in lookups.annotations(graph).collect()] == [("one", 1, 4), ("two", 1, 6)]
    detail = lookups.node_detail(graph, "adr-alpha").first()
    assert [(x.source, x.relation) for x in detail.incoming] == [("adr-beta", "references"), ("adr-beta", "supersedes")] and detail.outgoing is None
    with pytest.raises(ValueError):
        lookups.search(graph, " ")


def test_scores(graph):
    got = [(r.id, r.score) for r in scores.trust_ranking(graph, 5).collect()]
    assert got == [("adr-alpha", 0.2), ("readme-readme", 0.5000000000000001), ("runbook-deploy", 0.5000000000000001), ("adr-gamma", 0.625), ("guide-notes", 0.7291666666666667)]
    like = [(r.id, r.score) for r in scores.similar(graph, "adr-alpha").collect()][:4]
    assert like == [("adr-beta", 0.4), ("adr-gamma", 0.2), ("guide-index", 0.06666666666666667), ("generic-legacy", 0.0)]


def test_walks(graph):
    assert [r.id for r in walks.chain(graph, "adr-beta").collect()] == ["adr-alpha", "adr-beta"]
    sizes = {r.id: (r.component_id, r.size) for r in walks.components(graph).collect()}
    assert sizes["adr-alpha"] == (1, 5) and [sizes[x][0] for x in ("generic-legacy", "readme-readme", "runbook-deploy")] == [2, 3, 4]
    assert [(r.id, r.depth) for r in walks.neighborhood(graph, "guide-index").collect()] == [("guide-index", 0), ("adr-beta", 1), ("adr-gamma", 1), ("guide-notes", 1)]
    assert [(r.id, r.hops, [v.relation for v in r.via]) for r in walks.dependents(graph, "adr-alpha").orderBy("hops").collect()] == [("adr-beta", 1, ["references"]), ("guide-index", 2, ["references", "references"])]


def test_check_and_issues(graph):
    found, coverage, skipped = rules.check(graph)
    assert [(r.rule_id, r.node_id) for r in found.collect()] == [("orphan", "generic-legacy"), ("orphan", "guide-index"), ("orphan", "runbook-deploy"), ("required_field", "generic-legacy"), ("stale_review", "adr-gamma"), ("stale_review", "readme-readme"), ("stale_review", "runbook-deploy")]
    assert {r.rule_id: r.subjects for r in coverage.collect()} | {"acyclic_relation": 0} == {"acyclic_relation": 0, "cross_field": 8, "field_enum": 8, "field_parse": 8, "field_type": 0, "orphan": 6, "parse_failure": 8, "required_field": 8, "stale_review": 6}
    assert not skipped
    assert dict(rules.issues(graph).collect()) == {"excluded_target": 1, "unresolved_edge": 1, "violation_orphan": 3, "violation_required_field": 1, "violation_stale_review": 3}


def test_snapshot_status_and_delta(spark, graph, files, tmp_path):
    build.write_snapshot(graph, f"{tmp_path}/snap")
    again = build.read_snapshot(spark, f"{tmp_path}/snap", SETTINGS)
    assert again.edges.count() == 7 and build.status(again, files).count() == 0
    change = spark.createDataFrame([("docs/notes.md", None), ("docs/legacy.md", "# Legacy\n"), ("docs/new.md", doc("id: [1]", "x"))], "path string, content string")
    after = overlay(files, change)
    assert sorted((r.path, r.state) for r in build.status(again, after).collect()) == [("docs/legacy.md", "changed"), ("docs/new.md", "added"), ("docs/notes.md", "removed")]
    cached = build.parse_files(files, RULES)
    new = build.assemble(build.parse_changed(after, RULES, cached), SETTINGS)
    d = Delta(again, new)
    assert [r.id for r in d.added_nodes().collect()] == ["generic-new"] and [r.id for r in d.removed_nodes().collect()] == ["guide-notes"]
    assert [(r.id, r.field, r.after) for r in d.field_changes().collect()] == [("generic-legacy", "title", "Legacy")]
    assert {r.source for r in d.removed_edges().collect()} == {"guide-index"} == {r.source for r in d.added_edges().collect()}
    assert new.nodes.where("id = 'generic-new'").first().parse_issues[0].field == "id"
    text = report.markdown(graph)
    assert "- adr: 3" not in text and "kind adr: 3" in text and "~~adr-alpha~~ → adr-beta" in text


def test_duplicate_ids_and_rings_are_refused(spark):
    frame = lambda d: spark.createDataFrame([(p, t, "h") for p, t in d.items()], "path string, content string, content_hash string")
    with pytest.raises(build.DuplicateId):
        build.assemble(build.parse_files(frame({"a.md": doc("id: x"), "b.md": doc("id: x")}), RULES), SETTINGS)
    with pytest.raises(build.SupersessionCycle):
        build.assemble(build.parse_files(frame({"a.md": doc("id: x\nsupersedes: y"), "b.md": doc("id: y\nsupersedes: x")}), RULES), SETTINGS)


def test_stream_of_files(spark, files, tmp_path):
    files.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(files.schema).parquet(f"{tmp_path}/in")
    follow(stream, RULES, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert current(spark.read.parquet(f"{tmp_path}/out")).count() == 8


def test_reading_one_text():
    d = read_document("a/b.md", "﻿---\nstatus: 7\ncreated: 2026-1-5\nyes_word: yes\n---  \r\nT\r\n=\r\n```\n[a](x.md)\n```\n[b](<y z.md>) [c][ref] <http://q.md> [d](http://e.md) [e](f.txt) [f](g.md#h)\n\n[ref]: r.md\n", Rules())
    assert d.fields["created"] == dt.date(2026, 1, 5) and d.fields["title"] == "T" and d.fields["attrs"] == {"yes_word": '"yes"'}
    assert d.issues == [{"field": "status", "expected": "string", "found": "integer"}]
    assert [e[0] for e in d.raw_edges] == ["y z.md", "r.md", "g.md"]
    assert split_frontmatter("---") == (None, "---") and split_frontmatter("x\n---\n")[0] is None
    for bad in ("---\na: 1\n", "---\na: 1\na: 2\n---\n", "---\n- a\n---\n", "---\n1: a\n---\n"):
        with pytest.raises(ParseError):
            read_document("x.md", bad, Rules())
    assert code_lines(["a", "", "    code", "~~~", "x", "~~~", "b"]) == [False, False, True, True, True, True, False]
    assert link_path("a\\_b.md", (".md",)) == "a_b.md" and link_path("mailto:x.md", (".md",)) is None and slugify("Ä b--C!") == "ä-b-c" and len(slugify("!!")) == 12
    wiki = read_document("a.md", "[[x|label]] `[[y]]`\n", Rules(wikilinks=True, link_patterns=((r"ADR-(\d+)", "cites", True),)))
    assert [e[:2] for e in wiki.raw_edges] == [("x", "references")]


def test_resolution_frames(spark):
    nodes = spark.createDataFrame([("r", "x.md"), ("s", "d/x.md"), ("bare", "e/y.md")], "id string, path string")
    from quillgraph.plans.resolve import resolve

    raw = [("x.md", "r", None), ("./x", "s", None), ("../x.md", "r", None), ("bare", "bare", None), ("../../x.md", None, "escapes_source"), ("/x.md", None, "absolute"), ("no", None, "missing")]
    rows = spark.createDataFrame([("s", "d/x.md", t, "references", "L1", i) for i, (t, _, _) in enumerate(raw)], "source string, source_path string, target_raw string, relation string, location string, ordinal int")
    got = {r.ordinal: (r.target_id, r.cause) for r in resolve(rows, nodes).collect()}
    assert [got[i] for i in range(len(raw))] == [x[1:] for x in raw]


@pytest.mark.parametrize("seed", range(3))
def test_cycles_by_colouring_are_those_of_the_driver(spark, seed):
    import random

    rng = random.Random(seed)
    links = sorted({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(22)})
    edges = spark.createDataFrame([(a, b, "related") for a, b in links], "source string, target_id string, relation string")
    g = build.Graph(spark.createDataFrame([("x",)], "id string"), edges, SETTINGS)
    want = sorted(map(tuple, walks.cyclic_members(g, "related").collect()))
    assert sorted((r.id, r.region, r.via) for r in walks.cyclic_members(g, "related", driver_links=0).collect()) == want


def test_number_gaps_over_ranges(spark):
    numbers = [1, 2, 3, 7, 8, 20, 21, 22, 40]
    rows = spark.createDataFrame([(f"d{n}", f"x/{n}.md", n) for n in numbers], "id string, path string, n int").withColumn("number", F.col("n").cast("decimal(20,0)"))
    got = sorted((int(r.number), int(r.previous)) for r in rules.number_gaps(rows).collect())
    assert got == [(7, 3), (20, 8), (40, 22)]
    assert rules.number_gaps(rows.limit(0)).count() == 0


def test_hidden_files_need_a_pattern_that_names_every_dot(spark):
    from quillgraph.sources.files import _in_scope

    paths = ["a.md", ".github/a.md", ".obsidian/b.md", ".github/.cache/c.md", "x/.y/d.md", "x/.e.md", ".github/x.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = lambda *g: sorted(r.path for r in _in_scope(df, g, (), ()).collect())
    assert got("**/*.md") == ["a.md"]
    assert got("**/*.md", ".github/**/*.md") == [".github/a.md", "a.md"]
    assert got("**/.*/**/*.md") == [".github/a.md", ".obsidian/b.md", "x/.y/d.md"]
    assert got("x/.e.md", "x/**") == ["x/.e.md"]


def test_long_lineages_and_trees_cost_few_rounds(spark):
    from quillgraph.model import Graph

    ids = [f"n{i:03d}" for i in range(60)]
    nodes = spark.createDataFrame([(x, x, "k", "active", f"{x}.md") for x in ids], "id string, title string, kind string, status string, path string")
    links = [(i, ids[i], ids[i - 1], "supersedes", "l") for i in range(1, 60)] + [(100, ids[5], ids[5], "related", "l"), (101, ids[7], ids[8], "related", "l"), (102, ids[8], ids[7], "related", "l"), (103, ids[8], ids[9], "related", "l")]
    g = Graph(nodes, spark.createDataFrame(links, "edge_idx long, source string, target_id string, relation string, location string"), SETTINGS)
    assert [r.id for r in walks.chain(g, "n010").collect()] == ids
    assert walks.cyclic_members(g, "supersedes").count() == 0
    assert sorted((r.id, r.region, r.via) for r in walks.cyclic_members(g, "related").collect()) == [("n005", "n005", "n005"), ("n007", "n007", "n008"), ("n008", "n007", "n007")]
    out = walks.dependents(g, "n055").collect()
    assert [(r.id, r.hops, len(r.via)) for r in out] == [(f"n{55 + k:03d}", k, k) for k in range(1, 5)] and out[-1].via[0].source == "n059" and out[-1].via[-1].target == "n055"


def test_links_are_those_of_commonmark():
    edges = lambda body: [(t, at) for t, _, at in read_document("docs/a.md", body, Rules(wikilinks=True)).raw_edges]
    assert edges("see [a\nb](x.md) and [c [d] e](y.md) ![i](z.md) [![i](z.png)](w.md)\n") == [("x.md", "L1"), ("y.md", "L2"), ("w.md", "L2")]
    assert edges("- item\n\n    [yes](l.md)\n\n        [no](k.md)\n\n<div>\n[no](h.md)\n</div>\n\n`a\n[no](s.md)` z\n") == [("l.md", "L3")]
    assert edges("[r][L] [L] [q][] [none][x]\n[[wiki#x|t]] `[[no]]`\n\n[l]: <d.md> 'x'\n[Q]: q.md\n[l]: other.md\n") == [("d.md", "L1"), ("d.md", "L1"), ("q.md", "L1"), ("wiki", "L2")]
    assert edges("```\n[a](b.md)\n~~~\n```\n> [q](q.md)\n\n1. ```\n   [n](n.md)\n   ```\n   [y](y.md)\n") == [("q.md", "L5"), ("y.md", "L10")]
    assert edges("<!-- [c](c.md)\n[c](d.md) -->\n[e](e.md#f) [u](http://x/y.md) <http://a/[b](c.md)> \\[x](esc.md)\n[(a)](p(1).md \"t\") [o [i](in.md)](out.md)") == [("e.md", "L3"), ("p(1).md", "L4"), ("in.md", "L4")]
    assert edges("para\n    [still text](t.md)\n\n    [code](c.md)\n") == [("t.md", "L2")] and edges("[" * 3000 + "](x.md)" * 3) == [("x.md", "L1")]


def test_rewriting_follows_links_over_lines_and_definitions():
    from quillgraph.mutate import _rewritten

    text = "---\nid: a\n---\n[a\nb](old.md#x) [r] `[c](old.md)` [[old.md]]\n\n[r]: old.md 'T'\n"
    assert _rewritten(text, lambda t: "new.md" if t == "old.md" else None) == text.replace("(old.md#x)", "(new.md#x)").replace("[[old.md]]", "[[new.md]]").replace("[r]: old.md", "[r]: new.md")
