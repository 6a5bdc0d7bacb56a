"""Settings, exports, and commands that change documents."""

import datetime as dt
import json

import pytest

from quillgraph import cli, config, contract, mutate
from quillgraph.config import ConfigError, frontmatter_schema, load, manifest
from quillgraph.model import STOP_WORDS, Settings
from quillgraph.plans.parse import Rules, read_document

TODAY = dt.date(2026, 6, 15)
TOML = """
[scope]
include = ["docs/**/*.md"]
[kinds]
allowed = ["generic", "adr", "guide"]
[identity]
id_rules = [{ template = "{kind}-{stem}" }]
kind_rules = [{ glob = "docs/decisions/**", kind = "adr" }]
[schema]
required = ["created"]
overrides = [{ kinds = ["adr"], required = ["owner"], enums = { impact = ["low", "high"] } }]
cross_field = [{ when = "status=superseded", require = "superseded_by" }]
[[annotations]]
name = "promotes"
pattern = '\\[P:(?P<id>\\w+)\\]'
key = "id"
"""
DOC = "---\nid: a\n# kept\ntitle: 'A'\nstatus: active\nrelated:\n  - x\n  - y\n---\nsee [b](b.md) `[b](b.md)` [[x]]\n"


def test_settings_and_exports():
    p = load(TOML, TODAY)
    assert p.settings.kinds == ("generic", "adr", "guide") and p.exclude == ("_index/**",) and p.rules.annotations[0][2] == "id"
    assert manifest(p)["enums"]["kind"] == ["generic", "adr", "guide"]
    adr, rest = frontmatter_schema(p)["oneOf"]
    assert adr["required"] == ["created", "owner"] and rest["properties"]["kind"] == {"enum": ["generic", "guide"]}


@pytest.mark.parametrize("bad", ["[x]", "[scope]\ny = 1", '[kinds]\nallowed = ["adr"]', '[statuses]\nallowed = ["a"]\nterminal = ["b"]', "[trust.weights]\nstatus = -1.0", '[schema]\ncross_field = [{ when = "?", require = "x" }]', '[[annotations]]\nname = "n"\npattern = "(?=x)"\nkey = "k"', '[[detection.unresolved_policy]]\nname = "n"\ncause = "nope"', "a ="])
def test_wrong_settings_are_refused(bad):
    with pytest.raises(ConfigError):
        load(bad, TODAY)


def test_lifecycle():
    p = load(TOML, TODAY)
    ((_, text, _),) = mutate.lifecycle(p, "docs/a.md", DOC, "supersede", TODAY, "b")
    assert text == DOC.replace("status: active", "status: superseded").replace("  - y\n", "  - y\nsuperseded_by: b\nupdated: 2026-06-15\n")
    with pytest.raises(mutate.Refused):
        mutate.lifecycle(p, "docs/a.md", text, "set", TODAY, "active")
    assert "reviewed: 2026-06-15" in mutate.lifecycle(p, "docs/a.md", text, "review", TODAY)[0][1]
    with pytest.raises(mutate.Refused):
        mutate.supersede_safe([("a", "b"), ("b", "c")], "a", "c")


def test_scaffold_and_migrate():
    p = load(TOML, TODAY)
    made = mutate.scaffold(p, "adr", "Swept", {}, TODAY)
    assert made["path"] == "docs/decisions/swept.md" and made["id"] == "adr-swept" and "created: 2026-06-15" in made["content"]
    with pytest.raises(mutate.Refused):
        mutate.scaffold(p, "adr", "Swept", {"adr-swept": "x.md"}, TODAY)
    ((path, text, _),) = mutate.migrate(p, [("docs/a.md", DOC), ("docs/old.md", "# Old\n")])
    assert path == "docs/old.md" and text.startswith("---\nid: generic-old\ntitle: Old\nkind: generic\nstatus: active\n---\n")


def test_rename_keeps_what_links_name():
    p = load(TOML, TODAY)
    files = [("docs/a.md", DOC), ("docs/b.md", "[a](a.md#x) [r](docs/a.md) [w](http://a.md)\n"), ("docs/c/d.md", "[a](../a.md)\n")]
    plan = {path: (text, moved) for path, text, moved in mutate.rename(p, files, "docs/a.md", "docs/c/e.md")}
    assert plan["docs/c/e.md"][1] == "docs/a.md" and "[b](../b.md) `[b](b.md)`" in plan["docs/c/e.md"][0]
    assert plan["docs/b.md"][0] == "[a](c/e.md#x) [r](docs/c/e.md) [w](http://a.md)\n" and plan["docs/c/d.md"][0] == "[a](e.md)\n"
    with pytest.raises(mutate.Refused):
        mutate.rename(p, files, "docs/a.md", "docs/b.md")


def test_retarget():
    p = load(TOML, TODAY)
    ((_, text, _),) = mutate.retarget(p, [("docs/a.md", DOC)], "x", "y")
    assert "related: [y]" in text and "[[y]]" in text and "# kept" in text


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text(DOC)
    (tmp_path / "docs/b.md").write_text("# B\n\n[a](a.md)\n")
    (tmp_path / cli.CONFIG).write_text(TOML)

    def ask(*args):
        code = cli.main(["--root", str(tmp_path), "--today", "2026-06-15", *args], spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert ask("build")[1]["data"]["nodes"] == 2 and ask("status")[1]["data"]["state"] == "current"
    assert [x["id"] for x in ask("query", "backlinks", "a")[1]["data"]["items"]] == ["generic-b"]
    again = ask("build")[1]
    assert (again["data"]["cached"], again["data"]["parsed"]) == (2, 0) and any("docs/decisions" in w for w in again["warnings"])
    code, found = ask("check", "--severity", "warning")
    assert code == 1 and found["data"]["has_errors"] and all(x["severity"] == "warning" for x in found["data"]["items"])
    (tmp_path / "new.md").write_text("---\nid: n\nkind: nope\ncreated: 2026-01-01\n---\n[a](a.md)\n")
    code, found = ask("check", "--content", f"docs/new.md={tmp_path}/new.md")
    assert code == 1 and [(x["rule_id"], x["node_id"]) for x in found["data"]["items"] if x["severity"] == "error"] == [("field_enum", "n")]
    assert found["data"]["proposals"] == [{"path": "docs/new.md", "in_scope": True, "has_path_errors": True}] and not any(x["severity"] == "error" for x in found["data"]["standing"])
    issues = ask("query", "issues")[1]["data"]
    assert issues["summary"]["by_category"]["violation_required_field"] == 2 and {x["raw_target"] for x in issues["unresolved_edges"]} == {"x", "y"}
    assert ask("query", "nodes", "--where", "id=a", "--fields", "id,status", "--limit", "1")[1]["data"] == {"items": [{"id": "a", "status": "active"}], "total": 1, "returned": 1}
    assert "[b](b.md)" in ask("query", "node", "a", "--with-body")[1]["data"]["items"][0]["body"]
    for wrong, why in ((("query", "node", "zz"), "NOT_FOUND"), (("query", "nodes", "--kind", "zz"), "USAGE"), (("query", "nodes", "--tag", "a,,b"), "USAGE"), (("query", "stale", "--limit", "0"), "USAGE"), (("query", "similar"), "USAGE"), (("lifecycle", "set", "docs/a.md", "zz"), "CONFIG"), (("scaffold", "zz", "New"), "USAGE")):
        code, answer = ask(*wrong)
        assert code == 2 and answer["error"]["code"] == why
    assert ask("migrate", "--apply")[1]["data"]["paths"] == ["docs/b.md"] and "id: generic-b" in (tmp_path / "docs/b.md").read_text()
    assert ask("rename", "docs/b.md", "docs/n/c.md")[0] == 0 and "(../a.md)" in (tmp_path / "docs/n/c.md").read_text()
    assert ask("report")[1]["data"]["generated"][-1] == "GRAPH.md" and ask("query", "search")[0] == 2 and ask("export", "rules")[0] == 0


def test_grammar_and_envelope(spark, tmp_path, capsys):
    assert {"search", "trust"} <= {*cli.grammar()["commands"]["query"]["commands"]}
    assert cli.main(["--root", str(tmp_path), "export", "envelope"], spark) == 0
    made = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["data"]["commands"]
    assert made["stale"]["properties"]["data"]["properties"]["items"]["items"]["properties"]["reviewed"] == {"type": "string", "format": "date"}


def test_contract_changes_and_versions():
    old = {"properties": {"a": {"type": "string"}, "b": {"enum": ["x"]}}, "required": ["a"]}
    new = {"properties": {"a": {"type": "string"}, "b": {"enum": ["x", "y"]}, "c": {}}, "required": []}
    diff = contract.schema_diff(old, new)
    assert {(at, breaking) for at, _, breaking in diff} == {("/properties/b/enum/y", True), ("/properties/c", False), ("/required/a", True)}
    step = contract.step_covers
    assert not step("1.2.3", "1.3.0", diff) and step("1.2.3", "2.0.0", diff) and step("0.2.0", "0.3.0", diff) and step("1.0.0", "1.0.0", [])
    added = [("/properties/c", "added", False)]
    assert not step("0.1.0", "0.1.1", added) and step("0.1.0", "0.2.0", added) and not step("1.0.0", "1.0.1", added) and step("1.0.0", "1.1.0", added) and not step("2.0.0", "1.9.0", added)
    kinds = lambda x, y: {(at, breaking) for at, _, breaking in contract.schema_diff(x, y)}
    assert kinds({"type": "object"}, {"type": "object", "additionalProperties": False}) == {("/additionalProperties", True)}
    assert kinds({"additionalProperties": False}, {}) == {("/additionalProperties", False)} and not kinds({"description": "a"}, {"description": "b", "title": "c"})
    assert kinds({"properties": {"required": {"type": "string"}}}, {"properties": {"required": {"type": "string"}, "enum": {}}}) == {("/properties/enum", False)}
    assert kinds({"oneOf": [{}]}, {"oneOf": [{}, {}]}) == {("/oneOf", True)} and kinds({"minimum": 1}, {"minimum": 0}) == {("/minimum", True)} and kinds(True, {}) == {("", True)}
    match = contract.version_matches
    assert match("*", "0.1.0") and match("1.*", "1.9.3") and not match("1.2.*", "1.3.0") and match(">=1.2, <2", "1.9.0") and match("^0.2.1", "0.2.9") and not match("^0.2.1", "0.3.0")
    for bad in ("not a version", "", ">=1.*", "1.2.3.4"):
        with pytest.raises(ValueError):
            match(bad, "1.0.0")


def test_scaffold_quotes_fills_and_refuses():
    project = config.Project(Settings(today=TODAY, kinds=("adr",), statuses=("active", "superseded"), required=("created", "owner"), cross_field=(("status=superseded", "superseded_by"), ("owner exists", "stage")), enums={"stage": ("early", "late")}), Rules(), (), (), (), "out")
    made = mutate.scaffold(project, "adr", 'A "quoted" title: with #', {}, TODAY, node_id="adr-x", path="docs/x.md", fields={"team": "true"})
    doc = read_document("docs/x.md", made["content"], project.rules)
    assert doc.fields["title"] == 'A "quoted" title: with #' and doc.fields["id"] == "adr-x" and doc.fields["owner"] == "TODO" and doc.fields["created"] == TODAY and json.loads(doc.fields["attrs"]["team"]) == "true"
    assert json.loads(doc.fields["attrs"]["stage"]) == "early" and not doc.issues
    for fields in ({"status": "superseded"}, {"id": "y"}, {"path": "z"}):
        with pytest.raises(mutate.Refused):
            mutate.scaffold(project, "adr", "t", {}, TODAY, fields=fields)
    for bad in ("", " x", "a[b]", "a|b", "x\ny"):
        with pytest.raises(mutate.Refused):
            mutate.retarget(project, [], "a", bad)
    with pytest.raises(mutate.Refused):
        mutate.scaffold(project, "adr", "t", {}, TODAY, path="../x.md")
    for requirement, good, bad in (("^1.2", "1.9.0", "2.0.0"), ("~1.2", "1.2.9", "1.3.0"), (">=1, <2", "1.0.0", "2.0.0"), ("^0.3", "0.3.4", "0.4.0"), ("=1.2", "1.2.7", "1.3.0"), ("<=1.2", "1.2.9", "1.3.0")):
        assert contract.version_matches(requirement, good) and not contract.version_matches(requirement, bad)
