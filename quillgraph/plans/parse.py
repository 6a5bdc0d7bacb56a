"""Reading of Markdown files with frontmatter: plain functions over one text, run in Arrow batches by ``plans.build``."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import json
import re
from dataclasses import dataclass, field

import yaml

from quillgraph.functions.columns import glob_regex
from quillgraph.model import LISTS

SCALAR_TEXT = ("id", "title", "kind", "status", "owner", "superseded_by")
DATES = ("created", "updated", "reviewed")


class ParseError(ValueError):
    """A file that yields no document."""


class _Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML with null, true/false and numbers alone resolved, and repeated keys refused."""


_Loader.yaml_implicit_resolvers = {}
for _tag, _pattern, _first in (
    ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
    ("int", r"^[-+]?[0-9]+$", list("-+0123456789")),
    ("float", r"^[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$", list("-+.0123456789")),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(_pattern), _first)


def _mapping(loader, node):
    seen = set()
    for key, _ in node.value:
        if key.value in seen:
            raise ParseError(f"duplicate key {key.value!r}")
        seen.add(key.value)
    return yaml.SafeLoader.construct_mapping(loader, node, deep=True)


_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)


@dataclass(frozen=True)
class Rules:
    """What reading depends on besides the text."""

    kind_rules: tuple[tuple[str, str], ...] = ()  # glob, kind
    id_rules: tuple[tuple[str, str, str], ...] = ()  # kind or *, glob, template
    initial_status: str = "active"
    fallback_kind: str = "generic"
    extensions: tuple[str, ...] = (".md",)
    wikilinks: bool = False
    link_patterns: tuple[tuple[str, str, bool], ...] = ()  # regex with one group, relation, code spans too
    annotations: tuple[tuple[str, str, str, tuple[str, ...]], ...] = ()  # name, regex, key group, kinds
    body_lines: tuple[tuple[str, str, tuple[str, ...]], ...] = ()  # name, regex, kinds


def canonical_text(text: str) -> str:
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


_OPENED = re.compile(r"---[ \t]*\n")
_CLOSED = re.compile(r"^---[ \t]*$\n?", re.M)


def split_frontmatter(text: str) -> tuple[str | None, str]:
    """The text between the fences, and the body."""
    opened = _OPENED.match(text)
    if not opened:
        return None, text
    if not (closed := _CLOSED.search(text, opened.end())):
        raise ParseError("the frontmatter is not closed")
    return text[opened.end() : max(closed.start() - 1, opened.end())], text[closed.end() :]


#: Lines of frontmatter that YAML reads as one name with one word or words, in quotes, or with a list of such on the line.
_WORDS = r"[A-Za-z](?:[A-Za-z0-9_./#-]| (?=[A-Za-z0-9_./-]))*"
_PLAIN = re.compile(rf"([A-Za-z_][A-Za-z0-9_]{{0,99}}): (?:({_WORDS}|[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})|\"([A-Za-z0-9_ .,:#/-]*)\"|\[({_WORDS}(?:, {_WORDS})*)\])")
#: Words that YAML reads as null or a truth.
_VALUES = {"null", "Null", "NULL", "true", "True", "TRUE", "false", "False", "FALSE"}


def _plain_fields(front: str) -> dict | None:
    """The fields where all lines are plain; None where YAML has to read them."""
    out = {}
    for line in front.split("\n"):
        m = _PLAIN.fullmatch(line)
        if not m:
            return None
        name, words, quoted, items = m.groups()
        if name in out or name in _VALUES or words in _VALUES:
            return None
        if items is not None:
            words = items.split(", ")
            if not _VALUES.isdisjoint(words):
                return None
        out[name] = words if quoted is None else quoted
    return out


def read_fields(front: str | None) -> dict:
    if front is None:
        return {}
    if (plain := _plain_fields(front)) is not None:
        return plain
    try:
        found = yaml.load(front, _Loader)
    except yaml.YAMLError as e:
        raise ParseError(f"frontmatter: {e}") from None
    if found is None:
        return {}
    if not isinstance(found, dict) or not all(isinstance(k, str) for k in found):
        raise ParseError("the frontmatter is no mapping of names")
    return found


def _date(value) -> dt.date | None:
    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", value) if isinstance(value, str) else None
    try:
        return dt.date(*map(int, m.groups())) if m else None
    except ValueError:
        return None


def coerce(fields: dict) -> tuple[dict, list[dict]]:
    """Built-in fields by type; a value of another type reads as absent and leaves an issue."""
    out: dict = {"attrs": {}, "orphan_ok": False} | {f: [] for f in LISTS}
    issues = []
    shown = lambda v: "null" if v is None else {bool: "bool", int: "integer", float: "float", str: "string", list: "array", dict: "object"}[type(v)]

    def bad(name, expected, value):
        issues.append({"field": name, "expected": expected, "found": shown(value)})

    for name, value in fields.items():
        if value is None and (name in SCALAR_TEXT or name in DATES or name in LISTS or name == "orphan_ok"):
            continue
        if name in SCALAR_TEXT:
            out[name] = value if isinstance(value, str) else bad(name, "string", value)
        elif name in DATES:
            out[name] = _date(value)
            if out[name] is None:
                bad(name, "date", value)
        elif name in LISTS:
            items = [value] if isinstance(value, str) else value
            if isinstance(items, list) and all(isinstance(x, str) for x in items):
                out[name] = items
            else:
                bad(name, "list of strings", value)
        elif name == "orphan_ok":
            if isinstance(value, bool):
                out[name] = value
            else:
                bad(name, "bool", value)
        else:
            out["attrs"][name] = json.dumps(value, ensure_ascii=False, sort_keys=True)
    return out, issues


_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})(.*)$")
_ITEM = re.compile(r"([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|)$")
_HEADING = re.compile(r"#{1,6}(?:[ \t]|$)")
_UNDERLINE = re.compile(r"=+|-+")
_RULE = re.compile(r"([-*_])(?:[ \t]*\1){2,}[ \t]*$")
#: The names of tags that begin a block of HTML up to a blank line.
_BLOCK_TAGS = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
#: How a block of HTML begins, and what ends it (None: a blank line).
_HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(rf"</?(?:{_BLOCK_TAGS})(?:\s|/?>|$)", re.I), None),
)
_LONE_TAG = re.compile(r"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")


def line_kinds(lines: list[str]) -> list[str]:
    """What each line is: ``code`` (fenced or indented), ``html``, ``blank``, ``head`` (begins a block of text) or ``text`` (goes on with one).

    Code is indented by four beyond what its list item asks for. Text after a line of text is that paragraph's, however indented.
    """
    out: list[str] = []
    fence, html, open_text, offsets = None, False, False, []
    for line in lines:
        body = line.strip()
        indent = 0
        if line[:1] in (" ", "\t"):
            spread = line.expandtabs(4)
            indent = len(spread) - len(spread.lstrip(" "))
        if fence:
            out.append("code")
            if body and body[0] == fence[0] and not body.strip(fence[0]) and len(body) >= len(fence):
                fence = None
            continue
        if html is not False:
            out.append("html" if body or html else "blank")
            if html is None and not body or html and html.search(line):
                html = False
            continue
        if not body:
            out.append("blank")
            open_text = False
            continue
        item = None if _RULE.match(body) else _ITEM.match(body)
        while offsets and indent < offsets[-1] and not (open_text and not item):
            offsets.pop()
        base = offsets[-1] if offsets else 0
        if indent - base >= 4 and not open_text:
            out.append("code")
            continue
        while body.startswith(">"):
            body = body[1:].lstrip(" ")
        if item and indent - base < 4 and (not open_text or item[3]):
            spaces = len((item[2] or " ").expandtabs(4))
            offsets.append(indent + len(item[1]) + (spaces if spaces <= 4 else 1))
            body, open_text = item[3] or "", False
            out.append("head")
            if m := _FENCE.match(body):
                fence = m[1]
            elif body:
                open_text = True
            continue
        if m := _FENCE.match(body):
            fence, open_text = m[1], False
            out.append("code")
            continue
        begins = next((e for b, e in _HTML if b.match(body)), False) if body[:1] == "<" else False
        if begins is False and not open_text and body[:1] == "<" and _LONE_TAG.match(body):
            begins = None
        if begins is not False:
            out.append("html")
            open_text = False
            html = False if begins and begins.search(line[line.index("<") + 1 :]) else begins
            continue
        if _HEADING.match(body) or _RULE.match(body) and not (open_text and body[0] == "-"):
            out.append("head")
            open_text = False
        elif open_text and _UNDERLINE.fullmatch(body):
            out.append("text")
            open_text = False
        else:
            out.append("text" if open_text else "head")
            open_text = bool(body)
    return out


def code_lines(lines: list[str]) -> list[bool]:
    """Which lines belong to fenced or indented code, or to a block of HTML."""
    return [k in ("code", "html") for k in line_kinds(lines)]


_SPAN = re.compile(r"(?<![`\\])(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_AUTOLINK = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>")
_MARK = re.compile(r"\\.|!?\[|\]", re.S)
_DESTINATION = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\([^\s()]*\))*\))*)?)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")
DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")


def without_code_spans(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The text with code spans and bare URLs blanked, and where spans stand with what they hold."""
    spans: list[tuple[int, str]] = []

    def blank(m):
        if m.re is _SPAN:
            spans.append((m.start(2), m[2].strip()))
        return re.sub(r"[^\n]", " ", m[0])

    if "`" in text:
        text = _SPAN.sub(blank, text)
    return _AUTOLINK.sub(blank, text) if "<" in text else text, spans


def prose(lines: list[str], kinds: list[str]) -> tuple[list[tuple[int, int]], dict[str, str]]:
    """First and last (end exclusive) line of each block of text, and the destinations of link definitions, which are no text."""
    found, definitions, i = [], {}, 0
    while i < len(lines):
        if kinds[i] not in ("head", "text"):
            i += 1
            continue
        j = i + 1
        while j < len(lines) and kinds[j] == "text":
            j += 1
        while i < j and (m := DEFINITION.match(lines[i])):
            definitions.setdefault(_label(m[1]), m[2] if m[2] is not None else m[3])
            i += 1
        if i < j:
            found.append((i, j))
        i = j
    return found, definitions


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


def inline_links(text: str, definitions: dict[str, str]) -> list[tuple[int, str, tuple[int, int] | None]]:
    """Start, destination and the destination's place (None: from a definition) of each link in a block of text; images are none.

    Brackets are paired from the inside out; a link's text holds no other link, so the inner of two wins.
    """
    out, stack, at = [], [], 0
    while m := _MARK.search(text, at):
        at = m.end()
        if m[0][0] == "\\":
            continue
        if m[0] != "]":
            stack.append([m.start(), m[0][0] == "!", True])
            continue
        if not stack:
            continue
        start, image, active = stack.pop()
        if not active:
            continue
        place = None
        if d := _DESTINATION.match(text, at):
            k = 1 if d[1] is not None else 2
            to, place, end = d[k] or "", d.span(k), d.end()
        else:
            second = _LABEL.match(text, at)
            label = second[1] if second and second[1].strip() else text[start + (2 if image else 1) : m.start()]
            to, end = definitions.get(_label(label)), second.end() if second else at
            if to is None:
                continue
        at = end
        if not image:
            out.append((start, to, place))
            for one in stack:
                one[2] = one[1]  # outer brackets make no link any more, images may
    return sorted(out, key=lambda x: x[0])


WIKI = re.compile(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]")


def link_path(target: str, extensions: tuple[str, ...]) -> str | None:
    """The path a link names, without fragment; None for URLs, bare fragments and other kinds of file."""
    path = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", target).split("#", 1)[0]
    if not path or re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path) or path.startswith("//"):
        return None
    return path if path.endswith(extensions) else None


@dataclass
class Document:
    fields: dict
    issues: list[dict]
    inferred: list[str]
    raw_edges: list[tuple[str, str, str]] = field(default_factory=list)  # target, relation, location
    annotations: list[tuple[str, str, int]] = field(default_factory=list)
    body_lines: list[tuple[str, int, dict]] = field(default_factory=list)


def first_heading(lines: list[str], code: list[bool]) -> str | None:
    for i, line in enumerate(lines):
        if code[i]:
            continue
        if (m := re.match(r"^ {0,3}#(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line)) and m[1]:
            return _plain(m[1])
        if i and re.match(r"^ {0,3}=+[ \t]*$", line) and lines[i - 1].strip() and not code[i - 1]:
            return _plain(lines[i - 1].strip())
    return None


def _plain(text: str) -> str:
    text = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"(`+)(.+?)\1", r"\2", re.sub(r"(\*\*|__|\*|(?<!\w)_|_(?!\w))", "", text)).strip()


def slugify(text: str) -> str:
    out = "".join(c.lower() if c.isalnum() else "-" for c in text)
    out = re.sub("-+", "-", out).strip("-")
    return out or hashlib.sha256(text.encode()).hexdigest()[:12]


@functools.lru_cache(maxsize=1024)
def _glob(glob: str) -> re.Pattern:
    return re.compile(glob_regex(glob), re.S)


def identity(path: str, own: dict, rules: Rules, heading: str | None) -> tuple[dict, list[str]]:
    """id, title, kind and status, and which of them the file does not say itself."""
    name = path.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    matches = lambda glob: _glob(glob).match(path)
    inferred = [f for f in ("id", "title", "kind", "status") if not own.get(f)]
    kind = own.get("kind") or next((k for g, k in rules.kind_rules if matches(g)), rules.fallback_kind)
    made = {"kind": kind, "status": own.get("status") or rules.initial_status, "title": own.get("title") or heading or stem}
    if own.get("id"):
        return made | {"id": own["id"]}, inferred
    template = next((t for k, g, t in rules.id_rules if k in ("*", kind) and matches(g)), "{kind}-{stem}")
    parent = path.rsplit("/", 2)[-2] if path.count("/") else ""
    made["id"] = template.replace("{kind}", kind).replace("{stem}", slugify(stem)).replace("{parent}", slugify(parent) if parent else "").replace("{path_slug}", slugify(path.rsplit(".", 1)[0]))
    return made, inferred


def read_document(path: str, text: str, rules: Rules) -> Document:
    """A file's document, or a ParseError; body references come first, line captures next, then the lists of the frontmatter."""
    front, body = split_frontmatter(canonical_text(text))
    own, issues = coerce(read_fields(front))
    lines = body.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    kinds = line_kinds(lines)
    made, inferred = identity(path, own, rules, None if own.get("title") else first_heading(lines, [k in ("code", "html") for k in kinds]))
    fields = own | made
    fields["body_hash"] = hashlib.sha256(body.encode()).hexdigest()
    fields["body_lines_hash"] = [hashlib.sha256(x.encode()).hexdigest() for x in lines]
    doc = Document(fields, issues, inferred)
    blocks, definitions = prose(lines, kinds)
    captured = []
    for i, j in blocks:
        shown, spans = without_code_spans("\n".join(lines[i:j]))
        line_of = lambda at, shown=shown, i=i: i + 1 + shown.count("\n", 0, at)
        for at, target, _ in inline_links(shown, definitions) if "[" in shown else ():
            if (to := link_path(target, rules.extensions)) is not None:
                doc.raw_edges.append((to, "references", f"L{line_of(at)}"))
        if rules.wikilinks:
            captured += [(i, m.start(1), m[1].strip(), "references", line_of(m.start(1))) for m in WIKI.finditer(shown)]
        for pattern, relation, in_code in rules.link_patterns:
            start = 0
            for line in shown.split("\n"):
                captured += [(i, start + m.start(1), m[1].strip(), relation, line_of(start)) for m in re.finditer(pattern, line) if m[1]]
                start += len(line) + 1
            captured += [(i, at, m[1].strip(), relation, line_of(at)) for at, x in spans if in_code and (m := re.fullmatch(pattern, x))]
    doc.raw_edges += [(t, r, f"L{n}") for *_, target, r, n in sorted(captured) if (t := target.split("#", 1)[0])]
    marks = [(name, re.compile(pattern), key) for name, pattern, key, of in rules.annotations if not of or fields["kind"] in of]
    captures = [(name, re.compile(pattern)) for name, pattern, of in rules.body_lines if not of or fields["kind"] in of]
    for n, line in enumerate(lines, 1) if marks or captures else ():
        if kinds[n - 1] == "code":
            continue
        for name, pattern, key in marks:
            doc.annotations += [(name, m[key], n) for m in pattern.finditer(line) if m[key] is not None]
        for name, pattern in captures:
            doc.body_lines += [(name, n, {k: v for k, v in m.groupdict().items() if v is not None}) for m in pattern.finditer(line) if any(v is not None for v in m.groupdict().values())]
    for relation in ("supersedes", "implements", "related", "covers"):
        doc.raw_edges += [(x, relation, f"frontmatter:{relation}") for x in fields[relation]]
    return doc
