"""Column factories: predicates on fields, text, paths, and the parts of scores."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.model import LISTS, SCALARS

NOT_WORD = r"[^\p{IsAlphabetic}\p{N}]+"


def glob_regex(glob: str) -> str:
    """The regular expression (Python and Java) of a glob: ``*`` crosses separators, ``**/`` may be nothing."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif c == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out, i = out + ".", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inside = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        elif c == "{" and (end := glob.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(x)[1:-1] for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def matches_glob(column: Column, glob: str) -> Column:
    return column.rlike("(?s)" + glob_regex(glob))


def field_text(name: str) -> Column:
    """A scalar field as text, null where absent; other names are looked up in ``attrs``, whose values are JSON."""
    if name == "path" or name in SCALARS:
        return F.col(name).cast("string")
    if name in LISTS:
        return F.lit(None).cast("string")
    raw = F.col("attrs")[name]
    unquoted = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    return F.when(~raw.rlike(r"^\s*[\[{]") & (raw != "null"), unquoted)


def field_missing(name: str) -> Column:
    """Whether a field is null, empty text or an empty list."""
    if name in LISTS:
        return F.coalesce(F.size(F.col(name)), F.lit(0)) <= 0
    if name == "orphan_ok":
        return F.col(name).isNull()
    if name == "path" or name in SCALARS:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""
    raw = F.coalesce(F.col("attrs")[name], F.lit("null"))
    return raw.isin("null", '""', "[]")


def predicate(text: str) -> Column:
    """``f=v``, ``f in [a, b]``, ``f exists`` or ``f not_exists``; an absent field equals nothing."""
    text = text.strip()
    if m := re.fullmatch(r"(\w+)\s+(exists|not_exists)", text):
        return ~field_missing(m[1]) if m[2] == "exists" else field_missing(m[1])
    if m := re.fullmatch(r"(\w+)\s+in\s+\[(.*)\]", text):
        values = [v.strip().strip("\"'") for v in m[2].split(",") if v.strip()]
        return F.coalesce(field_text(m[1]).isin(values), F.lit(False))
    if m := re.fullmatch(r"(\w+)\s*={1,2}\s*(.+)", text):
        return F.coalesce(field_text(m[1]) == m[2].strip().strip("\"'"), F.lit(False))
    raise ValueError(f"not a predicate: {text!r}")


def directory(path: Column) -> Column:
    """The directory of a path, empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def sequence_number(path: Column) -> Column:
    """The digits that a file name begins with, null if none or beyond 64 bits."""
    return F.regexp_extract(stem(path), r"^(\d+)", 1).try_cast("decimal(20,0)")


def title_tokens(title: Column, stop_words: tuple[str, ...]) -> Column:
    words = F.filter(F.array_distinct(F.split(F.lower(title), NOT_WORD)), lambda x: F.char_length(x) >= 2)
    return F.array_except(words, F.array(*[F.lit(x) for x in stop_words]) if stop_words else F.array().cast("array<string>"))


def jaccard(target: Column, candidate: Column) -> Column:
    """Null where the target has nothing to compare, 0 where the candidate has nothing."""
    return F.when(F.size(target) > 0, F.size(F.array_intersect(target, candidate)) / F.size(F.array_union(target, candidate)))


def days_since(today, date: Column) -> Column:
    return F.greatest(F.datediff(F.lit(today), date), F.lit(0))


def weighted_mean(parts: list[tuple[float, Column]]) -> Column:
    """The mean of the parts that are not null, by weight, in order; null where their weights sum to 0."""
    total = weight = F.lit(0.0)
    for w, part in parts:
        total = F.when(part.isNotNull(), total + part * w).otherwise(total)
        weight = F.when(part.isNotNull(), weight + w).otherwise(weight)
    return F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / weight)))


def slug(text: Column) -> Column:
    """Letters and digits in lower case with single hyphens between; without any, the start of a digest."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), NOT_WORD, "-"), "^-+|-+$", "")
    return F.when(plain == "", F.substring(F.sha2(text, 256), 1, 12)).otherwise(plain)


def normalized_path(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` parts, ``..`` taking its parent; null where it leaves the root."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: (x != "") & (x != "."))
    start = F.array().cast("array<string>")
    up = lambda a, x: F.when(a.isNull() | ((x == "..") & (F.size(a) == 0)), F.lit(None).cast("array<string>")).when(x == "..", F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, start, up), "/")


def replaced(items: Column, old: str, new: str) -> Column:
    """A list with one value in place of another, each value once and in order."""
    return F.array_distinct(F.transform(items, lambda x: F.when(x == old, F.lit(new)).otherwise(x)))


def one_line(text: Column) -> Column:
    """The text with each run of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def canonical_text(content: Column) -> Column:
    """Content without a byte order mark, its lines ended by single line feeds."""
    return F.regexp_replace(F.regexp_replace(content, "^\ufeff", ""), "\r\n?", "\n")


def begins_with(lines: Column, start: Column) -> Column:
    """Whether a list begins with another one."""
    return F.slice(lines, 1, F.size(start)) == start


def newest(created: Column, reviewed: Column, updated: Column) -> tuple[Column, Column]:
    """The newest of three dates and its name; of equal dates created counts before reviewed before updated."""
    date = F.greatest(created, reviewed, updated)
    return date, F.when(created == date, "created").when(reviewed == date, "reviewed").when(updated == date, "updated")
