"""The shape of answers as JSON Schema, what changed between two shapes, and whether a version number says so."""

from __future__ import annotations

import re

from pyspark.sql import types as T

_PLAIN = {"string": {"type": "string"}, "long": {"type": "integer"}, "integer": {"type": "integer"}, "double": {"type": "number"}, "boolean": {"type": "boolean"}, "date": {"type": "string", "format": "date"}}


def type_schema(kind: T.DataType) -> dict:
    """JSON Schema of a column's values, as ``to_json`` writes them."""
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": type_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": type_schema(kind.valueType)}
    if isinstance(kind, T.StructType):
        return row_schema(kind)
    return dict(_PLAIN.get(kind.typeName(), {"type": "number"} if isinstance(kind, T.NumericType) else {}))


def row_schema(schema: T.StructType) -> dict:
    """JSON Schema of a row; a null column is left out of the row, so only columns never null are required."""
    made = {"type": "object", "properties": {f.name: type_schema(f.dataType) for f in schema.fields}}
    required = sorted(f.name for f in schema.fields if not f.nullable)
    return made | ({"required": required} if required else {})


def envelope_schema(answers: dict[str, T.StructType]) -> dict:
    """One schema for all commands: success with its items by command, or failure."""
    error = {"type": "object", "properties": {"ok": {"const": False}, "error": {"type": "object", "properties": {"code": {"type": "string"}, "message": {"type": "string"}}, "required": ["code", "message"]}}, "required": ["error", "ok"]}
    out = {}
    for name, schema in sorted(answers.items()):
        data = {"type": "object", "properties": {"items": {"type": "array", "items": row_schema(schema)}, "total": {"type": "integer"}, "returned": {"type": "integer"}}, "required": ["items", "total"]}
        out[name] = {"type": "object", "properties": {"ok": {"const": True}, "data": data, "warnings": {"type": "array", "items": {"type": "string"}}}, "required": ["data", "ok"]}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "error": error, "commands": out}


#: Keywords that say nothing about what is valid.
PROSE = ("description", "title", "$comment", "examples", "default", "$schema", "$id", "deprecated")


def schema_diff(old, new, at: str = "") -> list[tuple[str, str, bool]]:
    """(place, change, breaking) between two schemas of what is put out: readers of the old one must find all it promised.

    A promise withdrawn breaks, one gained adds; what is not known to be harmless breaks. Prose doesn't count.
    """
    if old == new:
        return []
    if not isinstance(old, dict) or not isinstance(new, dict):
        return [(at, "another shape", True)]
    out = []
    for key in sorted({*old, *new} - {*PROSE}):
        had, has, here = old.get(key), new.get(key), f"{at}/{key}"
        if had == has:
            continue
        if key in ("properties", "$defs", "commands"):
            had, has = had or {}, has or {}
            out += [(f"{here}/{x}", "removed", True) for x in sorted({*had} - {*has})] + [(f"{here}/{x}", "added", False) for x in sorted({*has} - {*had})]
            for x in sorted({*had} & {*has}):
                out += schema_diff(had[x], has[x], f"{here}/{x}")
        elif key == "required":
            had, has = set(had or ()), set(has or ())
            out += [(f"{here}/{x}", "no longer always there", True) for x in sorted(had - has)] + [(f"{here}/{x}", "always there", False) for x in sorted(has - had)]
        elif key == "enum" and isinstance(had, list) and isinstance(has, list):
            out += [(f"{here}/{x}", "value removed", False) for x in had if x not in has] + [(f"{here}/{x}", "value added", True) for x in has if x not in had]
        elif key == "additionalProperties" and (had is False or has is False):
            out.append((here, "others allowed" if had is False else "others no longer allowed", had is not False))
        elif key == "items" and had is not None and has is not None:
            out += schema_diff(had, has, here)
        elif key in ("oneOf", "anyOf", "allOf") and isinstance(had, list) and isinstance(has, list) and len(had) == len(has):
            for i, (x, y) in enumerate(zip(had, has, strict=True)):
                out += schema_diff(x, y, f"{here}/{i}")
        else:
            out.append((here, f"{had!r} became {has!r}", True))
    return out


def step_covers(before: str, after: str, changes: list[tuple[str, str, bool]]) -> bool:
    """Whether the step between two versions (x.y.z) is as large as the changes ask for.

    Any change asks for more than the last part; from 1.0 on one that breaks asks for the first.
    """
    a, b = (tuple(map(int, re.match(r"(\d+)\.(\d+)\.(\d+)", v).groups())) for v in (before, after))
    if not changes:
        return True
    if a[0] and any(breaking for *_, breaking in changes):
        return b[0] > a[0]
    return b[:2] > a[:2]


def version_matches(requirement: str, version: str) -> bool:
    """Whether a version meets all of comma-separated requirements: ``*``, ``1.*``, ``>=1.2``, ``<2``, ``=1.2.3``, ``~1.2`` or ``^1.2``."""
    have = tuple(map(int, re.match(r"(\d+)\.(\d+)\.(\d+)", version).groups()))
    parts = [x.strip() for x in requirement.split(",")]
    if not all(parts):
        raise ValueError(f"not a version requirement: {requirement!r}")
    for one in parts:
        if re.fullmatch(r"[*xX]", one):
            continue
        m = re.fullmatch(r"(>=|<=|>|<|=|~|\^)?\s*(\d+(?:\.\d+){0,2})((?:\.[*xX]){0,2})", one)
        if not m or m[1] and m[3]:
            raise ValueError(f"not a version requirement: {one!r}")
        op, want = "=" if m[3] else m[1] or "^", tuple(map(int, m[2].split(".")))
        low = (*want, 0, 0)[:3]
        if op in ("~", "^"):
            k = 1 if op == "~" and len(want) > 1 else 0 if op == "~" else next((i for i, x in enumerate(low) if x), len(want) - 1)
            high = (*low[:k], low[k] + 1, 0, 0)[:3]
            good = low <= have < high
        else:
            cut = have[: len(want)] if op in ("=", "<=", ">") else have
            good = {">=": have >= low, "<=": cut <= want, ">": cut > want, "<": have < low, "=": cut == want}[op]
        if not good:
            return False
    return True
