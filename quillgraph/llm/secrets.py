"""Secret scan: pattern matches, and structural confirmation of encoded keys and signed tokens.

Three base kinds are patterns alone (``assign``, ``access``, ``hex``). The structural kinds are reported only
after a candidate has been decoded and its inside parsed:

- ``jwt``: three base64url parts; the first decodes to a JSON object with a text ``alg``, the second to a JSON object. Or
  five parts whose first has a text ``alg`` and ``enc`` and whose others decode (the second may be empty).
- ``pem``: an armoured key whose body is base64 of a key encoding (below) or of an encrypted one.
- ``key``: a bare base64 or hex run, or base64 folded into lines of one width (the last may be shorter), that decodes to a key
  encoding: DER whose nested lengths fill the run exactly (RSA, PKCS#8, EC), or an OpenSSH private key whose nested
  length-prefixed strings stay within it.
- ``nested``: a base64 or hex run that decodes to printable ASCII in which one of the kinds above is confirmed,
  or an access or assign match stands. Runs within are decoded in turn, as deep as they go: each is shorter by a quarter.

Spans are code points, end exclusive. Null and empty text has no spans. Rows with equal texts give equal results;
other columns are neither read nor returned.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.common import table
from quillgraph.llm.text import slices

#: Ties at a start go in this order.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "nested")

_ASSIGN = re.compile(r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
# A run shorter than the bound cannot hold a longer match, so the bound may stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A JSON object's first bytes, white space before or in it, begin so in base64; parsing decides.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])((?:e[yw]|[ICD])[A-Za-z0-9_-]{5,})\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)(?:\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+))?")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
_ARMOUR = re.compile(r"[A-Za-z0-9+/=\s:,\\-]+", re.ASCII)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
#: The first line of a folded key: DER begins with a sequence, OpenSSH's encoding with its name.
_HEAD = re.compile(r"(?<![A-Za-z0-9+/])(?:M|b3BlbnNzaC)[A-Za-z0-9+/]{22,}(?=\r?\n[ \t]*[A-Za-z0-9+/])")
_LINE = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/]+={0,2})")
#: What every run of hex or base64 holds that is looked for; most texts have none, and are read once for all of them.
_ANYRUN = re.compile(r"[A-Za-z0-9+/_-]{24}")
_DOTS = re.compile(r"\.[A-Za-z0-9_-]*\.")
_ANYHEX = re.compile(r"(?:[0-9a-fA-F]{2}){16,}")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long"


def _unbase64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except binascii.Error:
        return None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, and where the content of the element at ``at`` begins and ends; None if it passes ``end``."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill at..end exactly."""
    out = []
    while at < end:
        if (x := _der(data, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


def is_key(data: bytes) -> bool:
    """Whether the bytes are a private key: DER (RSA, PKCS#8 plain or encrypted, EC) or OpenSSH's own encoding."""
    if data.startswith(b"openssh-key-v1\x00"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data) or (at := at + 4 + int.from_bytes(data[at : at + 4], "big")) > len(data):
                return False
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16
    if (top := _der(data, 0, len(data))) is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = _children(data, top[1], top[2])
    if not parts:
        return False
    tags, first = [x[0] for x in parts], data[parts[0][1] : parts[0][2]]
    if tags[0] == 0x02 and len(first) == 1:
        if first[0] in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return True  # RSA: version and eight integers
        if first[0] in (0, 1) and tags[1:3] == [0x30, 0x04]:
            inner = _children(data, parts[1][1], parts[1][2])
            return bool(inner) and inner[0][0] == 0x06  # PKCS#8: an algorithm's identifier, then the key
        return first[0] == 1 and tags[1] == 0x04 and all(t in (0xA0, 0xA1) for t in tags[2:])  # EC
    if tags == [0x30, 0x04]:  # PKCS#8 encrypted
        inner = _children(data, parts[0][1], parts[0][2])
        return bool(inner) and inner[0][0] == 0x06 and data[inner[0][1] : inner[0][2]].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01")
    return False


def _object(part: str) -> dict | None:
    try:
        x = json.loads((_unbase64(part) or b"").decode())
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def _armoured(text: str):
    """Start, end and body of each armoured block; one ends before the next begins, so the text is read once."""
    heads = list(_BEGIN.finditer(text))
    for m, after in zip(heads, [*heads[1:], None], strict=True):
        mark = f"-----END {m[1]}-----"
        end = text.find(mark, m.end(), after.start() if after else len(text))
        if end >= 0 and _ARMOUR.fullmatch(text, m.end(), end):
            yield m.start(), end + len(mark), text[m.end() : end].replace("\\n", "\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the pattern matches."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    if _ANYRUN.search(text):
        out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def _token(m: re.Match) -> int | None:
    """Where the signed or encrypted token of a match ends; None if it is none."""
    head = _object(m[1])
    if not head or not isinstance(head.get("alg"), str):
        return None
    if isinstance(head.get("enc"), str):
        return m.end() if m[5] and all(_unbase64(x) for x in m.groups()[2:]) and (not m[2] or _unbase64(m[2])) else None
    return m.end(3) if _object(m[2]) is not None and (not m[3] or _unbase64(m[3])) else None


def _folded(text: str):
    """Start and end of base64 in lines of one width, the last of them no longer, that is a key; no line is read twice."""
    at = 0
    while m := _HEAD.search(text, at):
        parts, ends, width = [m[0]], [m.end()], len(m[0])
        while len(parts[-1]) == width and (line := _LINE.match(text, ends[-1])) and len(line[1]) <= width:
            parts.append(line[1])
            ends.append(line.end())
        at = ends[-1]
        for k in {len(parts), len(parts) - 1} - {0, 1}:  # the last may be a word of the text
            data = _unbase64("".join(parts[:k]))
            if data and is_key(data):
                yield m.start(), ends[k - 1]
                break


def structural_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of what decoding and parsing confirms."""
    out = []
    for m in _JWT.finditer(text) if _DOTS.search(text) else ():
        if end := _token(m):
            out.append((m.start(), end, "jwt"))
    if "-----BEGIN" in text:
        for start, end, armour in _armoured(text):
            body = "".join(x for x in armour.split("\n") if ":" not in x)
            data = _unbase64("".join(body.split()))
            if data and (is_key(data) or "DEK-Info" in armour and len(data) % 8 == 0):
                out.append((start, end, "pem"))
    if not _ANYRUN.search(text):
        return out
    free = lambda start, end: (i := bisect.bisect_left(starts, end) - 1) < 0 or taken[i][1] <= start
    taken = sorted(out)  # they don't overlap, nor do the matches of one pattern
    starts = [s for s, _, _ in taken]
    out += [(start, end, "key") for start, end in _folded(text) if free(start, end)]
    for pattern, decode in ((_RUN, _unbase64), (_ANYHEX, bytes.fromhex)):
        taken = sorted(out)
        starts = [s for s, _, _ in taken]
        for m in pattern.finditer(text):
            if not free(m.start(), m.end()) or not (data := decode(m[0])):
                continue
            if is_key(data):
                out.append((m.start(), m.end(), "key"))
            elif data.isascii() and (inside := data.decode()).replace("\n", "").replace("\r", "").replace("\t", "").isprintable():
                if structural_spans(inside) or any(k != "hex" for *_, k in base_spans(inside)):
                    out.append((m.start(), m.end(), "nested"))
    return out


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan_text(text: str | None) -> tuple:
    """Counts of the base kinds, the digest of the base spans, all spans, and the count of structural ones."""
    base = base_spans(text or "")
    more = structural_spans(text or "")
    kinds = [k for *_, k in base]
    joined = _join(base)
    return (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined.encode()).hexdigest(), _join(base + more) if more else joined, len(more))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), with counts, digest and spans; no shuffle."""

    def scan(batches):
        for batch in slices(batches):
            rows = [scan_text(x) for x in batch.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if i in (3, 4) else pa.int64()) for i, c in enumerate(columns))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_structural"])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op1_secret_scan": op1_secret_scan}
SQL: dict[str, str] = {}
