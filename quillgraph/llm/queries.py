"""All queries of the subpackage, and their SQL."""

from __future__ import annotations

from quillgraph.llm import decontaminate, langid, lm, mixing, neardup, quality, secrets, sharding, sstable, toxicity

_MODULES = (secrets, quality, sharding, decontaminate, neardup, sstable, langid, toxicity, lm, mixing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
