"""Quality rules as a short-circuit cascade, in DataFrame and SQL functions only.

Each rule is a SQL condition over named features of a text; a row is rejected by the first rule that holds. Before
the main pass every rule runs alone over a bounded sample: its seconds beyond those of a rule that reads nothing are its
cost, the share it rejects its selectivity. A rule too quick to be told from the job around it runs over the sample
``REPEATS`` times in one job. The cascade then tries rules by rejection per cost, and CASE evaluates a feature of a later,
dearer rule only for rows that no earlier rule rejected. Features that a query returns anyway are computed before, cost
nothing in the cascade and are timed so. The order decides cost alone: a row is kept exactly if no rule holds, whatever
the order.

A word is ``[^\x20\x09-\x0D]+``. Null and empty text has no words and fails ``short``. Equal texts get equal
results; no column but the text is read. Repeated windows are found by 64-bit hashes within one text. An empty table gives
an empty one, with rules in any order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import fresh, table

#: Bounds of the sample on which costs and selectivities are estimated: so many rows, of texts no longer than so many bytes.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 1 << 15
#: A rule that takes less than so many seconds on the sample is timed over so many runs of it.
BRIEF, REPEATS = 0.15, 8

WORDS = r"filter(split(coalesce({text}, ''), '[ \\t\\n\\x0B\\f\\r]+'), x -> x != '')"

_LINES = r"filter(split(coalesce({text}, ''), '\n'), x -> x rlike '[^ \\t\\n\\x0B\\f\\r]')"

#: n: positions of words in 3-word windows that occur twice or more. Windows are sorted by hash, the positions of those
#: with an equal neighbour are sorted again, and each adds the words up to the next such window, three at most.
_REPEATS = """
if(size({words}) < 4, 0L, element_at(transform(array(transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))), h ->
  if(size(array_distinct(h)) = size(h), 0L, element_at(transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
    element_at(transform(array(sort_array(transform(filter(s, (a, i) -> (i > 0 AND s[i - 1].x = a.x) OR (i + 1 < size(s) AND s[i + 1].x = a.x)), a -> a.i))), p ->
      aggregate(transform(p, (a, i) -> if(i + 1 < size(p), least(3, p[i + 1] - a), 3)), 0L, (t, a) -> t + a)), 1)), 1))), 1))
"""

#: SQL of each feature, given {text} and {words}.
FEATURES = {
    "n_words": "CAST(size({words}) AS BIGINT)",
    "word_chars": "CAST(char_length(array_join({words}, '')) AS BIGINT)",
    "n_symbols": "CAST(regexp_count(coalesce({text}, ''), '[#*$%&|<>]') AS BIGINT)",
    "n_exclaims": "CAST(regexp_count(coalesce({text}, ''), '!') AS BIGINT)",
    "n_lines": f"CAST(size({_LINES}) AS BIGINT)",
    "n_dup_lines": f"element_at(transform(array({_LINES}), l -> CAST(size(l) - size(array_distinct(l)) AS BIGINT)), 1)",
    "n_repeat_words": _REPEATS,
}


@dataclass(frozen=True)
class Rule:
    """A name, and a SQL condition over {features} under which a row is rejected."""

    name: str
    rejects: str


#: The first and the third are the base; the others reject text that is mostly marks, shouting, copies of lines or no words.
RULES = (
    Rule("short", "{n_words} < 50"),
    Rule("symbols", "10 * {n_symbols} > 3 * {n_words}"),
    Rule("repeats", "100 * {n_repeat_words} > 50 * {n_words}"),
    Rule("exclaims", "10 * {n_exclaims} > 3 * {n_words}"),
    Rule("dup_lines", "{n_dup_lines} > 0 AND 2 * {n_dup_lines} > {n_lines}"),
    Rule("word_length", "{word_chars} < 2 * {n_words} OR {word_chars} > 15 * {n_words}"),
)
BASE = ("short", "repeats")


def feature_sql(text: str, words: str, given: dict[str, str] | None = None) -> dict[str, str]:
    """SQL of each feature; ``given`` has that of features computed before."""
    return {k: f"({v.format(text=text, words=words)})" for k, v in FEATURES.items()} | (given or {})


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS, given: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost on a sample of at most ``sample_rows`` rows, with cost in seconds and share rejected.

    The features ``given`` are computed before any rule is timed, as the words are. The sample is the first rows that Spark
    finds, partition after partition until there are enough; it passes through the driver, within its bounds, so that the
    rest of the table is neither read nor shuffled for it.
    """
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).where(F.octet_length("_text") <= SAMPLE_BYTES)
    found = docs.sparkSession.createDataFrame(texts.limit(sample_rows).collect(), "_text string").select("_text", F.expr(WORDS.format(text="_text")).alias("_words"))
    features = feature_sql("_text", "_words")
    sample = found.select("*", *(F.expr(features[k]).alias(f"_{k}") for k in given)).persist()
    features |= {k: f"_{k}" for k in given}

    def timed(condition: str, times: int) -> tuple[float, int]:
        rows = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_run")) if times > 1 else sample
        tried = rows.agg(F.count_if(F.expr(condition)))
        hits = tried.first()[0]  # compiles it
        began = time.perf_counter()
        tried.first()
        return time.perf_counter() - began, hits

    try:
        n = sample.count()
        idle = {k: timed("octet_length(_text) < 0", k)[0] for k in (1, REPEATS)}
        measured = []
        for i, rule in enumerate(rules):
            condition, times = rule.rejects.format_map(features), 1
            took, hits = timed(condition, 1)
            if took - idle[1] < BRIEF:
                times = REPEATS
                took, _ = timed(condition, times)
            measured.append((max(1e-6, (took - idle[times]) / times), hits / max(1, n), i, rule))
    finally:
        sample.unpersist()
    measured.sort(key=lambda x: (-x[1] / x[0], x[0], x[2]))
    return [(rule, cost, share) for cost, share, _, rule in measured]


def cascade(order: list[Rule], features: dict[str, str]) -> str:
    """SQL of the first rule's name that holds, null if none does; later conditions run only where earlier ones failed."""
    return "CASE " + " ".join(f"WHEN {r.rejects.format_map(features)} THEN '{r.name}'" for r in order) + " END" if order else "CAST(NULL AS STRING)"


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", reason: str = "reason") -> DataFrame:
    """``docs`` with the rule that rejects each row (null: kept), by the cascade; one pass, no shuffle."""
    order = [r for r, _, _ in order_rules(docs, rules, text)]
    return docs.withColumn(reason, F.expr(f"element_at(transform(array({WORDS.format(text=f'`{text}`')}), w -> {cascade(order, feature_sql(f'`{text}`', 'w'))}), 1)"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects; null and empty texts go, rows of equal text stay or go together."""
    (reason,) = fresh(docs, "_reason")
    return apply_rules(docs, reason=reason).where(F.col(reason).isNull()).drop(reason)


#: Features that the query returns, so that it computes them for every row; the cascade computes the others as it needs them.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = [r for r, _, _ in order_rules(docs, given=RETURNED)]
    features = feature_sql("text", "w")
    fields = ", ".join(f"'{k}', {features[k]}" for k in RETURNED)
    lazy = feature_sql("text", "w", {k: f"f.{k}" for k in RETURNED})
    found = docs.select("doc_id", F.expr(f"element_at(transform(array({WORDS.format(text='text')}), w -> element_at(transform(array(named_struct({fields})), f -> struct(f, {cascade(order, lazy)} AS reason)), 1)), 1)").alias("x"))
    base = " OR ".join(r.rejects.format_map({k: f"x.f.{k}" for k in RETURNED}) for r in RULES if r.name in BASE)
    return found.select("doc_id", *(F.expr(f"x.f.{k}").alias(k) for k in RETURNED), F.expr(base).alias("base_failed"), F.expr("x.reason IS NULL").alias("kept"))


_SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"
_SQL_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]'))"
#: Columns of each of ``source``'s rows, features and verdict, all columns of the source first.
FEATURE_SQL = f"""
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_exclaims > 3 * n_words
       OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM (SELECT * EXCLUDE (w, l, t, d),
  CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) AS BIGINT) AS n_exclaims,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(len(list_distinct(flatten(list_transform(list_filter(range(1, len(w) - 1), lambda i: d[t[i]] > 1), lambda i: [i, i + 1, i + 2])))) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, CASE WHEN len(t) > 0 THEN list_histogram(t) END AS d
    FROM (SELECT *, list_transform(range(1, greatest(1, len(w) - 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS t
      FROM (SELECT *, {_SQL_WORDS} AS w, {_SQL_LINES} AS l FROM {{source}}))))
"""

QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL = {"op2_quality_rules": "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM (" + FEATURE_SQL.format(source="documents") + ")"}
