"""Mixing to target weights by iterative proportional fitting.

Documents fall into cells by source, language and topic. Token weights of the cells are raked: scaled to the source
marginal, then the language marginal, then the topic marginal, round after round, from the tokens that there are. No cell
can give more tokens than it holds, so each round ends by cutting weights at ``cell tokens / budget tokens``; the next
round's scaling shares what was cut among the other cells. Each step is a projection, so where some mix within these bounds
meets all targets the weights come to meet them. A document of a cell is then sampled with probability ``budget tokens *
cell weight / cell tokens``. Whether a document is taken depends on its identifier, the seed and its cell's probability
alone, so repeated runs and retried tasks agree.

Targets that a marginal's own tokens can't reach are cut first, and the rest shared among its other values (``reachable``).
Targets that can be reached one by one but not together are missed, by as little as the rounds leave; ``achieved`` gives
each target, what is reachable of it, and the share that the sample has.

Targets name the values of each marginal; every other value, null included, counts as ``other``. So the targets bound the
number of cells (``MAX_CELLS``), whatever the size of the corpus. Targets of values that no document has are shared out among
the others in proportion. The topic is an SQL expression over the text; the default counts the terms of each topic, the most
frequent topic wins, the first of equals, and a text without any term is prose. Tokens are words ``[^\x20\x09-\x0D]+``; a
text counts one at least, so that empty and null texts are sampled too. Documents of the same identifier and cell are taken
or left together. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import Scratch, fresh, own, table
from quillgraph.llm.quality import _SQL_WORDS, WORDS

ROUNDS = 60
MAX_CELLS = 1_000_000
SEED = "mix-1"
OTHER = "other"
#: Share of the corpus's tokens to take.
BUDGET = 0.6

#: Terms of each topic, as patterns that Java and RE2 read alike, and the topic of texts without any.
TOPICS = {"tabular": " [|] ", "contact": "@[A-Za-z0-9-]+[.][A-Za-z]", "notice": "[Ll]icen[cs]|[Cc]opyright|[Pp]ermission", "shouting": "!!+"}
PLAIN = "prose"


def topic_sql(topics: dict[str, str] = TOPICS, plain: str = PLAIN) -> str:
    """The topic whose terms the text has most of, the first of equals."""
    counts = ", ".join(f"regexp_count(coalesce(text, ''), '{x}')" for x in topics.values())
    names = ", ".join(f"'{x}'" for x in topics)
    return f"element_at(transform(array(array({counts})), c -> CASE WHEN array_max(c) = 0 THEN '{plain}' ELSE element_at(array({names}), CAST(array_position(c, array_max(c)) AS INT)) END), 1)"


TARGETS = {
    "source": {"src0": 0.08} | {f"src{i}": 0.91 / 19 for i in range(1, 20)} | {OTHER: 0.01},
    "lang": {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.1, OTHER: 0.01},
    "topic": {"prose": 0.89, "tabular": 0.04, "contact": 0.02, "notice": 0.035, "shouting": 0.015},
}


def reachable(goal: np.ndarray, most: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``goal``, 1 in sum, cut at ``most``, with what was cut shared among the others in proportion."""
    goal = np.minimum(goal, most)
    for _ in range(rounds):
        free = goal < most
        have = goal[free].sum()
        if have > 0:
            goal = np.minimum(np.where(free, goal + goal * (1 - goal.sum()) / have, goal), most)
    return goal


def rake(tokens: np.ndarray, cells: list[tuple[str, ...]], targets: list[dict[str, float]], rounds: int = ROUNDS, budget: float = 0.0) -> np.ndarray:
    """Weights of the cells, with the targets as marginals as near as the cells and their tokens allow: none above
    its share of the tokens divided by ``budget`` (0: no such bound)."""
    weights = tokens / max(1, tokens.sum())
    most = weights / budget if budget else np.full(len(weights), np.inf)
    sides = []
    for k, target in enumerate(targets):
        names, which = np.unique([c[k] for c in cells], return_inverse=True)
        goal = np.array([target.get(str(n), 0.0) for n in names])
        if goal.sum() > 0:
            sides.append((which, reachable(goal / goal.sum(), np.bincount(which, most, len(goal)))))
    for _ in range(rounds):
        for which, goal in sides:
            have = np.bincount(which, weights, len(goal))
            weights = weights * np.divide(goal, have, out=np.zeros(len(goal)), where=have > 0)[which]
        weights = np.minimum(weights, most)
    return weights


def _class(column, names: dict[str, float]):
    """The value, or ``other`` for null and values without a target; the column is evaluated once."""
    known = [x for x in names if x != OTHER]
    return F.element_at(F.transform(F.array(column), lambda x: F.when(x.isin(known), x).otherwise(F.lit(OTHER))), 1)


def _cells(docs: DataFrame, targets: dict[str, dict[str, float]], topic: str) -> list:
    if np.prod([len(x) + 1 for x in targets.values()]) > MAX_CELLS:
        raise ValueError(f"the targets span more than {MAX_CELLS} cells")
    return [_class(F.col("source"), targets["source"]).alias("_source"), _class(F.col("lang"), targets["lang"]).alias("_lang"), _class(F.expr(topic), targets["topic"]).alias("_topic")]


def probabilities(light: DataFrame, targets: dict[str, dict[str, float]], budget: float) -> DataFrame:
    """One row per cell of ``light`` (_source, _lang, _topic, n_tokens): its weight and its probability."""
    rows = light.groupBy("_source", "_lang", "_topic").agg(F.sum("n_tokens").alias("t")).orderBy("_source", "_lang", "_topic").collect()
    tokens = np.array([r.t for r in rows], float)
    weights = rake(tokens, [tuple(r)[:3] for r in rows], [targets["source"], targets["lang"], targets["topic"]], budget=budget)
    p = np.minimum(1.0, budget * tokens.sum() * weights / np.maximum(tokens, 1))
    schema = "_source string, _lang string, _topic string, weight double, probability double"
    return light.sparkSession.createDataFrame([(*tuple(r)[:3], float(w), float(x)) for r, w, x in zip(rows, weights, p, strict=True)], schema)


def _tokens():
    return F.greatest(F.lit(1), F.size(F.expr(WORDS.format(text="text")))).cast("long")


def _unit(seed: str):
    """A number in [0, 1) from the identifier."""
    digest = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, topic: str = topic_sql(), budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, that the sample takes; the text is read twice and not shuffled."""
    cells = _cells(docs, targets, topic or topic_sql())
    p = probabilities(docs.select(*cells, _tokens().alias("n_tokens")), targets, budget)
    cell, chance = fresh(docs, "_cell", "_chance")
    p = p.select(F.struct("_source", "_lang", "_topic").alias(cell), F.col("probability").alias(chance))
    rows = docs.select(*own(docs), F.struct(*cells).alias(cell)).join(F.broadcast(p), cell)  # a row per cell: at most MAX_CELLS
    return rows.where(_unit(seed) < F.col(chance)).select(*own(docs))


def achieved(mix: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """side, value, target, reachable and share of the tokens taken, for each value of each marginal of ``mix``, the rows of
    ``op4_mixing``; an empty table gives none."""
    out = None
    for side, column in (("source", "source_class"), ("lang", "lang_class"), ("topic", "topic")):
        taken = F.sum(F.when(F.col("taken"), F.col("n_tokens")).otherwise(0))
        rows = mix.groupBy(F.col(column).alias("value")).agg(F.sum("n_tokens").alias("n"), taken.alias("t")).orderBy("value").collect()  # a row per target
        if not rows:
            continue
        n, t = np.array([r.n for r in rows], float), np.array([r.t for r in rows], float)
        goal = np.array([targets[side].get(r.value, 0.0) for r in rows])
        goal = goal / goal.sum() if goal.sum() else goal
        can = reachable(goal, n / n.sum() / budget)
        part = mix.sparkSession.createDataFrame([(side, r.value, float(g), float(c), float(x)) for r, g, c, x in zip(rows, goal, can, t / max(1, t.sum()), strict=True)], "side string, value string, target double, reachable double, share double")
        out = part if out is None else out.union(part)
    return out if out is not None else mix.sparkSession.createDataFrame([], "side string, value string, target double, reachable double, share double")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the sample takes; null and empty texts count one token, and null sources and languages as other."""
    return mixed(docs)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, its cell, the cell's weight and probability, and whether the document is taken."""
    docs = table(spark, sf_dir, "documents")
    light = Scratch(spark, "mixing").keep(docs.select("doc_id", _tokens().alias("n_tokens"), *_cells(docs, TARGETS, topic_sql())))
    rows = light.join(F.broadcast(probabilities(light, TARGETS, BUDGET)), ["_source", "_lang", "_topic"])
    return rows.select("doc_id", "n_tokens", F.col("_source").alias("source_class"), F.col("_lang").alias("lang_class"), F.col("_topic").alias("topic"), F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), (_unit(SEED) < F.col("probability")).alias("taken"))


def _sql() -> str:
    listed = lambda k: ", ".join(f"'{x}'" for x in TARGETS[k] if x != OTHER)
    named = ", ".join(f"'{x}'" for x in TARGETS["topic"] if x != OTHER)
    step = "SELECT * EXCLUDE (w), w * {goal} / sum(w) OVER (PARTITION BY {key}) AS w FROM ({source})"
    source = f"SELECT s, l, t, n, gs, gl, gt, m, k + 1 AS k, w FROM raked WHERE k < {ROUNDS}"
    for key, goal in (("s", "gs"), ("l", "gl"), ("t", "gt")):
        source = step.format(key=key, goal=goal, source=source)

    def goals(key: str, side: str) -> str:
        values = ", ".join(f"('{x}', {w!r}::DOUBLE)" for x, w in TARGETS[side].items())
        held = f"SELECT v, g / sum(g) OVER () AS g, m FROM (VALUES {values}) AS g(v, g) JOIN (SELECT {key} AS v, sum(n / total / {BUDGET}) AS m FROM cell GROUP BY ALL) USING (v)"
        more = "CASE WHEN g < m THEN coalesce(g + g * (1 - sum(g) OVER ()) / nullif(sum(CASE WHEN g < m THEN g END) OVER (), 0), g) ELSE g END"
        return f"g{key}k AS (SELECT v, least(g, m) AS g, m, 0 AS k FROM ({held}) UNION ALL SELECT v, least({more}, m), m, k + 1 FROM g{key}k WHERE k < {ROUNDS}), g{key} AS (SELECT v, g FROM g{key}k WHERE k = {ROUNDS})"

    counts = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{x}'))" for x in TOPICS.values())
    names = ", ".join(f"'{x}'" for x in TOPICS)
    topic = f"CASE WHEN list_max(c) = 0 THEN '{PLAIN}' ELSE ([{names}])[list_position(c, list_max(c))] END"
    return f"""
WITH RECURSIVE counted AS (SELECT doc_id, source, lang, greatest(1, len({_SQL_WORDS}))::BIGINT AS n_tokens, [{counts}] AS c FROM documents),
light AS (
  SELECT doc_id, n_tokens,
    CASE WHEN source IN ({listed("source")}) THEN source ELSE '{OTHER}' END AS s, CASE WHEN lang IN ({listed("lang")}) THEN lang ELSE '{OTHER}' END AS l,
    CASE WHEN ({topic}) IN ({named}) THEN ({topic}) ELSE '{OTHER}' END AS t FROM counted),
cell AS (SELECT s, l, t, n, sum(n) OVER () AS total FROM (SELECT s, l, t, sum(n_tokens)::DOUBLE AS n FROM light GROUP BY ALL)),
{goals("s", "source")},
{goals("l", "lang")},
{goals("t", "topic")},
raked AS (
  SELECT s, l, t, n, gs.g AS gs, gl.g AS gl, gt.g AS gt, n / total / {BUDGET} AS m, 0 AS k, n / total AS w FROM cell JOIN gs ON gs.v = s JOIN gl ON gl.v = l JOIN gt ON gt.v = t
  UNION ALL SELECT s, l, t, n, gs, gl, gt, m, k, least(w, m) FROM ({source})),
final AS (SELECT s, l, t, w, least(1.0, {BUDGET} * sum(n) OVER () * w / greatest(n, 1)) AS p FROM raked WHERE k = {ROUNDS})
SELECT doc_id, n_tokens, s AS source_class, l AS lang_class, t AS topic, round(w, 9) AS weight, round(p, 9) AS probability,
  ('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE / {1 << 52}::DOUBLE < p AS taken
FROM light JOIN final USING (s, l, t)"""


QUERIES = {"op4_mixing": op4_mixing}
SQL = {"op4_mixing": _sql()}
