"""Language identification by cross-parsing entropy over suffix automata.

For each language the labelled sample text becomes a suffix automaton. A text is parsed against it greedily: each phrase is
the longest match from where the last one ended, or one class that the sample lacks; so a text costs few phrases in its own
language. Phrases times the logarithm of the sample's length estimate the text's cross entropy; the language with the least
wins, ties going to the first by name. ``score`` is the runner-up's lead, 1 - least / second least, and 1 where there is one
language alone.

Whole texts are parsed, each as one sequence. Automata are dense tables over a reduced alphabet (letters in lower case,
bytes of UTF-8 sequences, one class for everything else). Stretches of ``STRETCH`` bytes of all texts of a batch are parsed in
step, each from the state that the ``LEAD`` bytes before it suggest; then those whose state turns out to be another when the
stretch before them ends are parsed again from that state, until all agree with their neighbours. A text that still
doesn't after ``PASSES`` is walked byte by byte. So stretches change the time alone, not the result.

The sample is bounded by parameters of ``fit``: at most ``rows`` different texts for each language, the least by a hash, with
those of ``MIN_BYTES`` to ``MAX_BYTES`` bytes before shorter and longer ones, of which the first ``MAX_BYTES`` characters count;
and the first ``sample_bytes`` bytes of these together, less where more than ``total_bytes / sample_bytes`` languages share
``total_bytes``. Null text, text without a letter, and any text where nothing could be learned gets ``und`` with score 0.
Equal texts get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import fold, table
from quillgraph.llm.text import LOWER, buffers, slices

ROWS = 64
MIN_BYTES, MAX_BYTES = 200, 8192
SAMPLE_BYTES = 24_000
#: Bytes of the samples of all languages together: 600 KB make automata of about 200 MB.
TOTAL_BYTES = 600_000
STRETCH, LEAD, PASSES = 256, 48, 3
_ENDS = 29  #: the bits of a table's entry that count ended phrases
_STATE = (1 << _ENDS) - 1


def suffix_automaton(values: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the root."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in values:
        now = len(move)
        move.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = now
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return move


class Model:
    """An alphabet, and for each language a table: where a class leads from a state, negative if a phrase ends before it."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        used = np.zeros(256, bool)
        for text in samples.values():
            used[LOWER[np.frombuffer(text, np.uint8)]] = True
        letters = np.flatnonzero(used & ((np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) < 123))))
        classes = np.zeros(256, np.int64)  # 0: everything that is no letter
        classes[128:] = len(letters) + 1  # bytes that no sample has
        classes[letters] = np.arange(1, len(letters) + 1)
        self.classes = classes[LOWER].astype(np.int32)
        self.still = len(letters) + 2  # the class of padding, which moves nothing
        self.width = len(letters) + 3
        self.tables, self.weights = [], []
        for lang in self.langs:
            values = self.classes[np.frombuffer(samples[lang], np.uint8)].tolist()
            move = suffix_automaton(values)
            root = np.zeros(self.width, np.int64)
            for c, to in move[0].items():
                root[c] = to
            to_state, ends = np.tile(root, (len(move), 1)), np.ones((len(move), self.width), np.int64)
            for state, to in enumerate(move):
                if to:
                    to_state[state, list(to)], ends[state, list(to)] = list(to.values()), 0
            ends[0] = 0  # at the root no phrase is open
            unseen = [c for c in range(self.width) if c not in move[0] and c != self.still]
            to_state[:, unseen], ends[1:, unseen], ends[0, unseen] = 0, 2, 1  # a class without a match is a phrase of its own
            to_state[:, self.still], ends[:, self.still] = np.arange(len(move)), 0
            self.tables.append((to_state * self.width | ends << _ENDS).astype(np.int32).ravel())
            self.weights.append(np.log2(max(2, len(values))))

    def _run(self, move: np.ndarray, grid: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases ended and last state of each column of ``grid``, from ``state``."""
        n = grid.shape[1]
        state, at, ended, total = state.copy(), np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(n, np.int32)
        for row in grid:
            np.add(state, row, out=at)
            np.take(move, at, out=state, mode="clip")
            np.right_shift(state, _ENDS, out=ended)
            np.add(total, ended, out=total)
            np.bitwise_and(state, _STATE, out=state)
        return total, state

    def phrases(self, move: np.ndarray, grid: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
        """Phrases of each text, whose stretches are the columns of ``grid`` with its number in ``doc``."""
        n = grid.shape[1]
        follows = np.concatenate([[False], doc[1:] == doc[:-1]])
        start = np.zeros(n, np.int32)
        lane = np.flatnonzero(follows)
        if len(lane):
            start[lane] = self._run(move, np.ascontiguousarray(grid[-LEAD:, lane - 1]), np.zeros(len(lane), np.int32))[1]
        total, last = self._run(move, grid, start)
        for turn in range(PASSES + 1):
            due = np.where(follows, np.concatenate([[0], last[:-1]]), 0)
            wrong = np.flatnonzero(due != start)
            if not len(wrong) or turn == PASSES:
                break
            start[wrong] = due[wrong]
            total[wrong], last[wrong] = self._run(move, np.ascontiguousarray(grid[:, wrong]), start[wrong])
        if len(wrong):
            table = memoryview(move)
            i = int(wrong[0])
            while i < n:  # the stretches after a wrong one, while their start is another
                state = int(last[i - 1]) if follows[i] else 0
                if state != start[i]:
                    start[i], ends = state, 0
                    for c in grid[:, i].tolist():
                        entry = table[state + c]
                        ends += entry >> _ENDS
                        state = entry & _STATE
                    total[i], last[i] = ends, state
                i += 1
        end = np.concatenate([~follows[1:], [True]])
        return np.bincount(doc, total + (end & (last != 0)), n_docs)  # the phrase open at the end

    def costs(self, column: pa.Array) -> np.ndarray:
        """Weighted phrases of each text (rows) for each language (columns)."""
        data, places = buffers(column)
        sizes = np.diff(places)
        count = -(-sizes // STRETCH)
        first = np.cumsum(count) - count
        n = int(count.sum())
        if not n:
            return np.zeros((len(sizes), len(self.langs)))
        grid = np.full(n * STRETCH, self.still, np.int32)
        grid[np.arange(len(data)) + np.repeat(first * STRETCH - places[:-1], sizes)] = self.classes[data]
        grid = np.ascontiguousarray(grid.reshape(n, STRETCH).T)
        doc = np.repeat(np.arange(len(sizes)), count)
        return np.stack([self.phrases(move, grid, doc, len(sizes)) * weight for move, weight in zip(self.tables, self.weights, strict=True)], axis=1)

    def predict(self, column: pa.Array, known: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and score of each text; ``known``: whether it has a letter."""
        if not self.langs:
            return ["und"] * len(column), np.zeros(len(column))
        costs = self.costs(column)
        best = costs.argmin(axis=1)
        if len(self.langs) > 1:
            two = np.partition(costs, 1, axis=1)
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
        else:
            score = np.ones(len(column))
        return [self.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(score, 0, 1), 0.0)


def fit(labelled: DataFrame, rows: int = ROWS, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> Model:
    """A model of the bounded sample of ``labelled`` (text, lang; nulls don't count); copies of a text count once."""
    texts = labelled.where("lang IS NOT NULL AND octet_length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    other = F.expr(f"octet_length(text) NOT BETWEEN {MIN_BYTES} AND {MAX_BYTES}").alias("other")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("other", "h"))
    chosen = texts.select("lang", other, "h").distinct().withColumn("r", rank).where(f"r <= {rows}").drop("other")
    # few rows: ``rows`` for each language
    found = texts.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "r").agg(F.min(F.substring("text", 1, MAX_BYTES)).alias("text"))
    held: dict[str, list[str]] = {}
    for row in found.orderBy("lang", "r").toLocalIterator():
        held.setdefault(row.lang, []).append(row.text)
    size = min(sample_bytes, total_bytes // max(1, len(held)))
    return Model({lang: "\n".join([*x, ""]).encode()[:size] for lang, x in held.items() if any(c.isalpha() for t in x for c in t)})


def identify(docs: DataFrame, model: Model, *columns) -> DataFrame:
    """doc_id, ``columns``, lang_pred and score of each row of ``docs`` (doc_id, text); no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", *columns, F.coalesce(F.expr(r"text rlike '\\p{L}'"), F.lit(False)).alias("_known"), "text")
    kept = rows.drop("_known", "text").schema

    def scan(batches):
        for batch in slices(batches):
            known = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            lang, score = held.value.predict(batch.column(batch.num_columns - 1), known)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-2], "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    return rows.mapInArrow(scan, StructType([*kept.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = fit(docs.where(~held_out).select("text", "lang"))
    return identify(docs, model, held_out.alias("held_out"))


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
