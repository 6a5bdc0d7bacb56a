"""Benchmark decontamination with suffix arrays over the training text.

Each task builds, for every piece of the corpus it reads, a suffix array over words: the positions whose following
words can begin a benchmark window (their word pairs all occur in the benchmark), sorted by the words that follow.
Every suffix of every benchmark item is binary-searched in it; the range it spans gives all verbatim places. Windows
found at consecutive places of the same item join into longest matches. The corpus is read once and not shuffled.

The benchmark is the stated query set: it is made into blocks of about ``BLOCK_WORDS`` words each on the executors, files in
the shared folder, and all blocks are searched in all texts. A worker holds ``HELD`` blocks, or one more than its texts
need at a time; so its memory doesn't grow with the benchmark, and a benchmark of few blocks is read once.

A window is 13 consecutive words of an item; an item with fewer words, but not none, is one window. Words are
``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z, compared by 64-bit hashes. Null and empty texts have no words and
no hits; a null item_id counts as the empty name, and rows of equal item_id as one item. An empty benchmark hits nothing.

``contaminated`` asks for hits on a twentieth of the document's words. ``affected`` is what ``decontaminate`` removes: every
document with one whole window of ``WINDOW`` words, however long the document is, and every contaminated one. So an item of
fewer words, which may be a common phrase, removes only documents of which it is a twentieth. Equal texts get equal results.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import arrow_uri, read_file, shared_dir, table, write_file
from quillgraph.llm.text import ALNUM, Words, distinct, pairs, slices

WINDOW = 13
#: Words of the benchmark in one block: about 30 MB with its windows; and blocks that a worker remembers.
BLOCK_WORDS, HELD = 1 << 18, 4
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_words long, longest_item string, longest_at long, affected boolean"


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted ``known``, -1 where it is absent."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _keys(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` ids from each place on as one byte string whose order is that of the ids."""
    rows = ids[at[:, None] + np.arange(size)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * size}").ravel()


class Block:
    """Part of the benchmark: its words, word pairs, and distinct windows with the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        words = Words(pa.array([text for _, text in items], pa.string()), ALNUM)
        self.vocabulary = distinct(words.hash)
        ids = _member(words.hash, self.vocabulary) + 1
        two = np.concatenate([pairs(words.hash[a : max(a, b - 1)], words.hash[a + 1 : b]) for a, b in zip(words.first, words.first[1:], strict=False)]) if items else np.zeros(0, np.uint64)
        self.pairs = distinct(two)
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for item, (a, b) in enumerate(zip(words.first, words.first[1:], strict=False)):
            size = min(window, b - a)
            if size:
                spans.setdefault(int(size), []).append((item, a, b - size + 1))
        #: size: sorted distinct windows; where each one's holders begin, with the end last; holders' items and offsets.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in spans.items():
            at = np.concatenate([np.arange(a, b) for _, a, b in parts])
            item = np.concatenate([np.full(b - a, i) for i, a, b in parts])
            offset = np.concatenate([np.arange(b - a) for _, a, b in parts])
            keys, group = np.unique(_keys(ids, at, size), return_inverse=True)
            order = np.argsort(group, kind="stable")
            first = np.searchsorted(group[order], np.arange(len(keys) + 1))
            self.windows[size] = (keys, first, item[order], offset[order])


class Stored:
    """A block in a file."""

    known: dict[tuple[str, str], Block] = {}

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name

    @property
    def value(self) -> Block:
        key = (self.folder, self.name)
        if key not in self.known:
            while len(self.known) >= HELD:
                self.known.pop(next(iter(self.known)))
            self.known[key] = pickle.loads(read_file(*key))
        return self.known[key]


def blocks(bench: DataFrame, window: int = WINDOW, size: int = BLOCK_WORDS) -> list[Stored]:
    """The benchmark in blocks of about ``size`` words, or of one item."""
    spark = bench.sparkSession
    rows = bench.selectExpr("coalesce(cast(item_id AS string), '') AS i", "coalesce(text, '') AS t").where("t != ''")
    words = rows.agg(F.sum(F.floor(F.length("t") / 2) + 1)).first()[0]  # at most
    if not words:
        return []
    n = -(-words // size)
    folder = arrow_uri(spark, f"{shared_dir(spark)}/benchmark-{uuid.uuid4().hex}")

    def build(batches):
        items, b = [], None
        for batch in batches:
            for b, i, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                items.append((i, t))
        if items:
            write_file(folder, f"block-{b}", pickle.dumps(Block(sorted(items), window)))
            yield pa.RecordBatch.from_arrays([pa.array([f"block-{b}"])], ["name"])

    made = rows.select(F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int").alias("b"), "i", "t").repartitionById(n, "b").mapInArrow(build, "name string")
    return [Stored(folder, r.name) for r in made.orderBy("name").collect()]


def _spread(first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of ``which`` all places first[w]:first[w + 1]: the entry's index, and the place."""
    count = first[which + 1] - first[which]
    index = np.repeat(np.arange(len(which)), count)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[which], count)


def search(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places of the block's windows: word position, size, item, offset within the item."""
    n = len(words.hash)
    ids = _member(words.hash, block.vocabulary) + 1
    doc_end = np.repeat(words.first[1:], np.diff(words.first))
    good = np.zeros(n, bool)
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)) if n > 1 else np.zeros(0, np.int64)
    good[both] = _member(pairs(words.hash[both], words.hash[both + 1]), block.pairs) >= 0
    stop = np.flatnonzero(~good)  # good pairs run from a position to the next stop
    reach = stop[np.searchsorted(stop, np.arange(n))] if n else stop
    reach = np.minimum(reach + 1, doc_end)
    found = []
    for size, (keys, first, item, offset) in block.windows.items():
        at = np.flatnonzero((ids > 0) & (reach - np.arange(n) >= size))
        if not len(at):
            continue
        suffixes = _keys(ids, at, size)
        order = np.argsort(suffixes, kind="stable")  # the suffix array
        suffixes, at = suffixes[order], at[order]
        low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
        hit = np.flatnonzero(high > low)
        count = high[hit] - low[hit]
        window = np.repeat(hit, count)
        place = at[np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)]
        index, holder = _spread(first, window)
        found.append((place[index], np.full(len(index), size), item[holder], offset[holder]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def judge(column: pa.Array, held: list, window: int = WINDOW) -> list[tuple]:
    """For each text: words, hit words, items, their digest, verdict, the longest match with its item and place, and whether it goes."""
    words = Words(column, ALNUM)
    edges = np.zeros(len(words.hash) + 1, np.int64)
    names: list[set] = [set() for _ in range(len(column))]
    best: list[tuple] = [(0, None, None)] * len(column)
    whole = np.zeros(len(column), bool)
    for one in held:
        block = one.value
        place, size, item, offset = search(words, block)
        if len(place):
            np.add.at(edges, place, 1)
            np.add.at(edges, place + size, -1)
            doc = np.searchsorted(words.first, place, "right") - 1
            whole[doc[size == window]] = True
            order = np.lexsort((place, place - offset, item, doc))
            doc, item, place, size, line = doc[order], item[order], place[order], size[order], (place - offset)[order]
            new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(line) != 0) | (np.diff(place) != 1)])
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(place))) - 1 + size[start]
            for s, n in zip(start.tolist(), length.tolist(), strict=True):
                d, name = int(doc[s]), block.names[item[s]]
                names[d].add(name)
                at = int(place[s] - words.first[d])
                if (n, best[d][2] is None or -at) > (best[d][0], -(best[d][2] or 0)):
                    best[d] = (n, name, at)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
    hits, sizes = covered[words.first[1:]] - covered[words.first[:-1]], np.diff(words.first)
    rows = zip(sizes.tolist(), hits.tolist(), names, best, whole.tolist(), strict=True)
    return [(n, h, len(x), hashlib.sha256(",".join(sorted(x)).encode()).hexdigest(), (c := h > 0 and 20 * h >= n), *b, w or c) for n, h, x, b, w in rows]


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, items' digest, verdict, longest match and where."""
    held = blocks(bench, window)

    def scan(batches):
        for batch in slices(batches):
            columns = list(zip(*judge(batch.column(1), held, window), strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose text isn't affected."""
    held = blocks(bench, window)

    def scan(batches):
        for batch in slices(batches):
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([not x[-1] for x in judge(text, held, window)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the benchmark does not affect; null and empty texts stay, rows of equal text stay or go together."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
SQL: dict[str, str] = {}
