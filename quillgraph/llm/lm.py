"""Language-model scoring with a log-frequency Bloom filter.

Words of all training text are counted exactly, in a table that grows with the corpus. On them stands a bigram model over
these words, all of them. A bigram seen c times goes into a Bloom filter as (bigram, 1) ... (bigram, q), q = 1 + floor(log2 c);
probing goes up the levels until one is absent and takes the middle of the last level for c (Talbot and Osborne 2007). The
filter has ``BITS`` bits for each entry, however many there are.

    P(w | u) = (c(u, w) + MU * P(w)) / (c(u) + MU),   P(w) = (c(w) + 1) / (N + V + 1)

A filter of all bigrams outgrows a broadcast, so it is cut by hash into blocks of the n-grams of about ``BLOCK_TOKENS`` tokens
or more, files in the shared folder, and the questions go to the blocks: a task gathers the distinct n-grams of many texts
(``PROBED``) and sends them, by block, to the tasks that hold one block each and probe it; the levels found come back as one
file for each set of questions, named by a hash of it, where the scoring pass finds them. What is exchanged grows with the
texts, the filter is read once, and a task holds one block, or one set of questions with its texts. The scoring pass asks
the same questions if it reads the same texts in the same pieces; where the pieces changed, as they may when executors
come or go in between, both passes run again. The frame must come from files or a checkpoint, whose rows don't change.

A text's first token has P(w). Counts of words at or above a level that at most ``TOP`` words reach are held in the workers;
in ``score`` the counts of all others come from the filter too. ``base_score`` is the sum of log10 P(w), exact for all words:
those not held are joined on the word. Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case, compared by 64-bit hashes,
and each text ends with one end token.

Null text is empty and has the end token alone. Repeated rows and identifiers are rows of their own. Without training
text all probabilities are 1 and all scores 0.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillgraph.llm import bloom
from quillgraph.llm.common import Scratch, arrow_uri, fold, read_file, shared_dir, table, write_file
from quillgraph.llm.text import Words, mix, pairs, slices
from quillgraph.llm.text import distinct as sorted_set

TOP = 400_000
MU = 50.0
LEVELS = 64
BITS = 12
PROBES = 5
#: Times that the texts are asked for and scored, at most, if their pieces change in between.
TURNS = 3
#: Tokens of a block: the least, and the most; between them such that there are about MANY blocks.
BLOCK_TOKENS, MOST_TOKENS, MANY = 1 << 22, 1 << 24, 1 << 16
#: Distinct n-grams that a task gathers, at least, before it asks for them.
PROBED = 1 << 19
_END = np.uint64(0x9D8F3C2B5A7E6142)
#: Distinct words that a task holds before it hands them on.
_HELD = 1 << 20


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and where each text's begin, with the end last."""
    words = Words(column)
    return np.insert(words.hash, words.first[1:], _END), words.first + np.arange(len(words.first))


def _counted(batches, values_of):
    """Sums of (values, counts) over batches, handed on whenever many are held."""
    held, size = [], 0

    def merged():
        values, inverse = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        return values, np.bincount(inverse, np.concatenate([x for _, x in held])).astype(np.int64)

    def batch_of(values, counts):
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts)], ["h", "c"])

    for batch in slices(batches):
        values, counts = np.unique(values_of(batch.column(0)), return_counts=True)
        held.append((values, counts))
        size += len(values)
        if size > _HELD:
            held = [merged()]
            size = len(held[0][0])
            if size > _HELD // 2:
                yield batch_of(*held[0])
                held, size = [], 0
    if held:
        yield batch_of(*merged())


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): the count of each token's hash over ``texts`` (text)."""
    return texts.select("text").mapInArrow(lambda b: _counted(b, lambda x: tokens(x)[0]), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _frequent(counts: DataFrame, sizes: dict[int, int], most: int) -> DataFrame:
    """The words whose count is at or above a level that at most ``most`` words reach; an eighth of a doubling is a level."""
    total, least = 0, None
    for level in sorted(sizes, reverse=True):
        total += sizes[level]
        if total > most:
            break
        least = level
    return counts.where(F.lit(False)) if least is None else counts.where(_level() >= least)


def _level():
    return F.floor(F.log2("c") * 8).cast("int")


class Model:
    """Counts of frequent words, and where the blocks of the filter are."""

    def __init__(self, top: pa.Table, n: int, v: int, folder: str):
        h, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
        order = np.argsort(h)
        self.hash, self.count, self.n, self.v, self.folder = h[order], c[order], n, v, folder
        self.n_blocks = max(1, -(-n // min(max(n // MANY, BLOCK_TOKENS), MOST_TOKENS)))

    def look(self, words: np.ndarray) -> np.ndarray:
        """The count of each word, -1 where it is not a frequent one."""
        if not len(self.hash):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hash, words), len(self.hash) - 1)
        return np.where(self.hash[at] == words, self.count[at], -1)

    def block(self, keys: np.ndarray) -> np.ndarray:
        """The block of each n-gram; it ascends with the n-gram."""
        return (((keys >> np.uint64(32)) * np.uint64(self.n_blocks)) >> np.uint64(32)).astype(np.int64)

    def load(self, b: int) -> bloom.Bloom | None:
        data = read_file(self.folder, f"block-{b}")
        return None if data is None else bloom.Bloom(np.frombuffer(data, np.uint8), len(data) // (bloom.SEGMENT_BITS >> 3), PROBES)


def levels_of(held: bloom.Bloom | None, keys: np.ndarray) -> np.ndarray:
    """The last level of each n-gram that the filter holds, by repeated probes."""
    out = np.zeros(len(keys), np.uint8)
    for p in range(0, len(keys) if held else 0, _PART):
        left, level = np.arange(p, min(len(keys), p + _PART)), 1
        while len(left) and level < LEVELS:
            left = left[held.holds(_entries(keys[left], level))]
            out[left] = level
            level += 1
    return out


#: The middle of each level.
MIDDLE = np.array([0.0, 1.0] + [1.5 * 2.0 ** (level - 1) for level in range(2, LEVELS)])


_PART = 1 << 16


def planes(values: np.ndarray) -> bytes:
    """The bytes of all values, the lowest of each first, so that those that are mostly zero compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplaned(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(keys: np.ndarray) -> bytes:
    """Ascending n-grams by their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unplaned(data, np.uint64), dtype=np.uint64)


def _digest(keys: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(keys.tobytes())


def _entries(keys: np.ndarray, level) -> np.ndarray:
    return keys * np.uint64(LEVELS) + np.asarray(level).astype(np.uint64)


def word_keys(words: np.ndarray) -> np.ndarray:
    """What stands for single words in the filter."""
    return mix(words ^ _END)


def _inner(first: np.ndarray) -> np.ndarray:
    """Where the tokens stand that are not a text's first."""
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    return np.flatnonzero(inner)


def fit(texts: DataFrame, counts: DataFrame) -> Model:
    """A model of ``texts`` (text), whose words ``counts`` counts."""
    spark = texts.sparkSession
    sizes = counts.groupBy(_level().alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()
    top = _frequent(counts, {r.level: r.n for r in sizes}, TOP).toArrow()
    model = Model(top, sum(r.c for r in sizes), sum(r.n for r in sizes), arrow_uri(spark, f"{shared_dir(spark)}/lm-filter-{uuid.uuid4().hex}"))
    held = spark.sparkContext.broadcast(model)

    def by_block(keys, counts):
        """A row for each block of sorted n-grams."""
        if not len(keys):
            return
        block = held.value.block(keys)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(keys)]
        columns = [block[cuts[:-1]].tolist(), [pack(keys[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], [planes(counts[i:j].astype(np.uint32)) for i, j in zip(cuts, cuts[1:], strict=False)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["b", "keys", "counts"])

    def bigrams(column):
        seq, first = tokens(column)
        at = _inner(first)
        return pairs(seq[at - 1], seq[at])

    def of_texts(batches):
        for batch in _counted(batches, bigrams):
            yield from by_block(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False))

    def of_words(batches):
        for batch in batches:
            words, counts = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False)
            rare = held.value.look(words) < 0
            keys = word_keys(words[rare])
            order = np.argsort(keys)
            yield from by_block(keys[order], counts[rare][order])

    def fill(batches):
        b, keys, counts = None, [], []
        for batch in batches:
            for b, k, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):  # one block
                keys.append(unpack(k))
                counts.append(unplaned(c, np.uint32))
        if b is not None:
            found, total = np.concatenate(keys), np.concatenate(counts)
            keys = counts = None
            order = np.argsort(found, kind="stable")
            found, total = found[order], total[order].astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            found, total = found[start], np.add.reduceat(total, start)
            levels = np.frexp(total.astype(float))[1].astype(np.uint8)  # 1 + floor(log2 c)
            segments = max(1, -(-BITS * int(levels.sum(dtype=np.int64)) // bloom.SEGMENT_BITS))
            bits = np.zeros(segments * (bloom.SEGMENT_BITS >> 3), np.uint8)
            for level in range(1, int(levels.max()) + 1):
                some = found[levels >= level]
                for p in range(0, len(some), _PART):
                    segment, bit = bloom.places(_entries(some[p : p + _PART], level), segments, PROBES)
                    at = (segment[:, None] * bloom.SEGMENT_BITS + bit).ravel()
                    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            write_file(held.value.folder, f"block-{b}", bits.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["n"])

    made = "b int, keys binary, counts binary"
    rows = texts.select("text").mapInArrow(of_texts, made).union(counts.select("h", "c").mapInArrow(of_words, made))
    rows.repartitionById(model.n_blocks, "b").mapInArrow(fill, "n long").count()
    return model


class Moved(ValueError):
    """The pieces in which texts are read changed between two passes."""


def _questions(model: Model, column: pa.Array) -> np.ndarray:
    """The n-grams of texts whose counts aren't held."""
    seq, first = tokens(column)
    at = _inner(first)
    distinct = sorted_set(seq)
    return np.concatenate([word_keys(distinct[model.look(distinct) < 0]), sorted_set(pairs(seq[at - 1], seq[at]))])


def _answered(rows: DataFrame, held, folder: str) -> None:
    """Leaves a file for each set of questions of ``rows`` (text): the levels of its n-grams in their order."""

    def ask(batches):
        model, parts, size = held.value, [], 0

        def asked():
            keys = sorted_set(np.concatenate(parts))
            if len(keys):
                block = model.block(keys)
                cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]], pa.int32()), pa.array([_digest(keys)] * (len(cuts) - 1)), pa.array([pack(keys[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["b", "name", "keys"])

        for batch in slices(batches):
            if batch.num_rows:
                parts.append(_questions(model, batch.column(0)))
                size += len(parts[-1])
            if size > PROBED:
                yield from asked()
                parts, size = [], 0
        if parts:
            yield from asked()

    def answer(batches):
        at, block = None, None
        for batch in batches:
            for b, name, keys in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != at:
                    at, block = b, held.value.load(b)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b], pa.int32()), pa.array([levels_of(block, unpack(keys)).tobytes()], pa.binary())], ["name", "b", "levels"])

    def deliver(batches):
        now, parts = None, {}
        for batch in batches:
            for name, b, levels in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != now:
                    if now is not None:
                        write_file(folder, now, b"".join(parts.values()))
                    now, parts = name, {}
                parts[b] = levels  # equal sets of questions have equal answers
        if now is not None:
            write_file(folder, now, b"".join(parts.values()))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["n"])

    asked = rows.select("text").mapInArrow(ask, "b int, name string, keys binary").repartitionById(held.value.n_blocks, "b")
    answers = asked.mapInArrow(answer, "name string, b int, levels binary").repartition("name").sortWithinPartitions("name", "b")
    answers.mapInArrow(deliver, "n long").count()


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, *columns) -> DataFrame:
    """doc_id, ``columns``, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    rows = docs.select("text", "doc_id", *columns, F.monotonically_increasing_id().alias("_row"))
    own = rows.drop("text")
    unit = float(np.log10(model.n + model.v + 1))

    def read(batch):
        """All of a piece but its score, and what that needs: its words and their counts, its n-grams, and the places of both."""
        m, n = held.value, batch.num_rows
        seq, first = tokens(batch.column(0))
        doc = np.repeat(np.arange(n), np.diff(first))
        distinct, inverse = np.unique(seq, return_inverse=True)
        count = m.look(distinct)
        base = np.bincount(doc, np.log10(np.maximum(count, 0) + 1)[inverse], n)
        known = np.bincount(doc, (count > 0)[inverse], n)
        rare = np.flatnonzero((count < 0)[inverse])
        both, times = np.unique(doc[rare] * np.int64(len(distinct)) + inverse[rare], return_counts=True)
        cut = pa.array(np.searchsorted(both, np.arange(n + 1) * np.int64(len(distinct))), pa.int32())
        word = pa.StructArray.from_arrays([pa.array(distinct[both % max(1, len(distinct))].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "t"])
        columns = [*batch.columns[1:], pa.array(np.diff(first)), pa.array(known.astype(np.int64)), pa.array(base), pa.ListArray.from_arrays(cut, word)]
        at = _inner(first)
        keys, place = np.unique(pairs(seq[at - 1], seq[at]), return_inverse=True)
        return columns, first, word_keys(distinct[count < 0]), count, inverse.astype(np.int32), keys, place.astype(np.int32)

    def scored(pieces, names, folder):
        m = held.value
        keys = sorted_set(np.concatenate([x for p in pieces for x in (p[2], p[5])]))
        levels = np.frombuffer((read_file(folder, _digest(keys)) if len(keys) else None) or b"", np.uint8)
        if len(levels) != len(keys):
            raise Moved(Moved.__doc__)
        found = MIDDLE[levels]
        look = lambda x: found[np.searchsorted(keys, x)]
        for columns, first, rare, count, inverse, bigrams, place in pieces:
            c = count.astype(float)
            c[count < 0] = look(rare)
            p = (c + 1) / (m.n + m.v + 1)
            log = np.log10(p)[inverse]  # right for first tokens
            at = _inner(first)
            u, w = inverse[at - 1], inverse[at]
            log[at] = np.log10((np.minimum(look(bigrams)[place], c[u]) + MU * p[w]) / (c[u] + MU))
            score = np.add.reduceat(log, first[:-1])  # no text is without its end token
            yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(np.minimum(score, 0.0)), columns[-1]], [*names, "n", "known", "base", "score", "rare"])

    def scan(folder):
        def run(batches):
            pieces, size = [], 0
            for batch in slices(batches):
                if batch.num_rows:
                    pieces.append(read(batch))
                    size += len(pieces[-1][2]) + len(pieces[-1][5])
                if size > PROBED:
                    yield from scored(pieces, batch.schema.names[1:], folder)
                    pieces, size = [], 0
            if pieces:
                yield from scored(pieces, batch.schema.names[1:], folder)

        return run

    made = StructType.fromDDL("n long, known long, base double, score double, rare array<struct<h: long, t: int>>")
    for turn in range(TURNS):
        scratch = Scratch(spark, "lm-scores")
        folder = arrow_uri(spark, f"{scratch.root}/answers")
        _answered(rows, held, folder)
        try:
            found = scratch.keep(rows.mapInArrow(scan(folder), StructType([*own.schema.fields, *made.fields])), "scores")
            break
        except PySparkException as e:
            if turn + 1 == TURNS or Moved.__doc__ not in str(e):
                raise
    scratch.drop("answers")
    rest = found.select("_row", F.explode("rare").alias("r")).select("_row", "r.h", "r.t").join(counts, "h")
    rest = rest.groupBy("_row").agg(F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("more"), F.sum("t").alias("also"))
    out = found.drop("rare").join(rest, "_row", "left")
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n") * F.lit(unit)
    return out.select(*own.drop("_row").columns, F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 7) == 2
    texts = docs.where(~held_out).select("text")
    counts = Scratch(spark, "lm-words").keep(word_counts(texts))
    return score_texts(docs, fit(texts, counts), counts, held_out.alias("held_out"))


QUERIES = {"op9_lm_score": op9_lm_score}
SQL: dict[str, str] = {}
