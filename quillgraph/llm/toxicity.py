"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; everything else is unlabelled, toxic texts among it. A linear classifier is trained in
numpy on the risk ``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))`` with the logistic loss, where p is the
class prior: the second part estimates the risk on non-toxic text, and where a step would push it below zero, which only
overfitting can, the step goes the other way (Kiryo et al. 2017). The prior is the share of toxic rows among the labelled
ones, a Laplace estimate within [0.01, 0.5].

Features are the words of a text and the six-byte stretches within its words, lower-cased, hashed to 2**20 buckets and
counted once a text. Frequencies over the training sample pick the buckets whose rates differ most, ``FEATURES`` at most.

The training sample is bounded by parameters of ``fit``: at most ``positives`` confirmed identifiers and ``unlabelled``
identifiers of all texts, the least by a hash, with one text each, the least where an identifier repeats. Whole texts
train and are scored. Text alone makes a score; null and empty text gets that of the bias. Without positives every
score is the prior. Equal texts get equal scores, and rows of one identifier a score each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillgraph.llm.common import Scratch, fold, table
from quillgraph.llm.text import LOWER, SPACED, Words, distinct, mix, slices

BUCKETS = 1 << 20
GRAM = 6
POSITIVES = 6_000
UNLABELLED = 18_000
FEATURES = 4096
LEAST_TEXTS = 5
#: Standard deviations by which a feature's rates must differ: others are noise, above all in small samples.
LEAST_Z = 4.0
THRESHOLD = 0.3


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of every feature, repeats included."""
    words = Words(column)
    doc = np.repeat(np.arange(len(column)), np.diff(words.first))
    at = (mix(words.hash) >> np.uint64(44)).astype(np.int64)
    data = LOWER[words.data]
    n = len(data) - GRAM + 1
    if n <= 0:
        return doc, at
    code = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    letters = SPACED[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[words.places] = True
    for k in range(GRAM):
        code = (code << np.uint64(8)) | data[k : k + n]
        inside &= letters[k : k + n]
        if k:
            inside &= ~edge[k : k + n]
    place = np.flatnonzero(inside)
    grams = (mix(code[place] + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(44)).astype(np.int64)
    return np.concatenate([doc, np.searchsorted(words.places, place, "right") - 1]), np.concatenate([at, grams])


class Model:
    """Weights of the chosen buckets, and a bias."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[chosen] = np.arange(len(chosen))

    def present(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and feature, once each."""
        doc, at = buckets(column)
        feature = self.place[at]
        hit = feature >= 0
        both = distinct(doc[hit] * np.int64(len(self.chosen) + 1) + feature[hit])
        return both // (len(self.chosen) + 1), both % (len(self.chosen) + 1)

    def scores(self, column: pa.Array) -> np.ndarray:
        doc, feature = self.present(column)
        z = np.bincount(doc, self.weights[feature], len(column)) + self.bias if len(column) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu(rows: list[np.ndarray], positive: np.ndarray, features: int, prior: float, rounds: int = 60, batch: int = 2048, rate: float = 0.05, decay: float = 3e-4, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias by stochastic steps (Adam) on the non-negative risk; rows hold the features that are present."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(features), float(np.log(prior / (1 - prior)))
    m, v, t = np.zeros(features + 1), np.zeros(features + 1), 0
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(pos) or not len(unl):
        return w, b
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def part(some: np.ndarray):
        sizes = np.array([len(rows[i]) for i in some])
        flat = np.concatenate([rows[i] for i in some]) if len(some) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(some)), sizes)
        return flat, owner, np.bincount(owner, w[flat], len(some)) + b

    for _ in range(rounds):
        order = rng.permutation(unl)
        cuts = max(1, len(order) // batch)
        for chunk, chosen in zip(np.array_split(order, cuts), np.array_split(rng.permutation(pos), cuts), strict=True):
            chosen = chosen if len(chosen) else rng.choice(pos, 1)
            (fp, op, zp), (fu, ou, zu) = part(chosen), part(chunk)
            down = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # derivatives of the losses by the margin, each as a mean over its texts
            up_p, down_p, down_u = (sig(zp) - 1) / len(zp), sig(zp) / len(zp), sig(zu) / len(zu)
            if down >= 0:
                gp, gu = prior * up_p - prior * down_p, down_u
            else:
                gp, gu = prior * down_p, -down_u
            g = np.append(np.bincount(fp, gp[op], features) + np.bincount(fu, gu[ou], features) + decay * w, gp.sum() + gu.sum())
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """A model from the texts of ``docs`` (doc_id, text) and the confirmed rows of ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    toxic, total = known.agg(F.count_if(F.col("toxic") == 1), F.count("*")).first()
    prior = min(0.5, max(0.01, (toxic + 1) / (total + 2)))
    pick = lambda df, n: [r[0] for r in df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]
    positive = pick(known.where("toxic = 1"), positives)
    others = pick(docs.where("doc_id IS NOT NULL"), unlabelled)
    bias = float(np.log(prior / (1 - prior)))
    if not positive or not others:
        return Model(np.zeros(0, np.int64), np.zeros(0), bias)
    chosen = spark.createDataFrame([(x, True) for x in positive] + [(x, False) for x in others], "doc_id long, positive boolean")
    scratch = Scratch(spark, "toxicity")
    # at most the identifiers chosen
    sample = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("positive", "text"), "sample")

    def count(batches):
        texts = np.zeros((2, BUCKETS), np.int32)
        sizes = np.zeros(2, np.int64)
        for batch in slices(batches):
            side = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, at = buckets(batch.column(1))
            both = distinct(doc * np.int64(BUCKETS) + at)
            for k in (0, 1):
                texts[k] += np.bincount(both[side[both // BUCKETS] == k] % BUCKETS, minlength=BUCKETS).astype(np.int32)
                sizes[k] += (side == k).sum()
        used = np.flatnonzero(texts.any(axis=0))
        at = np.append(used, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(texts[1, used], sizes[1]), pa.int64()), pa.array(np.append(texts[0, used], sizes[0]), pa.int64())], ["b", "p", "u"])

    found = sample.mapInArrow(count, "b long, p long, u long").groupBy("b").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    found = found.persist()
    try:
        sizes = found.where("b = -1").first()
        n_p, n_u = max(1, sizes.p), max(1, sizes.u)
        differ = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt((F.col("p") + F.col("u") + 1) / (n_p + n_u))
        least = LEAST_Z * (1 / n_p + 1 / n_u) ** 0.5
        rows = found.where(f"b >= 0 AND p + u >= {LEAST_TEXTS}").where(differ >= least).orderBy(differ.desc(), "b").limit(FEATURES).collect()
    finally:
        found.unpersist()
    model = Model(np.array([r.b for r in rows], np.int64), np.zeros(len(rows)), bias)
    held = spark.sparkContext.broadcast(model)

    def read(batches):
        for batch in slices(batches):
            doc, feature = held.value.present(batch.column(1))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))], ["positive", "f"])

    seen = sample.mapInArrow(read, "positive boolean, f array<int>").toPandas()
    scratch.drop()
    features = [np.asarray(x, np.int64) for x in seen["f"]]
    order = sorted(range(len(features)), key=lambda i: (bool(seen["positive"].iat[i]), len(features[i]), features[i].tobytes()))
    weights, bias = nnpu([features[i] for i in order], seen["positive"].to_numpy(bool)[order], len(rows), prior)
    return Model(model.chosen, weights, bias)


def score(docs: DataFrame, model: Model, *columns) -> DataFrame:
    """doc_id, ``columns``, score and predicted of each row of ``docs`` (doc_id, text); no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", *columns, "text")

    def scan(batches):
        for batch in slices(batches, size=4 << 20):
            s = held.value.scores(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(scan, StructType([*rows.drop("text").schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    model = fit(docs.where(~held_out).select("doc_id", "text"), labels.where(~held_out).select("doc_id", "toxic"))
    return score(docs, model, held_out.alias("held_out"))


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
