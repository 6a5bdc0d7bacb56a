"""Each operator on a small table of hard cases, and the pipeline's stages."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import bloom, components, lm, mixing, neardup, quality, secrets, sharding, sstable, toxicity
from quillgraph.llm import decontaminate as dec
from quillgraph.llm import langid
from quillgraph.llm.common import Scratch

LONG = " ".join(f"word{i}" for i in range(60_000))
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (0, "", "en", "src0"),
    (1, None, None, None),
    (2, BASE, "en", "src0"),
    (3, BASE, "en", "src0"),
    (3, BASE, "en", "src0"),
    (4, BASE.replace("w30", "other"), "de", "src1"),
    (5, LONG, "fr", "src2"),
    (None, BASE, "en", "src0"),
    (None, None, "en", None),
    (6, "one", "es", "src3"),
    (7, "   \n\t ", "es", "src3"),
    (8, "same line here\nsame line here\n" * 30, "en", "src4"),
    (9, "é ß ñ " + BASE.upper(), "de", "src5"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, weight string, shard string, reason string, kept string, n string, _key string, _block string, _cell string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(*r, len(r[1] or ""), "x", "x", "x", "x", "x", "x", "x", "x") for r in ROWS], SCHEMA).repartition(3).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def words(t):
    return (t or "").encode().lower().split()


def test_secrets(docs):
    got = secrets.scan_secrets(docs).collect()
    assert len(got) == len(ROWS) and all(r.spans == "" for r in got)


def test_quality(docs):
    got = quality.apply_rules(docs, reason="why").collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r.why for r in got}
    assert by[0] == by[6] == by[7] == "short" and by[5] is None and by[9] is None and by[8] in ("repeats", "dup_lines")


def brute_components(rows, size):
    sets = [frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []) for w in (words(r[1]) for r in rows)]
    label = [r[0] for r in rows]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and label[i] is not None and label[j] is not None and label[i] != label[j] and 100 * len(a & b) >= 80 * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted((str(r[0]), len(s), str(x)) for r, s, x in zip(rows, sets, label, strict=True))


def test_near_duplicates_match_brute_force(docs):
    got = neardup.near_duplicates(docs, size=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(ROWS, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_large_group_and_common_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    base = [f"b{i}" for i in range(90)]
    for i in range(150):
        w = [x if rng.random() > 0.03 else f"r{rng.integers(10**9)}" for x in base]
        rows.append((i, " ".join(w), "en", "s"))
    for i in range(150, 300):
        rows.append((i, " ".join(["of the and"] * 3 + [f"q{rng.integers(10**9)}" for _ in range(rng.integers(3, 40))]), "en", "s"))
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = neardup.near_duplicates(df, size=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 2)


@pytest.mark.parametrize("shared,least,most", [(200, 44, 49), (101, 20, 25)])
def test_near_duplicates_of_many_copies_that_add_text(spark, shared, least, most):
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(shared)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base + [f"u{i}x{j}" for j in range(rng.integers(least, most + 1))])) for i in range(1, 200)]
    want = brute_components(rows, 2)
    assert {x[2] for x in want} == {"0"}
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("common", [58, 132])
def test_pairs_at_the_threshold_under_shared_passages_are_found(spark, common):
    rng = np.random.default_rng(common)
    passage = [f"c{i}" for i in range(common)]
    rows = []
    for i in range(400):  # two sets of n values that share s of them: s / (2 n - s) just above 0.8
        mine = [f"m{i}x{j}" for j in range(int(rng.integers(60, 200)))]
        n = common + len(mine)
        cut = int(n - 8 * n / 9)  # values that differ, on each side
        other = mine[: len(mine) - cut] + [f"o{i}x{j}" for j in range(cut)]
        rows += [(2 * i, " ".join(passage + mine)), (2 * i + 1, " ".join(passage + other))]
    sets = [{*zip(w, w[1:], strict=False)} for w in (t.split() for _, t in rows)]
    want = [100 * len(a & b) >= 80 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(want) > 300 and max(len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)) < 0.82
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(400)] == want


def test_rows_of_one_identifier_and_other_texts_are_documents_of_their_own(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(50))
    rows = [(7, text("a")), (7, text("b")), (7, text("b")), (8, text("b")), (3, text("c")), (7, text("c")), (9, "A " + text("d")), (9, "a " + text("d")), (10, ""), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text[:2], r.component_id) for r in neardup.near_duplicates(df, size=2).join(df, "doc_id").collect() if r.doc_id in (3, 8))
    assert got == [(3, "c0", 3), (8, "b0", 7)]
    left = sorted((r.doc_id, r.text[:1].lower()) for r in neardup.drop_near_duplicates(df).collect())
    assert left == [(3, "c"), (7, "a"), (7, "b"), (9, "a"), (10, ""), (10, "")]
    assert neardup.drop_near_duplicates(df.limit(0)).count() == neardup.near_duplicates(df.limit(0)).count() == 0


def test_long_lists_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_VALUES", 1500)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(240):  # chains of edits: many components and links that no pivot has
        w = list(base)
        for j in rng.choice(100, int(rng.integers(0, 16)), replace=False):
            w[j] = f"r{i}x{j}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 2)
    assert len({x[2] for x in want}) > 3
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_dropping_near_duplicates_keeps_one_row_of_each(docs):
    got = neardup.drop_near_duplicates(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, x) for x in (0, 1, 2, 5, 6, 7, 8)] + [(True, 0)] * 2


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == {i: 20 for i in range(20, 41)} | {i: 100 for i in range(100, 130)}


def test_bloom_has_no_false_negative(spark):
    b = bloom.build(spark.range(5000).withColumn("id", F.col("id") * 7919), "id", 5000)
    assert b.holds(np.arange(5000, dtype=np.int64) * 7919).all()
    assert b.holds(np.arange(5000, dtype=np.int64) * 7919 + 1).mean() < 0.01


def test_mixing(docs):
    taken = mixing.mixed(docs, budget=50.0)
    assert taken.columns == docs.columns
    assert mixing.mixed(docs.limit(0)).count() == 0
    w = mixing.rake(np.array([1.0, 2, 3, 4]), [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], [{"a": 0.7, "b": 0.3}, {"x": 0.5, "y": 0.5, "absent": 9}])
    assert np.allclose([w[0] + w[1], w[0] + w[2], w.sum()], [0.7, 0.5, 1])


def test_capped_raking_meets_feasible_targets_and_names_others():
    rng = np.random.default_rng(4)
    cells = [(a, b, c) for a in "pqrs" for b in "xyz" for c in "mn"]
    tokens = rng.integers(500, 5000, len(cells)).astype(float)
    share = lambda k: {v: sum(t for t, c in zip(tokens, cells, strict=True) if c[k] == v) / tokens.sum() for v in {c[k] for c in cells}}
    targets = [{v: x * (1.3 if i % 2 else 0.8) for i, (v, x) in enumerate(sorted(share(k).items()))} for k in range(3)]
    w = mixing.rake(tokens, cells, targets, budget=0.6)
    assert (w <= tokens / tokens.sum() / 0.6 + 1e-12).all()
    for k, target in enumerate(targets):
        for v, x in target.items():
            assert abs(sum(y for y, c in zip(w, cells, strict=True) if c[k] == v) - x / sum(target.values())) < 2e-3
    goal = mixing.reachable(np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.9, 0.9]))
    assert np.allclose(goal, [0.1, 0.54, 0.36])
    assert mixing.reachable(np.array([1.0]), np.array([0.5])).tolist() == [0.5] and len(mixing.rake(np.zeros(0), [], targets, budget=0.5)) == 0


def test_the_sample_reaches_its_targets(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["word"] * int(rng.integers(5, 40))) + (" | x | y" if rng.random() < 0.1 else ""), rng.choice(["en", "de"], p=[0.7, 0.3]), rng.choice(["a", "b", "c"], p=[0.5, 0.3, 0.2])) for i in range(6000)]
    rows += [(1, "word word", None, None), (1, "word word", None, None), (None, None, "en", "a"), (None, "", None, "a")]
    df = spark.createDataFrame([(i, t, str(x) if x else None, str(y) if y else None) for i, t, x, y in rows], "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.4, "b": 0.35, "c": 0.24, "other": 0.01}, "lang": {"en": 0.6, "de": 0.39, "other": 0.01}, "topic": {"prose": 0.87, "tabular": 0.13}}
    taken = mixing.mixed(df, targets, budget=0.5)
    n = taken.selectExpr("greatest(1, size(split(coalesce(text, ''), ' '))) AS n", "source", "lang", "text").toPandas()
    for column, goals in (("source", targets["source"]), ("lang", targets["lang"])):
        for v, x in goals.items():
            if v != "other":
                assert abs(n.loc[n[column] == v, "n"].sum() / n["n"].sum() - x) < 0.03
    assert abs(n.loc[n["text"].fillna("").str.contains("|", regex=False), "n"].sum() / n["n"].sum() - 0.13) < 0.03
    ones = [r for r in taken.collect() if r.doc_id == 1 and r.lang is None]
    assert len(ones) in (0, 2)  # rows of one identifier and cell go together
    empty = spark.createDataFrame([], "source_class string, lang_class string, topic string, n_tokens long, taken boolean")
    assert mixing.achieved(empty).count() == 0


def test_shards_are_exact_and_gapless(docs):
    got = sharding.shard_rows(docs, 4).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(ROWS) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert sharding.shard_rows(docs.where("doc_id = -1")).count() == 0


def test_token_shards(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    shards = sstable.write_shards(docs, f"file://{tmp_path}/t", path)
    got = sstable.read_shards(spark, f"file://{tmp_path}/t", shards).collect()
    tokenizer, start = Tokenizer.from_file(path), 0
    want = []
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in sorted(got, key=lambda r: r.start)] == want
    assert sstable.read_shards(spark, "file:///none", []).count() == 0
    assert sstable.write_shards(docs.limit(0), f"{tmp_path}/e", path) == []
    same = spark.createDataFrame([(None, f"text {i:05d}") for i in range(4000)], "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    several = sstable.write_shards(same, f"{tmp_path}/s", path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(several) > 1 and sum(x[2] for x in several) == 4000
    assert sorted(r.start for r in sstable.read_shards(spark, f"{tmp_path}/s", several).collect())[0] == 0


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, BASE), (2, "one"), (None, None), (3, "")], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in dec.contamination(docs, items).collect()}
    assert got[2, 60].contaminated and got[6, 1].contaminated and not got[5, 60000].contaminated and got[1, 0].n_items == 0
    left = dec.decontaminate(docs, items)
    assert left.columns == docs.columns and 2 not in {r.doc_id for r in left.collect()}
    assert dec.decontaminate(docs, items.limit(0)).count() == len(ROWS)
    many = spark.createDataFrame([(i, f"item {i} " + BASE[: 40 + i]) for i in range(60)] + [(7, BASE)] * 3, "item_id long, text string")
    one, several = (sorted(map(str, docs.sparkSession.createDataFrame(docs.select("doc_id", "text").collect(), "doc_id long, text string").mapInArrow(lambda b, h=h: (pa.RecordBatch.from_arrays([pa.array([str(x) for x in dec.judge(y.column(1), h)])], ["x"]) for y in b), "x string").collect())) for h in (dec.blocks(many), dec.blocks(many, size=200)))
    assert one == several and len(dec.blocks(many, size=200)) > dec.HELD


def test_language_of_hard_rows(docs):
    model = langid.fit(docs.select("text", "lang"))
    got = langid.identify(docs, model).collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (0, 1, 7)} == {"und"}
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs.limit(0).select("text", "lang"))).collect()} == {"und"}


def test_languages_of_short_and_of_long_texts_are_learned_and_copies_count_once(spark):
    rows = [(f"kurz wort {i}", "de") for i in range(5)] + [(" ".join(f"longue{i}" for i in range(3000)), "fr")] + [("same english text here " * 20, "en")] * 300
    rows += [("other plain words follow now " * 12 + str(i), "en") for i in range(3)] + [("...", "xx"), (None, "yy"), ("", "zz")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), rows=4)
    assert model.langs == ["de", "en", "fr"]
    got = model.predict(pa.array(["kurz wort", "longue7 longue9", "plain words", "english text"]), np.ones(4, bool))[0]
    assert got == ["de", "fr", "en", "en"]


def test_lm_base_score_is_exact(docs, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 20)
    counts = lm.word_counts(docs)
    got = lm.score_texts(docs, lm.fit(docs.select("text"), counts), counts).collect()
    c = Counter(x for r in ROWS for x in [*words(r[1]), None])
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(words(r[1])) + 1, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*words(r[1]), None]), 6)) for r in ROWS)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.n_known == r.n_tokens and r.train_tokens == n and r.score <= 0 for r in got)
    empty = docs.limit(0)
    none = lm.word_counts(empty)
    assert all(r.score == r.base_score == 0 for r in lm.score_texts(docs, lm.fit(empty.select("text"), none), none).collect())


def test_lm_score_is_of_all_words(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "TOP", 20)
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 3000)
    monkeypatch.setattr(lm, "PROBED", 900)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 6000, 40)) for _ in range(300)]
    texts += texts[:100] + [None, "v1 v1 v1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    counts = lm.word_counts(df)
    got = {r.doc_id: r.score for r in lm.score_texts(df, lm.fit(df.select("text"), counts), counts).collect()}
    seqs = [[*words(t), None] for t in texts]
    one, two = Counter(x for s in seqs for x in s), Counter(p for s in seqs for p in zip(s, s[1:]))
    n, v = sum(one.values()), len(one)
    middle = lambda c: 0 if not c else 1 if c == 1 else 1.5 * 2 ** int(math.log2(c))
    top = {x for x, c in one.items() if x is None or c > 15}
    off = 0
    for i, s in enumerate(seqs):
        c = [one[x] if x in top else middle(one[x]) for x in s]
        want = math.log10((c[0] + 1) / (n + v + 1))
        for u, w, cu, cw in zip(s, s[1:], c, c[1:]):
            want += math.log10((min(middle(two[u, w]), cu) + lm.MU * (cw + 1) / (n + v + 1)) / (cu + lm.MU))
        off += abs(want - got[i]) > 0.02 * abs(want)  # false positives are rare
    assert len(got) == len(seqs) and off < 0.05 * len(seqs)


def test_toxicity_of_hard_rows(spark, docs):
    labels = spark.createDataFrame([(8, 1), (2, 0), (None, 1), (77, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        got = toxicity.score(docs, toxicity.fit(docs, some)).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_toxicity_of_repeated_identifiers_and_very_long_texts(spark):
    rng = np.random.default_rng(6)
    plain = lambda n: " ".join(f"plain{x}" for x in rng.integers(0, 300, n))
    bad = lambda n: " ".join(f"vile{x}" if k % 4 == 0 else f"plain{x}" for k, x in enumerate(rng.integers(0, 300, n)))
    rows = [(i, bad(40) if i % 5 == 0 else plain(40)) for i in range(600)]
    rows += [(5000, plain(30))] * 300 + [(5001, bad(60_000)), (5002, plain(60_000)), (5003, None), (5003, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600, 2)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels, positives=50, unlabelled=400)).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 5000}) == 1
    by = {r.doc_id: r.score for r in got}
    assert by[5001] > by[5002] and np.mean([by[i] for i in range(0, 600, 5)]) > 0.5 > 3 * np.mean([by[i] for i in range(600) if i % 5])
    assert [r.score for r in got if r.doc_id == 5003][0] == [r.score for r in got if r.doc_id == 5003][1]


SF1 = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF1), reason="needs the driver's tables")
def test_held_out_rows_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SF1}/documents.parquet"), spark.read.parquet(f"{SF1}/labels.parquet")
    lang = langid.op8_language_id(spark, SF1).where("held_out AND lang_pred != 'und'").join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 100").collect()
    assert len(lang) > 100 and np.mean([r.lang == r.lang_pred for r in lang]) > 0.98
    seen = toxicity.op10_toxicity(spark, SF1).where("held_out").join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    pos, neg = [r.score for r in seen if r.toxic == 1], [r.score for r in seen if r.toxic == 0]
    assert pos and neg and np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.75


def test_pipeline_of_hard_rows(spark, tmp_path):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
        want = {"quality": [2, 3, 3, 4, 5, 9, None], "near_duplicates": [2, 5, None], "decontamination": [2, 5, None]}[name]
        assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {*docs.columns, "shard", "slot"} == {*out.columns}
    assert {r.doc_id for r in out.collect()} <= {2, 5, None}
    empty = f"{tmp_path}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def brute_repeats(w):
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    return len({i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[x] > 1 for k in range(3)})


def brute_kept(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, marks = len(w), sum((text or "").count(c) for c in "#*$%&|<>")
    chars = sum(map(len, w))
    return not (n < 50 or 100 * brute_repeats(w) > 50 * n or 10 * marks > 3 * n or 10 * (text or "").count("!") > 3 * n or 2 * (len(lines) - len({*lines})) > len(lines) or chars < 2 * n or chars > 15 * n)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_each_stage_of_the_pipeline_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages, scratch = dict(corpus_pipeline.STAGES), Scratch(spark, "t")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    docs, rows = scratch.keep(stages["quality"](spark, docs, sf)), [r for r in rows if brute_kept(r[1])]
    assert ids(docs) == sorted(r[0] for r in rows) and 20 < len(rows) < 200
    component = {int(x): int(c) for x, _, c in brute_components(rows, 5)}
    docs, rows = scratch.keep(stages["near_duplicates"](spark, docs, sf)), [r for r in rows if component[r[0]] == r[0]]
    assert ids(docs) == sorted(r[0] for r in rows)

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + min(13, len(w))]) for w in map(split, items) for i in range(max(1, len(w) - 12)) if w}
    sizes = {len(x) for x in windows}

    def stays(text):
        w = split(text)
        found = [(i, n) for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
        return not any(n == 13 for _, n in found) and not (found and 20 * len({i + k for i, n in found for k in range(n)}) >= len(w))

    docs, rows = scratch.keep(stages["decontamination"](spark, docs, sf)), [r for r in rows if stays(r[1])]
    assert ids(docs) == sorted(r[0] for r in rows) and rows

    def cell(r):
        counts = [len(re.findall(x, r[1] or "")) for x in mixing.TOPICS.values()]
        topic = [*mixing.TOPICS][counts.index(max(counts))] if max(counts) else mixing.PLAIN
        return tuple(x if x in mixing.TARGETS[k] else "other" for k, x in (("source", r[3]), ("lang", r[2]), ("topic", topic)))

    tokens = Counter()
    for r in rows:
        tokens[cell(r)] += max(1, len(words(r[1])))
    cells = sorted(tokens)
    t = np.array([tokens[c] for c in cells], float)
    p = dict(zip(cells, np.minimum(1, mixing.BUDGET * t.sum() * mixing.rake(t, cells, [*mixing.TARGETS.values()], budget=mixing.BUDGET) / t), strict=True))
    unit = lambda d: int(hashlib.md5(f"{mixing.SEED}{d}".encode()).hexdigest()[:13], 16) / 2**52
    docs, rows = scratch.keep(stages["mixing"](spark, docs, sf)), [r for r in rows if unit(r[0]) < p[cell(r)]]
    assert ids(docs) == sorted(r[0] for r in rows) and rows

    out = stages["sharding"](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(24)) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())


def test_the_cascade_stops_at_the_first_rule(docs):
    boom = quality.Rule("boom", "CAST(raise_error('reached') AS BOOLEAN)")
    reason = quality.cascade([quality.Rule("all", "octet_length(coalesce(text, '')) >= 0"), boom], {})
    assert {r[0] for r in docs.select(F.expr(reason)).collect()} == {"all"}
    assert {r[0] for r in docs.select(F.expr(quality.cascade([], {}))).collect()} == {None}


def test_dear_rules_that_reject_little_come_late(spark):
    df = spark.createDataFrame([(" ".join(f"w{i * j % 97}" for i in range(300)),) for j in range(400)], "text string")
    dear = quality.Rule("dear", "{n_repeat_words} < 0")
    some = quality.Rule("some", "{n_symbols} = 0 AND {n_words} > 0")
    order = quality.order_rules(df, (dear, quality.Rule("none", "{n_words} < 0"), some))
    assert order[0][0] == some and order[0][2] == 1 and {share for _, _, share in order[1:]} == {0}
    cost = {r.name: c for r, c, _ in order}
    assert cost["dear"] > 5 * cost["none"]


def test_rules_are_ordered_on_a_bounded_sample(docs):
    for some in (docs, docs.limit(0)):
        order = quality.order_rules(some, sample_rows=5, given=quality.RETURNED)
        assert {r for r, _, _ in order} == {*quality.RULES} and all(cost > 0 and 0 <= share <= 1 for _, cost, share in order)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("module,name", [(quality, "op2_quality_rules"), (mixing, "op4_mixing")])
def test_query_matches_sql(spark, module, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    got, want = module.QUERIES[name](spark, SF).toPandas(), con.execute(module.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want[columns].astype(got[columns].dtypes).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_near_duplicates_of_the_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = neardup.op3_near_duplicates(spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_shards_of_the_documents_are_exact(spark):
    got = sharding.op6_sharding(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows, texts = got.collect(), {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t) + 8, zlib.crc32(t)) for k, t in texts.items()}
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
