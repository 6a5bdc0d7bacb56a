"""Near-duplicate groups with bottom-k sketches from one hash function.

A document's set is its distinct word shingles, hashed once to 64 bits; its sketch is the ``SKETCH`` least hashes.

1. Rows with equal sets form one class, a node of its own; only classes go on, so copies never meet as pairs.
2. Inverted lists of retained values give overlaps. Values that more than ``LIST_ROWS`` classes retain say too little, as
   common word pairs and shared passages do, and are set aside: each class is listed under its ``LISTED`` least others, so
   every list is short, and pairs in it must agree on a third of these.
3. Every class with a value set aside is listed also under runs of three neighbouring sketch values, common or not, as two
   texts may share little else. Short lists give pairs whose sketches agree well enough. Each member of a long list is
   paired with three pivots of the list; so a group of near copies falls into one component with a few comparisons each.
4. The union sketch of a listed pair estimates its similarity; pairs clearly below the threshold go.
5. The others are confirmed on their full sets, read again from the text of the documents concerned, and make components.
6. Lists with the same first member become one. Members that lie in different components then are compared, and only
   these: in blocks inside tasks, first by sketches, then those whose sketches agree by full sets of like size, breadth
   first from component to component. Blocks are bounded in members and in values, and no two blocks of the list's largest
   component meet.
7. All confirmed links make the final components, named after their least doc_id.

So a list of M members costs M times those outside its largest component, not M squared; only lists of many texts that
share passages but are not near copies cost their square, in sketches of 64 bytes.

What a sketch leaves out is a matter of chance that the sizes here keep small: a pair right at the threshold is missed if
its estimate falls 4.5 standard deviations short, or if its twelve values agree on fewer than four (6 in 100,000) and one
of the texts holds no common value or no three neighbouring values of 32 are shared (1.5 in 100,000); far fewer above the
threshold. Sets of at most 32 shingles always share such a run (those of five or fewer a run of two).

Defined cases: null and empty text, or text without words, has an empty set, links with nothing and stays; a row
without doc_id can't be named as a component, links with nothing and stays. Rows with the same doc_id and set are one node;
rows with the same doc_id and other sets are nodes of their own, which link or don't.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import bloom
from quillgraph.llm.common import Scratch, fresh, own, table
from quillgraph.llm.components import components
from quillgraph.llm.text import Words, distinct, mix, pairs, slices

SKETCH = 32
#: Sketch values that may be listed, and how many of them are.
POOL = 24
LISTED = 12
LIST_ROWS = 32
#: Members and values of a block of a long list, at most (one set, if it alone has more values).
BLOCK = 1024
BLOCK_VALUES = 1 << 20


def sets_of(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, as signed integers."""
    words = Words(column)
    h = words.hash
    grams = h
    for k in range(1, size):
        grams = pairs(grams[: max(0, len(h) - k)], h[k:])
    out = []
    for a, b in zip(words.first.tolist(), words.first[1:].tolist(), strict=False):
        if b - a >= size:
            s = distinct(grams[a : b - size + 1].view(np.int64))
        elif b > a:
            whole = h[a : a + 1]
            for i in range(a + 1, b):
                whole = pairs(whole, h[i : i + 1])
            s = mix(whole + np.uint64(b - a)).view(np.int64)
        else:
            s = np.zeros(0, np.int64)
        out.append(s)
    return out


def set_key(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key (null: empty set) and sketch of each row."""

    def scan(batches):
        for batch in slices(batches):
            sets = sets_of(batch.column(2), size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s[:k] for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "set_key", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(scan, "doc_id long, text_key long, n_shingles long, set_key binary, sketch array<long>")


def _marked(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Each class with its own values (few), those of them that others have (keys), and its sketch if it holds common values."""
    held = classes.select("node", F.explode(F.slice("sketch", 1, POOL)).alias("value"))
    counts = scratch.keep(held.groupBy("value").agg(F.count("*").alias("c")).where("c > 1"), "values")
    of = lambda test, name: F.collect_list(F.when(F.expr(test), F.col("value"))).alias(name)
    flags = held.join(counts, "value").groupBy("node").agg(of(f"c > {LIST_ROWS}", "common"), of(f"c <= {LIST_ROWS}", "repeated"))
    rows = classes.join(flags, "node", "left").withColumn("own", F.expr(f"slice(array_except(slice(sketch, 1, {POOL}), coalesce(common, array())), 1, {LISTED})"))
    short = F.expr("transform(own, v -> CAST(v & 2147483647 AS INT))")
    return rows.select("node", "n", short.alias("few"), F.expr("array_intersect(own, coalesce(repeated, array()))").alias("keys"), F.expr("CASE WHEN size(common) > 0 THEN sketch END").alias("sketch"))


#: Own values of which a third agree.
THIRD = "size(array_intersect(x.few, y.few)) >= greatest(1, CAST(least(size(x.few), size(y.few)) / 3 AS INT))"


def _least(percent: int) -> tuple[float, float]:
    """Factors of s and of its root in the least agreement of two sketches, the larger of s values, that step 4 could pass."""
    t = percent / 100
    return t, 4.5 * (t * (1 - t)) ** 0.5


def _pairs_of_lists(rows: DataFrame, percent: int, agree: str = THIRD) -> DataFrame:
    """Pairs (a, b) within each list of rows (key, node, n, few) that may reach the threshold; lists are short."""
    lists = rows.groupBy("key").agg(F.collect_list(F.struct("node", "n", "few")).alias("m")).where("size(m) > 1")
    pairs_of = f"""flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> x.node != y.node
        AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND {agree}), y -> struct(least(x.node, y.node) AS a, greatest(x.node, y.node) AS b))))"""
    return lists.select(F.explode(F.expr(pairs_of)).alias("p")).select("p.*")


def linked(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets, each pair of it at the threshold: breadth first, against those not yet reached.

    Sets of one ``label`` count as linked already; no pair of them is compared.
    """
    size = np.array([len(x) for x in sets])
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    _, value = np.unique(np.concatenate(sets), return_inverse=True) if sets else (None, np.zeros(0, np.int64))
    first = np.concatenate([[0], np.cumsum(size)])
    left = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    flag = np.zeros(int(value.max()) + 1 if len(value) else 0, bool)
    flat, start = value, first[:-1]  # of those not yet reached
    while len(left):
        own = label[left] == label[left[0]]
        queue, (left, flat, start) = left[own].tolist(), _without(left, flat, start, own)
        while queue and len(left):
            i = queue.pop()
            flag[value[first[i] : first[i + 1]]] = True
            common = np.add.reduceat(flag[flat].astype(np.int64), start)
            flag[value[first[i] : first[i + 1]]] = False
            hit = 100 * common >= percent * (size[i] + size[left] - common)
            if hit.any():
                out += [(i, j) for j in left[hit].tolist()]
                hit = np.isin(label[left], label[left[hit]])
                queue += left[hit].tolist()
                left, flat, start = _without(left, flat, start, hit)
    return out


def _without(left: np.ndarray, flat: np.ndarray, start: np.ndarray, gone: np.ndarray):
    """What is left of the sets (none empty) and of their values, laid end to end."""
    sizes = np.diff(np.append(start, len(flat)))
    flat, sizes = flat[np.repeat(~gone, sizes)], sizes[~gone]
    return left[~gone], flat, np.cumsum(sizes) - sizes


def _runs(marked: DataFrame, percent: int) -> DataFrame:
    """(key, node, total, p1, p2, p3): classes with a sketch under its runs of three values (and of two in the smallest sets)
    that ``total`` classes have, and three pivots of each list, chosen by hashes of the members."""
    run = lambda k: f"transform(sequence(1, size(sketch) - {k - 1}), i -> xxhash64({', '.join(f'sketch[i + {j}]' for j in range(-1, k - 1))}))"
    keys = F.expr(f"CASE WHEN size(sketch) <= {-(-percent // max(1, 100 - percent)) + 1} THEN concat({run(3)}, {run(2)}) ELSE {run(3)} END")
    rows = marked.where("size(sketch) > 2").select("node", F.explode(F.array_distinct(keys)).alias("key"))
    h = F.xxhash64("node")
    pivots = [F.min_by("node", h).alias("p1"), F.max_by("node", h).alias("p2"), F.min_by("node", F.xxhash64(F.lit(7), "node")).alias("p3")]
    counts = rows.groupBy("key").agg(F.count("*").alias("total"), *pivots).where("total > 1")
    return rows.join(counts, "key").select("key", "node", "total", "p1", "p2", "p3")


def _brief(marked: DataFrame) -> DataFrame:
    """(node, n, few): 16 bits of each sketch value."""
    return marked.where("size(sketch) > 2").select("node", "n", F.expr("transform(sketch, v -> CAST((v & 65535) - 32768 AS SMALLINT))").alias("few"))


def _agreement(percent: int) -> str:
    """Whether the sketches of x and y agree well enough, one value aside."""
    per, root = _least(percent)
    return f"size(array_intersect(x.few, y.few)) >= {per} * greatest(size(x.few), size(y.few)) - {root} * sqrt(greatest(size(x.few), size(y.few))) - 1"


def _merged(lists: DataFrame) -> DataFrame:
    """Long lists (p1, node, label) as (key, node, label): those with the same first member made one, under its name.

    Near copies share most of their runs, so their lists have the same members over and over; a member has some thirty lists
    at most, which bounds what becomes one.
    """
    return lists.select(F.col("p1").alias("key"), "node", "label").distinct()


def _pivoted(long: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each member of a long list with three pivots of it, the same ones whatever the list, if they may link."""
    pairs_of = long.select("node", F.explode(F.array_distinct(F.array("p1", "p2", "p3"))).alias("pivot")).where("node != pivot").distinct()
    of = lambda c: brief.select(F.col("node").alias("node" if c == "x" else "pivot"), F.struct("n", "few").alias(c))
    both = pairs_of.join(of("x"), "node").join(of("y"), "pivot").where(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)").where(_agreement(percent))
    return both.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` (by, node, n, label, ...) dealt to pairs of blocks (p, q): every two members of one ``by`` and of different
    labels meet in one. Blocks of the largest label (top) meet only blocks of others."""
    sums = rows.groupBy(*by, "label").agg(F.count("*").alias("c"), F.sum("n").alias("v"))
    parts = lambda c, v: F.greatest(F.lit(1), F.ceil(F.greatest(c / BLOCK, v / BLOCK_VALUES))).cast("long")
    tops = sums.groupBy(*by).agg(F.max_by("label", "c").alias("_top"), F.sum("c").alias("c"), F.sum("v").alias("v"), F.max("c").alias("tc"), F.max_by("v", "c").alias("tv"))
    tops = tops.where("c > tc").select(*by, "_top", parts(F.col("tc"), F.col("tv")).alias("_a"), parts(F.col("c") - F.col("tc"), F.col("v") - F.col("tv")).alias("_b"))
    rows = rows.join(tops, list(by)).withColumn("top", F.col("label") == F.col("_top"))
    h = F.xxhash64("node")
    part = F.when(F.col("top"), F.pmod(h, F.col("_a"))).otherwise(F.col("_a") + F.pmod(h, F.col("_b")))
    others = F.sequence(F.when(F.col("top"), F.col("_a")).otherwise(F.lit(0).cast("long")), F.col("_a") + F.col("_b") - 1)
    rows = rows.withColumn("_part", part).withColumn("_other", F.explode(others)).where("_other != _part")
    return rows.withColumn("p", F.least("_part", "_other")).withColumn("q", F.greatest("_part", "_other")).drop("_top", "_a", "_b", "_part", "_other")


def _alike(long: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, label): members of long lists whose sketch agrees with that of a member in another component."""
    per, root = _least(percent)

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        size, n, label, top = group["few"].str.len().to_numpy(), group["n"].to_numpy(), group["label"].to_numpy(), group["top"].to_numpy()
        first = np.cumsum(size) - size
        values = np.concatenate(group["few"].to_list()).astype(np.int64) & 65535
        flag, stays = np.zeros(65536, np.int8), np.zeros(len(n), bool)
        for i in np.flatnonzero(~top):
            own = values[first[i] : first[i] + size[i]]
            flag[own] = 1
            agree = np.add.reduceat(flag[values], first, dtype=np.int64)
            flag[own] = 0
            s = np.maximum(size, size[i])
            near = (label != label[i]) & (agree >= per * s - root * np.sqrt(s)) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            if near.any():
                stays |= near
                stays[i] = True
        return group.loc[stays, ["key", "node", "n", "label"]]

    return _dealt(long, "key").groupBy("key", "p", "q").applyInPandas(thin, "key long, node long, n long, label long").distinct()


def _dense_links(alike: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different components in the lists of ``alike``; those that don't fit in one block are
    dealt also by size, as only sets of like size can link."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))) if percent < 100 else F.col("n")
    fits = alike.groupBy("key").agg(((F.count("*") <= BLOCK) & (F.sum("n") <= BLOCK_VALUES)).alias("fits"))
    bands = F.when(F.col("fits"), F.array(F.lit(-1).cast("long"))).otherwise(F.array(band.cast("long"), band.cast("long") + 1))
    rows = alike.join(fits, "key").withColumn("band", F.explode(bands)).drop("fits")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        node = group["node"].to_numpy()
        found = np.array(linked(group["full"].to_list(), percent, group["label"].to_numpy()), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[found].min(axis=1), "b": node[found].max(axis=1)})

    return _dealt(rows, "key", "band").drop("n", "top").join(full, "node").groupBy("key", "band", "p", "q").applyInPandas(search, "a long, b long").distinct()


def _estimated(candidates: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidates whose union sketch doesn't rule the threshold out."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("sketch").alias(f"s_{c}"))
    both = candidates.join(side("a"), "a").join(side("b"), "b")
    t = percent / 100
    estimate = f"""element_at(transform(array(slice(sort_array(array_union(s_a, s_b)), 1, {k})), u ->
        size(array_intersect(array_intersect(u, s_a), s_b)) >= size(u) * {t} - 4.5 * sqrt(size(u) * {t * (1 - t)})), 1)"""
    return both.where(F.expr(estimate)).select("a", "b")


def _full_sets(wanted: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, full): the sets of the classes wanted (node, rep, set_key), read from the text of their documents; others are
    passed over by a Bloom filter."""
    held = docs.sparkSession.sparkContext.broadcast(bloom.build(wanted, "rep", wanted.count()))

    def scan(batches):
        seen = set()  # rows named here, of one partition
        for batch in slices(batches):
            batch = batch.filter(pa.array(held.value.holds(batch.column(0).to_numpy(zero_copy_only=False))))
            sets = sets_of(batch.column(1), size)
            rows = [(d, k, s) for d, k, s in zip(batch.column(0).to_pylist(), map(set_key, sets), sets, strict=True) if k and (d, k) not in seen]
            seen.update(x[:2] for x in rows)
            rep, key, full = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(key, pa.binary()), pa.array(full, pa.list_(pa.int64()))], ["rep", "set_key", "full"])

    found = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL").mapInArrow(scan, "rep long, set_key binary, full array<long>")
    return found.groupBy("rep", "set_key").agg(F.first("full").alias("full")).join(wanted, ["rep", "set_key"]).select("node", "full")


def _verified(candidates: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) whose full sets reach the threshold."""
    both = candidates.join(full.select(F.col("node").alias("a"), F.col("full").alias("f_a")), "a").join(full.select(F.col("node").alias("b"), F.col("full").alias("f_b")), "b")
    common = both.select("a", "b", (F.size("f_a") + F.size("f_b")).alias("total"), F.size(F.array_intersect("f_a", "f_b")).alias("common"))
    return common.where(f"100 * common >= {percent} * (total - common)").select("a", "b")


def groups(docs: DataFrame, size: int = 5, percent: int = 80, k: int = SKETCH, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, text_key, n_shingles, component (a number of the group, null for rows that link with nothing by definition) and
    component_id of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "neardup")
    base = scratch.keep(sketches(docs, size, k), "base")
    named = base.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    large = classes.where(f"n >= {-(-percent // max(1, 100 - percent))}")  # smaller sets have no other set near enough
    marked = scratch.keep(_marked(large.select("node", "n", "sketch"), scratch), "marked")
    own_pairs = _pairs_of_lists(marked.select("node", "n", "few", F.explode("keys").alias("key")), percent)
    runs, brief = scratch.keep(_runs(marked, percent), "runs"), _brief(marked)
    short, long = runs.where(f"total <= {LIST_ROWS}").join(brief, "node"), runs.where(f"total > {LIST_ROWS}").drop("total")
    listed = own_pairs.union(_pairs_of_lists(short, percent, _agreement(percent))).union(_pivoted(long, brief, percent)).distinct()
    likely = scratch.keep(_estimated(listed, classes, k, percent), "likely")

    key_of = classes.select("node", "rep", "set_key")
    wanted = scratch.keep(key_of.join(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node"), "wanted")
    full = scratch.keep(_full_sets(wanted, docs, size), "full")
    links = scratch.keep(_verified(likely, full, percent), "links")
    steps = Scratch(spark, "components")
    found = scratch.keep(components(links, steps), "found")

    labelled = long.join(found.withColumnRenamed("component", "label"), "node", "left").select("p1", "node", F.coalesce("label", "node").alias("label"))
    lists = scratch.keep(_merged(labelled), "lists")
    alike = scratch.keep(_alike(lists.join(brief, "node"), percent), "alike")
    if not alike.isEmpty():
        more = scratch.keep(key_of.join(alike.select("node").distinct(), "node").join(wanted.select("node"), "node", "left_anti"), "more")
        rest = scratch.keep(_full_sets(more, docs, size), "rest")
        dense = scratch.keep(_dense_links(alike, full.union(rest), percent), "dense")
        if not dense.isEmpty():
            found = scratch.keep(components(found.selectExpr("node AS a", "component AS b").union(dense), steps), "merged")
    steps.drop()
    scratch.drop("values", "marked", "runs", "likely", "wanted", "full", "links", "lists", "alike", "more", "rest", "dense")

    members = found.join(classes.select("node", "rep"), "node")
    least = members.groupBy("component").agg(F.min("rep").alias("least"))
    linked_to = found.join(least, "component").select("node", "component", "least")
    of_class = classes.select("set_key", "node", "rep").join(linked_to, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"), F.coalesce("least", "rep").alias("least"))
    out = base.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(of_class, "set_key", "left")
    return out.select("doc_id", "text_key", "n_shingles", "component", F.coalesce("least", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, k: int = SKETCH, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text): groups of texts whose sets of
    ``size``-word shingles are linked at ``percent`` per cent or more."""
    found = groups(docs, size, percent, k, scratch)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group: that of its least doc_id, or one of those.

    Rows without words or without doc_id all stay. Rows are told apart by doc_id and text: where doc_id repeats, a row
    goes only if its own text has a near duplicate that stays.
    """
    spark = docs.sparkSession
    scratch, kept = Scratch(spark, "neardup"), Scratch(spark, "neardup-gone")
    found = scratch.keep(groups(docs.select("doc_id", "text"), size, percent, scratch=scratch).where("component IS NOT NULL"), "groups")
    first = found.where("doc_id = component_id").groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("c"))
    several = first.groupBy("component").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo != hi").select("component", F.col("lo").alias("text_key"))
    others = first.join(several.select("component"), "component", "left_semi").join(several, ["component", "text_key"], "left_anti").select("doc_id", "text_key")
    gone = kept.keep(found.where("doc_id != component_id").select("doc_id", "text_key").union(others).distinct(), "gone")
    twice = kept.keep(first.where("c > 1").select("doc_id", "text_key").join(gone, ["doc_id", "text_key"], "left_anti"), "twice")
    scratch.drop()

    # Few rows go, and texts are long: a Bloom filter tells which rows may, and only these are shuffled to be told for certain.
    held = spark.sparkContext.broadcast(bloom.build(gone.select(F.xxhash64("doc_id", "text_key").alias("k")), "k", gone.count()))

    @F.pandas_udf("boolean")
    def may_go(keys: pd.Series) -> pd.Series:
        return pd.Series(held.value.holds(keys.to_numpy()))

    key, text_key, number, flag = fresh(docs, "_key", "_text", "_number", "_flag")
    to = lambda df: df.withColumnsRenamed({"doc_id": key, "text_key": text_key})
    rows = docs.select(*own(docs), F.col("doc_id").cast("long").alias(key), F.xxhash64("text").alias(text_key))  # a null doc_id is in neither table
    rows = rows.withColumn(flag, may_go(F.xxhash64(key, text_key)))
    rest = rows.where(~F.col(flag)).unionByName(rows.where(flag).join(to(gone), [key, text_key], "left_anti")).drop(flag)
    if not twice.isEmpty():  # equal rows of one identifier
        within = F.row_number().over(Window.partitionBy(key, text_key).orderBy(key))
        once = rest.join(to(twice), [key, text_key], "left_semi").withColumn(number, within).where(F.col(number) == 1).drop(number)
        rest = rest.join(to(twice), [key, text_key], "left_anti").unionByName(once)
    return rest.select(*own(docs))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 80 per cent); documents without words stay."""
    return drop_near_duplicates(docs)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


QUERIES = {"op3_near_duplicates": op3_near_duplicates}
SQL: dict[str, str] = {}
