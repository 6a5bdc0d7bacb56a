"""Steps keep their share of memory and tasks however large the tables are."""

import os

import pytest
from pyspark.sql import functions as F

from quillgraph.plans import parse
from quillgraph.plans.build import parse_changed, parse_files
from quillgraph.plans.resolve import mirrored, resolve

SF = "/root/testdata/sf0.001"


@pytest.fixture
def eager(spark):
    """Any join that may broadcast does."""
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 40))
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_files_of_one_packed_table_are_dealt_to_all_tasks(spark):
    from quillgraph.etl_queries import files

    made = files(spark, SF)
    held = made.groupBy(F.spark_partition_id().alias("p")).count().where("count > 0")
    assert held.count() >= 2 * spark.sparkContext.defaultParallelism


def test_names_of_documents_are_not_broadcast(eager):
    nodes = eager.createDataFrame([("r", "x.md", "s"), ("s", "d/x.md", None)], "id string, path string, superseded_by string")
    rows = eager.createDataFrame([("s", "d/x.md", "../x.md", "references", "L1", 0)], "source string, source_path string, target_raw string, relation string, location string, ordinal int")
    files = eager.createDataFrame([("x.md", "# X", "h")], "path string, content string, content_hash string")
    for df in (resolve(rows, nodes), mirrored(nodes), parse_changed(files, parse.Rules(), parse_files(files, parse.Rules()))):
        assert "Broadcast" not in plan(df) and df.count()


@pytest.mark.parametrize("front", ["a: x", "a: null", "null: a", "a: true\nb: [x, y-1]", "a: [x, null]", "a: x #c", "a: b#c d", 'a: "x: #y"', "a: 2001-09-01", "a: 12", "a: x\na: y", "a: x\n  y", "a: [x,y]", "a:", "A_b: x y.md", "a: n", 'a: "x\\ty"'])
def test_plain_frontmatter_reads_as_yaml_reads_it(front, monkeypatch):
    def read():
        try:
            return parse.read_fields(front)
        except parse.ParseError as e:
            return str(e)

    quick = read()
    monkeypatch.setattr(parse, "_plain_fields", lambda front: None)
    assert quick == read()


@pytest.mark.parametrize("forest", [3, 40, 2_000_000])
def test_components_by_contraction_are_those_of_a_search(spark, forest, monkeypatch):
    import random

    from quillgraph.operators import walks

    monkeypatch.setattr(walks, "FOREST", forest)
    rnd = random.Random(forest)
    links = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(90)] + [(f"s{i}", "hub") for i in range(60)] + [(f"r{rnd.randrange(80)}", f"r{rnd.randrange(80)}") for _ in range(60)] + [("self", "self")]
    near: dict = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [x] if x not in want else []
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    del want["self"]
    rnd.shuffle(links)
    edges = spark.createDataFrame(links, "a string, b string").repartition(4)
    lone = {x for x in want if near[x] == {x}}
    assert {r.id: r.component for r in walks.component_labels(edges).collect()} == {k: v for k, v in want.items() if k not in lone}
    # What a task hands on is a forest: fewer edges than ids, however many came in.
    assert walks._contracted(spark.range(0, 5000, 1, 1).selectExpr("id % 10 AS a", "(id + 1) % 10 AS b")).count() == 9


def test_orphans_join_each_linked_id_once(spark):
    import datetime as dt

    from quillgraph.model import Graph, Settings
    from quillgraph.operators import lookups

    nodes = spark.createDataFrame([(x, x, "k", "active", f"{x}.md", None, False, None) for x in "abc"], "id string, title string, kind string, status string, path string, created date, orphan_ok boolean, superseded_by string")
    edges = spark.createDataFrame([("b", "a", "references"), ("c", "a", "related"), ("c", "a", "references")], "source string, target_id string, relation string")
    found = lookups.orphans(Graph(nodes, edges, Settings(today=dt.date(2020, 1, 1))))
    assert [r.id for r in found.collect()] == ["b", "c"]
    assert "Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()
