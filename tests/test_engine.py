"""Every catalogued query against its SQL at the smallest scale, and unit tests of the building blocks."""

import os

import duckdb
import pytest

import __spark_entry__
from quadlake.operators import graph, triples
from quadlake.plans import catalog, code_catalog, file_catalog, reader_catalog, store_catalog  # noqa: F401
from quadlake.plans.rules import Rule, derive

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted(map(tuple, x[columns].astype(str).to_numpy().tolist())) for x in (got, want)]
    assert rows[0] == rows[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


FACTS = [("Alice", "mentored", "Bob", "fact"), ("Bob", "mentored", "Carol", "fact"), ("Dan", "mentored", "Eve", "fact"), ("Frank", "mentored", "Gina", "fact"), ("Zoe", "mentored", "Zoe", "fact")]


def test_two_hop_rule(spark):
    q = spark.createDataFrame(FACTS, "subject string, relation string, object string, condition string")
    rule = Rule("two", (("?a", "mentored", "?b", "?_"), ("?b", "mentored", "?c", "?_")), ("?a", "mentor_of_mentor", "?c", "derived"), 0.9)
    assert {(r.subject, r.object, r.strong) for r in derive(q, [rule]).collect()} == {("Alice", "Carol", True), ("Zoe", "Zoe", True)}
    same = Rule("self", (("?a", "mentored", "?a", "?_"),), ("?a", "self", "?a", ""), 0.5)
    assert [(r.subject, r.strong) for r in derive(q, [same]).collect()] == [("Zoe", False)]
    assert derive(q, [Rule("void", (("?a", "mentored", "?b", "?_"),), ("?x", "r", "?a", ""))]).count() == 0
    assert derive(q, [Rule("capped", (("?a", "mentored", "?b", "?_"),), ("?a", "r", "?b", ""))], cap=2).count() == 2


def test_layers_and_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "source string, target string")
    assert {r.node: r.layer for r in graph.layers(e).collect()} == {"c": 0, "b": 1, "a": 2, "x": 3, "y": 3, "z": 3}
    nodes = spark.createDataFrame([("lonely",)], "node string")
    assert {r.node: r.component for r in graph.connected_components(e, nodes).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x", "lonely": "lonely"}


def test_sentence_ladder(spark):
    d = spark.createDataFrame([(1, "Bob is a doctor. Bob is an engineer! A and B are red; Ann works at Acme. Ann likes tea")], "id long, text string")
    got = [(r.subject, r.relation, r.object) for r in triples.sentence_quads(d, "id", "text").orderBy("pos").collect()]
    # the article alternative "a" needs no space after it, hence "n engineer"
    assert got == [("Bob", "is", "doctor"), ("Bob", "is", "n engineer"), ("A and B", "is", "red"), ("Ann", "works_at", "Acme"), ("Ann", "likes", "tea")]


def test_palette(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (24,), (25,)], "c long").select(catalog.rgb(__import__("pyspark").sql.functions.col("c"))).collect()]
    assert got == ["255,0,0", "0,64,192", "85,86,21"]
