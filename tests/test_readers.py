"""Sources, the cache of extractions, lookups and reports against cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quadlake.functions import text as X
from quadlake.operators import evaluation, graph, lookups
from quadlake.sources import readers


def test_scan_keeps_the_first_readable_files(spark, tmp_path):
    for path, raw in {"b/x.py": b"x = 1\n", "a.py": "é".encode(), "b/__pycache__/x.py": b"no", "c.txt": b"no", "d.py": b"\xff\xfe", "e.py": b"", "é f.py": b"y"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(raw)
    assert sorted(map(tuple, readers.scan(spark, str(tmp_path)).collect())) == [("a.py", "é"), ("b/x.py", "x = 1\n"), ("e.py", ""), ("é f.py", "y")]
    assert [r.path for r in readers.scan(spark, f"{tmp_path}/", limit=2).collect()] == ["a.py", "b/x.py"]


def test_cases_of_one_document(spark, tmp_path):
    case = {"python": [{"repo": "r", "content": {"a.py": "pass"}, "needles": [{"name": "f", "description": "d", "path": "a.py", "start_line": 4}]}, {"repo": "s", "content": {}, "needles": []}]}
    (tmp_path / "cases.json").write_text(json.dumps(case, indent=1))
    assert [tuple(r) for r in readers.load_cases(spark, str(tmp_path / "cases.json")).collect()] == [("r", "f", "d", "a.py", 5)]


def test_json_documents_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, '{"a.py": "x", "b.py": null}'), (2, "[1]"), (3, None), (4, "{}"), (5, "junk")], "id int, j string")
    assert sorted(map(tuple, readers.json_documents(rows, "j", "id").collect())) == [(1, "a.py", "x"), (1, "b.py", None)]


def test_task_cards(tmp_path):
    base = {"domain": "d", "description": "x", "input_schema": {}, "query": {"kind": "qa"}}
    (tmp_path / "card.json").write_text(json.dumps({**base, "eval": {"threshold": 0.5}}))
    card = readers.task_card(str(tmp_path / "card.json"))
    assert card["eval"] == {"metric": "exact_match", "threshold": 0.5} and card["holdout"] == []
    assert readers.task_card(base)["eval"]["threshold"] == 0.8
    with pytest.raises(ValueError, match="query"):
        readers.task_card({k: base[k] for k in ("domain", "description", "input_schema")})


def test_cache_extracts_each_text_once(spark, tmp_path):
    seen = []

    def lines(texts):
        seen.append(texts.count())
        return texts.select("key", F.posexplode(F.split("text", "\n")).alias("seq", "line"))

    cache = readers.ExtractionCache(spark, str(tmp_path / "cache"))
    files = spark.createDataFrame([(1, "a\nb"), (2, "a\nb"), (3, None)], "id int, text string")
    assert {r.id: r.status for r in cache.extract(files, lines).collect()} == {1: "miss", 2: "miss", 3: "miss"}
    status = cache.extract(files.union(spark.createDataFrame([(4, "new")], "id int, text string")), lines)
    assert {r.id: r.status for r in status.collect()} == {1: "hit", 2: "hit", 3: "hit", 4: "miss"} and seen == [2, 1]
    assert tuple(cache.stats(status).first()) == (3, 1, 0.75) and cache.facts().count() == 4
    cache.clear()
    assert cache.index().count() == 0 and cache.facts() is None


def test_identifier_parts(spark):
    names = ["getHTTPUrl", "snake_case.Name", "__init__", "a1B", "", "Über"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(X.split_identifier(F.col("n"))).collect()
    assert [r[0] for r in got] == [["get", "httpurl"], ["snake", "case", "name"], ["init"], ["a1", "b"], [], ["über"]]


def test_modules_by_their_longest_suffix(spark):
    modules = spark.createDataFrame([("x.y", "xy.py"), ("z", "z.py"), ("b.c", "bc.py")], "module string, file string")
    wanted = spark.createDataFrame([(m,) for m in ("x.y", "a.x.y", "q.z", "a.b.c", "a.b", "", "z")], "module string")
    assert {r.module: r.file for r in lookups.find_modules(wanted, modules).collect()} == {"x.y": "xy.py", "a.x.y": "xy.py", "q.z": "z.py", "a.b.c": "bc.py", "a.b": None, "": None, "z": "z.py"}


def test_standard_imports(spark):
    lines = ["import os.path", "from json import *", " from json import mine, b", "from numpy import x", "import jsonx", "x = 1", "from typing import other"]
    got = lookups.standard_imports(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame([("mine",)], "name string"))
    assert {r.line: r.standard for r in got.collect()} == dict(zip(lines, [True, True, False, False, False, False, True], strict=True))


def test_graph_stats_of_a_cycle(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.9), ("x", "y", 0.2)], "source string, target string, confidence double")
    assert graph.stats(e).first().asDict() == {"n_files": 5, "n_edges": 4, "n_strong": 3, "has_cycle": True, "n_components": 2, "n_ambiguous_pairs": 7}
    assert graph.stats(e.where("source <> 'c'")).first().has_cycle is False


def test_grading(spark):
    rows = [(1, ["a"], ["a"]), (2, [], ["a"]), (3, ["b", "a"], ["a", "b"]), (4, ["a", "a"], ["a", "b"]), (5, ["a"], ["a", "b"])]
    got = evaluation.records(spark.createDataFrame(rows, "qi int, pred array<string>, gold array<string>")).collect()
    assert {r.qi: (r.exact, r.error_type) for r in got} == {1: (True, "correct"), 2: (False, "empty"), 3: (False, "wrong_order"), 4: (False, "wrong_files"), 5: (False, "wrong_files")}
    assert tuple(got[0].asDict()) == evaluation.RECORD
