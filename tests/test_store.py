"""The order of placing in the store, nested functions and answers that are none, worked out by hand."""

from pyspark.sql import functions as F

from quadlake.operators import prompts, store
from quadlake.sources import functions


def test_fold():
    assert store.fold([], 4) == []
    assert store.fold([[], [("a", "b")]], 4) == [0, 0]
    # c shares b with the first; d and e would fill it to its capacity; the last shares with both and takes more entities
    assert store.fold([[("a", "b")], [("b", "c")], [("d", "e")], [("e", "b")], []], 4, 2.0) == [0, 0, 1, 1, 1]
    assert store.fold([[("a", "a")], [("a", "b")]], 9, 0.5) == [0, 1]  # dense shards take nothing


def test_encode(spark):
    rows = [("s", 1, "a", "b"), ("s", 2, "b", "c"), ("s", 3, "d", "e"), ("s", 3, "d", "e"), ("t", 7, "d", "e")]
    q = spark.createDataFrame(rows, "store string, batch long, subject string, object string")
    assert sorted(map(tuple, store.encode(q, 4, 2.0).collect())) == [("s", 1, 0), ("s", 2, 0), ("s", 3, 1), ("t", 7, 0)]
    assert store.encode(q.limit(0)).count() == 0


def test_functions(spark):
    text = 'class A:\n    def f(self):\n        """Doc."""\n        def g(): pass\n'
    files = spark.createDataFrame([("r", "a.py", text), ("r", "b.py", "def ("), ("r", "c.py", None)], "repo string, path string, text string")
    found = functions.functions(files)
    assert {(x.qual, x.line, x.docstring) for x in found.collect()} == {("a.py::A.f", 2, "Doc."), ("a.py::A.f.g", 4, "")}


def test_answers(spark):
    d = spark.createDataFrame([("",), (None,), ("no list",), ("[1, 2",), ("```\n[1]\n```",)], "t string")
    got = [tuple(r) for r in d.select(*[prompts.answer(F.col("t"), k) for k in ("json_array", "json_string", "single_token", "line")]).collect()]
    assert got == [(None, None, None, None), (None, None, None, None), (None, None, "no", "no list"), (None, None, "[1,", "[1, 2"), ("[1]", None, "[1]", "[1]")]
