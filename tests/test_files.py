"""Sentence facts, files as wholes, completion and shard files, on cases worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from quadlake.operators import completion, file_order, sentences
from quadlake.sources import file_facts, shard_files


def test_sentence_facts(spark):
    texts = [
        "I watched 22 MCU movies in two weeks", "My commute takes about 45 minutes each way", "Admon works the 8am-4pm shift on Sunday",
        "I graduated with a degree in Business Administration", "[user]: I'm a nurse (since 2020)", "- I like tea", "The user walks to work every day", "tiny", None, "",
        "I've been running marathons! Her house was old! They are very old", "The long name of an old red box holds tea",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r.id, r.pos): tuple(r)[2:] for r in sentences.fact_quads(d, "id", "text").collect()}
    assert got == {
        (0, 0): ("user", "watched", "22 MCU movies", "in two weeks"),
        (1, 0): ("user", "commute", "about 45 minutes", "each way"),
        (2, 0): ("Admon", "works", "the 8am-4pm shift", "on Sunday"),
        (3, 0): ("user", "graduated_with", "a degree in Business Administration", ""),
        (4, 0): ("user", "is", "nurse", "since 2020"),
        (6, 0): ("user", "walks_to", "work", "every day"),
        (10, 0): ("user", "has", "running marathons", ""),
        (10, 1): ("Her house", "was", "old", ""),  # a verb like any other that ends in s
        (10, 2): ("They", "is", "very old", ""),
    }


CASES = [
    ({"base.py": "class Base:\n    pass\n", "model.py": "from base import Base\nclass Model(Base):\n    pass\n", "main.py": "from model import Model\ndef run(): return Model()\n"}, ["base.py", "model.py", "main.py"]),
    ({"token.py": "class T: pass\n", "parser.py": "from token import T\nclass P:\n    def parse(self): return T()\n", "engine.py": "from parser import P\ndef run(): return P().parse()\n"}, ["token.py", "parser.py", "engine.py"]),
    ({"db.py": "class DB: pass\n", "repo.py": "from db import DB\nclass R:\n    def __init__(self): self.db = DB()\n", "api.py": "from repo import R\ndef get_r(): return R()\n"}, ["db.py", "repo.py", "api.py"]),
    ({"pkg/__init__.py": "from .core import go\n", "pkg/core.py": "LIMIT = 3\ndef go(): pass\n", "test_core.py": "import pkg.core\n", "cli/core.py": "from pkg import go, gone\n", "bad.py": "def (:\nfrom core import LIMIT, *\nimport json, cli.core\n", "none.py": None}, None),
]


@pytest.fixture(scope="module")
def quads(spark):
    rows = [(f"r{i}", p, t) for i, (files, _) in enumerate(CASES) for p, t in files.items()]
    return file_facts.file_graph(spark.createDataFrame(rows, "repo string, path string, text string")).cache()


def test_file_order(quads):
    files = quads.where("relation = 'contains_file'").select("repo", F.col("object").alias("alias"))
    rows = file_order.order_files(files, file_order.dependencies(quads)).orderBy("repo", "pos").collect()
    for i, (_, want) in enumerate(CASES):
        if want:
            assert [r.alias for r in rows if r.repo == f"r{i}"] == want


def test_file_quads(quads):
    got = {tuple(r)[1:5] for r in quads.where("repo = 'r3'").collect()}
    # cli/core.py comes first among the files named core.py
    assert ("r3", "contains_file", "core(1).py", "repo_level") in got
    assert {("core(1).py", "defines_constant", "LIMIT@core(1).py", "symbol_level"), ("go@core(1).py", "defined_in", "core(1).py", "symbol_level")} <= got
    assert ("__init__.py", "imports_symbol", "go@core(1).py", "internal") in got  # the last path has the name "core"
    assert {("core.py", "imports_symbol", "go@__init__.py", "inferred"), ("core.py", "imports_symbol", "gone@__init__.py", "inferred")} <= got
    assert {("bad.py", "imports_symbol", "LIMIT@core(1).py", "internal"), ("bad.py", "imports_module", "core(1).py", "internal"), ("bad.py", "imports_module", "core.py", "internal")} <= got
    assert ("bad.py", "imports_module", "json", "external") in got
    edges = {(r.source, r.target): (r.confidence, r.edge_type, len(r.evidence)) for r in file_order.dependencies(quads).where("repo = 'r3'").collect()}
    assert edges == {
        ("__init__.py", "core(1).py"): (0.9, "import", 1), ("core.py", "__init__.py"): (0.9, "import", 2), ("bad.py", "core(1).py"): (0.9, "import", 2), ("bad.py", "core.py"): (0.85, "module", 1),
        ("test_core.py", "core(1).py"): (0.85, "module", 2), ("test_core.py", "core.py"): (0.5, "heuristic", 1),
    }


def test_order_of_any_graph():
    rng = random.Random(5)
    for _ in range(200):
        files = [f"{rng.choice(['test_', '', ''])}f{i}.py" for i in range(7)]
        needs = {f: set(rng.sample(files, rng.randrange(3))) - {f} for f in files}
        got = file_order.order_one(files, needs)
        assert sorted(got) == sorted(files)
        # plainly: again and again the least of all files that need nothing open; a cycle's files in the end
        want, left = [], set(files)
        while ready := [f for f in left if not needs[f] & left]:
            want.append(min(ready, key=file_order.rank_of))
            left.remove(want[-1])
        assert got == want + sorted(left, key=file_order.rank_of)
        assert file_order.order_one(files, needs, late_tests=False)[len(want) :] == [f for f in files if f in left]


def test_completion(spark):
    text = "import numpy as np\nfrom a.b import c as d, e\nclass K:\n    def run(self):\n        self.rule.check(1)\n        self.rule.check(2)\n        x = _hid(3)\n        print(other.stop())\n"
    docs = spark.createDataFrame([("d", text), ("n", None)], "id string, text string")
    names = completion.names(docs, "id", "text")
    got = {(r.relation, r.object): (r.n, r.receivers) for r in names.collect()}
    assert got == {
        ("imports_module", "np"): (None, None), ("imports_symbol", "d"): (None, None), ("imports_symbol", "e"): (None, None), ("defines_class", "K"): (None, None), ("defines_function", "run"): (None, None), ("assigns_local", "x"): (None, None),
        ("used_as_method", "check"): (2, {"self.rule": 2, ".rule": 2}), ("used_as_method", "stop"): (1, {"other": 1, ".other": 1}), ("used_as_function", "run"): (1, None), ("used_as_function", "_hid"): (1, None),
    }
    sites = spark.createDataFrame([("a", "x\n  self.rule.\n\n"), ("b", "y.fo"), ("c", "f(a,"), ("e", "plain word"), ("f", " \n"), ("g", "arr[0].")], "id string, t string")
    assert {r.id: tuple(r.s) for r in sites.select("id", completion.site(F.col("t")).alias("s")).collect()} == {
        "a": ("method_call", "self.rule", None), "b": ("attribute", "y", "fo"), "c": ("arg_position", None, None), "e": ("bare", None, None), "f": ("unknown", None, None), "g": ("method_call", "arr[0]", None),
    }
    ranked = completion.rank(names, spark.createDataFrame([("d", "K\n self.rule.")], "id string, tail string"))
    order = [(r.symbol, r.kind, r.score) for r in ranked.orderBy("pos").collect()]
    # check: 10 + 6, a callable at a call 30, the same receiver 60; K: a class 5, named before 8
    assert order[0] == ("check", "used_method", 106)
    assert ("K", "class", 23) in order and ("stop", "used_method", 43) in order and ("_hid", "used_func", -2) in order
    few = completion.reduce(spark.createDataFrame([("d", 1, "make_one", "var", 30), ("d", 2, "make", "var", 29), ("d", 3, "gone", "var", 5), ("d", 4, "late", "var", 4)], "id string, pos long, symbol string, kind string, score long"), top_k=2, always=("late",), never=("gone",))
    assert [(r.symbol, r.score) for r in few.orderBy("pos").collect()] == [("late", 44), ("make", 29)]


def test_shard_files(spark, tmp_path):
    quads, tape = [("a", "r", "b", ""), ("b", "r", "ü", "when")], [("a", "r", "b", ""), None, ("b", "r", "ü", "when"), None]
    data = shard_files.encode(quads, tape, 64, "what it holds")
    assert shard_files.decode(data) == (quads, tape, 64, "what it holds")
    assert data[:12] == b"PMEM" + bytes([64, 0, 5, 0, 2, 0, 4, 0])
    assert shard_files.decode(shard_files.encode([])) == ([], [], 256, "")
    with pytest.raises(ValueError):
        shard_files.encode([("x" * 256, "r", "b", "")])
    with pytest.raises(ValueError):
        shard_files.decode(b"else")
    (tmp_path / "s1.pmem").write_bytes(data)
    assert {tuple(r) for r in shard_files.read_shards(spark, str(tmp_path)).collect()} == {("s1", *q) for q in quads}
