"""Code graph, call chains and session state, on small cases worked out by hand."""

import random

import pandas as pd

from quadlake.operators import navigation
from quadlake.sources import python_code
from quadlake.streaming import sessions

FILES = {
    "app/__init__.py": "from .tools import twice as double\nfrom .loop import ghost\n",
    "app/tools.py": "import os.path as osp\n\ndef twice(x):\n    return add(x, add(x, 1))\n\nasync def add(a, *b, c=0, **d) -> int:\n    osp.join(a)\n    return a\n",
    "app/loop.py": "from .ring import ghost\n",
    "app/ring.py": "from .loop import ghost\n",
    "app/shapes.py": "from app import double, ghost\nfrom .tools import add\n\nclass Base:\n    def area(self):\n        return double(2)\n\nclass Box(Base):\n    size: int = add(1)\n    def show(self, add):\n        add(3)\n        ghost()\n        return self.area()\n\nclass Loop(Knot):\n    def go(self): self.gone()\nclass Knot(Loop): pass\nif True:\n    def hidden(): pass\n",
    "bad.py": "def (:\n",
    "empty.py": None,
    "notes.txt": "def no(): pass",
}


def _graph(spark):
    # the same files twice: repositories do not see each other
    rows = [(r, p, t) for r in ("one", "two") for p, t in FILES.items() if r == "one" or p != "app/tools.py"]
    return python_code.code_graph(spark.createDataFrame(rows, "repo string, path string, text string"))


def test_code_graph(spark):
    rows = _graph(spark).collect()
    one = {(r.subject.split("/")[-1], r.relation, r.object, r.condition) for r in rows if r.repo == "one"}
    calls = {(s, o, c) for s, r, o, c in one if r == "calls"}
    assert calls == {
        ("tools.py::twice", "app/tools.py::add", "resolved"),
        ("tools.py::add", "join", "unresolved"),
        ("shapes.py::Base.area", "app/tools.py::twice", "resolved"),  # through the package's re-export
        ("shapes.py::Box", "app/tools.py::add", "resolved"),
        ("shapes.py::Box.show", "add", "unresolved"),  # a parameter hides the import
        ("shapes.py::Box.show", "ghost", "unresolved"),  # re-exports in a circle
        ("shapes.py::Box.show", "app/shapes.py::Base.area", "self"),
        ("shapes.py::Box.show", "area", "unresolved"),  # seen again without its class
        ("shapes.py::Loop.go", "gone", "unresolved"),  # base classes in a circle
    }
    # a call in an argument is no site, but its function is a use
    assert {(s, o) for s, r, o, _ in one if r == "uses"} >= {("tools.py::twice", "app/tools.py::add")}
    assert {o for s, r, o, c in one if r == "defines"} == {"app/tools.py::twice", "app/tools.py::add", *(f"app/shapes.py::{x}" for x in ("Base", "Base.area", "Box", "Box.show", "Loop", "Loop.go", "Knot"))}
    assert ("shapes.py::Box", "inherits", "app/shapes.py::Base", "resolved") in one
    assert ("tools.py::add", "annotates", "int", "return") in one
    assert {r.sig for r in rows if r.object == "app/tools.py::add" and r.relation == "defines"} == {"(a, *b, c, **d)"}
    assert all(r.condition != "resolved" or "tools" not in r.object for r in rows if r.repo == "two")


def test_facts_of_odd_files(spark):
    f = python_code.facts(spark.createDataFrame([("r", p, t) for p, t in FILES.items()], "repo string, path string, text string")).collect()
    assert [r.path for r in f if r.kind == "error"] == ["bad.py"]
    assert not [r for r in f if r.path in ("empty.py", "notes.txt")]
    assert python_code.code_graph(spark.createDataFrame([], "repo string, path string, text string")).count() == 0


def test_call_chains(spark):
    rng = random.Random(3)
    edges = sorted({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(26)})
    seeds = [f"n{i}" for i in range(9)] + ["alone"]
    got = navigation.call_chains(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame([(s,) for s in seeds], "seed string"), depth=2, limit=4).collect()
    onward: dict[str, list[str]] = {}
    for a, b in edges:
        onward.setdefault(a, []).append(b)
    want = {(s, i, " -> ".join(w)) for s in seeds for i, w in enumerate(navigation.chains(s, onward, 2, 4))}
    assert {tuple(r) for r in got} == want and want
    assert navigation.chains("a", {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": ["e"]}, 3, 6) == [["a", "c", "d", "e"], ["a", "b", "d"]]


def test_session_stream(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    rows = [(u, i, f"x{(i * 7 + u) % 90}") for u in (1, 2) for i in range(200)]
    for k in range(4):
        pd.DataFrame([r for r in rows if r[1] // 50 == k], columns=["user", "at", "item"]).to_parquet(place / f"{k}.parquet")
    stream = spark.readStream.schema("user long, at long, item string").option("maxFilesPerTrigger", 1).parquet(str(place))
    seen: dict[int, list[str]] = {}

    def keep(batch, _):
        seen.update({r["user"]: r["items"] for r in batch.collect()})

    sessions.session_memory(stream, "user", "item", "at").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    for u in (1, 2):
        items: list[str] = []
        for k in range(4):
            items = sessions.remember(items, [x for v, i, x in rows if v == u and i // 50 == k])
        assert seen[u] == items and len(items) == 64
