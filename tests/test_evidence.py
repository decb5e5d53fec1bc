"""Evidence packets worked out by hand, and JSON as models write it."""

import json

from quadlake.functions import json_text
from quadlake.operators import evidence
from quadlake.sources import python_code

FILES = {
    "lib/__init__.py": "from .net import fetch\n",
    "lib/net.py": "import json\n\ndef fetch(url):\n    return pause(url)\n\ndef pause(n):\n    pass\n",
    "app.py": "from lib import fetch, missing\nimport lib.gone\nimport os\n\nclass App:\n    def run(self):\n        fetch('u')\n        self.stop()\n    def stop(self):\n        pass\n",
    "bad.py": "def (:\n",
    "two.py": "def f(): pass\ndef f(): pass\n",
}
RUN, FETCH, PAUSE, STOP = "app.py|app.py::App.run|6", "lib/net.py|lib/net.py::fetch|3", "lib/net.py|lib/net.py::pause|6", "app.py|app.py::App.stop|9"


def _packet(spark, **limits):
    files = spark.createDataFrame([("r", p, t) for p, t in FILES.items()], "repo string, path string, text string")
    facts, graph = python_code.facts(files), python_code.code_graph(files)
    requests = spark.createDataFrame([("q", "r", "run app")], "request string, repo string, query string")
    seeds = spark.createDataFrame([("q", "app.py", 6, "run"), ("q", "lib/net.py", None, None), ("q", "app.py", 99, "nowhere")], "request string, path string, line long, name string")
    hits = evidence.search(evidence.definitions(graph), requests)
    return evidence.packet(facts, graph, files.select("repo", "path"), requests, seeds, hits, **limits)


def test_packet(spark):
    p = _packet(spark)
    assert [r.qual for r in p["candidates"].orderBy("pos").collect()] == ["app.py::App.run", "lib/net.py::fetch", "lib/net.py::pause", "app.py::App", "app.py::App.stop"]
    assert {(r.from_id, r.relation, r.to_id, r.line) for r in p["edges"].collect()} == {
        (RUN, "calls", FETCH, 7), (RUN, "calls", STOP, 8), (FETCH, "calls", PAUSE, 4),
        ("app.py|@file|0", "imports_module", "lib/__init__.py|@file|0", 1), ("app.py|@file|0", "imports_symbol", FETCH, 1),
    }
    gaps = [(r.reason, r.target_text, r.path, r.line, r.name) for r in p["gaps"].orderBy("pos").collect()]
    assert gaps == [
        ("target_not_proven", "stop", "app.py", 8, None),  # seen again without its class
        ("target_not_proven", "missing", "app.py", 1, None), ("target_not_proven", "lib.gone", "app.py", 2, None),
        ("not_indexed", None, "bad.py", None, None), ("seed_not_in_graph", None, "app.py", 99, "nowhere"), ("duplicate_definition", None, "two.py", None, "two.py::f"),
    ]
    assert [r.reason for r in evidence.prompt_gaps(p["gaps"], 4).orderBy("pos").collect()] == ["not_indexed", "seed_not_in_graph", "duplicate_definition", "target_not_proven"]


def test_limits_are_reported(spark):
    p = _packet(spark, hops=2, max_edges=2, max_gaps=1)
    assert [(r.from_id, r.to_id) for r in p["edges"].orderBy("pos").collect()] == [(RUN, FETCH), (RUN, STOP)]
    gaps = {r.reason: r.omitted for r in p["gaps"].collect()}
    assert gaps["edge_limit"] == 3 and gaps["gap_limit"] == 2


def test_json_of_models():
    parse = json_text.parse
    assert parse('Sure:\n```json\n{"a": [1, 2,], // no\n}\n``` done', dict) is None  # a comment behind a value is no comment line
    assert parse('Sure:\n```json\n// yes\n{"a": [1, 2,],\n}\n``` done', dict) == {"a": [1, 2]}
    assert parse("x {'a': r'\\d', 'b': '}'} {}", dict) == {"a": "\\d", "b": "}"}
    assert parse('[[1], ["]"]] [2]', list) == [[1], ["]"]]
    assert parse("it's {1}", dict) is None and parse("{1}", dict) is None and parse(None, list) is None and parse("", list) is None and parse("[1", list) is None
    view = {"calls": list(range(9)), "used_by": [x * 20 for x in "abcdef"], "symbol": "s"}
    assert json_text.fit(view, 1000) == view and view["calls"] == list(range(9))
    assert json_text.fit(view, (len(json.dumps(view)) - 4) // 4) == {**view, "used_by": [x * 20 for x in "abc"], "used_by_truncated": True}
    assert json_text.fit(view, 1)["calls"] == [0, 1, 2]
