"""Counts and choices over entities that very many others share: the same as written out, without rows for all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quadlake.operators import store
from quadlake.plans import catalog
from quadlake.plans.rules import Rule, derive, tally

QUADS = "subject string, relation string, object string, condition string"


def made(df):
    """The rows of ``df``, and the most rows that one step of its plan has put out."""
    rows, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            metric = node.metrics().get("numOutputRows")
            most = max(most, metric.get().value() if metric.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows, most


def _near(spark, tmp_path, n):
    """The star's tables with ``n`` customers and suppliers in one nation."""
    spark.createDataFrame([(3, 1)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit(3).alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def test_facts_are_counted_by_what_they_share(spark, tmp_path):
    rows, most = made(catalog.j05_strong_and_ambiguous(spark, _near(spark, tmp_path, 500)))
    assert {r.rule: (r.strong, r.confidence, r.n_facts, r.n_subjects) for r in rows} == {"near": (False, 0.6, 250_000, 500), "home": (True, 0.9, 500, 500)}
    assert most < 5_000


def test_rules_fired_are_found_by_what_they_share(spark, tmp_path):
    rows, most = made(catalog.j06_rules_fired(spark, _near(spark, tmp_path, 500)))
    assert [tuple(r) for r in rows] == [(2,)] and most < 5_000


RULES = {
    "pair": Rule("pair", (("?a", "r", "?k", "?_"), ("?b", "s", "?k", "?_")), ("?a", "pair", "?b", "x"), 0.9),
    "back": Rule("back", (("?a", "r", "?k", "?_"), ("?b", "s", "?k", "?_")), ("?b", "back", "?a", "x"), 0.5),
    "three": Rule("three", (("?a", "r", "?k", "?c"), ("?b", "s", "?k", "?_"), ("?b", "t", "?z", "?c")), ("?z", "three", "?a", "?c"), 0.7),
    "keyed": Rule("keyed", (("?a", "r", "?k", "?_"), ("?b", "s", "?k", "?_")), ("?a", "keyed", "?b", "?k")),
    "half": Rule("half", (("?a", "r", "?k", "?_"), ("?b", "s", "?k", "?_")), ("?a", "half", "x", "x")),
    "named": Rule("named", (("?a", "r", "?k", "?_"), ("?b", "s", "?k", "?_")), ("x", "named", "?b", "x")),
    "apart": Rule("apart", (("?a", "r", "1", "?_"), ("?b", "s", "2", "?_")), ("?a", "apart", "?b", "x")),
    "constant": Rule("constant", (("?a", "r", "?k", "?_"), ("?b", "s", "?k", "?_")), ("x", "constant", "x", "x")),
    "one": Rule("one", (("?a", "r", "?k", "?_"),), ("?a", "one", "x", "x")),
    "void": Rule("void", (("?a", "r", "?k", "?_"), ("?b", "s", "?k", "?_")), ("?a", "void", "?y", "x")),
    "none": Rule("none", (("?a", "r", "?k", "?_"), ("?b", "missing", "?k", "?_")), ("?a", "none", "?b", "x")),
}


@pytest.mark.parametrize("names", [tuple(RULES), ("half", "constant"), ("pair", "void", "pair"), ("void",), ()])
def test_tally_equals_facts_written_out(spark, names):
    draw = random.Random(5)
    name = lambda n: draw.choice([None, *map(str, range(n))])
    q = spark.createDataFrame([(name(9), draw.choice("rst"), name(6), name(3)) for _ in range(90)] + [("lone", "r", "k1", ""), ("l1", "s", "k1", ""), ("l2", "s", "k1", "")], QUADS)
    rules = [RULES[n] for n in names] + ([Rule("later", RULES["pair"].pattern[:1], ("?a", "pair", "?k", "x"), 0.2)] if len(names) > 9 else [])
    want = derive(q, rules).groupBy("rule", "strong", "confidence").agg(F.count("*").alias("n_facts"), F.countDistinct("subject").alias("n_subjects"))
    got = tally(q, rules)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tally_of_rules_that_meet(spark):
    """A fact of two rules is the first one's, also where another rule stands apart from both."""
    q = spark.createDataFrame([("a", "r", "k", ""), ("a", "r", "l", ""), ("b", "s", "k", ""), ("b", "s", "l", ""), ("c", "s", "l", "")], QUADS)
    second = Rule("second", RULES["pair"].pattern, ("?a", "pair", "?b", "x"), 0.4)
    rows = tally(q, [RULES["pair"], RULES["back"], second]).collect()
    assert {(r.rule, r.n_facts, r.n_subjects) for r in rows} == {("pair", 2, 1), ("back", 2, 2)}


def _placed(batches, shards, held, capacity, target):
    """Every shard looked at for every batch."""
    out = {}
    for batch in {b for b, _ in batches}:
        own, found = {e for b, e in batches if b == batch}, []
        for shard, n, density in shards:
            overlap = len({e for e in own if e is not None and (e, shard) in held})
            if density < target and n < capacity and n + len(own) - overlap < capacity:
                found.append((-(overlap * 1000 + n), shard))
        out[batch] = min(found)[1] if found else None
    return out


@pytest.mark.parametrize("seed", range(3))
def test_best_shards_equal_plain_search(spark, seed):
    draw = random.Random(seed)
    shards = [(f"s{i:02}", draw.randint(1, 13), draw.choice([0.1, 0.1, 0.4])) for i in range(16)]
    names = [f"e{i}" for i in range(14)]
    held = [(e, s) for s, _, _ in shards for e in names if draw.random() < (0.8 if e in names[:3] else 0.15)]
    batches = [(b, draw.choice([None, "new", *names, *names[:3]])) for b in range(120) for _ in range(draw.choice([1, 2, 2, 3, 5, 12]))]
    batches += [(b, f"only{i}") for b, n in ((200, 1), (201, 9), (202, 13), (203, 30)) for i in range(n)] + [(204, "e0")] * 2
    got = store.best_shards(spark.createDataFrame(batches, "batch long, entity string"), spark.createDataFrame(shards, "shard string, n_entities long, density double"), spark.createDataFrame(held, "entity string, shard string"), 12, 0.3).collect()
    assert len(got) == len({b for b, _ in batches})
    assert {r.batch: r.shard for r in got} == _placed(batches, shards, set(held), 12, 0.3)


def test_best_shards_do_not_pair_batches_with_all_holders(spark):
    """Each batch has an entity of its own, held by its own shard, and one that all 400 shards hold."""
    n = spark.range(400)
    shards = n.select(F.col("id").cast("string").alias("shard"), F.lit(5).cast("long").alias("n_entities"), F.lit(0.1).alias("density"))
    pairs = n.select(F.col("id").cast("string").alias("batch"), F.explode(F.array(F.concat(F.lit("own"), "id"), F.lit("all"))).alias("entity"))
    rows, most = made(store.best_shards(pairs, shards, pairs.select("entity", F.col("batch").alias("shard")), 100, 0.3))
    assert all(r.batch == r.shard for r in rows) and len(rows) == 400 and most < 5_000
