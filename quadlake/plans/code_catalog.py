"""Queries on code graphs, the store of quads, packing and metrics, registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadlake.functions import text as X
from quadlake.operators import navigation
from quadlake.operators.naming import aliases
from quadlake.plans.catalog import query
from quadlake.sources import python_code, star
from quadlake.sources.star import CALLS, DEFS, QUADS, table

#: Sources written from the tables: every part is a function in the module of its brand and block of 50 keys, and
#: calls the parts that follow it in an order.
_SRC = f"""{DEFS}, {CALLS}, k AS (SELECT key, replace(file, '#', '') AS pkg, key // 50 AS block, replace(file, '#', '') || '/m' || (key // 50) || '.py' AS path FROM d),
  e AS (SELECT DISTINCT a.path || '::p' || a.key AS subject, b.path || '::p' || b.key AS object, a.path AS source, b.path AS target FROM c JOIN k a ON c.caller = a.key JOIN k b ON c.callee = b.key WHERE c.condition = 'resolved')"""


def sources(spark, sf):
    """(repo, path, text): the files behind :data:`_SRC`; a file has at most 50 functions."""
    block = F.floor(F.col("key") / 50).cast("string")
    d = star.definitions(spark, sf).select("key", F.replace("file", F.lit("#"), F.lit("")).alias("pkg"), block.alias("block"))
    c = star.calls(spark, sf).where("condition = 'resolved'").select("caller", "callee").distinct()
    b = d.select(F.col("key").alias("callee"), F.col("pkg").alias("to"), F.col("block").alias("to_block"))
    c = d.withColumnRenamed("key", "caller").join(c, "caller").join(b, "callee")
    away = F.when((F.col("pkg") != F.col("to")) | (F.col("block") != F.col("to_block")), F.concat(F.lit("from "), "to", F.lit(".m"), "to_block", F.lit(" import p"), F.col("callee").cast("string")))
    c = c.groupBy("caller").agg(F.collect_set(away).alias("imports"), F.array_join(F.collect_list(F.concat(F.lit("    p"), F.col("callee").cast("string"), F.lit("()\n"))), "").alias("body"))
    f = d.join(c.withColumnRenamed("caller", "key"), "key", "left")
    body = F.concat(F.lit("def p"), F.col("key").cast("string"), F.lit("():\n    pass\n"), F.coalesce("body", F.lit("")))
    files = f.groupBy("pkg", "block").agg(F.array_distinct(F.flatten(F.collect_list("imports"))).alias("i"), F.array_join(F.collect_list(body), "\n").alias("b"))
    return files.select(F.lit("star").alias("repo"), F.concat("pkg", F.lit("/m"), "block", F.lit(".py")).alias("path"), F.concat(F.array_join("i", "\n"), F.lit("\n\n"), "b").alias("text"))


@query(f"WITH {_SRC} SELECT subject, 'calls' AS relation, object, 'resolved' AS condition FROM e UNION ALL SELECT path, 'defines', path || '::p' || key, 'function' FROM k")
def e01_code_graph(spark, sf):
    """Definitions and resolved calls, extracted from source files by their syntax trees."""
    return python_code.code_graph(sources(spark, sf)).where("relation in ('calls', 'defines')").select("subject", "relation", "object", "condition").distinct()


@query(f"WITH {_SRC} SELECT path || '::p' || key AS qual, path, 'p' || key AS name FROM k")
def e12_line_definitions(spark, sf):
    """Definitions by line patterns, for files without a syntax tree."""
    lines = sources(spark, sf).select("path", F.explode(F.split("text", "\n")).alias("line"))
    name = F.regexp_extract("line", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", 1)
    return lines.select("path", name.alias("name")).where("name <> ''").select(F.concat("path", F.lit("::"), "name").alias("qual"), "path", "name")


def _edges(spark, sf):
    d, c = star.definitions(spark, sf), star.calls(spark, sf).where("condition = 'resolved'").select("caller", "callee").distinct()
    a, b = d.select(F.col("key").alias("caller"), F.col("qual").alias("source")), d.select(F.col("key").alias("callee"), F.col("qual").alias("target"))
    return c.join(a, "caller").join(b, "callee").select("source", "target")


_EDGES = f"{DEFS}, {CALLS}, e AS (SELECT DISTINCT a.qual AS source, b.qual AS target FROM c JOIN d a ON c.caller = a.key JOIN d b ON c.callee = b.key WHERE c.condition = 'resolved')"


@query(f"""WITH {_EDGES}, o AS (SELECT source AS node, count(*) AS n, list_sort(list(target)) AS t FROM e GROUP BY 1), i AS (SELECT target AS node, count(*) AS n FROM e GROUP BY 1)
  SELECT coalesce(o.node, i.node) AS node, coalesce(i.n, 0) AS n_callers, coalesce(o.n, 0) AS n_callees, coalesce(array_to_string(o.t[1:6], ','), '') AS callees FROM o FULL JOIN i ON o.node = i.node""")
def n01_ego_graphs(spark, sf):
    """Callers and callees of every definition."""
    return navigation.ego(_edges(spark, sf))


def n03_call_chains(spark, sf):
    """The call chains into the first definition of every file, by depth-first walk."""
    seeds = star.definitions(spark, sf).groupBy("file").agg(F.min("qual").alias("seed")).select("seed")
    return navigation.call_chains(_edges(spark, sf), seeds, depth=2, reverse=True)


query()(n03_call_chains)

#: Shards are bounded by construction: 500 subjects of one relation at most.
_SHARD = f"{QUADS}, s AS (SELECT *, relation || '#' || (CAST(split_part(subject, ':', 2) AS BIGINT) // 500) AS shard FROM q), n AS (SELECT shard, subject AS entity FROM s UNION SELECT shard, object FROM s)"


def _sharded(spark, sf):
    block = F.floor(F.split_part("subject", F.lit(":"), F.lit(2)).cast("long") / 500).cast("string")
    return star.quads(spark, sf).withColumn("shard", F.concat("relation", F.lit("#"), block))


def _entities(s):
    return s.select("shard", F.explode(F.array("subject", "object")).alias("entity")).distinct()


def _numbered(s):
    return _entities(s).withColumn("idx", F.row_number().over(Window.partitionBy("shard").orderBy("entity")).cast("long"))


@query(f"WITH {_SHARD} SELECT shard, entity, row_number() OVER (PARTITION BY shard ORDER BY entity) AS idx FROM n")
def m01_entity_ids(spark, sf):
    """Dense numbers of entities from 1 within a shard."""
    return _numbered(_sharded(spark, sf))


@query(f"WITH {_SHARD}, i AS (SELECT shard, entity, row_number() OVER (PARTITION BY shard ORDER BY entity) AS idx FROM n) SELECT s.shard, a.idx AS i, b.idx AS j, max(s.relation) AS relation, count(*) AS n_written FROM s JOIN i a ON s.shard = a.shard AND s.subject = a.entity JOIN i b ON s.shard = b.shard AND s.object = b.entity GROUP BY 1, 2, 3")
def m03_cells(spark, sf):
    """A cell (i, j) of a shard keeps one relation, the last by name."""
    s, n = _sharded(spark, sf), _numbered(_sharded(spark, sf))
    s = s.join(n.select("shard", F.col("entity").alias("subject"), F.col("idx").alias("i")), ["shard", "subject"]).join(n.select("shard", F.col("entity").alias("object"), F.col("idx").alias("j")), ["shard", "object"])
    return s.groupBy("shard", "i", "j").agg(F.max("relation").alias("relation"), F.count("*").alias("n_written"))


@query(f"WITH {_SHARD} SELECT shard, CASE WHEN condition = '' THEN subject || ' ' || relation || ' ' || object ELSE subject || ' ' || relation || ' ' || object || ' (' || condition || ')' END AS line FROM s")
def m07_quad_lines(spark, sf):
    """Quads as lines of text, the condition in brackets."""
    body = F.concat_ws(" ", "subject", "relation", "object")
    return _sharded(spark, sf).select("shard", F.when(F.col("condition") == "", body).otherwise(F.concat(body, F.lit(" ("), "condition", F.lit(")"))).alias("line"))


@query(f"WITH {_SHARD}, k AS (SELECT shard, count(*) AS entities FROM n GROUP BY 1), c AS (SELECT shard, count(DISTINCT subject || '>' || object) AS cells FROM s GROUP BY 1) SELECT shard, entities, cells, CAST(cells AS DOUBLE) / (entities * entities) AS density FROM k JOIN c USING (shard)")
def p07_density(spark, sf):
    """Filled share of a shard's matrix."""
    s = _sharded(spark, sf)
    k, c = _entities(s).groupBy("shard").agg(F.count("*").alias("entities")), s.select("shard", "subject", "object").distinct().groupBy("shard").agg(F.count("*").alias("cells"))
    return k.join(c, "shard").withColumn("density", F.col("cells").cast("double") / (F.col("entities") * F.col("entities")))


CHOSEN = ("region:0", "region:1", "nation:0", "nation:1", "nation:2", "nation:3", "nation:17", "nation:24")
_IN = ", ".join(f"'{x}'" for x in CHOSEN)


@query(f"WITH {QUADS} SELECT subject, relation, object FROM q WHERE subject IN ({_IN}) AND object IN ({_IN})")
def p08_submatrix(spark, sf):
    """Quads between chosen entities."""
    return star.quads(spark, sf).where(F.col("subject").isin(*CHOSEN) & F.col("object").isin(*CHOSEN)).select("subject", "relation", "object")


@query(f"WITH {QUADS} SELECT subject, relation, object, condition FROM q WHERE subject = 'nation:3' OR object = 'nation:3'")
def p09_entity_scan(spark, sf):
    """All quads of an entity, on either side."""
    return star.quads(spark, sf).where("subject = 'nation:3' or object = 'nation:3'")


TERMS = ("nation:7", "lives", "region")


@query(f"WITH {_SHARD} SELECT shard, score FROM (SELECT shard, sum(x.score)::BIGINT AS score FROM (" + " UNION ALL ".join(
    f"SELECT shard, CASE WHEN entity = '{t}' THEN 10 WHEN contains(entity, '{t}') THEN 5 ELSE 0 END AS score FROM n UNION ALL SELECT DISTINCT shard, CASE WHEN list_contains(string_split(relation, '_'), '{t}') THEN 3 ELSE 0 END FROM s" for t in TERMS) + ") x GROUP BY shard) WHERE score > 0")
def k05_shard_routing(spark, sf):
    """Score of shards for the terms of a question: entity 10, part of an entity 5, word of a relation 3."""
    s = _sharded(spark, sf)
    term = F.explode(F.array(*map(F.lit, TERMS))).alias("t")
    by_entity = _entities(s).select("shard", "entity", term).select("shard", F.when(F.col("entity") == F.col("t"), 10).when(F.contains("entity", "t"), 5).otherwise(0).alias("score"))
    by_word = s.select("shard", "relation").distinct().select("shard", "relation", term).select("shard", F.when(F.array_contains(F.split("relation", "_"), F.col("t")), 3).otherwise(0).alias("score"))
    return by_entity.unionByName(by_word).groupBy("shard").agg(F.sum("score").cast("long").alias("score")).where("score > 0")


ROOM = 60


@query(f"WITH t AS (SELECT conv_id, list((length(coalesce(text, '')) + 3) // 4 ORDER BY turn) AS c FROM conversations GROUP BY conv_id) SELECT conv_id, len(c) AS n_turns, CAST(list_reduce(list_prepend(0, c), lambda a, x: CASE WHEN a + x <= {ROOM} THEN a + x ELSE a END) AS BIGINT) AS used FROM t")
def k12_greedy_pack(spark, sf):
    """Turns of a conversation packed in order into a budget of tokens; what does not fit is skipped."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", X.approx_tokens(F.coalesce("text", F.lit(""))).alias("cost")))).alias("t"))
    used = F.aggregate("t", F.lit(0).cast("long"), lambda a, x: F.when(a + x["cost"] <= ROOM, a + x["cost"]).otherwise(a))
    return t.select("conv_id", F.size("t").cast("long").alias("n_turns"), used.alias("used"))


_GAP = "[ \\t\\n\\r\\f]+"
_WORDS = "list_distinct(list_filter(string_split_regex(lower({}), '" + _GAP + "'), lambda w: w <> ''))"


@query(f"""WITH t AS (SELECT conv_id, turn, text AS gold, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pred FROM conversations), w AS (SELECT *, {_WORDS.format('gold')} AS g, {_WORDS.format('pred')} AS p FROM t WHERE pred IS NOT NULL AND gold IS NOT NULL),
  m AS (SELECT *, len(list_intersect(g, p)) AS n_both FROM w)
  SELECT conv_id, turn, pred = gold AS exact, trim(regexp_replace(lower(pred), '{_GAP}', ' ', 'g')) = trim(regexp_replace(lower(gold), '{_GAP}', ' ', 'g')) AS fuzzy, CASE WHEN n_both = 0 THEN 0.0 ELSE 2.0 * n_both / (len(g) + len(p)) END::DOUBLE AS f1 FROM m""")
def x01_answer_metrics(spark, sf):
    """Exact and fuzzy equality, and F1 of word sets, of a turn against the one before it."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("gold"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("pred")).where("pred is not null and gold is not null")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), _GAP), lambda w: w != ""))
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), _GAP, " "))
    t = t.withColumn("g", words("gold")).withColumn("p", words("pred")).withColumn("both", F.size(F.array_intersect("g", "p")))
    f1 = F.when(F.col("both") == 0, F.lit(0.0)).otherwise(F.lit(2.0) * F.col("both") / (F.size("g") + F.size("p")))
    return t.select("conv_id", "turn", (F.col("pred") == F.col("gold")).alias("exact"), (flat("pred") == flat("gold")).alias("fuzzy"), f1.alias("f1"))


@query("WITH l AS (SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS n FROM pages) SELECT page_id, CAST(n AS BIGINT) AS n_quads, n = 0 AS too_few, n > 20 AS too_many FROM l")
def g05_extractor_report(spark, sf):
    """Quads a template gives for each page, held against limits."""
    n = F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).cast("long")
    return table(spark, sf, "pages").select("page_id", n.alias("n_quads")).withColumn("too_few", F.col("n_quads") == 0).withColumn("too_many", F.col("n_quads") > 20)


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS types FROM f GROUP BY user_id")
def g12_first_occurrences(spark, sf):
    """Distinct event types of a user in order of their first event."""
    f = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("at"))
    return f.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


@query("WITH b AS (SELECT source || '/' || lang AS dir, 'doc' || (doc_id % 50) || '.txt' AS base, doc_id FROM documents), p AS (SELECT DISTINCT dir || '/' || base AS path, base FROM b) , n AS (SELECT path, base, row_number() OVER (PARTITION BY base ORDER BY path) - 1 AS i FROM p), a AS (SELECT path, CASE WHEN i = 0 THEN base ELSE replace(base, '.txt', '') || '(' || i || ').txt' END AS alias FROM n) SELECT DISTINCT 's' || b.doc_id || '@' || a.alias AS symbol, a.path FROM b JOIN a ON b.dir || '/' || b.base = a.path")
def a02_symbol_aliases(spark, sf):
    """Symbols named by the alias of their file."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc"), (F.col("doc_id") % 50).cast("string"), F.lit(".txt")).alias("path"))
    return d.join(aliases(d.select("path", F.element_at(F.split("path", "/"), -1).alias("base")).distinct()), "path").select(F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.lit("@"), "alias").alias("symbol"), "path").distinct()


BACK = r"\b(previous|earlier|above|that function)\b"


@query(f"SELECT role, count(*) AS n_turns, count(*) FILTER (regexp_matches(lower(text), '{BACK}')) AS n_back FROM conversations GROUP BY role")
def v06_back_references(spark, sf):
    """Turns that refer back to what was said."""
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n_turns"), F.count_if(F.lower("text").rlike(BACK)).alias("n_back"))


@query(f"WITH {CALLS}, {DEFS}, g AS (SELECT c.caller, c.callee, min(c.line) AS line FROM c WHERE condition = 'unresolved' GROUP BY 1, 2) SELECT d.file, count(*) AS n_gaps, min(g.line) AS first_line FROM g JOIN d ON g.caller = d.key GROUP BY d.file")
def v03_unresolved_gaps(spark, sf):
    """Calls that were not resolved, as gaps of the caller's file."""
    g = star.calls(spark, sf).where("condition = 'unresolved'").groupBy("caller", "callee").agg(F.min("line").alias("line"))
    return g.join(star.definitions(spark, sf).select(F.col("key").alias("caller"), "file"), "caller").groupBy("file").agg(F.count("*").alias("n_gaps"), F.min("line").alias("first_line"))
