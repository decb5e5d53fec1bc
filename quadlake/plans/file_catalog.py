"""Queries on sentences, files as wholes, completion, shard files, gaps and reports, registered with the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadlake.functions import json_text
from quadlake.functions import text as X
from quadlake.operators import completion, evidence, file_order, graph, sentences
from quadlake.operators.naming import aliases, sort_rank
from quadlake.plans.catalog import _PATHS, _PRED, _paths, _predictions, query
from quadlake.plans.code_catalog import _SHARD, _SRC, _sharded, sources
from quadlake.sources import file_facts, python_code, shard_files, star
from quadlake.sources.star import CALLS, DEFS, QUADS, table


@query(sentences.fact_sql("SELECT conv_id * 1000 + turn AS id, text FROM conversations"))
def e17_fact_quads(spark, sf):
    """Facts of the turns of conversations, with their conditions."""
    turns = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return sentences.fact_quads(turns, "id", "text")


_DOT, _INNER = (p.replace("'", "''") for p in (completion.AFTER_DOT, completion.IN_NAME))


@query(f"""WITH l AS (SELECT conv_id, turn, regexp_replace(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))[-1], '\\s+$', '') AS s FROM conversations)
  SELECT conv_id, turn, CASE WHEN s IS NULL THEN 'unknown' WHEN regexp_matches(s, '{_DOT}') THEN 'method_call' WHEN regexp_matches(s, '{_INNER}') THEN 'attribute' WHEN ends_with(s, '(') OR ends_with(s, ',') THEN 'arg_position' ELSE 'bare' END AS kind,
    CASE WHEN regexp_matches(s, '{_DOT}') THEN regexp_extract(s, '{_DOT}', 1) WHEN regexp_matches(s, '{_INNER}') THEN regexp_extract(s, '{_INNER}', 1) END AS receiver FROM l""")
def e24_completion_sites(spark, sf):
    """Where each turn breaks off."""
    return table(spark, sf, "conversations").select("conv_id", "turn", completion.site(F.col("text")).alias("s")).select("conv_id", "turn", "s.kind", "s.receiver")


#: Calls of one file to functions of others, and of every function of a file.
_IMP = "imp AS (SELECT DISTINCT a.path, a.pkg, a.block, b.pkg AS tp, b.block AS tb, b.key FROM c JOIN k a ON c.caller = a.key JOIN k b ON c.callee = b.key WHERE c.condition = 'resolved' AND a.path <> b.path)"
_NAMES = f"""{_SRC}, {_IMP}, u AS (SELECT DISTINCT c.caller, c.callee FROM c WHERE condition = 'resolved'),
  n AS (SELECT path AS id, 'defines_function' AS relation, 'p' || key AS object, CAST(NULL AS BIGINT) AS n FROM k
    UNION ALL SELECT path, 'imports_symbol', 'p' || key, NULL FROM imp
    UNION ALL SELECT path, 'used_as_function', object, count(*) FROM (SELECT path, 'p' || key AS object FROM k UNION ALL SELECT k.path, 'p' || u.callee FROM u JOIN k ON u.caller = k.key) GROUP BY path, object)"""


@query(f"WITH {_NAMES} SELECT id, relation, object, coalesce(n, 0) AS n FROM n")
def e14_symbol_names(spark, sf):
    """Names that source files define, import and call."""
    return completion.names(sources(spark, sf), "path", "text").select("id", "relation", "object", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {_NAMES}, s AS (SELECT id, object AS symbol, CASE relation WHEN 'defines_function' THEN 'function' WHEN 'imports_symbol' THEN 'import' ELSE 'used_func' END AS kind, max(10 + least(20, 3 * coalesce(n, 0))) AS base FROM n GROUP BY ALL),
  r AS (SELECT id, symbol, kind, base + 8 + CASE WHEN kind = 'import' THEN 0 ELSE 5 END AS score FROM s)
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY score DESC, kind, symbol) AS pos, symbol, kind, CAST(score AS BIGINT) AS score FROM r QUALIFY pos <= 12""")
def k03_candidate_ranking(spark, sf):
    """The twelve best names for the end of each source file, which is no call in progress."""
    src = sources(spark, sf)
    return completion.rank(completion.names(src, "path", "text"), src.select(F.col("path").alias("id"), F.col("text").alias("tail")))


def _repositories(spark, sf):
    """The sources in repositories of at most eight files."""
    group = F.floor(F.regexp_extract("path", r"/m(\d+)\.py$", 1).cast("long") / 8).cast("string")
    return sources(spark, sf).select(F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("-"), group).alias("repo"), "path", "text")


_REPOS = f"""{_SRC}, {_IMP}, f AS (SELECT DISTINCT path, pkg, block, pkg || '-' || (block // 8) AS repo, 'm' || block || '.py' AS alias FROM k),
  hit AS (SELECT f.repo, f.alias, imp.key, t.alias AS target, CASE WHEN imp.tp = f.pkg THEN 'internal' ELSE 'inferred' END AS condition FROM imp JOIN f USING (path) JOIN f t ON t.repo = f.repo AND t.block = imp.tb AND t.path <> f.path)"""


@query(f"""WITH {_REPOS} SELECT repo, repo AS subject, 'contains_file' AS relation, alias AS object, 'repo_level' AS condition FROM f
  UNION ALL SELECT repo, alias, 'file_type', 'python', 'file_level' FROM f
  UNION ALL SELECT f.repo, f.alias, 'contains_function', 'p' || k.key || '@' || f.alias, 'symbol_level' FROM k JOIN f USING (path)
  UNION ALL SELECT f.repo, 'p' || k.key || '@' || f.alias, 'defined_in', f.alias, 'symbol_level' FROM k JOIN f USING (path)
  UNION ALL SELECT f.repo, f.alias, 'imports_module', imp.tp || '.m' || imp.tb, 'external' FROM imp JOIN f USING (path)
  UNION ALL SELECT f.repo, f.alias, 'imports_symbol', imp.tp || '.m' || imp.tb || '.p' || imp.key, 'external' FROM imp JOIN f USING (path)
  UNION ALL SELECT repo, alias, 'imports_symbol', 'p' || key || '@' || target, condition FROM hit""")
def e10_file_quads(spark, sf):
    """File-level quads with imports resolved to files."""
    return file_facts.file_graph(_repositories(spark, sf)).drop("ord")


@query(f"WITH {_REPOS} SELECT repo, alias AS source, target, count(*) AS n_evidence, CAST(0.9 AS DOUBLE) AS confidence, 'import' AS edge_type FROM hit GROUP BY repo, alias, target")
def j09_file_dependencies(spark, sf):
    """Dependencies between files of a repository, all evidence merged."""
    d = file_order.dependencies(file_facts.file_graph(_repositories(spark, sf)))
    return d.select("repo", "source", "target", F.size("evidence").cast("long").alias("n_evidence"), "confidence", "edge_type")


def t02_file_order(spark, sf):
    """Files of every repository after what they need; rows only, the tests hold it against a plain walk."""
    q = file_facts.file_graph(_repositories(spark, sf))
    files = q.where("relation = 'contains_file'").select("repo", F.col("object").alias("alias"))
    return file_order.order_files(files, file_order.dependencies(q))


query()(t02_file_order)


@query(f"WITH {_PATHS}, r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) - 1 AS i FROM p), a AS (SELECT path, CASE WHEN i = 0 THEN base ELSE replace(base, '.py', '') || '(' || i || ').py' END AS alias FROM r) SELECT path, alias, CASE WHEN starts_with(alias, 'test_') THEN 2 WHEN split_part(alias, '(', 1) = '__init__.py' THEN 1 ELSE 0 END AS rank FROM a")
def t08_sort_ranks(spark, sf):
    """The rank of every file among files that are ready."""
    return aliases(_paths(spark, sf)).select("path", "alias", sort_rank(F.col("alias")).alias("rank"))


@query(f"WITH {_SHARD}, x AS (SELECT shard, subject, object, max(relation || chr(1) || condition) AS m FROM s GROUP BY ALL) SELECT shard, subject, split_part(m, chr(1), 1) AS relation, object, split_part(m, chr(1), 2) AS condition FROM x")
def s10_compact_shards(spark, sf):
    """Shards written as compact binary files and read back."""
    return shard_files.decode_shards(shard_files.encode_shards(_sharded(spark, sf)))


@query(f"""WITH {_SHARD}, t AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY subject, relation, object, condition) - 1 AS pos FROM s),
  en AS (SELECT shard, e, row_number() OVER (PARTITION BY shard ORDER BY min(p)) - 1 AS id FROM (SELECT shard, subject AS e, 2 * pos AS p FROM t UNION ALL SELECT shard, object, 2 * pos + 1 FROM t) GROUP BY shard, e),
  cn AS (SELECT shard, condition AS e, row_number() OVER (PARTITION BY shard ORDER BY min(pos)) - 1 AS id FROM t WHERE condition <> '' GROUP BY shard, condition)
  SELECT t.shard, t.pos, a.id AS s, CAST(0 AS BIGINT) AS r, b.id AS o, coalesce(cn.id, -1) AS c FROM t JOIN en a ON t.shard = a.shard AND t.subject = a.e JOIN en b ON t.shard = b.shard AND t.object = b.e LEFT JOIN cn ON t.shard = cn.shard AND t.condition = cn.e""")
def m06_dictionary_quads(spark, sf):
    """Quads of a shard as numbers of its dictionaries, in order of first use; -1 is no condition."""
    in_shard = Window.partitionBy("shard")
    pos = F.row_number().over(in_shard.orderBy("subject", "relation", "object", "condition")).cast("long") - 1
    t = _sharded(spark, sf).withColumn("pos", pos)

    def numbered(values, name):
        first = values.groupBy("shard", "v").agg(F.min("at").alias("at"))
        return first.select("shard", F.col("v").alias(name), (F.row_number().over(in_shard.orderBy("at")) - 1).cast("long").alias(name[0]))

    ends = F.explode(F.array(F.struct(F.col("subject").alias("v"), (2 * F.col("pos")).alias("at")), F.struct(F.col("object").alias("v"), (2 * F.col("pos") + 1).alias("at")))).alias("x")
    entities = t.select("shard", ends).select("shard", "x.*")
    for name, values in (("subject", entities), ("object", entities), ("relation", t.select("shard", F.col("relation").alias("v"), F.col("pos").alias("at")))):
        t = t.join(numbered(values, name), ["shard", name])
    t = t.join(numbered(t.where("condition <> ''").select("shard", F.col("condition").alias("v"), F.col("pos").alias("at")), "condition"), ["shard", "condition"], "left")
    return t.select("shard", "pos", "s", "r", "o", F.coalesce("c", F.lit(-1).cast("long")).alias("c"))


#: The topics of relations.
TOPICS = {
    "works_at": "employment", "ceo_of": "employment", "role": "employment", "manages": "management", "reports_to": "management", "lives_in": "locations",
    "born_in": "locations", "located_in": "locations", "has_skill": "skills", "knows": "skills", "founded_by": "organizations", "partner_of": "organizations",
}


@query(f"""WITH {QUADS}, t AS (SELECT *, CASE WHEN relation IN ('lives_in', 'located_in') THEN 'locations' ELSE 'general' END AS topic FROM q), n AS (SELECT topic, list_sort(list(DISTINCT relation)) AS r, count(*) AS n_quads FROM t GROUP BY topic),
  s AS (SELECT topic, subject, row_number() OVER (PARTITION BY topic ORDER BY subject) AS k, count(*) OVER (PARTITION BY topic) AS n FROM (SELECT DISTINCT topic, subject FROM t)), e AS (SELECT topic, string_agg(subject, ', ' ORDER BY subject) AS e, max(n) AS n FROM s WHERE k <= 10 GROUP BY topic)
  SELECT n.topic, n.n_quads, 'Topic: ' || n.topic || '. Relations: ' || array_to_string(n.r, ', ') || '. Entities: ' || e.e || CASE WHEN e.n > 10 THEN '... (+' || (e.n - 10) || ' more)' ELSE '' END AS summary FROM n JOIN e USING (topic)""")
def k07_topic_summaries(spark, sf):
    """Quads by topic, with a summary naming the first ten subjects (the bound is the feature)."""
    topics = F.create_map(*[F.lit(x) for kv in TOPICS.items() for x in kv])
    t = star.quads(spark, sf).withColumn("topic", F.coalesce(F.element_at(topics, X.canonical(F.col("relation"))), F.lit("general")))
    n = t.groupBy("topic").agg(F.count("*").alias("n_quads"), F.array_join(F.array_sort(F.collect_set("relation")), ", ").alias("r"))
    subjects = t.select("topic", "subject").distinct()
    total = subjects.groupBy("topic").agg(F.count("*").alias("n"))
    first = subjects.withColumn("k", F.row_number().over(Window.partitionBy("topic").orderBy("subject"))).where("k <= 10")
    e = first.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("subject")), ", ").alias("e")).join(total, "topic")
    more = F.when(F.col("n") > 10, F.concat(F.lit("... (+"), (F.col("n") - 10).cast("string"), F.lit(" more)"))).otherwise("")
    return n.join(e, "topic").select("topic", "n_quads", F.concat(F.lit("Topic: "), "topic", F.lit(". Relations: "), "r", F.lit(". Entities: "), "e", more).alias("summary"))


_GAPS = f"{DEFS}, {CALLS}, g AS (SELECT a.file AS file, a.qual AS from_id, b.name AS target, c.line FROM c JOIN d a ON c.caller = a.key JOIN d b ON c.callee = b.key WHERE c.condition = 'unresolved'), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, from_id, target) AS k, count(*) OVER (PARTITION BY file) AS n FROM g)"


@query(f"WITH {_GAPS} SELECT file, 'target_not_proven' AS reason, from_id, target, line, CAST(0 AS BIGINT) AS omitted FROM r WHERE k <= 80 UNION ALL SELECT DISTINCT file, 'gap_limit', '', '', 0, n - 80 FROM r WHERE n > 80")
def k09_limited_gaps(spark, sf):
    """The first 80 gaps of each file and a marker of how many more there are (the bound is the feature)."""
    d = star.definitions(spark, sf)
    g = star.calls(spark, sf).where("condition = 'unresolved'").join(d.select(F.col("key").alias("caller"), "file", F.col("qual").alias("from_id")), "caller").join(d.select(F.col("key").alias("callee"), F.col("name").alias("target")), "callee")
    k = F.row_number().over(Window.partitionBy("file").orderBy("line", "from_id", "target"))
    kept = g.withColumn("k", k).where("k <= 80").select("file", F.lit("target_not_proven").alias("reason"), "from_id", "target", "line", F.lit(0).cast("long").alias("omitted"))
    over = g.groupBy("file").agg((F.count("*") - 80).alias("omitted")).where("omitted > 0").select("file", F.lit("gap_limit").alias("reason"), F.lit("").alias("from_id"), F.lit("").alias("target"), F.lit(0).cast("long").alias("line"), "omitted")
    return kept.unionByName(over)


@query(f"WITH {DEFS}, {CALLS} SELECT 'calls ' || a.qual || ' -> ' || b.qual || ' at ' || a.file || ':' || min(c.line) AS line FROM c JOIN d a ON c.caller = a.key JOIN d b ON c.callee = b.key WHERE c.condition = 'resolved' GROUP BY a.qual, b.qual, a.file")
def v08_edge_lines(spark, sf):
    """Edges as lines of text, with the place of their first site."""
    d = star.definitions(spark, sf)
    c = star.calls(spark, sf).where("condition = 'resolved'").groupBy("caller", "callee").agg(F.min("line").alias("at"))
    c = c.join(d.select(F.col("key").alias("caller"), F.col("qual").alias("a"), "file"), "caller").join(d.select(F.col("key").alias("callee"), F.col("qual").alias("b")), "callee")
    return c.select(F.concat(F.lit("calls "), "a", F.lit(" -> "), "b", F.lit(" at "), "file", F.lit(":"), F.col("at").cast("string")).alias("line"))


@query("WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT source, doc_id, CASE WHEN k > 40 THEN 'omitted' WHEN text IS NULL THEN 'unreadable' ELSE 'indexed' END AS status FROM r")
def s03_indexed_documents(spark, sf):
    """Documents of a repository in order, up to its number of files, and what became of the rest.

    Spark limits every repository to its first files before the shuffle; only those are numbered."""
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    d = table(spark, sf, "documents").select("source", "doc_id", F.col("text").isNull().alias("gone"))
    first = d.select("source", "doc_id").withColumn("k", k).where("k <= 40").select("source", "doc_id", F.lit(True).alias("kept"))
    r = d.join(first, ["source", "doc_id"], "left")
    return r.select("source", "doc_id", F.when(F.col("kept").isNull(), "omitted").when(F.col("gone"), "unreadable").otherwise("indexed").alias("status"))


@query("SELECT page_id, left(array_to_string(string_split(html, chr(10))[3:11], chr(10)), 420) AS excerpt FROM pages")
def p11_excerpts(spark, sf):
    """Nine lines from the third on, 420 characters at most (the bound is the feature)."""
    return table(spark, sf, "pages").select("page_id", F.substring(F.array_join(F.slice(F.split("html", "\n"), 3, 9), "\n"), 1, 420).alias("excerpt"))


_CLASS = "CASE WHEN lang IS NULL THEN 'parse_error' WHEN n_chars = 0 THEN 'missing_primitive' WHEN pred = gold THEN 'correct' ELSE 'wrong_answer' END"
_STAGES = {"missing_primitive": "extractor", "zero_strong_edges": "derivation", "parse_error": "prompt", "wrong_order": "prompt", "wrong_answer": "prompt", "plugin_error": "extractor"}


@query(f"""WITH {_PRED}, x AS (SELECT p.lang, {_CLASS} AS category FROM (SELECT p.*, d.n_chars FROM p JOIN documents d USING (doc_id)) p), n AS (SELECT lang, category, count(*) AS n FROM x GROUP BY ALL),
  a AS (SELECT lang, sum(n) AS total, coalesce(sum(n) FILTER (category = 'correct'), 0) AS ok FROM n GROUP BY lang), w AS (SELECT lang, category, n FROM n WHERE category <> 'correct' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, category) = 1)
  SELECT a.lang, CAST(a.ok AS DOUBLE) / a.total AS accuracy, w.category AS dominant, CASE WHEN a.ok >= 0.8 * a.total OR w.category IS NULL THEN 'stop' WHEN w.category = 'missing_primitive' THEN 'rerun_extractor' ELSE 'rerun_prompt' END AS action FROM a LEFT JOIN w USING (lang)""")
def x05_refinement(spark, sf):
    """Failures by class, and the stage to run again: that of the most frequent class, unless the threshold is met."""
    p = _predictions(spark, sf).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    kind = F.when(F.col("lang").isNull(), "parse_error").when(F.col("n_chars") == 0, "missing_primitive").when(F.col("pred") == F.col("gold"), "correct").otherwise("wrong_answer")
    n = p.groupBy("lang", kind.alias("category")).agg(F.count("*").alias("n"))
    good = F.col("category") == "correct"
    a = n.groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.when(good, F.col("n")).otherwise(0)).alias("ok"), F.min(F.when(~good, F.struct((-F.col("n")).alias("n"), "category")))["category"].alias("dominant"))
    stages = F.create_map(*[F.lit(x) for kv in _STAGES.items() for x in kv])
    stage = F.element_at(stages, F.col("dominant"))
    action = F.when((F.col("ok") >= 0.8 * F.col("total")) | stage.isNull(), "stop").otherwise(F.concat(F.lit("rerun_"), stage))
    return a.select("lang", (F.col("ok").cast("double") / F.col("total")).alias("accuracy"), "dominant", action.alias("action"))


@query(f"WITH {_PRED} SELECT lang, gold, count(*) AS n, avg(pred) AS mean, CAST(count(*) FILTER (pred = 1) AS DOUBLE) / greatest(count(*) FILTER (pred = 0), 0.000001) AS ratio FROM p GROUP BY lang, gold")
def g08_experiment_summary(spark, sf):
    """Means and ratios by group, with a floor under the divisor."""
    p = _predictions(spark, sf).groupBy("lang", "gold").agg(F.count("*").alias("n"), F.avg("pred").alias("mean"), F.count_if(F.col("pred") == 1).alias("a"), F.count_if(F.col("pred") == 0).alias("b"))
    return p.select("lang", "gold", "n", "mean", (F.col("a").cast("double") / F.greatest(F.col("b").cast("double"), F.lit(0.000001))).alias("ratio"))


@query(f"WITH {_SHARD} SELECT relation, arg_max(shard, CAST(split_part(shard, '#', 2) AS BIGINT)) AS last_shard, count(DISTINCT shard) AS n_shards FROM s GROUP BY relation")
def g11_registry(spark, sf):
    """The registry of relations over all shards: the last shard wins."""
    block = F.split_part("shard", F.lit("#"), F.lit(2)).cast("long")
    return _sharded(spark, sf).groupBy("relation").agg(F.max_by("shard", block).alias("last_shard"), F.countDistinct("shard").alias("n_shards"))


@query(f"WITH {QUADS}, ids AS (SELECT DISTINCT subject AS id FROM q) SELECT relation, count(*) AS n, count(*) FILTER (object IN (SELECT id FROM ids)) AS n_cross FROM q GROUP BY relation")
def j16_cross_document_edges(spark, sf):
    """Quads whose object is itself a document."""
    q = star.quads(spark, sf)
    ids = q.select(F.col("subject").alias("object")).distinct()
    cross = q.join(ids, "object", "left_semi").groupBy("relation").agg(F.count("*").alias("c"))
    return q.groupBy("relation").agg(F.count("*").alias("n")).join(cross, "relation", "left").select("relation", "n", F.coalesce("c", F.lit(0)).alias("n_cross"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN n_name END AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def j18_recased_names(spark, sf):
    """Predicted names, in another case or unknown, brought back to the case of the known ones."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    said = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.upper("n_name")).when(F.col("c_custkey") % 3 == 1, F.lower("n_name")).otherwise(F.concat("n_name", F.lit("_"))).alias("said"))
    known = n.select(F.lower("n_name").alias("low"), F.col("n_name").alias("nation"))
    return said.withColumn("low", F.lower("said")).join(known, "low", "left").select("c_custkey", "nation")


@query("SELECT event_id, CASE WHEN regexp_matches(props, '\"[A-Za-z_]{4,}\"') THEN regexp_extract(props, '\"([A-Za-z_]{4,})\"', 1) ELSE '' END AS answer FROM events")
def e25_answers(spark, sf):
    """The first quoted name of over three letters, as an answer is read."""
    return table(spark, sf, "events").select("event_id", F.regexp_extract("props", '"([A-Za-z_]{4,})"', 1).alias("answer"))


@query(f"""WITH {QUADS}, e AS (SELECT subject AS a, object AS b FROM q UNION SELECT object, subject FROM q), h1 AS (SELECT DISTINCT b AS n FROM e WHERE a = 'nation:3' UNION SELECT 'nation:3')
  SELECT DISTINCT subject, relation, object, condition FROM q WHERE subject IN (SELECT n FROM h1) OR object IN (SELECT n FROM h1)""")
def n07_decoded_hops(spark, sf):
    """All quads within two hops of an entity: those of its neighbours and its own."""
    q = star.quads(spark, sf).distinct()
    near = graph.k_hop(q.select(F.col("subject").alias("source"), F.col("object").alias("target")), spark.createDataFrame([("nation:3",)], "node string"), 1).select("node")
    by_subject = q.join(near.withColumnRenamed("node", "subject"), "subject", "left_semi").select(q.columns)
    return by_subject.unionByName(q.join(near.withColumnRenamed("node", "object"), "object", "left_semi").select(q.columns)).distinct()


@query("WITH w AS (SELECT conv_id, turn, list_contains(string_split(lower(text), ' '), 'the') AS hit FROM conversations), h AS (SELECT DISTINCT conv_id FROM w WHERE hit) SELECT w.conv_id, w.turn FROM w JOIN h USING (conv_id)")
def n12_entity_chunks(spark, sf):
    """All rows of the chunks that name an entity."""
    c = table(spark, sf, "conversations")
    hit = c.where(F.array_contains(F.split(F.lower("text"), " "), "the")).select("conv_id").distinct()
    return c.join(hit, "conv_id", "left_semi").select("conv_id", "turn")


@query(f"WITH {_PATHS}, s AS (SELECT DISTINCT p.path, p.base, 's' || (d.doc_id % 30) AS symbol FROM documents d JOIN p ON p.path = d.source || '/f' || (d.n_chars % 97) || '.py'), o AS (SELECT base, symbol, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT s.path, arg_min(s.symbol, (length(s.symbol), s.symbol)) AS symbol FROM s JOIN o USING (base, symbol) WHERE o.n = 1 GROUP BY s.path), c AS (SELECT base, count(*) AS n FROM p GROUP BY base) SELECT p.path, CASE WHEN c.n = 1 THEN p.base WHEN b.symbol IS NOT NULL THEN p.base || ' (' || b.symbol || ')' ELSE p.base END AS label FROM p JOIN c USING (base) LEFT JOIN b USING (path)")
def a08_symbol_labels(spark, sf):
    """Files of one name told apart by the shortest symbol that none of the others has."""
    p = _paths(spark, sf)
    path = F.concat(F.col("source"), F.lit("/f"), (F.col("n_chars") % 97).cast("string"), F.lit(".py"))
    s = table(spark, sf, "documents").select(path.alias("path"), F.concat(F.lit("s"), (F.col("doc_id") % 30).cast("string")).alias("symbol")).distinct().join(p, "path")
    alone = s.groupBy("base", "symbol").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    best = alone.groupBy("path").agg(F.min(F.struct(F.length("symbol").alias("n"), "symbol"))["symbol"].alias("symbol"))
    n = F.count("*").over(Window.partitionBy("base"))
    return p.withColumn("n", n).join(best, "path", "left").select("path", F.when((F.col("n") > 1) & F.col("symbol").isNotNull(), F.concat("base", F.lit(" ("), "symbol", F.lit(")"))).otherwise(F.col("base")).alias("label"))


def _packet(spark, sf):
    """Packets for one request a repository, seeded with its first file."""
    files = _repositories(spark, sf)
    facts, links = python_code.facts(files), python_code.code_graph(files)
    requests = files.groupBy("repo").agg(F.min("path").alias("path")).select(F.col("repo").alias("request"), "repo", F.lit("p1").alias("query"), "path")
    seeds = requests.select("request", "path", F.lit(None).cast("long").alias("line"), F.lit(None).cast("string").alias("name"))
    requests = requests.drop("path")
    hits = evidence.search(evidence.definitions(links), requests)
    return evidence.packet(facts, links, files.select("repo", "path"), requests, seeds, hits)


def v01_packet_edges(spark, sf):
    """Edges of evidence packets; rows only, the tests work packets out by hand."""
    return _packet(spark, sf)["edges"]


def v04_packet_gaps(spark, sf):
    """The gaps that prompts show; rows only, as above."""
    return evidence.prompt_gaps(_packet(spark, sf)["gaps"])


query()(v01_packet_edges)
query()(v04_packet_gaps)


@query("SELECT event_id, CASE WHEN n > 3 THEN 3 ELSE n END AS n_kept, n > 3 AS cut FROM (SELECT event_id, CAST(event_id % 9 AS BIGINT) AS n FROM events)")
def k11_budget_trim(spark, sf):
    """Lists of a view cut to three where its JSON is over the budget."""
    n = (F.col("event_id") % 9).cast("int")
    names = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("name_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    view = json_text.within_budget(F.to_json(F.struct(names.alias("calls"))), 12)
    e = table(spark, sf, "events").select("event_id", view.alias("v"))
    kept = F.json_array_length(F.get_json_object("v", "$.calls")).cast("long")
    return e.select("event_id", kept.alias("n_kept"), F.coalesce(F.get_json_object("v", "$.calls_truncated") == "true", F.lit(False)).alias("cut"))


@query("SELECT event_id, len(json_keys(props)) > 0 AS has_keys FROM events")
def e26_tolerant_json(spark, sf):
    """Objects read out of text around them, with a fence and a comma too many."""
    said = F.concat(F.lit("Here it is:\n```json\n// found\n"), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit("\n```"))
    e = table(spark, sf, "events").select("event_id", json_text.first_object(said).alias("v"))
    return e.select("event_id", (F.size(F.json_object_keys("v")) > 0).alias("has_keys"))
