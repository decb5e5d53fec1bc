"""Queries on the store of shards, prompts, retrieval, extractor tests, and parts of code graphs, registered with the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadlake.functions.session import work_dir
from quadlake.operators import completion, evaluation, evidence, file_order, prompts, retrieval, store
from quadlake.plans.catalog import ORACLES, query
from quadlake.plans.code_catalog import _SHARD, _numbered, _sharded, k05_shard_routing, m03_cells
from quadlake.plans.reader_catalog import _N, _world, packages
from quadlake.sources import functions, python_code, readers, star
from quadlake.sources.star import CALLS, DEFS, table

# --- the store


@query(f"WITH {_SHARD} SELECT entity, count(*) AS n_shards, min(shard) AS first_shard FROM n GROUP BY entity")
def m04_entity_index(spark, sf):
    """In how many shards an entity is, and the first of them."""
    return store.index(_sharded(spark, sf)).groupBy("entity").agg(F.count("*").alias("n_shards"), F.min("shard").alias("first_shard"))


_ROOM, _TARGET = 527, 0.02


@query(f"""WITH {_SHARD}, z AS (SELECT shard, count(*) AS m FROM n GROUP BY 1), c AS (SELECT shard, count(DISTINCT subject || '>' || object) AS cells FROM s GROUP BY 1), f AS (SELECT z.shard, m FROM z JOIN c USING (shard) WHERE CAST(cells AS DOUBLE) / (m * m) < {_TARGET}),
  b AS (SELECT 'c' || c_custkey AS batch, 'customer:' || c_custkey AS entity FROM customer UNION SELECT 'c' || c_custkey, 'nation:' || c_nationkey FROM customer UNION SELECT 'p' || p_partkey, 'part:' || p_partkey FROM part UNION SELECT 'p' || p_partkey, p_brand FROM part),
  o AS (SELECT b.batch, n.shard, count(*) AS k FROM b JOIN n USING (entity) GROUP BY 1, 2),
  x AS (SELECT a.batch, f.shard, coalesce(o.k, 0) * 1000 + f.m AS score FROM (SELECT DISTINCT batch FROM b) a CROSS JOIN f LEFT JOIN o ON o.batch = a.batch AND o.shard = f.shard WHERE f.m + 2 - coalesce(o.k, 0) < {_ROOM}),
  w AS (SELECT batch, shard, row_number() OVER (PARTITION BY batch ORDER BY score DESC, shard) AS i FROM x)
  SELECT a.batch, w.shard FROM (SELECT DISTINCT batch FROM b) a LEFT JOIN w ON w.batch = a.batch AND w.i = 1""")
def k06_best_shards(spark, sf):
    """The shard each customer and each part would go to."""
    q = _sharded(spark, sf).select("shard", "subject", "object").repartition("shard")  # dealt once, for the sizes and the index
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    c = table(spark, sf, "customer").select(name("c", "c_custkey").alias("batch"), F.explode(F.array(name("customer:", "c_custkey"), name("nation:", "c_nationkey"))).alias("entity"))
    p = table(spark, sf, "part").select(name("p", "p_partkey").alias("batch"), F.explode(F.array(name("part:", "p_partkey"), F.col("p_brand"))).alias("entity"))
    return store.best_shards(c.unionByName(p), store.sizes(q), store.index(q), _ROOM, _TARGET)


@query()
def m05_placed_batches(spark, sf):
    """Calls of each brand's parts, put into its store part by part; tests hold the order of placing by hand."""
    d = star.definitions(spark, sf)
    c = star.calls(spark, sf).where("condition = 'resolved'").join(d.select(F.col("key").alias("caller"), F.col("file").alias("store")), "caller")
    text = lambda x: F.col(x).cast("string")
    return store.encode(c.select("store", F.col("caller").cast("long").alias("batch"), text("caller").alias("subject"), text("callee").alias("object")))


@query(f"WITH {_SHARD}, k AS (SELECT shard, count(*) AS n_entities FROM n GROUP BY 1) SELECT s.shard, n_entities, count(*) AS n_quads, count(DISTINCT subject) AS n_subjects FROM s JOIN k USING (shard) GROUP BY s.shard, n_entities")
def s11_saved_store(spark, sf):
    """A store written by shard, and read again with its manifest."""
    place = work_dir(spark)
    store.save(_sharded(spark, sf), place)
    quads, manifest = store.load(spark, place)
    return manifest.join(quads.groupBy("shard").agg(F.countDistinct("subject").alias("n_subjects")), "shard")


@query(f"WITH {_SHARD} SELECT shard, subject, object, max(relation) AS relation FROM s GROUP BY 1, 2, 3")
def s08_saved_cells(spark, sf):
    """Numbered cells and the numbers of entities, written by shard, and named again."""
    place = work_dir(spark)
    m03_cells(spark, sf).repartition("shard").write.partitionBy("shard").parquet(f"{place}/cells")
    _numbered(_sharded(spark, sf)).repartition("shard").write.partitionBy("shard").parquet(f"{place}/entities")
    cells = spark.read.schema("i long, j long, relation string, n_written long, shard string").parquet(f"{place}/cells")
    named = spark.read.schema("entity string, idx long, shard string").parquet(f"{place}/entities")
    of = lambda at, to: named.select("shard", F.col("idx").alias(at), F.col("entity").alias(to))
    return cells.join(of("i", "subject"), ["shard", "i"]).join(of("j", "object"), ["shard", "j"]).select("shard", "subject", "object", "relation")


@query(f"""WITH {_SHARD}, sc AS ({ORACLES['k05_shard_routing']}), rel AS (SELECT shard FROM sc ORDER BY score DESC, shard LIMIT 3), base AS (SELECT s.* FROM s JOIN rel USING (shard)), h1 AS (SELECT * FROM base WHERE subject = 'nation:7' OR object = 'nation:7'),
  f AS (SELECT shard, subject AS e FROM h1 UNION SELECT shard, object FROM h1), h2 AS (SELECT base.* FROM base JOIN f ON base.shard = f.shard AND base.subject = f.e UNION SELECT base.* FROM base JOIN f ON base.shard = f.shard AND base.object = f.e),
  g AS (SELECT subject AS e FROM h2 UNION SELECT object FROM h2), x AS (SELECT DISTINCT n.shard FROM n JOIN g ON n.entity = g.e WHERE n.shard NOT IN (SELECT shard FROM rel) ORDER BY 1 LIMIT 3),
  h3 AS (SELECT s.* FROM s JOIN x USING (shard) WHERE s.subject IN (SELECT e FROM g) OR s.object IN (SELECT e FROM g))
  SELECT shard, subject, relation, object FROM h2 UNION SELECT shard, subject, relation, object FROM h3""")
def n09_store_question(spark, sf):
    """Two hops around an entity in the three best shards, and one more into others that hold what was found."""
    return store.ask(_sharded(spark, sf), k05_shard_routing(spark, sf), ["nation:7"], hops=2)


# --- prompts and answers

_HEAD, _ASK = "Facts of a shard", "Answer with an array of names."
_SEQ = "row_number() OVER (PARTITION BY shard ORDER BY subject, object, condition)"


def _cases(spark, sf):
    q = _sharded(spark, sf).withColumn("seq", F.struct("subject", "object", "condition"))
    return q, q.select("shard", F.concat(F.lit('{"shard": "'), "shard", F.lit('"}')).alias("query"), F.lit(None).cast("string").alias("hint")).distinct()


@query(f"""WITH {_SHARD}, r AS (SELECT *, {_SEQ} AS k FROM s), t AS (SELECT *, {_SEQ} AS k FROM s WHERE condition <> 'P'),
  a AS (SELECT shard, string_agg('  (' || subject || ', ' || relation || ', ' || object || ', ' || condition || ')', chr(10) ORDER BY k) AS raw FROM r WHERE k <= 60 GROUP BY 1), b AS (SELECT shard, string_agg('  (' || subject || ', ' || relation || ', ' || object || ')', chr(10) ORDER BY k) AS strong FROM t WHERE k <= 40 GROUP BY 1)
  SELECT shard, '{_HEAD}' || chr(10) || chr(10) || chr(10) || 'Raw primitives:' || chr(10) || raw || chr(10) || chr(10) || coalesce('Confirmed facts:' || chr(10) || strong || chr(10) || chr(10), '') || 'Query: {{"shard": "' || shard || '"}}' || chr(10) || chr(10) || '{_ASK}' AS prompt FROM a LEFT JOIN b USING (shard)""")
def v11_prompts(spark, sf):
    q, cases = _cases(spark, sf)
    return prompts.synthesized(cases, "shard", q, q.where("condition <> 'P'"), _HEAD, _ASK)


@query(f"""WITH {_SHARD}, r AS (SELECT *, {_SEQ} AS k FROM s), a AS (SELECT shard, string_agg('  (' || subject || ', ' || relation || ', ' || object || ')', chr(10) ORDER BY k) AS raw FROM r WHERE k <= 50 GROUP BY 1)
  SELECT shard, '{_HEAD}' || chr(10) || chr(10) || 'Extracted primitives:' || chr(10) || raw || chr(10) || chr(10) || 'Query input:' || chr(10) || '{{"shard": "' || shard || '"}}' || chr(10) || chr(10) || '{_ASK}' AS prompt FROM a""")
def v12_one_shot_prompts(spark, sf):
    q, cases = _cases(spark, sf)
    return prompts.one_shot(cases, "shard", q, _HEAD, _ASK)


@query("""SELECT p_partkey, '["' || p_name || '"]' AS as_array, p_name AS as_string, 'Found:' AS as_token, 'Found: ["' || p_name || '"]' AS as_line FROM part""")
def v10_parsed_answers(spark, sf):
    """What a fenced answer says, read in each of the four ways."""
    said = F.concat(F.lit('```json\n\nFound: ["'), "p_name", F.lit('"]\n```'))
    kinds = {"as_array": "json_array", "as_string": "json_string", "as_token": "single_token", "as_line": "line"}
    return table(spark, sf, "part").select("p_partkey", *[prompts.answer(said, k).alias(c) for c, k in kinds.items()])


# --- retrieval and tests of extractors

_PARTS = "list_distinct(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""WITH q AS (SELECT t AS request, unnest({_PARTS.format('t')}) AS w FROM (SELECT DISTINCT p_type AS t FROM part)),
  f AS (SELECT p_brand, p_partkey, unnest({_PARTS.format('p_name')}) AS w, 3 AS v FROM part UNION ALL SELECT p_brand, p_partkey, unnest({_PARTS.format('p_type')}), 2 FROM part UNION ALL SELECT p_brand, p_partkey, unnest([p_size::VARCHAR]), 1 FROM part),
  s AS (SELECT request, p_brand AS path, p_partkey AS line, sum(v)::BIGINT AS score FROM q JOIN f USING (w) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, path, line) AS pos FROM s) SELECT * FROM r WHERE pos <= 12""")
def k10_retrieved_functions(spark, sf):
    """The 12 parts that fit each type best, as functions found by their description."""
    p = table(spark, sf, "part").withColumn("repo", F.lit("r"))
    f = p.select("repo", F.col("p_brand").alias("path"), F.col("p_partkey").alias("line"), F.col("p_name").alias("name"), F.col("p_type").alias("docstring"), F.col("p_size").cast("string").alias("snippet"))
    asked = p.select(F.col("p_type").alias("request"), "repo", F.col("p_type").alias("description")).distinct()
    return retrieval.best(asked, f).select("request", "path", "line", "score", "pos")


@query(f"""WITH {DEFS}, {CALLS}, e AS (SELECT d.file, d.key, count(c.caller) AS n FROM d LEFT JOIN c ON c.caller = d.key GROUP BY 1, 2), i AS (SELECT file, count(*) AS n_docs, sum(n)::BIGINT AS n_primitives, count(*) FILTER (n < 20) + count(*) FILTER (n > 30) + 1 AS n_issues FROM e GROUP BY 1),
  k AS (SELECT d.file, c.condition, count(*) AS m FROM c JOIN d ON c.caller = d.key GROUP BY 1, 2), l AS (SELECT file, string_agg(condition || '=' || m, ', ' ORDER BY m DESC, condition) AS r FROM k GROUP BY 1)
  SELECT file, n_docs, n_primitives, n_issues, 'Extractor test: FAILED' || chr(10) || '  docs: ' || n_docs || '  primitives: ' || n_primitives || coalesce(chr(10) || '  relations: ' || r, '') || chr(10) || 'Issues:' AS head FROM i LEFT JOIN l USING (file)""")
def x06_extractor_feedback(spark, sf):
    """Calls of parts by brand as what an extractor gave for documents, held against limits and wanted relations."""
    d = star.definitions(spark, sf).select("file", F.col("key").alias("doc"))
    q = star.calls(spark, sf).select(F.col("caller").alias("doc"), F.col("condition").alias("relation")).join(d, "doc")
    t = evaluation.extractor_test(d, q, "file", least=20, most=30, required=("inferred",))
    return t.select("file", "n_docs", "n_primitives", F.size("issues").cast("long").alias("n_issues"), F.regexp_extract("feedback", r"(?s)^(.*?Issues:)", 1).alias("head"))


# --- functions, calls, seeds and orders of the packages of regions and nations


@query(f"WITH {_N} SELECT bf AS subject, 'helper' AS object, CAST(3 AS BIGINT) AS line, 2 AS n_lines FROM r UNION ALL SELECT bf, 'ping', 7, 4 FROM r UNION ALL SELECT f, 'make', 6, 2 FROM n UNION ALL SELECT f, 'run', 9, 5 FROM n")
def b01_function_quads(spark, sf):
    q = functions.quads(functions.functions(packages(spark, sf)))
    return q.select("subject", "object", "line", F.size(F.split("snippet", "\n")).alias("n_lines"))


@query(f"WITH {_N} SELECT f AS path, CAST(9 AS BIGINT) AS line, c || '.run' AS qual FROM n")
def x09_wanted_functions(spark, sf):
    """The function of a name on a line; one line further there is none."""
    found = functions.functions(packages(spark, sf))
    n = table(spark, sf, "nation").select(F.lit("world").alias("repo"), F.format_string("r%d/n%d.py", "n_regionkey", "n_nationkey").alias("path"), F.lit("run").alias("name"), F.explode(F.array(F.lit(9).cast("long"), F.lit(10).cast("long"))).alias("line"))
    return functions.wanted(n, found).select("path", "line", "qual")


@query(f"""WITH {_N} SELECT bf || '::helper' AS subject, 'str' AS object, 'unresolved' AS condition FROM r UNION ALL SELECT bf || '::Base' || r || '.ping', bf || '::helper', 'resolved' FROM r UNION ALL SELECT c || '.make', c, 'resolved' FROM n
  UNION ALL SELECT c || '.run', bf || '::' || b || '.ping', 'self' FROM n UNION ALL SELECT c || '.run', bf || '::helper', 'resolved' FROM n UNION ALL SELECT c || '.run', 'missing' || n, 'unresolved' FROM n UNION ALL SELECT c || '.run', 'ping', 'unresolved' FROM n""")
def r06_resolved_callables(spark, sf):
    """All calls: bare names, methods of the own class, dotted names through imports, and what stays open.

    A method's statements count once with its class and once without, so a call on ``self`` is also there as open."""
    return _world(spark, sf, "calls").select("subject", "object", "condition").distinct()


@query(f"WITH {_N} SELECT f AS owner, p || '.base' AS module, bf AS path FROM n UNION ALL SELECT f, p, p || '/__init__.py' FROM n UNION ALL SELECT f, '.base', bf FROM n UNION ALL SELECT f, 'n' || n, f FROM n")
def r15_module_paths(spark, sf):
    """Modules by their path, as a package, relative to a file, and by a suffix that one file alone has."""
    files = packages(spark, sf).select("repo", "path")
    n = table(spark, sf, "nation").select(F.format_string("r%d/n%d.py", "n_regionkey", "n_nationkey").alias("owner"), F.concat(F.lit("r"), "n_regionkey").alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("m"))
    asked = n.select(F.lit("world").alias("repo"), "owner", F.explode(F.array(F.concat("p", F.lit(".base")), F.col("p"), F.lit(".base"), F.col("m"), F.lit("nowhere"))).alias("module"))
    return evidence.module_paths(asked, files).select("owner", "module", "path")


@query(f"WITH {_N} SELECT f AS request, c AS qual, 1 AS pos FROM n UNION ALL SELECT f, bf || '::helper', 2 FROM n UNION ALL SELECT f, bf || '::' || b, 3 FROM n")
def k08_seeded_candidates(spark, sf):
    """A seed of a name and line, one on a wrong line, and a whole file, whose first two definitions count."""
    files = packages(spark, sf)
    defs = evidence.definitions(python_code.code_graph(files))
    n = table(spark, sf, "nation").select(F.format_string("r%d/n%d.py", "n_regionkey", "n_nationkey").alias("request"), F.concat(F.lit("r"), "n_regionkey", F.lit("/base.py")).alias("base"), F.concat(F.lit("N"), "n_nationkey").alias("name"))
    requests = n.select("request", F.lit("world").alias("repo"))
    none = lambda kind: F.lit(None).cast(kind)
    seeds = n.select("request", F.col("request").alias("path"), F.explode(F.array(F.lit(4).cast("long"), F.lit(5).cast("long"))).alias("line"), "name")
    seeds = seeds.unionByName(n.select("request", F.col("base").alias("path"), none("long").alias("line"), none("string").alias("name")))
    hits = requests.select("request", none("string").alias("qual"), none("long").alias("pos")).limit(0)
    return evidence.candidates(defs, requests, seeds, hits).select("request", "qual", "pos")


@query("""WITH a AS (SELECT n_regionkey AS id, 'item' || n_nationkey AS symbol, 100 - n_nationkey AS score FROM nation UNION ALL SELECT n_regionkey, 'item' || n_nationkey || '_extra', 90 FROM nation), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, symbol) AS k FROM a),
  s AS (SELECT id, symbol, k, score - CASE WHEN symbol LIKE '%extra' THEN 20 ELSE 0 END + CASE WHEN symbol = 'item5_extra' THEN 40 ELSE 0 END AS score FROM p WHERE symbol <> 'item7'), r AS (SELECT id, symbol, score::BIGINT AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS pos FROM s) SELECT id, symbol, score, pos FROM r WHERE pos <= 6""")
def k04_reduced_ranking(spark, sf):
    """Names that only go on after another's lose, one is always wanted and one never."""
    from pyspark.sql import Window

    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("id"), F.concat(F.lit("item"), "n_nationkey").alias("symbol"), (100 - F.col("n_nationkey")).cast("long").alias("score"))
    n = n.unionByName(n.select("id", F.concat("symbol", F.lit("_extra")).alias("symbol"), F.lit(90).cast("long").alias("score"))).withColumn("kind", F.lit("name"))
    n = n.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "symbol")).cast("long"))
    return completion.reduce(n, 6, always=("item5_extra",), never=("item7",)).select("id", "symbol", "score", "pos")


@query("WITH a AS (SELECT n_regionkey AS r, 'n' || n_nationkey || '.py' AS alias, 2 AS place FROM nation UNION ALL SELECT r_regionkey, '__init__.py', 1 FROM region UNION ALL SELECT r_regionkey, 'base.py', 0 FROM region) SELECT CAST(r AS VARCHAR) AS repo, alias, row_number() OVER (PARTITION BY r ORDER BY place, alias) - 1 AS pos FROM a")
def t01_files_by_need(spark, sf):
    """Files of each region after those they need: the base, the package, then the modules by name."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("repo"), F.concat(F.lit("n"), "n_nationkey", F.lit(".py")).alias("alias"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("repo"))
    files = n.unionByName(r.select("repo", F.explode(F.array(F.lit("__init__.py"), F.lit("base.py"))).alias("alias")))
    edges = n.select("repo", F.col("alias").alias("source"), F.explode(F.array(F.lit("base.py"), F.lit("__init__.py"))).alias("target"))
    edges = edges.unionByName(r.select("repo", F.lit("__init__.py").alias("source"), F.lit("base.py").alias("target")))
    return file_order.order_files(files, edges, late_tests=False)


@query("SELECT DISTINCT 'b' || replace(p_brand, 'Brand#', '') || '.txt' AS path FROM part ORDER BY 1 LIMIT 10")
def s02_first_files(spark, sf):
    """A scan that keeps the first files by path, as many as a demonstration takes."""
    root = work_dir(spark)
    brands = table(spark, sf, "part").select(F.concat(F.lit("b"), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit(".txt")).alias("folder"), F.col("p_name").alias("value"))
    brands.repartition("folder").write.partitionBy("folder").text(root)
    return readers.scan(spark, root, ".txt", limit=10).select(F.regexp_extract("path", r"folder=([^/]*)/", 1).alias("path"))
