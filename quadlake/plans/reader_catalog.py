"""Queries on sources, lookups, labels, evaluation, and code graphs of written packages, registered with the catalogue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadlake.functions import text as X
from quadlake.functions.session import work_dir
from quadlake.operators import evaluation, file_order, graph, lookups, symbol_tables
from quadlake.operators.naming import aliases
from quadlake.plans.catalog import _MERGED, _PATHS, _merged, _paths, query
from quadlake.plans.code_catalog import _EDGES, _edges
from quadlake.sources import python_code, readers, star
from quadlake.sources.star import CALLS, DEFS, QUADS, table

# --- sources and the cache


@query("SELECT replace(p_brand, '#', '') AS folder, count(*) AS n_definitions FROM part GROUP BY 1")
def s01_scanned_sources(spark, sf):
    """Files written below a folder, one folder a brand, are found again and read whole."""
    root = work_dir(spark)
    line = F.concat(F.lit("def p"), F.col("p_partkey").cast("string"), F.lit("(): pass"))
    table(spark, sf, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("folder"), line.alias("value")).write.partitionBy("folder").text(root)
    found = readers.scan(spark, root, ".txt", limit=None)
    lines = found.select(F.regexp_extract("path", r"folder=([^/]*)/", 1).alias("folder"), F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.startswith("line", F.lit("def "))).groupBy("folder").agg(F.count("*").alias("n_definitions"))


@query("SELECT event_id, k AS path, json_extract_string(props, '$.' || k) AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def s04_json_documents(spark, sf):
    return readers.json_documents(table(spark, sf, "events"), "props", "event_id")


@query("SELECT p_brand AS repo, 'p' || p_partkey AS name, p_name AS description, p_type || '.py' AS path, p_size + 1 AS line FROM part")
def s05_cases(spark, sf):
    """Functions to be found, written as nested JSON and loaded."""
    root = work_dir(spark)
    p = table(spark, sf, "part").withColumn("path", F.concat("p_type", F.lit(".py")))
    needle = F.struct(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_name").alias("description"), "path", F.col("p_size").alias("start_line"))
    r = p.groupBy("p_brand", F.floor(F.col("p_partkey") / 100)).agg(F.collect_list(needle).alias("needles"))
    r.select(F.array(F.struct(F.col("p_brand").alias("repo"), F.expr("map('a.py', 'pass')").alias("content"), "needles")).alias("python")).write.json(root)
    return readers.load_cases(spark, root, multiline=False)


def _items(spark, sf):
    """Orders as items: the distinct parts in order of their lines are the files in the wanted order."""
    path = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".py"))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("qi"), path.alias("path")).agg(F.min("l_linenumber").alias("at"))
    return rows.groupBy("qi").agg(F.array_sort(F.collect_list(F.struct("at", "path"))).alias("f")).select("qi", F.transform("f", lambda x: F.struct(x["path"].alias("path"), F.concat(F.lit("# "), x["path"]).alias("text"))).alias("files"))


_ITEMS = "i AS (SELECT l_orderkey AS qi, 'p' || l_partkey || '.py' AS path, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), g AS (SELECT qi, count(*) AS n, string_agg(path, ',' ORDER BY pos, path) AS gold, string_agg(path, ',' ORDER BY path) AS files FROM i GROUP BY qi)"


@query(f"WITH {_ITEMS} SELECT qi, n AS n_files FROM g WHERE n BETWEEN 3 AND 5")
def s06_items_of_three_to_five(spark, sf):
    return readers.load_items(_items(spark, sf)).select("qi", F.size("files").cast("long").alias("n_files"))


@query(f"WITH {_ITEMS} SELECT qi, files, gold, n AS n_contents FROM g")
def b05_parsed_items(spark, sf):
    """Items as files by path, contents, and the wanted order."""
    p = readers.parsed_items(_items(spark, sf))
    return p.select("qi", F.array_join("files", ",").alias("files"), F.array_join("gold", ",").alias("gold"), F.size("contents").cast("long").alias("n_contents"))


def _cached(spark, sf):
    """Documents with even ids are extracted first, then all: (cache, documents with status)."""
    cache = readers.ExtractionCache(spark, work_dir(spark))
    lines = lambda d: d.select("key", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache.extract(docs.where("doc_id % 2 = 0"), lines)
    return cache, cache.extract(docs, lines)


_CACHED = "e AS (SELECT DISTINCT coalesce(text, '') AS t FROM documents WHERE doc_id % 2 = 0), h AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN e.t IS NULL THEN 'miss' ELSE 'hit' END AS status FROM documents LEFT JOIN e ON e.t = coalesce(text, ''))"


@query(f"WITH {_CACHED} SELECT doc_id, status FROM h")
def s14_cache_status(spark, sf):
    return _cached(spark, sf)[1].select("doc_id", "status")


@query("SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_facts, md5(coalesce(text, '')) AS digest FROM documents")
def s15_cached_facts(spark, sf):
    """Facts read back by key and in order are what was extracted: lines joined again give the text."""
    cache, status = _cached(spark, sf)
    facts = cache.facts().groupBy("key").agg(F.count("*").alias("n_facts"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")).alias("digest"))
    return status.select("doc_id", "key").join(facts, "key").select("doc_id", "n_facts", "digest")


@query(f"WITH {_CACHED} SELECT count(*) FILTER (status = 'hit') AS n_hits, count(*) FILTER (status = 'miss') AS n_misses, count(*) FILTER (status = 'hit') / count(*) AS hit_rate FROM h")
def s16_cache_stats(spark, sf):
    cache, status = _cached(spark, sf)
    return cache.stats(status)


# --- quads


@query("SELECT 'supplier:' || s_suppkey AS subject, 'rated' AS relation, CASE WHEN s_acctbal < 0 THEN 'low' ELSE 'high' END AS object, CASE WHEN s_suppkey % 3 = 0 THEN 'audited' ELSE '' END AS condition FROM supplier")
def e22_padded_triples(spark, sf):
    """Triples of three parts get an empty condition."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("subject"), F.lit("rated").alias("relation"), F.when(F.col("s_acctbal") < 0, "low").otherwise("high").alias("object"), F.when(F.col("s_suppkey") % 3 == 0, "audited").alias("condition"))
    return s.withColumn("condition", F.coalesce("condition", F.lit("")))


@query("SELECT doc_id, 'mentions' AS relation, l AS object, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(l) >= 3 GROUP BY 1, 2, 3")
def e23_fallback_lines(spark, sf):
    """Without a pattern of its own, every line of three characters or more is an object."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("object")).where(F.length("object") >= 3)
    return lines.groupBy("doc_id", F.lit("mentions").alias("relation"), "object").agg(F.count("*").alias("n"))


@query(f"WITH {QUADS} SELECT relation, count(*) AS n_kept, CAST(0 AS BIGINT) AS n_added FROM q WHERE relation <> 'lives_in' OR CAST(split_part(object, ':', 2) AS INT) < 10 GROUP BY relation")
def r19_resolver_only_removes(spark, sf):
    """A resolver keeps a subset: customers of ten nations; nothing is added."""
    q = star.quads(spark, sf)
    kept = q.where("relation <> 'lives_in' or int(split_part(object, ':', 2)) < 10")
    added = lookups.only_removes(q, kept).groupBy("relation").agg(F.count("*").alias("n_added"))
    return kept.groupBy("relation").agg(F.count("*").alias("n_kept")).join(added, "relation", "left").select("relation", "n_kept", F.coalesce("n_added", F.lit(0)).cast("long").alias("n_added"))


# --- lookups

_WORD = "['json', 'os', 'numpy', 'typing', 'brands']"
_IMPORTS = f"s AS (SELECT p_partkey AS k, {_WORD}[1 + p_partkey % 5] AS m FROM part), l AS (SELECT k, m, CASE k % 3 WHEN 0 THEN 'import ' || m || '.x' WHEN 1 THEN 'from ' || m || ' import p' || k || ', q' ELSE '  from ' || m || '.y import z' || k END AS line FROM s)"


@query(f"WITH {_IMPORTS} SELECT line, m IN ('json', 'os', 'typing') AND NOT (k % 3 = 1 AND k % 2 = 0) AS standard FROM l")
def r13_standard_imports(spark, sf):
    """Import lines of standard modules, unless they name what is defined here (parts with even keys)."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.get(F.array(*[F.lit(x) for x in ("json", "os", "numpy", "typing", "brands")]), (F.col("p_partkey") % 5).cast("int")).alias("m"))
    key = F.col("k").cast("string")
    line = F.when(F.col("k") % 3 == 0, F.concat(F.lit("import "), "m", F.lit(".x"))).when(F.col("k") % 3 == 1, F.concat(F.lit("from "), "m", F.lit(" import p"), key, F.lit(", q"))).otherwise(F.concat(F.lit("  from "), "m", F.lit(".y import z"), key))
    symbols = table(spark, sf, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    return lookups.standard_imports(p.select("k", line.alias("line")), symbols).select("line", "standard")


@query("""WITH m AS (SELECT 'm' || n_nationkey AS module, 'n' || n_nationkey || '.py' AS file FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 'r' || n_regionkey || '.m' || n_nationkey, 'deep' || n_nationkey || '.py' FROM nation WHERE n_nationkey % 3 = 0),
  w AS (SELECT DISTINCT 'r' || n_regionkey || '.m' || s_nationkey AS module, 'm' || s_nationkey AS last FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT w.module, coalesce(a.file, b.file) AS file FROM w LEFT JOIN m a ON a.module = w.module LEFT JOIN m b ON b.module = w.last""")
def r14_modules_by_suffix(spark, sf):
    """Files of dotted paths: the whole path, else its last part."""
    n = table(spark, sf, "nation").withColumn("k", F.col("n_nationkey").cast("string")).withColumn("r", F.col("n_regionkey").cast("string"))
    modules = n.where("n_nationkey < 20").select(F.concat(F.lit("m"), "k").alias("module"), F.concat(F.lit("n"), "k", F.lit(".py")).alias("file"))
    modules = modules.unionByName(n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("r"), "r", F.lit(".m"), "k").alias("module"), F.concat(F.lit("deep"), "k", F.lit(".py")).alias("file")))
    wanted = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("r"), "r", F.lit(".m"), "k").alias("module"))
    return lookups.find_modules(wanted, modules)


@query(f"WITH {DEFS} SELECT name, count(*) AS n_definitions, min(qual) AS first_definition FROM d GROUP BY name")
def r11_definitions_by_name(spark, sf):
    """All definitions of every name that is asked for."""
    d = star.definitions(spark, sf)
    asked = d.select("name").distinct()
    return d.join(asked, "name").groupBy("name").agg(F.count("*").alias("n_definitions"), F.min("qual").alias("first_definition"))


@query(f"WITH {_PATHS}, f AS (SELECT path, base FROM p UNION SELECT base, base FROM p WHERE base LIKE 'f1%'), w AS (SELECT DISTINCT base AS name FROM p UNION SELECT path FROM p) SELECT w.name, coalesce(min(f.path) FILTER (f.path = w.name), min(f.path)) AS path FROM w JOIN f ON f.path = w.name OR f.path LIKE '%' || w.name GROUP BY w.name")
def r21_file_matches(spark, sf):
    """Files by whole path, else the first one that ends so; files are in order of their paths."""
    p = _paths(spark, sf)
    paths = p.select("path").unionByName(p.where("base like 'f1%'").select(F.col("base").alias("path"))).distinct()
    # the order of insertion is that of the paths, which min_by takes as any other key
    return lookups.match_files(p.select(F.col("base").alias("name")).unionByName(p.select(F.col("path").alias("name"))), paths.withColumn("seq", F.col("path")))


@query(f"WITH {_PATHS}, r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) - 1 AS i FROM p) SELECT CASE WHEN i = 0 THEN base ELSE replace(base, '.py', '') || '(' || i || ').py' END AS alias, path, '{{\"alias\":\"' || CASE WHEN i = 0 THEN base ELSE replace(base, '.py', '') || '(' || i || ').py' END || '\",\"path\":\"' || path || '\"}}' AS dump FROM r WHERE i > 0")
def a03_paths_of_aliases(spark, sf):
    """The path behind each numbered alias, and the entry as JSON."""
    known = aliases(_paths(spark, sf))
    asked = known.where(F.col("alias") != F.col("base")).select("alias")
    return known.join(asked, "alias").select("alias", "path", F.to_json(F.struct("alias", "path")).alias("dump"))


_LABELS = f"""{_PATHS}, b AS (SELECT path, base, CASE WHEN CAST(substr(base, 2, length(base) - 4) AS INT) % 2 = 0 THEN 'src' ELSE split_part(path, '/', 1) END AS parent FROM p),
  s AS (SELECT path, base, 'common' AS name, 0 AS seq FROM b UNION ALL SELECT path, base, 'only_' || replace(split_part(path, '/', 1), ' ', '_'), 1 FROM b WHERE CAST(substr(base, 2, length(base) - 4) AS INT) % 4 = 0),
  u AS (SELECT path, arg_min(name, length(name) * 10 + seq) AS symbol FROM s WHERE (SELECT count(DISTINCT t.path) FROM s t WHERE t.base = s.base AND t.name = s.name) = 1 GROUP BY path),
  e AS (SELECT path AS source, lead(path) OVER (ORDER BY path) AS target FROM b), d AS (SELECT source, target FROM e WHERE target IS NOT NULL AND CAST(substr(split_part(source, '/', 2), 2, length(split_part(source, '/', 2)) - 4) AS INT) % 3 = 0),
  n AS (SELECT b.*, count(*) OVER (PARTITION BY base) AS same, count(*) OVER (PARTITION BY base, parent) AS there FROM b),
  a AS (SELECT n.path, CASE WHEN same = 1 THEN n.base WHEN symbol IS NOT NULL THEN 'the ' || n.base || ' that defines ' || symbol WHEN there = 1 THEN n.base || ' (in ' || parent || '/)'
    WHEN o.target IS NOT NULL THEN 'the ' || n.base || ' that imports ' || split_part(o.target, '/', 2) WHEN i.source IS NOT NULL THEN 'the ' || n.base || ' imported by ' || split_part(i.source, '/', 2) ELSE n.base END AS label
    FROM n LEFT JOIN u ON u.path = n.path LEFT JOIN d o ON o.source = n.path LEFT JOIN d i ON i.target = n.path)"""


def _labelled(spark, sf):
    number = F.expr("int(substring(base, 2, length(base) - 4))")
    b = _paths(spark, sf).withColumn("k", number).withColumn("folder", F.split_part("path", F.lit("/"), F.lit(1)))
    files = b.select("path", "base", F.when(F.col("k") % 2 == 0, "src").otherwise(F.col("folder")).alias("parent"))
    symbols = b.select("path", F.lit(0).alias("seq"), F.lit("common").alias("name")).unionByName(b.where("k % 4 = 0").select("path", F.lit(1).alias("seq"), F.concat(F.lit("only_"), F.replace("folder", F.lit(" "), F.lit("_"))).alias("name")))
    # each file depends on the next by path (a chain over a few hundred paths, numbered in one task)
    e = b.select(F.col("path").alias("source"), F.lead("path").over(Window.orderBy("path")).alias("target"), "k").where("target is not null and k % 3 = 0")
    return lookups.natural_labels(files, symbols, e.select("source", "target", F.lit(0).alias("seq")))


@query(f"WITH {_LABELS} SELECT path, label FROM a")
def a07_natural_label_ladder(spark, sf):
    """Labels by symbol, folder, dependency or dependent, whichever first tells equal file names apart."""
    return _labelled(spark, sf)


@query(f"WITH {_LABELS} SELECT path, label FROM a WHERE label LIKE '% that imports %' OR label LIKE '% imported by %'")
def a10_labels_by_dependency(spark, sf):
    return _labelled(spark, sf).where("label like '% that imports %' or label like '% imported by %'")


@query(f"WITH {_LABELS}, k AS (SELECT split_part(path, '/', 1) AS folder, label, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY path) AS i FROM a) SELECT folder, string_agg('  ' || i || '. ' || label, chr(10) ORDER BY i) AS text FROM k GROUP BY folder")
def a11_file_tables(spark, sf):
    """The labels of each folder as a numbered list."""
    rows = _labelled(spark, sf).select(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), F.col("path").alias("seq"), "label")
    return lookups.file_table(rows, "folder")


@query("SELECT p_partkey, 'get,part,' || p_partkey || ',http,of,' || replace(lower(p_brand), '#', '#') AS parts FROM part")
def k02_identifier_parts(spark, sf):
    """Parts of names at dots, underscores and capitals."""
    name = F.concat(F.lit("getPart_"), F.col("p_partkey").cast("string"), F.lit("HTTP.of"), "p_brand")
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.split_identifier(name), ",").alias("parts"))


# --- navigation, gaps and packets


@query(f"""WITH {_EDGES}, o AS (SELECT source AS n, array_to_string(list_sort(list(target))[1:8], ', ') AS t FROM e GROUP BY 1), i AS (SELECT target AS n, array_to_string(list_sort(list(source))[1:8], ', ') AS t FROM e GROUP BY 1)
  SELECT d.qual AS symbol, 'function ' || d.qual || '()  [' || d.file || ']' || coalesce(chr(10) || '  called by: ' || i.t, '') || coalesce(chr(10) || '  calls: ' || o.t, '') AS text FROM d LEFT JOIN o ON o.n = d.qual LEFT JOIN i ON i.n = d.qual""")
def n02_rendered_egos(spark, sf):
    """Each definition with its first callers and callees, as a block of text."""
    e = _edges(spark, sf)
    some = lambda by, c: e.groupBy(F.col(by).alias("symbol")).agg(F.slice(F.array_sort(F.collect_set(c)), 1, 8).alias(f"l_{by}"))
    v = star.definitions(spark, sf).select(F.col("qual").alias("symbol"), "file").join(some("source", "target"), "symbol", "left").join(some("target", "source"), "symbol", "left")
    none = F.array().cast("array<string>")
    v = v.select("symbol", F.lit("function").alias("kind"), F.lit("()").alias("signature"), "file", none.alias("inherits"), none.alias("methods"), F.coalesce("l_target", none).alias("called_by"), F.coalesce("l_source", none).alias("calls"), none.alias("used_by"))
    return lookups.render_ego(v)


@query("SELECT o_custkey, o_orderstatus, o_orderpriority, max(o_orderkey // 100) AS chunk FROM orders GROUP BY 1, 2, 3")
def n13_chunks_of_quads(spark, sf):
    """Decoded quads get the number of the last chunk that has them."""
    key = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    o = table(spark, sf, "orders")
    chunks = o.groupBy(*key).agg(F.max(F.floor(F.col("o_orderkey") / 100)).cast("long").alias("chunk"))
    return o.select(*key).distinct().join(chunks, key, "left")


_GAPS = "g AS (SELECT l_orderkey AS packet, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq, CASE l_returnflag WHEN 'R' THEN 'edge_limit' WHEN 'A' THEN 'unresolved' ELSE 'not_indexed' END AS reason FROM lineitem)"


@query(f"WITH {_GAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY CASE WHEN reason = 'unresolved' THEN 1 ELSE 0 END, seq) AS place FROM g) SELECT packet, seq, reason, CAST(place AS INT) AS place FROM r WHERE place <= 3")
def k14_first_gaps(spark, sf):
    """Of each packet's gaps the first three, those that sum it up before the others."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    reason = F.when(F.col("l_returnflag") == "R", "edge_limit").when(F.col("l_returnflag") == "A", "unresolved").otherwise("not_indexed")
    gaps = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("packet"), F.row_number().over(order).cast("long").alias("seq"), reason.alias("reason"))
    return lookups.prompt_gaps(gaps, "packet", 3)


@query("""WITH c AS (SELECT l_orderkey AS packet, CASE WHEN l_suppkey % 7 = 0 THEN 'candidate belongs to another snapshot' WHEN l_partkey % 5 = 0 OR l_linenumber - 1 < 1 THEN 'candidate has no source location' END AS problem FROM lineitem
  UNION ALL SELECT l_orderkey, CASE WHEN l_suppkey % 11 = 0 THEN 'relation belongs to another snapshot' WHEN l_partkey % 5 = 0 OR CAST(l_quantity AS INT) > 40 THEN 'relation source site cannot be checked' END FROM lineitem) SELECT DISTINCT packet, problem FROM c WHERE problem IS NOT NULL""")
def p12_invalid_packets(spark, sf):
    """Packets with evidence of another snapshot, or that points at no line of a document."""
    line = table(spark, sf, "lineitem")
    docs = table(spark, sf, "part").where("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("path"), F.lit(40).alias("n_lines"))
    mark = lambda n: F.concat(F.when(F.col("l_suppkey") % n == 0, "old").otherwise("now"), F.lit("|x"))
    base = [F.col("l_orderkey").alias("packet")]
    path = F.col("l_partkey").cast("string").alias("path")
    c = line.select(*base, mark(7).alias("id"), path, (F.col("l_linenumber") - 1).alias("line"))
    e = line.select(*base, F.lit("now|y").alias("from_id"), mark(11).alias("to_id"), path, F.col("l_quantity").cast("int").alias("line"))
    return lookups.invalid_packets(c, e, docs, F.lit("now"))


@query("WITH s AS (SELECT l_orderkey AS packet, 'p' || l_partkey AS name, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY packet ORDER BY score DESC, name) AS k, lead(score) OVER (PARTITION BY packet ORDER BY score DESC, name) AS next FROM s) SELECT packet, CASE WHEN score - coalesce(next, 0) >= 8 THEN name END AS pick FROM r WHERE k = 1")
def v14_confident_picks(spark, sf):
    """The best candidate where it is eight points above the next."""
    ranked = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("packet"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name")).agg(F.sum("l_quantity").alias("score"))
    return lookups.confident_pick(ranked, "packet")


@query(f"WITH {DEFS} SELECT qual AS symbol, 'function' AS kind, file, CAST(key % 50 AS BIGINT) AS line, '()' AS signature FROM d")
def p05_definition_cards(spark, sf):
    d = star.definitions(spark, sf).select(F.struct(F.col("qual").alias("symbol"), F.lit("function").alias("kind"), "file", (F.col("key") % 50).cast("long").alias("line"), F.lit("()").alias("signature")).alias("card"))
    return d.select("card.*")


@query(f"WITH {CALLS}, {_MERGED}, w AS (SELECT a.file AS source, b.file AS target FROM f a, f b WHERE a.file < b.file) SELECT w.source, w.target, m.source IS NOT NULL AS has_edge, m.edge_type, CAST(m.confidence AS DOUBLE) AS confidence, 'depends: ' || coalesce(m.edge_type, 'no edge') AS explained FROM w LEFT JOIN m USING (source, target)")
def p03_edge_lookups(spark, sf):
    """Stated pairs of brands: whether there is an edge, and why."""
    f = star.definitions(spark, sf).select("file").distinct()
    asked = f.select(F.col("file").alias("source")).join(f.select(F.col("file").alias("target")), F.col("source") < F.col("target"))
    rows = asked.join(_merged(spark, sf), ["source", "target"], "left")
    return rows.select("source", "target", F.col("edge_type").isNotNull().alias("has_edge"), "edge_type", "confidence", F.concat(F.lit("depends: "), F.coalesce("edge_type", F.lit("no edge"))).alias("explained"))


_THIN = "t AS (SELECT p_brand AS source, arg_min(q, k) AS target, CASE WHEN min(k) % 2 = 0 THEN 0.8 ELSE 0.2 END AS confidence FROM (SELECT p_brand, p_partkey AS k, lead(p_brand) OVER (ORDER BY p_partkey) AS q FROM part) WHERE q <> p_brand GROUP BY p_brand)"


@query(f"""WITH RECURSIVE {_THIN}, n AS (SELECT source AS x FROM t UNION SELECT target FROM t), r AS (SELECT source, target FROM t WHERE confidence > 0.7 UNION SELECT r.source, t.target FROM r JOIN t ON r.target = t.source WHERE t.confidence > 0.7),
  u AS (SELECT source AS a, target AS b FROM t UNION SELECT target, source FROM t), c AS (SELECT x AS a, x AS b FROM n UNION SELECT c.a, u.b FROM c JOIN u ON c.b = u.a)
  SELECT (SELECT count(*) FROM n) AS n_files, (SELECT count(*) FROM t) AS n_edges, (SELECT count(*) FROM t WHERE confidence > 0.7) AS n_strong, (SELECT count(*) > 0 FROM r WHERE source = target) AS has_cycle,
    (SELECT count(DISTINCT m) FROM (SELECT a, min(b) AS m FROM c GROUP BY a)) AS n_components,
    (SELECT count(*) FROM n a JOIN n b ON a.x < b.x) - (SELECT count(*) FROM (SELECT DISTINCT least(source, target), greatest(source, target) FROM t WHERE confidence >= 0.3)) AS n_ambiguous_pairs""")
def g02_dependency_stats(spark, sf):
    """Counts of a thin graph of brands, with cycles of strong edges, components, and pairs without a clear edge."""
    return graph.stats(_thin(spark, sf))


def _thin(spark, sf):
    """One edge from each brand: to the brand of the part after its first one with another brand after it."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("source"), F.col("p_partkey").alias("k"), F.lead("p_brand").over(Window.orderBy("p_partkey")).alias("q")).where("q <> source")
    e = p.groupBy("source").agg(F.min_by("q", "k").alias("target"), F.min("k").alias("k")).select("source", "target", F.when(F.col("k") % 2 == 0, 0.8).otherwise(0.2).alias("confidence"))
    return e


@query(f"WITH {_THIN}, n AS (SELECT source AS x FROM t UNION SELECT target FROM t), s AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM t WHERE confidence >= 0.3) SELECT u.x AS a, v.x AS b FROM n u JOIN n v ON u.x < v.x ANTI JOIN s ON s.a = u.x AND s.b = v.x")
def t04_ambiguous_pairs(spark, sf):
    """Pairs of files whose best edge either way is under 0.3; the pairs of all files are what is asked for."""
    e = _thin(spark, sf)
    n = e.select(F.explode(F.array("source", "target")).alias("x")).distinct()
    sure = e.where("confidence >= 0.3").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return n.select(F.col("x").alias("a")).join(n.select(F.col("x").alias("b")), F.col("a") < F.col("b")).join(sure, ["a", "b"], "left_anti")


@query(f"""WITH RECURSIVE {_THIN}, r AS (SELECT source, target FROM t UNION SELECT r.source, t.target FROM r JOIN t ON r.target = t.source),
  f AS (SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation), q AS (SELECT source, target FROM f UNION SELECT q.source, f.target FROM q JOIN f ON q.target = f.source)
  SELECT 'brands' AS graph, (SELECT count(*) > 0 FROM r WHERE source = target) AS has_cycle UNION ALL SELECT 'nations', (SELECT count(*) > 0 FROM q WHERE source = target)""")
def t06_has_cycle(spark, sf):
    """Whether edges form a cycle: one edge from every brand must, nations and their regions do not."""
    n = table(spark, sf, "nation")
    tree = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("target"))
    both = ((name, graph.stats(e.withColumn("confidence", F.lit(1.0))).select(F.lit(name).alias("graph"), "has_cycle")) for name, e in (("brands", _thin(spark, sf).select("source", "target")), ("nations", tree)))
    (_, a), (_, b) = both
    return a.unionByName(b)


# --- evaluation


def _cases(spark, sf):
    """Orders as graded cases: every fifth is right, empty, reversed, short or wrong by its key."""
    g = _items(spark, sf).select("qi", F.transform("files", lambda x: x["path"]).alias("gold"))
    k, empty = F.col("qi") % 5, F.array().cast("array<string>")
    short = F.slice("gold", F.lit(1), F.size("gold") - 1)
    pred = F.when(k == 0, F.col("gold")).when(k == 1, empty).when(k == 2, F.reverse("gold")).when(k == 3, short).otherwise(F.concat(short, F.array(F.lit("other.py"))))
    return g.withColumn("pred", pred)


#: the same in SQL: the kind of answer follows from the key, except that an item of one file has no other order
_GRADED = f"{_ITEMS}, x AS (SELECT *, CASE WHEN qi % 5 = 0 OR (qi % 5 = 2 AND n = 1) THEN 'correct' WHEN qi % 5 = 1 OR (qi % 5 = 3 AND n = 1) THEN 'empty' WHEN qi % 5 = 2 THEN 'wrong_order' ELSE 'wrong_files' END AS kind FROM g)"


@query(f"WITH {_GRADED} SELECT qi, kind AS error_type FROM x")
def x08_error_types(spark, sf):
    return _cases(spark, sf).select("qi", evaluation.error_type(F.col("pred"), F.col("gold")).alias("error_type"))


@query(f"WITH {_GRADED} SELECT qi, kind = 'correct' AS exact, gold AS gt_order, CAST(n AS INT) AS n_files, kind AS error_type FROM x")
def x10_result_records(spark, sf):
    """Cases in the columns of recorded results."""
    return evaluation.records(_cases(spark, sf)).select("qi", "exact", F.array_join("gt_order", ",").alias("gt_order"), "n_files", "error_type")


_FAILED = f"{_GRADED}, y AS (SELECT qi, qi % 4 AS split, CASE WHEN qi % 13 = 0 THEN 'parse_error' WHEN qi % 7 = 0 OR n * 2 < 2 * n - qi % 3 THEN 'missing_primitive' WHEN qi % 11 = 0 THEN 'zero_strong_edges' WHEN kind = 'wrong_order' AND qi % 2 = 0 THEN 'wrong_order' WHEN kind <> 'correct' THEN 'wrong_answer' ELSE 'correct' END AS failure FROM x)"


def _failures(spark, sf):
    c = _cases(spark, sf)
    n, k = F.size("gold"), F.col("qi")
    quads = F.when(k % 7 == 0, 0).otherwise(2 * n + k % 3)
    strong = F.when(k % 11 == 0, 0).otherwise(1)
    return c.select(F.col("qi").alias("qid"), (k % 4).alias("split"), evaluation.failure_class(k % 13 == 0, quads, n, F.lit(2), strong, F.lit(0), k % 2 == 0, F.col("pred"), F.col("gold")).alias("failure"))


@query(f"WITH {_FAILED} SELECT qi AS qid, failure FROM y")
def x02_failure_classes(spark, sf):
    """Why each case failed, by the first of five causes."""
    return _failures(spark, sf).select("qid", "failure")


@query(f"WITH {_FAILED} SELECT split, count(*) AS n, count(*) FILTER (failure = 'correct') AS n_correct, count(*) FILTER (failure = 'correct') / count(*) AS accuracy, count(*) FILTER (failure = 'correct') / count(*) >= 0.13 AS passed FROM y GROUP BY split")
def x03_evaluated_splits(spark, sf):
    """Accuracy of each split, and whether it reaches the threshold."""
    return evaluation.evaluate(_failures(spark, sf), "split", 0.13)


@query(f"WITH {_FAILED} SELECT count(*) AS n_splits, count(*) FILTER (p) AS n_passed FROM (SELECT split, count(*) FILTER (failure = 'correct') / count(*) >= 0.13 AS p FROM y GROUP BY split)")
def x04_passed_threshold(spark, sf):
    return evaluation.evaluate(_failures(spark, sf), "split", 0.13).agg(F.count("*").alias("n_splits"), F.count_if("passed").alias("n_passed"))


@query(f"""WITH {_FAILED}, c AS (SELECT split, failure, count(*) AS n FROM y GROUP BY 1, 2), k AS (SELECT split, string_agg('- ' || failure || ': ' || n, chr(10) ORDER BY n DESC, failure) AS kinds FROM c GROUP BY split),
  f AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY qi) AS i FROM y WHERE failure <> 'correct'), l AS (SELECT split, string_agg('- case ' || qi, chr(10) ORDER BY qi) AS first FROM f WHERE i <= 5 GROUP BY split)
  SELECT k.split, '## Failures' || chr(10) || kinds || chr(10) || '## First cases' || chr(10) || coalesce(first, '') AS text FROM k LEFT JOIN l USING (split)""")
def s17_failure_reports(spark, sf):
    """A report of each split: kinds of failures, commonest first, and its first five failed cases."""
    return evaluation.markdown(_failures(spark, sf), "split")


# --- code graphs of packages: a package a region, a module a nation


def packages(spark, sf):
    """(repo, path, text): bases and helpers of each region, re-exported by its package, and a module for each nation."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("r"))
    init = r.select(F.concat(F.lit("r"), "r", F.lit("/__init__.py")).alias("path"), F.format_string("from r%1$s.base import Base%1$s\nfrom r%1$s.base import helper as help%1$s\n", "r").alias("text"))
    base = r.select(F.concat(F.lit("r"), "r", F.lit("/base.py")).alias("path"), F.format_string("import os\n\ndef helper(x: int) -> str:\n    return str(x)\n\nclass Base%s:\n    def ping(self):\n        helper(1)\n        helper(2)\n        helper(2)\n", "r").alias("text"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_regionkey").cast("string").alias("r"))
    body = "import r%2$s.base\nfrom r%2$s import Base%2$s, help%2$s\n\nclass N%1$s(Base%2$s):\n    @staticmethod\n    def make():\n        return N%1$s()\n\n    def run(self, size: float):\n        self.ping()\n        help%2$s(3)\n        r%2$s.base.helper(4)\n        missing%1$s()\n"
    mine = n.select(F.concat(F.lit("r"), "r", F.lit("/n"), "n", F.lit(".py")).alias("path"), F.format_string(body, "n", "r").alias("text"))
    return init.unionByName(base).unionByName(mine).select(F.lit("world").alias("repo"), "path", "text")


def _world(spark, sf, *relations):
    return python_code.code_graph(packages(spark, sf)).where(F.col("relation").isin(*relations))


_N = "n AS (SELECT n_nationkey AS n, 'r' || n_regionkey AS p, 'Base' || n_regionkey AS b, 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS f, 'r' || n_regionkey || '/base.py' AS bf, 'r' || n_regionkey || '/n' || n_nationkey || '.py::N' || n_nationkey AS c FROM nation), r AS (SELECT r_regionkey AS r, 'r' || r_regionkey AS p, 'r' || r_regionkey || '/base.py' AS bf FROM region)"


@query(f"WITH {_N} SELECT c AS subject, 'has_method' AS relation, c || '.make' AS object FROM n UNION ALL SELECT c, 'has_method', c || '.run' FROM n UNION ALL SELECT bf || '::Base' || r, 'has_method', bf || '::Base' || r || '.ping' FROM r UNION ALL SELECT c || '.make', 'decorated_by', 'staticmethod' FROM n UNION ALL SELECT c, 'inherits', bf || '::' || b FROM n")
def e03_structure(spark, sf):
    """Methods, decorators and base classes; a base is found through the package that re-exports it."""
    return _world(spark, sf, "has_method", "decorated_by", "inherits").select("subject", "relation", "object")


@query(f"WITH {_N} SELECT f AS subject, 'imports_module' AS relation, p || '.base' AS object, '' AS condition, CAST(1 AS BIGINT) AS line FROM n UNION ALL SELECT f, 'imports_module', p, 'from', 2 FROM n UNION ALL SELECT f, 'imports_symbol', b, p, 2 FROM n UNION ALL SELECT f, 'imports_symbol', 'help' || substr(p, 2), p, 2 FROM n UNION ALL SELECT bf, 'imports_module', 'os', '', 1 FROM r UNION ALL SELECT p || '/__init__.py', 'imports_module', p || '.base', 'from', 1 FROM r UNION ALL SELECT p || '/__init__.py', 'imports_symbol', 'Base' || r, p || '.base', 1 FROM r UNION ALL SELECT p || '/__init__.py', 'imports_symbol', 'helper', p || '.base', 2 FROM r")
def e04_imports(spark, sf):
    """Modules and symbols that files import, each with the first line that does so."""
    return _world(spark, sf, "imports_module", "imports_symbol").select("subject", "relation", "object", "condition", F.col("line").cast("long").alias("line"))


@query(f"WITH {_N} SELECT c || '.run' AS subject, 'float' AS object, 'param' AS condition FROM n UNION ALL SELECT bf || '::helper', 'int', 'param' FROM r UNION ALL SELECT bf || '::helper', 'str', 'return' FROM r")
def e05_annotations(spark, sf):
    return _world(spark, sf, "annotates").select("subject", "object", "condition")


@query(f"WITH {_N} SELECT bf || '::Base' || r || '.ping' AS subject, bf || '::helper' AS object, CAST(l AS BIGINT) AS line, CAST(8 AS BIGINT) AS col FROM r, (VALUES (8), (9), (10)) v(l)")
def e09_call_sites(spark, sf):
    """Each place of a repeated call is a row of its own, once."""
    return _world(spark, sf, "calls").where("object like '%/base.py::helper' and subject like '%.ping'").select("subject", "object", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"))


@query(f"WITH {_N} SELECT c || '.make' AS subject, c AS object, 'resolved' AS condition FROM n UNION ALL SELECT c || '.run', 'missing' || n, 'unresolved' FROM n UNION ALL SELECT bf || '::helper', 'str', 'unresolved' FROM r")
def r03_bare_names(spark, sf):
    """Bare names: a class of the same file is found, an unknown name is not."""
    return _world(spark, sf, "calls").where("object rlike '::N[0-9]+$' or object like 'missing%' or object = 'str'").select("subject", "object", "condition")


@query(f"WITH {_N} SELECT c || '.run' AS subject, bf || '::helper' AS object, CAST(l AS BIGINT) AS line FROM n, (VALUES (11), (12)) v(l)")
def r04_reexports(spark, sf):
    """A renamed function of a package (line 11), and one by its module's path (line 12), lead to their definition."""
    return _world(spark, sf, "calls").where("object like '%::helper' and subject like '%.run' and condition = 'resolved'").select("subject", "object", F.col("line").cast("long").alias("line"))


@query(f"WITH {_N} SELECT c || '.run' AS subject, bf || '::' || b || '.ping' AS object FROM n")
def r05_inherited_methods(spark, sf):
    """Calls on ``self`` of a method that a base class in another file defines."""
    return _world(spark, sf, "calls").where("condition = 'self'").select("subject", "object")


# --- dependencies between files, by what they follow from

_FILE_QUADS = f"""{DEFS}, {CALLS}, k AS (SELECT key, 'b' || replace(file, 'Brand#', '') || '.py' AS home, 'p' || key || '@b' || replace(file, 'Brand#', '') || '.py' AS symbol FROM d),
  h AS (SELECT DISTINCT home FROM k)"""


def _file_quads(spark, sf):
    """Quads of one repository: brands are files, parts their symbols; some parts extend others, some files are tests."""
    home = F.concat(F.lit("b"), F.replace("file", F.lit("Brand#"), F.lit("")), F.lit(".py"))
    d = star.definitions(spark, sf).select("key", home.alias("home")).withColumn("symbol", F.concat(F.lit("p"), F.col("key").cast("string"), F.lit("@"), "home"))
    files = d.select("home").distinct()
    stage = lambda s, path, seq: F.struct(F.lit(s).alias("stage"), path.alias("path"), seq.cast("long").alias("seq")).alias("ord")

    def quad(rows, subject, relation, obj, condition, at):
        return rows.select(F.lit("r").alias("repo"), subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"), F.lit(condition).alias("condition"), at)

    c, zero = F.col, F.lit(0)
    out = quad(files, F.lit("r"), "contains_file", c("home"), "file_level", stage(0, c("home"), zero))
    out = out.unionByName(quad(files, F.lit("r"), "contains_file", F.concat(F.lit("test_"), c("home")), "file_level", stage(0, c("home"), zero)))
    out = out.unionByName(quad(d, c("symbol"), "defined_in", c("home"), "symbol_level", stage(1, c("home"), c("key"))))
    next_file = files.select("home", F.concat(F.lit("b"), (F.regexp_extract("home", r"b(\d+)", 1).cast("int") + 1).cast("string"), F.lit(".py")).alias("to"))
    out = out.unionByName(quad(next_file, c("home"), "imports_module", c("to"), "internal", stage(2, c("home"), zero)))
    ext = d.where("key % 10 = 0").select("symbol", "home", "key", F.concat(F.lit("p"), (c("key") + 1).cast("string")).alias("base"))
    out = out.unionByName(quad(ext, c("symbol"), "extends", c("base"), "name", stage(2, c("home"), c("key"))))
    pairs = star.calls(spark, sf).where("condition = 'resolved'").select("caller", "callee").distinct()
    pairs = pairs.join(d.select(c("key").alias("caller"), c("symbol").alias("a"), c("home").alias("at")), "caller").join(d.select(c("key").alias("callee"), c("symbol").alias("b")), "callee")
    return out.unionByName(quad(pairs, c("a"), "calls", c("b"), "resolved", stage(3, c("at"), c("caller"))))


def _dependencies(spark, sf, relation=None):
    q = _file_quads(spark, sf)
    if relation:
        q = q.where(F.col("relation").isin("contains_file", "defined_in", relation))
    d = file_order.dependencies(q)
    return d.select("source", "target", F.size("evidence").cast("long").alias("n_evidence"), "confidence", "edge_type")


_NEXT = "'b' || (CAST(replace(replace(home, 'b', ''), '.py', '') AS INT) + 1) || '.py'"


@query(f"WITH {_FILE_QUADS} SELECT home AS source, {_NEXT} AS target, CAST(1 AS BIGINT) AS n_evidence, CAST(0.85 AS DOUBLE) AS confidence, 'module' AS edge_type FROM h WHERE {_NEXT} IN (SELECT home FROM h)")
def j10_module_edges(spark, sf):
    return _dependencies(spark, sf, "imports_module").where("edge_type = 'module'")


@query(f"WITH {_FILE_QUADS}, e AS (SELECT DISTINCT a.home AS source, b.home AS target, c.caller, c.callee FROM c JOIN k a ON a.key = c.caller JOIN k b ON b.key = c.callee WHERE c.condition = 'resolved' AND a.home <> b.home) SELECT source, target, count(*) AS n_evidence, CAST(0.8 AS DOUBLE) AS confidence, 'call' AS edge_type FROM e GROUP BY source, target")
def j11_call_edges(spark, sf):
    return _dependencies(spark, sf, "calls").where("edge_type = 'call'")


@query(f"WITH {_FILE_QUADS} SELECT a.home AS source, b.home AS target, count(*) AS n_evidence, CAST(0.95 AS DOUBLE) AS confidence, 'extends' AS edge_type FROM k a JOIN k b ON b.key = a.key + 1 WHERE a.key % 10 = 0 AND a.home <> b.home GROUP BY 1, 2")
def j12_extends_edges(spark, sf):
    """A base is looked up by a name that only one file defines."""
    return _dependencies(spark, sf, "extends").where("edge_type = 'extends'")


@query(f"WITH {_FILE_QUADS} SELECT 'test_' || home AS source, home AS target, CAST(1 AS BIGINT) AS n_evidence, CAST(0.5 AS DOUBLE) AS confidence, 'heuristic' AS edge_type FROM h")
def j13_test_edges(spark, sf):
    return _dependencies(spark, sf, "contains_file").where("edge_type = 'heuristic'")


# --- symbol tables: three modules a region in a chain of re-exports, one of them read too early


def _exporting(spark, sf):
    """(files, modules): in region r, api re-exports base, late takes it from api, and early too but comes before api."""
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("r"))
    bodies = {"base": "class Base%1$s:\n    pass\n\nLIMIT%1$s = 3\n", "api": "from .base%1$s import *\nfrom .base%1$s import Base%1$s\n", "late": "from .api%1$s import Base%1$s\n", "early": "from .api%1$s import Base%1$s, gone%1$s\n"}
    order = {"early": 0, "api": 1, "base": 2, "late": 3}
    files = None
    for name, body in bodies.items():
        one = r.select(F.lit("w").alias("repo"), F.concat(F.lit(f"{name}"), "r", F.lit(".py")).alias("path"), F.lit(order[name]).alias("seq"), F.format_string(body, "r").alias("text"), F.concat(F.lit(name), "r").alias("module"))
        files = one if files is None else files.unionByName(one)
    return files, files.select("repo", "module", F.col("path").alias("file"))


_TABLES = """r AS (SELECT r_regionkey AS r FROM region), t AS (
  SELECT 'base' || r || '.py' AS path, 'Base' || r AS name, 'defined' AS kind, 'base' || r || '.py' AS defined_in FROM r UNION ALL SELECT 'base' || r || '.py', 'LIMIT' || r, 'defined', 'base' || r || '.py' FROM r
  UNION ALL SELECT 'api' || r || '.py', 'Base' || r, 're_exported', 'base' || r || '.py' FROM r UNION ALL SELECT 'api' || r || '.py', 'LIMIT' || r, 're_exported', 'base' || r || '.py' FROM r
  UNION ALL SELECT 'late' || r || '.py', 'Base' || r, 're_exported', 'base' || r || '.py' FROM r
  UNION ALL SELECT 'early' || r || '.py', 'Base' || r, 're_exported', 'api' || r || '.py' FROM r UNION ALL SELECT 'early' || r || '.py', 'gone' || r, 're_exported', 'api' || r || '.py' FROM r)"""


@query(f"WITH {_TABLES} SELECT * FROM t")
def r10_symbol_tables(spark, sf):
    """Own and re-exported names with the file that defines them; tables are filled in the order of the files."""
    files, modules = _exporting(spark, sf)
    return symbol_tables.symbol_tables(files, modules).select("path", "name", "kind", "defined_in")


@query("""SELECT n_nationkey AS n, CASE n_nationkey % 6 WHEN 0 THEN 'base' || n_regionkey || '.py' WHEN 1 THEN NULL WHEN 2 THEN 'base' || n_regionkey || '.py' WHEN 3 THEN 'api' || n_regionkey || '.py' WHEN 4 THEN NULL ELSE 'late' || n_regionkey || '.py' END AS target FROM nation""")
def r12_import_targets(spark, sf):
    """Import lines of a module for each nation: through re-exports, of the standard library, of a module, of nothing."""
    files, modules = _exporting(spark, sf)
    tables = symbol_tables.symbol_tables(files, modules)
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("r"), (F.col("n_nationkey") % 6).alias("k"))
    lines = ("from .api%s import Base%s", "import os", "  from pkg.api%s import nothing, LIMIT%s", "import pkg.api%s", "from json import dumps", "from nowhere import x, late%s")
    line = F.lit(None).cast("string")
    for i, text in enumerate(lines):
        line = F.when(F.col("k") == i, F.format_string(text.replace("%s", "%1$s"), "r")).otherwise(line)
    asked = n.select("n_nationkey", F.lit("w").alias("repo"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".py")).alias("path"), line.alias("line"))
    found = symbol_tables.import_targets(asked.select("repo", "path", "line"), tables, modules)
    return asked.join(found, ["repo", "path", "line"]).select(F.col("n_nationkey").alias("n"), "target")
