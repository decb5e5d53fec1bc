"""All queries of the graph engine by name, with SQL that gives the same rows over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.functions import text as X
from quadlake.operators import graph, triples
from quadlake.operators.naming import aliases
from quadlake.plans.rules import Rule, derive, tally
from quadlake.sources import star
from quadlake.sources.star import CALLS, DEFS, QUADS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SHIPS = Rule("ships", (("?o", "placed_by", "?c", "?_"), ("?c", "lives_in", "?n", "?_"), ("?n", "located_in", "?r", "?_")), ("?o", "ships_to", "?r", "derived"), 0.9)
NEAR = Rule("near", (("?s", "based_in", "?n", "?_"), ("?c", "lives_in", "?n", "?_")), ("?s", "near", "?c", "derived"), 0.6)
LOST = Rule("lost", (("?s", "based_in", "?n", "?_"),), ("?s", "near", "?nowhere", "derived"), 0.9)
HOME = Rule("home", (("?c", "lives_in", "?n", "?_"), ("?n", "located_in", "?r", "?_")), ("?c", "ships_to", "?r", "derived"), 0.9)


@query(f"WITH {QUADS} SELECT a.subject, 'ships_to' AS relation, c.object, 'derived' AS condition, 'ships' AS rule, CAST(0.9 AS DOUBLE) AS confidence, true AS strong FROM q a JOIN q b ON a.object = b.subject JOIN q c ON b.object = c.subject WHERE a.relation = 'placed_by' AND b.relation = 'lives_in' AND c.relation = 'located_in'")
def j01_ships_to_region(spark, sf):
    """A three-atom rule as joins."""
    return derive(star.quads(spark, sf), [SHIPS])


@query(f"WITH {QUADS}, m AS (SELECT DISTINCT a.subject, 'near' AS relation, b.subject AS object, 'near' AS rule, CAST(0.6 AS DOUBLE) AS confidence, false AS strong FROM q a JOIN q b ON a.object = b.object WHERE a.relation = 'based_in' AND b.relation = 'lives_in' UNION ALL SELECT b.subject, 'ships_to', c.object, 'home', CAST(0.9 AS DOUBLE), true FROM q b JOIN q c ON b.object = c.subject WHERE b.relation = 'lives_in' AND c.relation = 'located_in') SELECT rule, strong, confidence, count(*) AS n_facts, count(DISTINCT subject) AS n_subjects FROM m GROUP BY rule, strong, confidence")
def j05_strong_and_ambiguous(spark, sf):
    """Facts of several rules, first rule wins, split at the strong threshold; a rule with an unbound head is void."""
    return tally(star.quads(spark, sf), [LOST, NEAR, HOME])


@query(f"SELECT count(DISTINCT rule) AS n_rules_fired FROM ({ORACLES['j05_strong_and_ambiguous']}) t")
def j06_rules_fired(spark, sf):
    return tally(star.quads(spark, sf), [LOST, NEAR, HOME]).agg(F.countDistinct("rule").alias("n_rules_fired"))


def _file_edges(spark, sf):
    """Resolved calls between files: (source, target, caller, callee, name)."""
    d, c = star.definitions(spark, sf), star.calls(spark, sf).where("condition = 'resolved'")
    # files first, distinct calls only: what is joined is no larger than the pairs of definitions
    pairs = c.select("caller", "callee").distinct()
    a = d.select(F.col("key").alias("caller"), F.col("file").alias("source"))
    b = d.select(F.col("key").alias("callee"), F.col("file").alias("target"), F.col("qual"))
    return pairs.join(a, "caller").join(b, "callee").where("source <> target")


_FILES = f"WITH {DEFS}, {CALLS}, e AS (SELECT DISTINCT a.file AS source, b.file AS target, b.qual, c.caller, c.callee FROM c JOIN d a ON c.caller = a.key JOIN d b ON c.callee = b.key WHERE c.condition = 'resolved' AND a.file <> b.file)"


@query(f"{_FILES} SELECT source, 'file_depends_on' AS relation, target, count(DISTINCT qual) AS n, string_agg(DISTINCT qual, ',' ORDER BY qual) AS via FROM e GROUP BY source, target")
def j07_file_depends_on(spark, sf):
    """Calls between files as file dependencies, with the called definitions."""
    e = _file_edges(spark, sf).groupBy("source", "target").agg(F.array_sort(F.collect_set("qual")).alias("v"))
    return e.select("source", F.lit("file_depends_on").alias("relation"), "target", F.size("v").cast("long").alias("n"), F.array_join("v", ",").alias("via"))


@query(f"{_FILES}, s AS (SELECT DISTINCT source, target, qual FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY qual) AS k FROM s) SELECT source, target, count(*) AS n, string_agg(qual, ',' ORDER BY qual) FILTER (k <= 6) AS first_six FROM r GROUP BY source, target")
def g03_file_reasons(spark, sf):
    """Number of distinct called definitions, and the first six."""
    e = _file_edges(spark, sf).groupBy("source", "target").agg(F.array_sort(F.collect_set("qual")).alias("v"))
    return e.select("source", "target", F.size("v").cast("long").alias("n"), F.array_join(F.slice("v", 1, 6), ",").alias("first_six"))


@query(f"{_FILES} SELECT target AS file, count(DISTINCT source) AS n_dependents, count(DISTINCT qual) AS n_symbols FROM e GROUP BY target")
def n04_reverse_dependencies(spark, sf):
    return _file_edges(spark, sf).groupBy(F.col("target").alias("file")).agg(F.countDistinct("source").alias("n_dependents"), F.countDistinct("qual").alias("n_symbols"))


@query(f"{_FILES}, p AS (SELECT DISTINCT source, target FROM e) SELECT a.source, a.target FROM p a JOIN p b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target")
def t07_mutual_pairs(spark, sf):
    """Files that depend on each other."""
    e = _file_edges(spark, sf).select("source", "target").distinct()
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return e.join(back, ["source", "target"], "left_semi").where("source < target")


_MERGED = """f AS (SELECT DISTINCT p_brand AS file FROM part), x AS (
  SELECT a.p_brand AS source, b.p_brand AS target, 'call' AS kind, 0.8 AS conf, 1 AS seq FROM c JOIN part a ON c.caller = a.p_partkey JOIN part b ON c.callee = b.p_partkey WHERE c.condition = 'resolved' AND a.p_brand <> b.p_brand
  UNION ALL SELECT a.p_brand, b.p_brand, 'mention', 0.2, 2 FROM c JOIN part a ON c.caller = a.p_partkey JOIN part b ON c.callee = b.p_partkey WHERE c.condition = 'unresolved' AND a.p_brand <> b.p_brand),
m AS (SELECT source, target, count(*) AS n_evidence, max(conf) AS confidence, arg_min(kind, seq) AS edge_type FROM x GROUP BY source, target)"""


def _merged(spark, sf):
    """Edges with all evidence merged: most confidence, type of the first."""
    files = star.definitions(spark, sf).select("key", "file")
    c = star.calls(spark, sf).groupBy("caller", "callee", "condition").agg(F.count("*").alias("n"))
    e = c.join(files.select(F.col("key").alias("caller"), F.col("file").alias("source")), "caller").join(files.select(F.col("key").alias("callee"), F.col("file").alias("target")), "callee").where("source <> target")
    call = F.col("condition") == "resolved"
    return e.groupBy("source", "target").agg(F.sum("n").alias("n_evidence"), F.max(F.when(call, 0.8).otherwise(0.2)).alias("confidence"), F.min_by(F.when(call, "call").otherwise("mention"), F.when(call, 1).otherwise(2)).alias("edge_type"))


@query(f"WITH {CALLS}, {_MERGED} SELECT source, target, CAST(n_evidence AS BIGINT) AS n_evidence, CAST(confidence AS DOUBLE) AS confidence, edge_type FROM m")
def j14_merged_edges(spark, sf):
    return _merged(spark, sf)


@query(f"WITH {CALLS}, {_MERGED} SELECT source, 'depends_on' AS relation, target, 'derived_dependency' AS condition FROM m UNION ALL SELECT source, 'calls_into', target, 'derived_dependency' FROM m WHERE edge_type = 'call'")
def j15_derived_triples(spark, sf):
    m = _merged(spark, sf)
    base = m.select("source", F.explode(F.when(F.col("edge_type") == "call", F.array(F.lit("depends_on"), F.lit("calls_into"))).otherwise(F.array(F.lit("depends_on")))).alias("relation"), "target")
    return base.withColumn("condition", F.lit("derived_dependency"))


@query(f"WITH {CALLS}, {_MERGED} SELECT source, count(*) AS n_strong FROM m WHERE confidence > 0.7 GROUP BY source")
def p04_strong_edges(spark, sf):
    return _merged(spark, sf).where("confidence > 0.7").groupBy("source").agg(F.count("*").alias("n_strong"))


@query(f"WITH {DEFS}, {CALLS} SELECT (SELECT count(DISTINCT file) FROM d) AS files, (SELECT count(*) FROM d) AS definitions, count(*) AS call_edges, count(*) FILTER (condition = 'resolved') AS resolved_call_edges FROM c")
def g01_graph_stats(spark, sf):
    d = star.definitions(spark, sf).agg(F.countDistinct("file").alias("files"), F.count("*").alias("definitions"))
    c = star.calls(spark, sf).agg(F.count("*").alias("call_edges"), F.count_if(F.col("condition") == "resolved").alias("resolved_call_edges"))
    return d.crossJoin(c)  # one row each


@query(f"WITH {QUADS} SELECT relation, condition, count(*) AS n, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM q GROUP BY relation, condition")
def p01_relations(spark, sf):
    return star.quads(spark, sf).groupBy("relation", "condition").agg(F.count("*").alias("n"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"))


@query(f"WITH {CALLS} SELECT caller, callee, count(*) AS n FROM c WHERE condition IN ('resolved', 'self') GROUP BY caller, callee")
def p02_resolved_edges(spark, sf):
    return star.calls(spark, sf).where(F.col("condition").isin("resolved", "self")).groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query(f"WITH {DEFS} SELECT qual, split_part(qual, '::', 2) AS short_name, split_part(qual, '.', 2) AS simple_name FROM d")
def p06_short_names(spark, sf):
    return star.definitions(spark, sf).select("qual", X.short_name(F.col("qual")).alias("short_name"), X.simple_name(F.col("qual")).alias("simple_name"))


@query(f"WITH {CALLS}, s AS (SELECT callee, caller, count(*) AS n_sites, min(line) AS line FROM c GROUP BY callee, caller) SELECT callee, caller, n_sites, line FROM s")
def n05_usage_sites(spark, sf):
    """Call sites by definition and caller, with the first line."""
    return star.calls(spark, sf).groupBy("callee", "caller").agg(F.count("*").alias("n_sites"), F.min("line").alias("line"))


_SEARCH = "small_ring"


@query(f"""WITH {DEFS}, t AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(name), '[._]+'), lambda x: x <> '')) AS nt, list_distinct(list_filter(string_split_regex(lower(file), '[._]+'), lambda x: x <> '')) AS ft FROM d),
o AS (SELECT *, len(list_filter(['small', 'ring'], lambda q: list_contains(list_concat(nt, ft), q) OR len(list_filter(list_concat(nt, ft), lambda y: len(q) >= 4 AND len(y) >= 4 AND (starts_with(q, y) OR starts_with(y, q)))) > 0)) AS ov FROM t),
s AS (SELECT qual, name, CASE WHEN lower(name) = '{_SEARCH}' THEN 100.0 WHEN starts_with(lower(name), '{_SEARCH}') OR starts_with('{_SEARCH}', lower(name)) THEN 70.0 WHEN contains(lower(name), '{_SEARCH}') THEN 50.0 ELSE 20.0 * ov END AS base, nt FROM o),
r AS (SELECT qual, name, CAST(base AS DOUBLE) + CASE WHEN list_contains(nt, 'small') OR list_contains(nt, 'ring') THEN 2.0 ELSE 0.0 END - CAST(0.01 AS DOUBLE) * abs(len(name) - {len(_SEARCH)}) AS score FROM s WHERE base > 0)
SELECT qual, name, round(score, 6) AS score FROM r ORDER BY round(score, 6) DESC, qual LIMIT 8""")
def k01_search_symbol(spark, sf):
    """The eight best names for a query: exact, prefix, substring, else token overlap; ties by qualified name."""
    return search(star.definitions(spark, sf), _SEARCH, 8)


def search(defs: DataFrame, words: str, k: int) -> DataFrame:
    q = words.strip().lower()
    qt = list(dict.fromkeys(x for x in q.replace(".", "_").replace(" ", "_").split("_") if x))
    name = F.lower("name")
    nt, ft = X.tokens(F.col("name")), X.tokens(F.col("file"))
    every = F.array_union(nt, ft)

    def hit(w: str):
        near = F.exists(every, lambda y: (F.length(y) >= 4) & (F.lit(w).startswith(y) | y.startswith(F.lit(w)))) if len(w) >= 4 else F.lit(False)
        return (F.array_contains(every, w) | near).cast("int")

    overlap = sum((hit(w) for w in qt), F.lit(0))
    base = F.when(name == q, 100.0)
    if len(q) >= 3:
        base = base.when(name.startswith(q) | F.lit(q).startswith(name), 70.0).when(name.contains(q), 50.0)
    base = base.otherwise(20.0 * overlap)
    bonus = F.when(F.arrays_overlap(nt, F.array(*[F.lit(w) for w in qt])), 2.0).otherwise(0.0)
    score = F.round(base + bonus - 0.01 * F.abs(F.length("name") - len(q)), 6)
    return defs.where(base > 0).select("qual", "name", score.alias("score")).orderBy(F.desc("score"), "qual").limit(k)


@query(f"WITH {DEFS}, n AS (SELECT name, count(*) AS n, min(qual) AS qual FROM d GROUP BY name) SELECT name, n, CASE WHEN n = 1 THEN qual END AS canonical FROM n")
def r20_canonical_names(spark, sf):
    """The definition a bare name stands for, if it is the only one."""
    n = star.definitions(spark, sf).groupBy("name").agg(F.count("*").alias("n"), F.min("qual").alias("q"))
    return n.select("name", "n", F.when(F.col("n") == 1, F.col("q")).alias("canonical"))


@query("SELECT role, lower(trim(role)) AS canonical, count(*) AS n FROM conversations GROUP BY role")
def r22_canonical_entities(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n")).select("role", X.canonical(F.col("role")).alias("canonical"), "n")


_URL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(f"WITH p AS (SELECT DISTINCT string_split({_URL}, '/') AS s, {_URL} AS path FROM pages), x AS (SELECT path, array_to_string(s[i:], '.') AS suffix FROM (SELECT path, s, unnest(range(1, len(s) + 1)) AS i FROM p)) SELECT suffix, min(path) AS path FROM x WHERE suffix <> '' GROUP BY suffix HAVING count(DISTINCT path) = 1")
def r01_unique_suffixes(spark, sf):
    """Dotted suffixes of paths that one path owns."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    p = table(spark, sf, "pages").select(path.alias("path")).distinct().withColumn("s", F.split("path", "/"))
    x = p.select("path", F.explode(F.expr("transform(sequence(1, size(s)), i -> array_join(slice(s, i, size(s)), '.'))")).alias("suffix")).where("suffix <> ''")
    return x.groupBy("suffix").agg(F.countDistinct("path").alias("n"), F.min("path").alias("path")).where("n = 1").select("suffix", "path")


_PATHS = "p AS (SELECT DISTINCT source || '/f' || (n_chars % 97) || '.py' AS path, 'f' || (n_chars % 97) || '.py' AS base FROM documents)"


def _paths(spark, sf):
    base = F.concat(F.lit("f"), (F.col("n_chars") % 97).cast("string"), F.lit(".py"))
    return table(spark, sf, "documents").select(F.concat("source", F.lit("/"), base).alias("path"), base.alias("base")).distinct()


@query(f"WITH {_PATHS}, r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) - 1 AS i FROM p) SELECT path, base, CASE WHEN i = 0 THEN base ELSE replace(base, '.py', '') || '(' || i || ').py' END AS alias FROM r")
def a01_file_aliases(spark, sf):
    return aliases(_paths(spark, sf))


@query(f"WITH {_PATHS} SELECT base, count(*) AS n FROM p GROUP BY base HAVING count(*) > 1")
def a04_duplicate_names(spark, sf):
    return _paths(spark, sf).groupBy("base").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {_PATHS} SELECT path, replace(base, '.py', '') AS stem, '.py' AS extension, split_part(path, '/', 1) AS parent, split_part(path, '/', 1) AS package FROM p")
def a06_path_parts(spark, sf):
    p = _paths(spark, sf)
    return p.select("path", X.stem(F.col("base")).alias("stem"), X.extension(F.col("base")).alias("extension"), X.parent_dir(F.col("path")).alias("parent"), X.package_path(F.col("path")).alias("package"))


@query(f"WITH {_PATHS}, l AS (SELECT path, base, split_part(path, '/', 1) AS dir, count(*) OVER (PARTITION BY base) AS n FROM p) SELECT path, CASE WHEN n = 1 THEN base ELSE base || ' (in ' || dir || '/)' END AS label FROM l")
def a09_natural_labels(spark, sf):
    """A unique file name is its own label; others name the folder if that tells them apart."""
    p = _paths(spark, sf).withColumn("dir", X.parent_dir(F.col("path")))
    n, m = F.count("*").over(Window.partitionBy("base")), F.count("*").over(Window.partitionBy("base", "dir"))
    return p.select("path", F.when(n == 1, F.col("base")).when(m == 1, F.concat("base", F.lit(" (in "), "dir", F.lit("/)"))).otherwise(F.col("base")).alias("label"))


@query(f"WITH RECURSIVE {QUADS}, w AS (SELECT DISTINCT object AS node, CAST(0 AS BIGINT) AS layer FROM q WHERE object NOT IN (SELECT subject FROM q) UNION ALL SELECT q.subject, w.layer + 1 FROM w JOIN q ON q.object = w.node) SELECT node, max(layer) AS layer FROM w GROUP BY node")
def t03_layers(spark, sf):
    """Topological layers of the star graph: regions first, orders last."""
    return graph.layers(star.quads(spark, sf).select(F.col("subject").alias("source"), F.col("object").alias("target")))


@query("SELECT 'nation:' || n_nationkey AS node, min('nation:' || n_nationkey) OVER (PARTITION BY n_regionkey) AS component FROM nation UNION ALL SELECT 'region:' || r_regionkey, least('region:' || r_regionkey, coalesce((SELECT min('nation:' || n_nationkey) FROM nation WHERE n_regionkey = r_regionkey), 'region:' || r_regionkey)) FROM region")
def t05_components(spark, sf):
    """Components of nations and regions."""
    e = star.quads(spark, sf).where("relation = 'located_in'").select(F.col("subject").alias("source"), F.col("object").alias("target"))
    nodes = table(spark, sf, "region").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.connected_components(e, nodes)


@query(f"WITH {QUADS}, e AS (SELECT subject AS a, object AS b FROM q UNION SELECT object, subject FROM q), h1 AS (SELECT DISTINCT b AS n FROM e WHERE a = 'region:0'), h2 AS (SELECT DISTINCT e.b AS n FROM h1 JOIN e ON e.a = h1.n WHERE e.b <> 'region:0' AND e.b NOT IN (SELECT n FROM h1)) SELECT 'region:0' AS node, CAST(0 AS BIGINT) AS hop UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2")
def n08_two_hops(spark, sf):
    """Everything within two undirected steps of a region."""
    e = star.quads(spark, sf).select(F.col("subject").alias("source"), F.col("object").alias("target"))
    return graph.k_hop(e, spark.createDataFrame([("region:0",)], "node string"), 2)


_IS = triples.IS.replace("'", "''")


@query(f"WITH s AS (SELECT conv_id, turn, string_split_regex(text, '[.!?;]+') AS l FROM conversations), x AS (SELECT conv_id, turn, i, regexp_replace(regexp_replace(l[i], '^\\s+', ''), '\\s+$', '') AS s FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM s)) SELECT count(*) AS n, count(*) FILTER (regexp_matches(s, '{_IS}')) AS n_copula FROM x WHERE s <> '' AND NOT contains(s, chr(10))")
def e16_copula_sentences(spark, sf):
    """Sentences, and those with a copula rung."""
    rows = table(spark, sf, "conversations").select(F.explode(F.split("text", "[.!?;]+")).alias("raw"))
    s = F.regexp_replace(F.regexp_replace("raw", r"^\s+", ""), r"\s+$", "")
    rows = rows.select(s.alias("s")).where("s <> '' and not contains(s, '\n')")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("s").rlike(triples.IS)).alias("n_copula"))


def _sql_rung(pattern: str, relation: str, subject: int, obj: int) -> str:
    p = pattern.replace("'", "''")
    a, b = f"regexp_extract(s, '{p}', {subject})", f"regexp_extract(s, '{p}', {obj})"
    valid = " AND ".join(f"trim({x}) <> '' AND length(trim({x})) < 200 AND len(string_split_regex(trim({x}), '\\s+')) < 15" for x in (a, b))
    return f"WHEN regexp_matches(s, '{p}') AND {valid} THEN {{'subject': trim({a}), 'relation': {relation}, 'object': trim({b})}}"


@query(
    "WITH l AS (SELECT conv_id * 1000 + turn AS id, string_split_regex(text, '[.!?;]+') AS l FROM conversations), x AS (SELECT id, i - 1 AS pos, regexp_replace(regexp_replace(l[i], '^\\s+', ''), '\\s+$', '') AS s FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM l)), f AS (SELECT id, pos, CASE "
    + _sql_rung(triples.IS, "'is'", 1, 2)
    + " "
    + _sql_rung(triples.VERB_PREP, f"regexp_extract(s, '{triples.VERB_PREP}', 2) || '_' || regexp_extract(s, '{triples.VERB_PREP}', 3)", 1, 4)
    + " "
    + _sql_rung(triples.SVO, f"regexp_extract(s, '{triples.SVO}', 2)", 1, 3)
    + " END AS f FROM x WHERE s <> '' AND NOT contains(s, chr(10))) SELECT id, pos, f.subject AS subject, f.relation AS relation, f.object AS object FROM f WHERE f IS NOT NULL"
)
def e16_sentence_quads(spark, sf):
    """Sentences of conversations through the rule ladder."""
    turns = table(spark, sf, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return triples.sentence_quads(turns, "id", "text")


@query("SELECT CAST(page_id AS VARCHAR) AS subject, 'links_to' AS relation, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS object FROM pages")
def e15_template_links(spark, sf):
    """A declarative template over pages: every link is a quad."""
    return triples.template_quads(table(spark, sf, "pages"), "page_id", "html", 'href="([^"]*)"', "links_to")


@query("SELECT doc_id, text <> '' AND length(trim(text)) < 200 AND len(string_split_regex(trim(text), '\\s+')) < 15 AS valid FROM documents")
def e19_valid_entities(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.valid_entity(F.col("text")).alias("valid"))


@query("SELECT doc_id, CAST((length(text) + 3) // 4 AS BIGINT) AS n_tokens FROM documents")
def k15_token_estimates(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.approx_tokens(F.col("text")).alias("n_tokens"))


@query("WITH r AS (SELECT doc_id, source, (n_chars + 3) // 4 AS t, sum((n_chars + 3) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) SELECT source, count(*) AS n_kept, CAST(sum(t) AS BIGINT) AS tokens FROM r WHERE run <= 4000 GROUP BY source")
def k13_prefix_budget(spark, sf):
    """The first documents of each source within a budget of tokens.

    Sums of blocks of ids come first, so only blocks that begin within the budget are summed row by row."""
    t = F.floor((F.col("n_chars") + 3) / 4).cast("long")
    d = table(spark, sf, "documents").select("doc_id", "source", t.alias("t"), F.floor(F.col("doc_id") / 1000).alias("block"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = d.groupBy("source", "block").agg(F.sum("t").alias("s")).withColumn("before", before).where("before <= 4000").drop("s")
    run = F.col("before") + F.sum("t").over(Window.partitionBy("source", "block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0))
    d = d.join(blocks, ["source", "block"]).withColumn("run", run).where("run <= 4000")
    return d.groupBy("source").agg(F.count("*").alias("n_kept"), F.sum("t").alias("tokens"))


@query("WITH c AS (SELECT *, CAST(text = '<stop>' AS INT) AS stop FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, '<stop>' FROM conversations GROUP BY conv_id)), k AS (SELECT *, sum(stop) OVER (ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING) - stop AS chunk FROM c) SELECT conv_id, count(*) AS n_rows, CAST(min(turn) AS BIGINT) AS first_turn FROM k WHERE stop = 0 GROUP BY chunk, conv_id")
def n11_reconstruct_chunks(spark, sf):
    """Chunks of a tape between stop rows; the tape is cut by conversation, so islands are found within each."""
    c = table(spark, sf, "conversations")
    stops = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("stop", F.lit(1))
    tape = c.select("conv_id", "turn").withColumn("stop", F.lit(0)).unionByName(stops)
    chunk = F.sum("stop").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - F.col("stop")
    k = tape.withColumn("chunk", chunk).where("stop = 0")
    return k.groupBy("conv_id", "chunk").agg(F.count("*").alias("n_rows"), F.min("turn").alias("first_turn")).drop("chunk")


@query(f"WITH {QUADS}, e AS (SELECT relation, count(*) AS n FROM q GROUP BY relation), r AS (SELECT relation, row_number() OVER (ORDER BY relation) AS id FROM e) SELECT relation, id AS color_id, CASE id WHEN 1 THEN '255,0,0' WHEN 2 THEN '0,255,0' WHEN 3 THEN '0,0,255' ELSE '255,255,0' END AS rgb FROM r")
def m02_relation_colors(spark, sf):
    """Colours of relations, numbered by name; ids beyond the palette follow from a modulus."""
    r = star.quads(spark, sf).select("relation").distinct()
    r = r.withColumn("color_id", F.row_number().over(Window.orderBy("relation")).cast("long"))  # one row a relation: bounded
    return r.select("relation", "color_id", rgb(F.col("color_id")).alias("rgb"))


#: The first colours of the palette.
PALETTE = ("255,0,0", "0,255,0", "0,0,255", "255,255,0", "255,0,255", "0,255,255", "255,128,0", "128,0,255", "0,255,128", "255,0,128", "0,128,255", "128,255,0",
           "128,128,0", "128,0,128", "0,128,128", "255,128,128", "128,255,128", "128,128,255", "255,255,128", "255,128,255", "128,255,255", "192,64,0", "64,192,0", "0,64,192")


def rgb(color: F.Column) -> F.Column:
    spread = F.greatest(F.pmod(color * 5592413, F.lit(1 << 24)), F.lit(1))
    beyond = F.concat_ws(",", *[F.shiftright(spread, s).bitwiseAND(F.lit(255)).cast("string") for s in (16, 8, 0)])
    return F.when(color <= len(PALETTE), F.get(F.array(*[F.lit(x) for x in PALETTE]), (color - 1).cast("int"))).otherwise(beyond)


@query(f"WITH {QUADS}, x AS (SELECT pmod AS shard, subject, relation, object FROM (SELECT *, length(subject) % 4 AS pmod FROM q)) SELECT CAST(shard AS BIGINT) AS shard, count(*) AS quads, count(DISTINCT relation) AS relations, (SELECT count(DISTINCT e) FROM (SELECT subject AS e, shard AS s FROM x UNION ALL SELECT object, shard FROM x) y WHERE y.s = x.shard) AS entities FROM x GROUP BY shard")
def g09_store_stats(spark, sf):
    """Quads, relations and entities by shard."""
    x = star.quads(spark, sf).withColumn("shard", (F.length("subject") % 4).cast("long"))
    e = x.select("shard", F.explode(F.array("subject", "object")).alias("e")).groupBy("shard").agg(F.countDistinct("e").alias("entities"))
    return x.groupBy("shard").agg(F.count("*").alias("quads"), F.countDistinct("relation").alias("relations")).join(e, "shard")


@query(f"WITH {QUADS} SELECT DISTINCT subject, relation, object, condition FROM q")
def s12_distinct_quads(spark, sf):
    return star.quads(spark, sf).distinct()


@query("SELECT source, count(*) AS n_documents, count(*) FILTER (text IS NULL OR text = '') AS n_unreadable, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source")
def g10_coverage(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("n_unreadable"), F.sum("n_chars").alias("n_chars"))


@query("SELECT doc_id, sha256(source || chr(1) || text) AS digest FROM documents")
def s20_content_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.concat("source", F.lit(chr(1)), "text").cast("binary"), 256).alias("digest"))


_PRED = "p AS (SELECT l.doc_id, CAST(l.quality AS BIGINT) AS gold, CAST(CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END AS BIGINT) AS pred, d.lang FROM labels l JOIN documents d USING (doc_id))"


def _predictions(spark, sf):
    p = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return p.select("doc_id", F.col("quality").cast("long").alias("gold"), F.when(F.col("n_chars") >= 400, 1).otherwise(0).cast("long").alias("pred"), "lang")


@query(f"WITH {_PRED} SELECT lang, count(*) AS n, CAST(sum(CAST(gold = pred AS INT)) AS DOUBLE) / greatest(count(*), 1) AS accuracy, sum(CAST(gold = pred AS INT)) >= 0.8 * count(*) AS passed FROM p GROUP BY lang")
def g06_accuracy_report(spark, sf):
    """Accuracy by language, and whether it reaches the threshold."""
    p = _predictions(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("gold") == F.col("pred")).cast("long")).alias("ok"))
    return p.select("lang", "n", (F.col("ok").cast("double") / F.greatest("n", F.lit(1))).alias("accuracy"), (F.col("ok") >= 0.8 * F.col("n")).alias("passed"))


@query(f"WITH {_PRED} SELECT CASE WHEN gold = pred THEN 'correct' WHEN pred = 1 THEN 'false_accept' ELSE 'false_reject' END AS category, count(*) AS n FROM p GROUP BY 1")
def g07_failure_counts(spark, sf):
    p = _predictions(spark, sf)
    kind = F.when(F.col("gold") == F.col("pred"), "correct").when(F.col("pred") == 1, "false_accept").otherwise("false_reject")
    return p.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, count(*) AS n_kept, min(event_id) AS oldest, max(event_id) AS newest FROM r WHERE k <= 64 GROUP BY user_id")
def v07_session_memory(spark, sf):
    """The last 64 events of every user (the bound is the feature)."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    e = table(spark, sf, "events").select("user_id", "event_id").withColumn("k", k).where("k <= 64")
    return e.groupBy("user_id").agg(F.count("*").alias("n_kept"), F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"))


@query(f"WITH {DEFS} SELECT 'snap|' || file || '|' || qual || '|' || key AS id FROM d UNION SELECT DISTINCT 'snap|' || file || '|@file|0' FROM d")
def v02_entity_ids(spark, sf):
    d = star.definitions(spark, sf)
    own = d.select(F.concat_ws("|", F.lit("snap"), "file", "qual", F.col("key").cast("string")).alias("id"))
    return own.unionByName(d.select(F.concat_ws("|", F.lit("snap"), "file", F.lit("@file"), F.lit("0")).alias("id")).distinct()).distinct()
