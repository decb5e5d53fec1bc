"""Names that a document offers, the place where a text breaks off, and the ranking of the names for that place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed list: names that are never offered.
NOISE = (
    "if", "elif", "else", "for", "while", "with", "try", "except", "finally",
    "return", "yield", "raise", "pass", "break", "continue", "import", "from",
    "as", "in", "is", "not", "and", "or", "lambda", "def", "class",
    "True", "False", "None", "self", "cls",
    "print", "len", "range", "list", "tuple", "dict", "set", "str", "int",
    "float", "bool", "type", "isinstance", "hasattr", "getattr", "setattr",
    "super", "open", "map", "filter", "sorted", "zip", "enumerate", "iter",
    "next", "all", "any", "sum", "min", "max", "abs", "round",
)

#: Fixed patterns of names in source text; lines may be commented out.
NAME = "[A-Za-z_][A-Za-z0-9_]*"
DEF = rf"(?md)^\s*#?\s*(?:async\s+)?def\s+({NAME})"
CLASS = rf"(?md)^\s*#?\s*class\s+({NAME})"
FROM = r"(?md)^\s*#?\s*from\s+[\w.]+\s+import\s+([^#\n]+)"
IMPORT = r"(?md)^\s*#?\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?"
ASSIGN = rf"(?md)^\s*({NAME})\s*="
METHOD = rf"\.({NAME})\s*\("
FUNCTION = rf"(?<![.\w])({NAME})\s*\("
RECEIVER = rf"({NAME}(?:\.{NAME})*)\.({NAME})\s*\("

#: Fixed patterns of the end of a line.
AFTER_DOT = r"([A-Za-z_][A-Za-z0-9_.\[\]]*)\.$"
IN_NAME = r"([A-Za-z_][A-Za-z0-9_.\[\]]*)\.([A-Za-z_][A-Za-z0-9_]*)$"

RELATION_KIND = {"defines_function": "function", "defines_class": "class", "imports_symbol": "import", "imports_module": "module", "assigns_local": "var", "used_as_method": "used_method", "used_as_function": "used_func"}


def names(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, relation, object, n, receivers): the names of each document and how often they are used.

    ``receivers`` counts what a method is called on, whole and by the last part (with a dot before it). A null text
    has no names; documents are rows, so one id in two rows gives its names twice."""
    every = lambda p, g=1: F.regexp_extract_all(F.col("t"), F.lit(p), F.lit(g))
    quiet = lambda a: F.filter(a, lambda x: ~x.isin(*NOISE))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    piece = lambda x: F.trim(F.regexp_replace(F.trim(F.when(x.contains(" as "), F.split_part(x, F.lit(" as "), F.lit(2))).otherwise(x)), r"\\+$", ""))
    listed = F.transform(F.flatten(F.transform(every(FROM), lambda x: F.split(x, ","))), lambda x: piece(F.trim(x)))
    local = F.transform(F.arrays_zip(every(IMPORT, 1).alias("m"), every(IMPORT, 2).alias("a")), lambda x: F.when(x["a"] != "", x["a"]).otherwise(F.element_at(F.split(x["m"], r"\."), -1)))
    on = F.arrays_zip(every(RECEIVER, 1).alias("r"), every(RECEIVER, 2).alias("m"))
    sites = F.filter(on, lambda x: ~x["m"].isin(*NOISE))
    told = F.transform(sites, lambda x: x["m"])
    loose = F.array_distinct(F.filter(quiet(every(METHOD)), lambda x: ~F.array_contains(told, x)))
    plain = {
        "defines_function": F.array_distinct(quiet(every(DEF))), "defines_class": quiet(every(CLASS)),
        "imports_symbol": F.filter(quiet(listed), lambda x: x.rlike(f"^{NAME}$")), "imports_module": quiet(local), "assigns_local": F.array_distinct(quiet(every(ASSIGN))),
    }
    tag = lambda kind, a: F.transform(a, lambda x: F.struct(F.lit(kind).alias("relation"), x.alias("object"), F.lit(None).cast("string").alias("r")))
    uses = F.concat(tag("used_as_method", loose), tag("used_as_function", quiet(every(FUNCTION))), F.transform(sites, lambda x: F.struct(F.lit("used_as_method").alias("relation"), x["m"].alias("object"), x["r"].alias("r"))))
    out = d.select("id", F.explode(F.concat(*[tag(k, a) for k, a in plain.items()])).alias("x")).select("id", "x.relation", "x.object", F.lit(None).cast("long").alias("n"), F.lit(None).cast("map<string,long>").alias("receivers"))
    u = d.select("id", F.explode(uses).alias("x")).select("id", "x.*")
    n = u.groupBy("id", "relation", "object").agg(F.count("*").alias("n"))
    r = u.where("r is not null").select("id", "relation", "object", F.explode(F.array("r", F.concat(F.lit("."), F.element_at(F.split("r", r"\."), -1)))).alias("r")).groupBy("id", "relation", "object", "r").agg(F.count("*").alias("c"))
    r = r.groupBy("id", "relation", "object").agg(F.map_from_entries(F.collect_list(F.struct("r", "c"))).alias("receivers"))
    return out.unionByName(n.join(r, ["id", "relation", "object"], "left"))


def site(text: Column) -> Column:
    """(kind, receiver, partial) of the end of a text: method_call, attribute, arg_position, bare or unknown."""
    line = F.regexp_replace(F.try_element_at(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")), F.lit(-1)), r"\s+$", "")

    def as_(kind: str, receiver: Column | None = None, partial: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), (none if receiver is None else receiver).alias("receiver"), (none if partial is None else partial).alias("partial"))

    out = F.when(line.isNull(), as_("unknown")).when(line.rlike(AFTER_DOT), as_("method_call", F.regexp_extract(line, AFTER_DOT, 1)))
    out = out.when(line.rlike(IN_NAME), as_("attribute", F.regexp_extract(line, IN_NAME, 1), F.regexp_extract(line, IN_NAME, 2)))
    return out.when(line.endswith("(") | line.endswith(","), as_("arg_position")).otherwise(as_("bare"))


def rank(facts: DataFrame, tails: DataFrame, top_k: int = 12) -> DataFrame:
    """(id, pos, symbol, kind, score): the best names for the end of each text.

    ``facts`` (id, relation, object, n, receivers) as :func:`names` gives them, ``tails`` (id, tail). Equal scores go
    by kind and name. At most ``top_k`` rows an id: that is the report asked for."""
    pairs = F.create_map(*[F.lit(x) for kv in RELATION_KIND.items() for x in kv])
    f = facts.withColumn("kind", F.element_at(pairs, F.col("relation"))).where("kind is not null").withColumnRenamed("object", "symbol")
    s = f.groupBy("id", "symbol", "kind").agg(F.max(10 + F.least(F.lit(20), 3 * F.coalesce("n", F.lit(0)))).alias("base"))
    r = f.where("receivers is not null").select("id", "symbol", "kind", F.explode("receivers").alias("r", "c")).groupBy("id", "symbol", "kind", "r").agg(F.sum("c").alias("c"))
    r = r.groupBy("id", "symbol", "kind").agg(F.map_from_entries(F.collect_list(F.struct("r", "c"))).alias("on"), F.max("c").alias("most"))
    s = s.join(r, ["id", "symbol", "kind"], "left").join(tails.select("id", "tail", site(F.col("tail")).alias("site")), "id")

    kind, where, receiver = F.col("kind"), F.col("site.kind"), F.col("site.receiver")
    known = lambda key: F.coalesce(F.map_contains_key("on", key), F.lit(False))
    tail_part = F.concat(F.lit("."), F.element_at(F.split(receiver, r"\."), -1))
    by_receiver = F.when((kind != "used_method") | (receiver == ""), 0).when(known(receiver), 60).when(known(tail_part), 30).when(F.col("most") >= 3, -25).otherwise(0)
    callable_ = kind.isin("function", "import", "used_method")
    partial = F.lower("site.partial")
    bonus = (
        F.when(where == "method_call", F.when(callable_, 30).when(kind == "class", 5).otherwise(0) + by_receiver)
        .when(where == "attribute", F.when((partial != "") & F.lower("symbol").startswith(partial), 50).otherwise(0) + F.when(callable_, 10).otherwise(0))
        .when(where == "arg_position", F.when(kind.isin("var", "import", "used_func"), 20).otherwise(0))
        .when(where == "bare", F.when(kind.isin("function", "class", "used_func"), 5).otherwise(0))
        .otherwise(0)
    )
    private = F.when(F.col("symbol").startswith("_") & ~F.col("symbol").startswith("__"), -15).otherwise(0)
    seen = F.when(F.expr(r"regexp_like(tail, concat('\\b\\Q', symbol, '\\E\\b'))"), 8).otherwise(0)
    s = s.withColumn("score", (F.col("base") + private + bonus + seen).cast("long"))
    pos = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "kind", "symbol"))
    return s.withColumn("pos", pos.cast("long")).where(F.col("pos") <= top_k).select("id", "pos", "symbol", "kind", "score")


def reduce(ranked: DataFrame, top_k: int = 12, penalty: int = 20, always: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> DataFrame:
    """Ranked names again: a name that goes on after another's name of four or more characters and ``_`` loses
    ``penalty``, ``always`` gain 40, ``never`` go. Rank twice ``top_k`` names first."""
    others = ranked.groupBy("id").agg(F.collect_set("symbol").alias("others"))  # a ranked list is short by construction
    longer = F.exists("others", lambda x: (F.length(x) >= 4) & (F.length("symbol") > F.length(x) + 2) & F.col("symbol").startswith(F.concat(x, F.lit("_"))))
    score = F.col("score") - F.when(longer, penalty).otherwise(0) + F.when(F.col("symbol").isin(*always), 40).otherwise(0)
    out = ranked.join(others, "id").withColumn("score", score.cast("long")).where(~F.col("symbol").isin(*never))
    again = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "pos"))
    return out.withColumn("pos", again.cast("long")).where(F.col("pos") <= top_k).select("id", "pos", "symbol", "kind", "score")
