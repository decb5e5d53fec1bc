"""Lookups of files, imports and labels as joins, and renderings of what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Top modules that count as the standard library.
STANDARD = (
    "abc", "argparse", "ast", "asyncio", "base64", "bisect", "builtins", "calendar", "collections", "configparser",
    "contextlib", "copy", "csv", "ctypes", "dataclasses", "datetime", "decimal", "difflib", "email", "enum",
    "functools", "gc", "glob", "hashlib", "heapq", "html", "http", "importlib", "inspect", "io", "itertools", "json",
    "keyword", "logging", "math", "multiprocessing", "numbers", "operator", "os", "pathlib", "pickle", "platform", "pprint",
    "queue", "random", "re", "secrets", "select", "shelve", "shutil", "signal", "socket", "sqlite3", "ssl", "stat",
    "statistics", "string", "struct", "subprocess", "sys", "tempfile", "textwrap", "threading", "time", "timeit",
    "tkinter", "token", "tokenize", "trace", "traceback", "turtle", "types", "typing", "unicodedata", "unittest",
    "urllib", "uuid", "warnings", "wave", "weakref", "xml", "xmlrpc", "zipfile", "zlib",
)

#: Reasons of gaps that sum up a packet.
SUMMARY = ("edge_limit", "gap_limit", "not_indexed", "seed_not_in_graph", "duplicate_definition")


def standard_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """``imports`` (line, ...) with ``standard``: a standard module, and no imported name is defined in ``symbols`` (name).

    Only names of ``from`` imports can be defined elsewhere; ``*`` is no name."""
    line = F.trim("line")
    top = F.regexp_extract(line, r"^(?:from\s+(\w+)[\w.]*\s+import|import\s+(\w+))", 1)
    plain = F.regexp_extract(line, r"^import\s+(\w+)", 1)
    names = F.transform(F.split(F.regexp_extract(line, r"^from\s+[\w.]+\s+import\s+([\w, *]+)", 1), ","), lambda x: F.trim(x))
    rows = imports.select("*", F.when(top != "", top).otherwise(plain).isin(*STANDARD).alias("__top"), F.when(top != "", names).otherwise(F.array().cast("array<string>")).alias("__names"))
    lines = rows.where("__top").select("line", F.explode(F.array_distinct("__names")).alias("name"))
    local = lines.join(symbols.select("name").distinct(), "name", "left_semi").select("line").distinct().withColumn("__local", F.lit(True))
    return rows.join(local, "line", "left").withColumn("standard", F.col("__top") & F.col("__local").isNull()).drop("__top", "__names", "__local")


def find_modules(wanted: DataFrame, modules: DataFrame, *by: str) -> DataFrame:
    """(*by, module, file) of the dotted paths in ``wanted`` (*by, module): itself, else its last part, else its longest
    suffix that is a module of ``modules`` (*by, module, file); null where none is."""
    parts = F.split("module", r"\.")
    ways = F.concat(F.array("module", F.element_at(parts, -1)), F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>")))
    asked = wanted.select(*by, "module").distinct()
    each = asked.where("module <> ''").select(*by, "module", F.posexplode(ways).alias("way", "at"))
    hit = each.join(modules.select(*by, F.col("module").alias("at"), "file"), [*by, "at"]).groupBy(*by, "module").agg(F.min_by("file", "way").alias("file"))
    return asked.join(hit, [*by, "module"], "left")


def match_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): the file of that path, else the first (by ``seq``) that ends with it or has it as its own name.

    A name's last part is a key of both sides, so only files of that own name (or a longer one) are looked at."""
    own = F.element_at(F.split("path", "/"), -1)
    asked = wanted.distinct().withColumn("own", F.element_at(F.split("name", "/"), -1))
    known = files.withColumn("tail", own)
    tails = known.select("tail").distinct().join(asked, F.expr("endswith(tail, own)")).select("name", "tail")
    found = known.join(tails, "tail").where(F.endswith("path", "name") | (F.col("tail") == F.col("name")))
    return found.groupBy("name").agg(F.min_by("path", F.struct(F.col("path") != F.col("name"), "seq")).alias("path"))


def natural_labels(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, label) of ``files`` (path, base, parent): a unique base, else the shortest symbol that no file of the same
    base has, else a folder that tells it apart, else its first dependency or dependent, else the base.

    symbols: (path, seq, name); edges: (source, target, seq)."""
    same = files.select("path", "base")
    shared = symbols.join(same, "path").groupBy("base", "name").agg(F.countDistinct("path").alias("n"))
    own = symbols.join(same, "path").join(shared.where("n = 1").select("base", "name"), ["base", "name"])
    own = own.groupBy("path").agg(F.min_by("name", F.struct(F.length("name"), "seq")).alias("symbol"))
    named = lambda side: same.select(F.col("path").alias(side), F.col("base").alias("other"))
    to = edges.join(named("target"), "target").groupBy(F.col("source").alias("path")).agg(F.min_by("other", "seq").alias("to"))
    of = edges.join(named("source"), "source").groupBy(F.col("target").alias("path")).agg(F.min_by("other", "seq").alias("of"))
    counts = files.groupBy("base").agg(F.count("*").alias("same")), files.groupBy("base", "parent").agg(F.count("*").alias("there"))
    rows = files.join(counts[0], "base").join(counts[1], ["base", "parent"]).join(own, "path", "left").join(to, "path", "left").join(of, "path", "left")
    label = (
        F.when(F.col("same") == 1, F.col("base"))
        .when(F.col("symbol").isNotNull(), F.format_string("the %s that defines %s", "base", "symbol"))
        .when((F.col("parent") != "") & (F.col("there") == 1), F.format_string("%s (in %s/)", "base", "parent"))
        .when(F.col("to").isNotNull(), F.format_string("the %s that imports %s", "base", "to"))
        .when(F.col("of").isNotNull(), F.format_string("the %s imported by %s", "base", "of"))
        .otherwise(F.col("base"))
    )
    return rows.select("path", label.alias("label"))


def file_table(labels: DataFrame, *by: str) -> DataFrame:
    """(*by, text): the labels (seq, label) of each group as a numbered list."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda x, i: F.format_string("  %d. %s", i + 1, x["label"]))
    return labels.groupBy(*by).agg(F.array_join(lines, "\n").alias("text"))


def render_ego(views: DataFrame) -> DataFrame:
    """(symbol, text) of views (symbol, kind, signature, file, inherits, methods, called_by, calls, used_by): lists of names."""
    line = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"  {title}: "), F.array_join(c, ", ")))
    head = F.concat("kind", F.lit(" "), "symbol", F.coalesce("signature", F.lit("")), F.lit("  ["), "file", F.lit("]"))
    return views.select("symbol", F.concat_ws("\n", head, line("inherits", "inherits"), line("methods", "methods"), line("called by", "called_by"), line("calls", "calls"), line("used by", "used_by")).alias("text"))


def prompt_gaps(gaps: DataFrame, by: str, limit: int = 12) -> DataFrame:
    """The first ``limit`` gaps (by, seq, reason) of each packet, reasons that sum it up before the others."""
    order = Window.partitionBy(by).orderBy(F.when(F.col("reason").isin(*SUMMARY), 0).otherwise(1), "seq")
    return gaps.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def invalid_packets(candidates: DataFrame, edges: DataFrame, documents: DataFrame, snapshot: Column) -> DataFrame:
    """(packet, problem) of candidates (packet, id, path, line) and edges (packet, from_id, to_id, path, line) that don't
    belong to the snapshot or point at no line of ``documents`` (path, n_lines)."""
    mark = F.concat(snapshot, F.lit("|"))
    c = candidates.join(documents, "path", "left")
    c = c.select("packet", F.when(~F.startswith("id", mark), "candidate belongs to another snapshot").when(F.col("n_lines").isNull() | (F.col("line") < 1), "candidate has no source location").alias("problem"))
    e = edges.join(documents, "path", "left")
    away = ~F.startswith("from_id", mark) | ~F.startswith("to_id", mark)
    e = e.select("packet", F.when(away, "relation belongs to another snapshot").when(F.col("n_lines").isNull() | (F.col("line") < 1) | (F.col("line") > F.col("n_lines")), "relation source site cannot be checked").alias("problem"))
    return c.unionByName(e).where("problem is not null").distinct()


def only_removes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that a resolver added, which it must not."""
    return after.exceptAll(before)


def confident_pick(ranked: DataFrame, by: str, gap: float = 8) -> DataFrame:
    """(by, pick): the best candidate (by, name, score) where its score is ``gap`` above the next one's, else null."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "name")
    rows = ranked.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("place = 1")
    return rows.select(by, F.when(F.col("score") - F.coalesce("next", F.lit(0)) >= gap, F.col("name")).alias("pick"))
