"""Symbol tables of files: what each defines and re-exports, and the file that an import line leads to."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.functions.session import cut
from quadlake.operators.lookups import STANDARD, find_modules

FACTS = "repo string, path string, seq long, kind string, module string, name string, at long"

#: Lines of imports, and definitions in files that don't parse.
FROM = r"^from\s+(\.{0,3}[\w.]*)\s+import\s+([\w, *]+)"
IMPORT = r"^import\s+([\w.]+)"
DEFINED = r"^\s*(?:def|class)\s+(\w+)"


def _defined(text: str) -> list[str]:
    """Names of functions, classes and plain assignments at the top of a file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [m[1] for line in text.split("\n") if (m := re.match(DEFINED, line.strip()))]
    out = []
    for node in tree.body:
        match node:
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                out.append(name)
            case ast.Assign(targets=targets):
                out += [t.id for t in targets if isinstance(t, ast.Name)]
    return out


def _parse(batches):
    for batch in batches:
        rows = []
        for repo, path, seq, text in batch.itertuples(index=False):
            rows += [(repo, path, seq, "def", None, name, 0) for name in dict.fromkeys(_defined(text or ""))]
            at = 0
            for line in (text or "").split("\n"):
                m = re.match(FROM, line.strip())
                if m and m[1].startswith("."):
                    for name in m[2].split(","):
                        at += 1
                        rows.append((repo, path, seq, "from", m[1].lstrip("."), name.strip() or "*", at))
        yield pd.DataFrame(rows, columns=["repo", "path", "seq", "kind", "module", "name", "at"])


def symbol_tables(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, path, name, kind, defined_in) of every file's own and re-exported names.

    files: (repo, path, seq, text); modules: (repo, module, file). Relative imports re-export, the last one of a name
    wins; ``*`` takes what the source itself defines. A name that the source re-exports leads on to where that one
    leads if the source comes earlier (``seq``), as tables are filled in that order; a name that the source lacks is
    taken to be defined there. Chains lead to ever earlier files and are shortened by half a round."""
    f = cut(files.select("repo", "path", F.col("seq").cast("long").alias("seq"), "text").mapInPandas(_parse, FACTS))
    own = f.where("kind = 'def'").select("repo", "path", "name")
    froms = f.where("kind = 'from'")
    froms = froms.join(find_modules(froms.select("repo", "module"), modules, "repo"), ["repo", "module"]).where("file is not null and file <> path").withColumnRenamed("file", "source")
    of = own.withColumnsRenamed({"path": "source", "name": "defined"})
    every = froms.where("name = '*'").join(of, ["repo", "source"]).select("repo", "path", "seq", "at", F.col("defined").alias("name"), "source")
    named = froms.where("name <> '*'").select("repo", "path", "seq", "at", "name", "source")
    last = cut(every.unionByName(named).groupBy("repo", "path", "seq", "name").agg(F.max_by("source", "at").alias("to")))

    # a step leads on from (to, name) unless it is defined there, or the file there comes later
    known = last.join(own.select("repo", F.col("path").alias("to"), "name", F.lit(True).alias("there")), ["repo", "to", "name"], "left")
    step = known.select("repo", F.col("path").alias("from"), F.col("seq").alias("from_seq"), "name", "to", "there")
    on = step.select("repo", F.col("from").alias("to"), F.col("from_seq").alias("to_seq"), "name")
    links = cut(step.where("there is null").join(on, ["repo", "to", "name"]).where("to_seq < from_seq").select("repo", "from", "name", "to"))
    while not links.isEmpty():
        further = links.select("repo", F.col("from").alias("to"), "name", F.col("to").alias("next"))
        ends = last.select("repo", F.col("path").alias("to"), "name", F.col("to").alias("end"))
        # a link that leads to a link takes its place; one that leads to an end takes the end
        moved = links.join(further, ["repo", "to", "name"], "left").join(ends, ["repo", "to", "name"])
        done = moved.where("next is null").select("repo", F.col("from").alias("path"), "name", "end")
        last = cut(last.join(done, ["repo", "path", "name"], "left").withColumn("to", F.coalesce("end", "to")).drop("end"))
        links = cut(moved.where("next is not null").select("repo", "from", "name", F.col("next").alias("to")))
    exported = last.select("repo", "path", "name", F.lit("re_exported").alias("kind"), F.col("to").alias("defined_in"))
    return own.select("repo", "path", "name", F.lit("defined").alias("kind"), F.col("path").alias("defined_in")).unionByName(exported)


def import_targets(imports: DataFrame, tables: DataFrame, modules: DataFrame) -> DataFrame:
    """(repo, path, line, target): the file that an import line of ``imports`` (repo, path, line) leads to, else null.

    Lines of the standard library lead nowhere unless they name something that is defined here. A re-exported name
    leads to its definition, a name of the module to the module; otherwise the module it is, or a name's module."""
    line = F.trim("line")
    rows = imports.distinct().withColumn("dots", F.regexp_extract(line, FROM, 1)).withColumn("list", F.regexp_extract(line, FROM, 2)).withColumn("plain", F.regexp_extract(line, IMPORT, 1))
    module = F.when(F.col("plain") != "", F.col("plain")).otherwise(F.regexp_replace("dots", r"^\.+", ""))
    rows = rows.withColumn("module", module).withColumn("names", F.filter(F.transform(F.split("list", ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "*")))
    # of "import" lines the top module counts, of "from" lines the whole path
    rows = cut(rows.withColumn("std", F.when(F.col("plain") != "", F.split("module", r"\.")[0].isin(*STANDARD)).otherwise(F.col("module").isin(*STANDARD) & ~F.startswith("dots", F.lit(".")))))
    key = ["repo", "path", "line"]
    each = cut(rows.select(*key, F.posexplode("names").alias("pos", "name")))
    local = each.join(tables.where("kind = 'defined'").select("repo", "name").distinct(), ["repo", "name"], "left_semi").select(*key).distinct().withColumn("local", F.lit(True))
    by_module = find_modules(rows.select("repo", "module"), modules, "repo").withColumnRenamed("file", "by_module")
    by_name = each.join(find_modules(each.select("repo", F.col("name").alias("module")), modules, "repo").where("file is not null").withColumnRenamed("module", "name"), ["repo", "name"])
    by_name = by_name.groupBy(*key).agg(F.min_by("file", "pos").alias("by_name"))
    direct = rows.join(local, key, "left").join(by_module, ["repo", "module"], "left").join(by_name, key, "left")
    direct = direct.withColumn("file", F.coalesce("by_module", F.when(F.col("plain") == "", F.col("by_name")))).withColumn("file", F.when((F.col("std") & F.col("local").isNull()) | (F.col("file") == F.col("path")), None).otherwise(F.col("file")))
    direct = cut(direct.select(*key, "file"))
    found = each.join(direct.where("file is not null"), key).join(tables.select("repo", F.col("path").alias("file"), "name", "kind", "defined_in"), ["repo", "file", "name"])
    found = found.where("kind = 'defined' or defined_in <> path").groupBy(*key).agg(F.min_by("defined_in", F.struct("pos", F.col("kind") == "defined")).alias("traced"))
    return direct.join(found, key, "left").select(*key, F.coalesce("traced", "file").alias("target"))
