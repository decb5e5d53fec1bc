"""Every function of Python files, nested ones too, with its docstring and source."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "repo string, path string, qual string, name string, line long, docstring string, snippet string"


def _functions(path: str, text: str):
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    lines, open_ = text.split("\n"), [(tree, "")]
    while open_:
        node, above = open_.pop()
        for child in ast.iter_child_nodes(node):
            within = above
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                within = f"{above}.{child.name}" if above else child.name
                if not isinstance(child, ast.ClassDef):
                    yield f"{path}::{within}", child.name, child.lineno, ast.get_docstring(child) or "", "\n".join(lines[child.lineno - 1 : child.end_lineno])
            open_.append((child, within))


def functions(files: DataFrame) -> DataFrame:
    """Functions of files (repo, path, text); a file that isn't Python has none."""

    def parse(batches):
        for batch in batches:
            rows = [(repo, path, *f) for repo, path, text in batch.itertuples(index=False) for f in _functions(path, text or "")]
            yield pd.DataFrame(rows, columns=["repo", "path", "qual", "name", "line", "docstring", "snippet"]).astype({"line": "int64"})

    return files.select("repo", "path", "text").mapInPandas(parse, SCHEMA)


def quads(found: DataFrame) -> DataFrame:
    """(repo, subject, relation, object, docstring, snippet, line): what each file defines."""
    return found.select("repo", F.col("path").alias("subject"), F.lit("defines_function").alias("relation"), F.col("name").alias("object"), "docstring", "snippet", "line")


def wanted(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, path, name, line, qual) of what is asked for: the only function of that name on that line."""
    hit = asked.join(found.select("repo", "path", "name", "line", "qual"), ["repo", "path", "name", "line"])
    return hit.groupBy("repo", "path", "name", "line").agg(F.count("*").alias("n"), F.min("qual").alias("qual")).where("n = 1").drop("n")
