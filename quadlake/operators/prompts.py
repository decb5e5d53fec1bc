"""Prompts assembled from the first quads of each case, and the answers read back.

How many quads a prompt shows is part of its format; what goes beyond is not needed by any other column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(rows: DataFrame, by: str, line: Column, limit: int) -> DataFrame:
    """(by, lines): a line for each of the first ``limit`` rows (by, seq) of a case."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("seq"))  # Spark limits each case before its shuffle
    first = rows.select(by, "seq", line.alias("line")).withColumn("place", place).where(F.col("place") <= limit)
    return first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))


def _quad(*columns: str) -> Column:
    return F.concat(F.lit("  ("), F.concat_ws(", ", *columns), F.lit(")"))


def synthesized(cases: DataFrame, by: str, raw: DataFrame, strong: DataFrame, header: str, instruction: str) -> DataFrame:
    """(by, prompt) of cases (by, query, hint): up to 60 raw quads, 40 strong facts, the hint and 500 characters of the query."""
    r = listed(raw, by, _quad("subject", "relation", "object", "condition"), 60).withColumnRenamed("lines", "raw")
    s = listed(strong, by, _quad("subject", "relation", "object"), 40).withColumnRenamed("lines", "strong")
    titled = lambda title, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(title), F.col(c)))
    x = cases.join(r, by, "left").join(s, by, "left").withColumn("query", F.substring("query", 1, 500))
    parts = (titled("Raw primitives:\n", "raw"), titled("Confirmed facts:\n", "strong"), titled("Computed hint: ", "hint"), titled("Query: ", "query"))
    return x.select(by, F.concat_ws("\n\n", F.lit(header.rstrip() + "\n"), *parts, F.lit(instruction.strip())).alias("prompt"))


def one_shot(cases: DataFrame, by: str, raw: DataFrame, header: str, instruction: str) -> DataFrame:
    """(by, prompt) of cases (by, query): up to 50 quads, objects of 120 and a query of 2,500 characters at most."""
    r = listed(raw.withColumn("object", F.substring("object", 1, 120)), by, _quad("subject", "relation", "object"), 50)
    x = cases.join(r, by, "left")
    body = F.concat(F.lit("Extracted primitives:\n"), F.coalesce("lines", F.lit("  (no primitives)")))
    return x.select(by, F.concat_ws("\n\n", F.lit(header), body, F.concat(F.lit("Query input:\n"), F.substring("query", 1, 2500)), F.lit(instruction)).alias("prompt"))


def answer(said: Column, kind: str) -> Column:
    """The answer in what a model said: ``json_array`` (as its text), ``json_string``, ``single_token`` or the first
    ``line``; null where there is none. Fences around it go."""
    text = F.trim(said)
    inner = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith("```")), "\n")
    text = F.trim(F.when(text.startswith("```"), inner).otherwise(text), F.lit(" \n\t\r"))
    if kind == "json_array":
        found = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
        return F.when(F.from_json(found, "array<string>").isNotNull(), found)
    if kind == "json_string":
        return F.when(F.regexp_like(text, F.lit('"[^"]*"')), F.regexp_extract(text, '"([^"]*)"', 1))
    if kind == "single_token":
        return F.when(text != "", F.regexp_extract(text, r"^(\S+)", 1))
    if kind == "line":
        return F.get(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), F.lit(0))
    raise ValueError(f"unknown kind of answer {kind}")
