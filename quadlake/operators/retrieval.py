"""Functions found by what describes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a shared word counts in the name, the docstring and the snippet of a function.
WEIGHTS = {"name": 3, "docstring": 2, "snippet": 1}


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def scores(requests: DataFrame, functions: DataFrame) -> DataFrame:
    """(request, repo, path, line, name, score) of requests (request, repo, description): words are the keys of the join,
    so only functions that share one are looked at."""
    asked = requests.select("request", "repo", F.explode(words(F.col("description"))).alias("word"))
    each = [functions.select("repo", "path", "line", "name", F.explode(words(F.col(c))).alias("word"), F.lit(w).alias("weight")) for c, w in WEIGHTS.items()]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).groupBy("repo", "path", "line", "name", "word").agg(F.sum("weight").alias("weight"))
    return asked.join(rows, ["repo", "word"]).groupBy("request", "repo", "path", "line", "name").agg(F.sum("weight").cast("long").alias("score"))


def best(requests: DataFrame, functions: DataFrame, k: int = 12) -> DataFrame:
    """The ``k`` best functions of each request, by score, path and line; Spark keeps ``k`` of each task before it sorts."""
    order = Window.partitionBy("request").orderBy(F.desc("score"), "path", "line")
    return scores(requests, functions).withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= k)
