"""A corpus pipeline of five stages over ``documents``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.

quality    rows scored below the threshold by the rule ensemble go
lines      lines in later occurrences of repeated three-line windows go; n_chars follows the text
near_dups  of each group of near duplicates one row stays, by the least doc_id (null last) and among its rows any one
benchmark  rows that hold a window of ten words of a benchmark item go
encode     (doc_id, n_tokens, ids): byte-level BPE ids, as little-endian 32-bit integers
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadlake.llm import bpe, decontaminate, jaccard_join, line_dedup, quality, runtime


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate_lines(docs)
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = runtime.fresh(docs.columns, "__row")
    rows = runtime.cut(docs.withColumn(row, F.monotonically_increasing_id()))
    found = jaccard_join.jaccard_components(rows, row).where("n_shingles > 0").select(F.col("doc_id").alias("r"), "component_id")
    found = runtime.cut(rows.select(F.col(row).alias("r"), "doc_id").join(found, "r"))
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r")).alias("first")).select("first.r")
    gone = runtime.cut(found.select("r").join(kept, "r", "left_anti"))
    return rows.join(runtime.small(gone.withColumnRenamed("r", row), gone.count()), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.encode(docs)
    return ids.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", _quality), ("lines", _lines), ("near_dups", _near_dups), ("benchmark", _benchmark), ("encode", _encode)]

#: Fitted rules and BPE are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = runtime.cut(docs)
            if i:  # what the stage before wrote is needed no more
                runtime.drop(before)
    return docs
