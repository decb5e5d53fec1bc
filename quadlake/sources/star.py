"""Quads, definitions and calls read off the relational test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, relation, object, condition) of the star schema."""
    def part(name: str, subject: Column, relation: str, obj: Column, condition: Column | None = None) -> DataFrame:
        return table(spark, sf_dir, name).select(subject.alias("subject"), F.lit(relation).alias("relation"), obj.alias("object"), F.coalesce(condition if condition is not None else F.lit(""), F.lit("")).alias("condition"))

    out = part("nation", _id("nation", "n_nationkey"), "located_in", _id("region", "n_regionkey"))
    out = out.unionByName(part("customer", _id("customer", "c_custkey"), "lives_in", _id("nation", "c_nationkey")))
    out = out.unionByName(part("supplier", _id("supplier", "s_suppkey"), "based_in", _id("nation", "s_nationkey")))
    return out.unionByName(part("orders", _id("order", "o_orderkey"), "placed_by", _id("customer", "o_custkey"), F.col("o_orderstatus")))


QUADS = """q AS (
  SELECT 'nation:' || n_nationkey AS subject, 'located_in' AS relation, 'region:' || n_regionkey AS object, '' AS condition FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'lives_in', 'nation:' || c_nationkey, '' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'based_in', 'nation:' || s_nationkey, '' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'placed_by', 'customer:' || o_custkey, o_orderstatus FROM orders)"""


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qual, file, name, key): every part is a definition in the file of its brand."""
    return table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("::part."), F.col("p_partkey").cast("string")).alias("qual"), F.col("p_brand").alias("file"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.col("p_partkey").alias("key"))


DEFS = """d AS (SELECT p_brand || '::part.' || p_partkey AS qual, p_brand AS file, replace(p_name, ' ', '_') AS name, p_partkey AS key FROM part)"""

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(caller, callee, line, condition): consecutive lines of an order; returned ones are unresolved."""
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*_ORDER))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), after.alias("callee"), F.col("l_linenumber").cast("long").alias("line"), F.when(F.col("l_returnflag") == "R", "unresolved").otherwise("resolved").alias("condition"))
    return rows.where("callee is not null")


CALLS = f"""c AS (SELECT * FROM (
  SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS callee, CAST(l_linenumber AS BIGINT) AS line,
    CASE WHEN l_returnflag = 'R' THEN 'unresolved' ELSE 'resolved' END AS condition FROM lineitem) WHERE callee IS NOT NULL)"""
