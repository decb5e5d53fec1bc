"""Session helpers: the shared folder, lineage cuts, size-checked broadcasts and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many rows (of a few longs each).
BROADCAST_ROWS = 500_000


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough for two Python workers beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, but only in local mode, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="quadlake-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: survives lost executors, ends its lineage.

    What :func:`drop` does not delete goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadlake/{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadlake_path = path
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote, once nothing lazy refers to it."""
    place, system = _place(df.sparkSession, df._quadlake_path)
    system.delete(place, True)


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores after it until no column of ``taken`` is called so."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Marks ``df`` for broadcast if its counted ``rows`` are under the limit; a shuffle join otherwise."""
    return F.broadcast(df) if rows <= limit else df


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected edges (a, b): label is the smallest node it reaches.

    Alternating large-star and small-star rounds: every round is a groupBy-min and an equi-join, whose hot keys
    adaptive execution can split; the edge table never grows, and each round is written to the shared folder."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(e)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        after = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(after.unionByName(least.withColumnRenamed("m", "b")).distinct())
        drop(large)
        was, mark = mark, _mark(after)
        drop(now)
        now = after
        if was == mark:
            break
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label"))).distinct()
