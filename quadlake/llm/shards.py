"""Operator 5: sharding by balanced label propagation. Law: ``rows`` (shard sizes differ by one row at most).

Documents are linked where their texts are equal (128-bit digest). All start in a shard by hash. Each round counts
every group's members by shard, and a linked document moves to the shard that holds more of its group than its own
does, among the shards that have room; where more want to enter than a shard's quota has room for, an equal share
of them by hash may. Rounds end when nothing moves, or after ROUNDS. Then quotas become exact: documents without
links, and linked ones beyond a quota, fill the shards up by rank, which cuts no edge of the others.

Ranks are made of counts by hash bucket and row numbers within a bucket, so no task sees a whole shard. Only the
number of rows by shard, a bounded figure, comes to the driver. All choices follow from a hash of doc_id and text, so
the result does not depend on how the rows are laid out in files or partitions; rows that repeat both are
interchangeable.

size: UTF-8 bytes of the text (null: none) plus one. Null texts and texts of their own are not linked. Rows that
repeat a doc_id are rows of their own. slot numbers the rows of a shard from 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.llm import runtime

SHARDS = 8
ROUNDS = 6
#: Rows in a bucket of a rank.
RANK_ROWS = 5_000
#: Linked documents may take this share of a quota while they move.
FILL = 0.98


def ranked(rows: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``rows`` with their gapless rank from 0 within ``key``, by buckets of the column ``hash``."""
    buckets = max(1, n // RANK_ROWS)
    rows = rows.withColumn("__bucket", F.pmod("hash", F.lit(buckets)))
    counts = rows.groupBy(key, "__bucket").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "__bucket", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(key, "__bucket").orderBy("hash", "row")
    rows = rows.withColumn("__rn", F.row_number().over(within))
    counts = F.broadcast(counts) if buckets * SHARDS <= runtime.BROADCAST_ROWS else counts
    return rows.join(counts, [key, "__bucket"]).withColumn(name, (F.col("__before") + F.col("__rn") - 1).cast("long")).drop("__bucket", "__before", "__rn")


def _by_shard(rows: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in rows.groupBy("shard").count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(linked: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Moves the rows (row, hash, text_key, shard) towards their groups' shards; the loads stay near the quotas."""
    shards = len(quota)
    for turn in range(rounds):
        room = [max(0.0, FILL * q - x) for q, x in zip(quota, _by_shard(linked, shards), strict=True)]
        votes = linked.groupBy("text_key").pivot("shard", list(range(shards))).count().fillna(0)
        tally = F.array(*[F.struct((F.col(str(s)) if room[s] > 0 else F.lit(-1).cast("long")).alias("c"), F.lit(-s).alias("s")) for s in range(shards)])
        votes = votes.select("text_key", F.array_max(tally).alias("best"), F.array(*[F.col(str(s)) for s in range(shards)]).alias("held"))
        wish = linked.join(votes, "text_key")
        better = F.col("best.c") > F.get("held", F.col("shard"))
        better |= (F.col("best.c") == F.get("held", F.col("shard"))) & (-F.col("best.s") < F.col("shard"))
        wish = runtime.cut(wish.select("row", "hash", "text_key", "shard", F.when(better, -F.col("best.s")).otherwise(F.col("shard")).alias("to")))
        wanted = {r[0]: r[1] for r in wish.where("shard <> to").groupBy("to").count().collect()}
        if not wanted:
            break
        share = F.array(*[F.lit(min(1.0, room[s] / wanted[s]) if s in wanted else 0.0) for s in range(shards)])
        luck = F.pmod(F.xxhash64("hash", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moves = (F.col("to") != F.col("shard")) & (luck < F.get(share, F.col("to")))
        linked = runtime.cut(wish.select("row", "hash", "text_key", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")))
        if all(room[s] <= 0 for s in wanted):
            break
    return linked


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row."""
    raw = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit("").cast("binary"))).alias("text_crc32"),
        F.unhex(F.md5(raw)).alias("text_key"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = runtime.cut(rows)
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    groups = rows.where("text_key is not null").groupBy("text_key").count().where("count > 1").select("text_key")
    groups = runtime.cut(groups)
    linked = rows.join(runtime.small(groups, groups.count()), "text_key").select("row", "hash", "text_key", F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int").alias("shard"))
    linked = propagate(runtime.cut(linked), quota)

    placed = runtime.cut(ranked(linked.select("row", "hash", "shard"), "shard", max(1, n // shards), "rank"))
    limit = F.array(*[F.lit(q) for q in quota])
    stays = placed.where(F.col("rank") < F.get(limit, F.col("shard"))).select("row", F.col("shard").alias("kept"))
    need = [q - x for q, x in zip(quota, _by_shard(stays.withColumnRenamed("kept", "shard"), shards), strict=True)]
    both = runtime.cut(rows.join(stays, "row", "left"))
    pool = both.where("kept is null").select("row", "hash", F.lit(0).alias("all"))
    pool = ranked(pool, "all", n, "rank")
    shard, end = F.lit(None).cast("int"), 0
    for s in range(shards):
        shard = F.when((F.col("rank") >= end) & (F.col("rank") < end + need[s]), F.lit(s)).otherwise(shard)
        end += need[s]
    pool = pool.select("row", shard.alias("filled"))
    done = both.join(pool, "row", "left").withColumn("shard", F.coalesce("kept", "filled")).drop("kept", "filled", "text_key")
    return ranked(runtime.cut(done), "shard", max(1, n // shards), "slot").drop("row", "hash")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
