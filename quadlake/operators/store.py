"""The store of shards: its index, the shard a batch belongs into, its files, and questions across shards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadlake.functions.session import cut

#: Entities that a shard's numbers can name; a shard stays below it.
CAPACITY, DENSITY = 256, 0.3


def index(quads: DataFrame) -> DataFrame:
    """(entity, shard): the shards that hold an entity, as rows."""
    return quads.select(F.explode(F.array("subject", "object")).alias("entity"), "shard").distinct()


def sizes(quads: DataFrame) -> DataFrame:
    """(shard, n_entities, density): density is the share of filled cells."""
    n = index(quads).groupBy("shard").agg(F.count("*").alias("n_entities"))
    cells = quads.select("shard", "subject", "object").distinct().groupBy("shard").agg(F.count("*").alias("cells"))
    return n.join(cells, "shard").select("shard", "n_entities", (F.col("cells") / (F.col("n_entities") * F.col("n_entities"))).alias("density"))


def best_shards(batches: DataFrame, shards: DataFrame, held: DataFrame, capacity: int = CAPACITY, target: float = DENSITY) -> DataFrame:
    """(batch, shard) of batches (batch, entity): of the shards with room and below the target density, the one that
    holds most of the batch's entities, then most entities, then the first by name; null where a new one is needed.

    Of a batch's entities, the one that most shards hold is looked up by itself: among its holders only the fullest with
    room counts, so one row for each such entity and size of batch. A shard that holds another entity of the batch too
    weighs more, and is found through that one, as are all shards that hold it. For the rest the size of the batch
    decides, so sizes are matched with counts of entities, both below ``capacity``, which may be 1,000 at most."""
    if capacity > 1000:
        raise ValueError("a shared entity must weigh more than a full shard: capacity is 1,000 at most")
    free = shards.where(F.col("density") < target).where(F.col("n_entities") < capacity).select("shard", "n_entities")
    rows = cut(free.join(held.select("entity", "shard"), "shard", "left"))  # read in all that follows
    free, held = rows.select("shard", "n_entities").distinct(), rows.where("entity is not null")
    n = held.groupBy("entity").agg(F.count("*").alias("holders"))
    batch = Window.partitionBy("batch")
    common = batch.orderBy(F.desc("holders"), "entity")
    each = batches.select("batch", "entity").distinct().join(n, "entity", "left").select("batch", "entity", "holders", F.count("*").over(batch).alias("size"), F.row_number().over(common).alias("k"), F.first("entity").over(common).alias("common"))
    weight = lambda overlap: F.struct((-(overlap * 1000 + F.col("n_entities"))).alias("weight"), "shard")
    fits = lambda overlap: F.col("n_entities") + F.col("size") - overlap < capacity

    one = each.where("k = 1").select("batch", "common", "size")
    fullest = held.groupBy(F.col("entity").alias("common"), "n_entities").agg(F.min("shard").alias("shard"))
    by_common = one.select("common", "size").distinct().join(fullest, "common").where(fits(F.lit(1))).groupBy("common", "size").agg(F.min(weight(F.lit(1))).alias("by_common"))
    rest = each.where("k > 1 and holders is not null").join(held, "entity").groupBy("batch", "common", "size", "shard", "n_entities").agg(F.count("*").alias("n"))
    rest = rest.join(held.select(F.col("entity").alias("common"), "shard", F.lit(1).alias("too")), ["common", "shard"], "left")
    overlap = F.col("n") + F.coalesce("too", F.lit(0))
    by_rest = rest.where(fits(overlap)).select("batch", "common", "size", weight(overlap).alias("by_rest"))
    # a union and no join: a join's filter on batch would have all that leads to each batch's entities read twice
    found = one.unionByName(by_rest, allowMissingColumns=True).groupBy("batch", "common", "size").agg(F.min("by_rest").alias("by_rest"))

    sized = free.groupBy("n_entities").agg(F.min("shard").alias("shard"))  # below `capacity` rows, as the sizes are
    room = one.select("size").distinct().where(F.col("size") < capacity).join(F.broadcast(sized), fits(F.lit(0)))
    room = room.groupBy("size").agg(F.min_by("shard", F.struct(-F.col("n_entities"), "shard")).alias("other"))
    out = found.join(by_common, ["common", "size"], "left").join(F.broadcast(room), "size", "left")
    return out.select("batch", F.coalesce(F.least("by_common", "by_rest")["shard"], F.col("other")).alias("shard"))


def fold(batches: list[list[tuple[str, str]]], capacity: int = CAPACITY, target: float = DENSITY) -> list[int]:
    """The shard of each batch of pairs (subject, object) put in one after the other; an empty one goes to the last."""
    names: list[set[str]] = []
    cells: list[set[tuple[str, str]]] = []
    out = []
    for pairs in batches:
        asked = {e for pair in pairs for e in pair}
        place, best = (len(names) - 1, 0) if not pairs and names else (-1, -1)
        for i, own in enumerate(names) if pairs else ():
            overlap = len(asked & own)
            if len(own) + len(asked) - overlap < capacity and len(cells[i]) < target * max(1, len(own)) ** 2 and overlap * 1000 + len(own) > best:
                place, best = i, overlap * 1000 + len(own)
        if place < 0:
            place = len(names)
            names.append(set())
            cells.append(set())
        names[place] |= asked
        cells[place].update(pairs)
        out.append(place)
    return out


def encode(quads: DataFrame, capacity: int = CAPACITY, target: float = DENSITY) -> DataFrame:
    """(store, batch, shard) of quads (store, batch, subject, object): shards numbered from 0 in order of the batches.

    Each batch is placed by what the earlier ones left, so a store is one task, over distinct pairs only."""
    rows = quads.select("store", "batch", "subject", "object").distinct()

    def one(x: pd.DataFrame) -> pd.DataFrame:
        by = [(b, list(g.itertuples(index=False, name=None))) for b, g in x.sort_values(["batch", "subject", "object"]).groupby("batch")[["subject", "object"]]]
        return pd.DataFrame({"store": x["store"].iloc[0], "batch": [b for b, _ in by], "shard": fold([g for _, g in by], capacity, target)})

    return rows.groupBy("store").applyInPandas(one, "store string, batch long, shard long")


def save(quads: DataFrame, place: str) -> None:
    """Quads by shard as Parquet and a manifest (shard, n_entities, n_quads) as JSON, below ``place``."""
    quads.repartition("shard").write.partitionBy("shard").parquet(f"{place}/shards")
    n = quads.groupBy("shard").agg(F.count("*").alias("n_quads"))
    sizes(quads).join(n, "shard").select("shard", "n_entities", "n_quads").write.json(f"{place}/manifest")


def load(spark: SparkSession, place: str) -> tuple[DataFrame, DataFrame]:
    """(quads, manifest) of :func:`save`."""
    quads = "subject string, relation string, object string, condition string, shard string"
    return spark.read.schema(quads).parquet(f"{place}/shards"), spark.read.schema("shard string, n_entities long, n_quads long").json(f"{place}/manifest")


def ask(quads: DataFrame, scores: DataFrame, names: list[str], max_shards: int = 3, hops: int = 1) -> DataFrame:
    """Quads around ``names`` in the best shards of ``scores`` (shard, score), in ``hops`` steps within each shard; with
    more than one, also a step from all that was found into the first other shards that hold any of it."""
    columns = ("shard", "subject", "relation", "object")
    chosen = cut(scores.orderBy(F.desc("score"), "shard").limit(max_shards).select("shard"))
    base = quads.join(F.broadcast(chosen), "shard", "left_semi")
    found = base.where(F.col("subject").isin(names) | F.col("object").isin(names)).select(*columns).distinct()
    touching = lambda rows, ends: rows.join(ends.withColumnRenamed("entity", "subject"), ["shard", "subject"], "left_semi").select(*columns).unionByName(rows.join(ends.withColumnRenamed("entity", "object"), ["shard", "object"], "left_semi").select(*columns)).distinct()
    for _ in range(hops - 1):
        found = touching(base, index(cut(found)))
    if hops < 2:
        return found
    found = cut(found)
    names_found = found.select(F.explode(F.array("subject", "object")).alias("entity")).distinct()
    more = index(quads).join(names_found, "entity", "left_semi").join(F.broadcast(chosen), "shard", "left_anti").select("shard").distinct().orderBy("shard").limit(max_shards)
    other = quads.join(F.broadcast(more), "shard", "left_semi")
    return found.unionByName(touching(other, index(other).join(names_found, "entity", "left_semi"))).distinct()
