"""Graph algorithms over edge tables (source, target)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.functions.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b")))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node that can be reached, directions ignored; isolated ``nodes`` stay alone.

    Least labels spread over the edges and are shortened by pointer jumping, so rounds grow with the logarithm of
    the longest path."""
    both = cut(_both(edges).distinct())
    label = both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    if nodes is not None:
        label = label.unionByName(nodes.select("node", F.col("node").alias("label"))).distinct()
    label = cut(label)
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["a"], "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = step.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        after = cut(step.join(jump, step["label"] == jump["n2"], "left").select("node", "was", F.least("label", F.coalesce("l2", "label")).alias("label")))
        label = after.select("node", "label")
        if after.where("label <> was").isEmpty():
            return label.select("node", F.col("label").alias("component"))


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): layer 0 depends on nothing; a node that is on or behind a cycle has the last layer.

    ``source`` depends on ``target``. Each round takes the nodes whose targets are all placed."""
    edges = cut(edges.where("source <> target").distinct())
    left = cut(edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct())
    placed, at = None, 0
    while True:
        open_edges = edges.join(left.withColumnRenamed("node", "target"), "target", "left_semi")
        ready = left.join(open_edges.select(F.col("source").alias("node")), "node", "left_anti")
        ready = cut(ready)
        if ready.isEmpty():
            break
        part = ready.withColumn("layer", F.lit(at).cast("long"))
        placed = part if placed is None else placed.unionByName(part)
        left, at = cut(left.join(ready, "node", "left_anti")), at + 1
    rest = left.withColumn("layer", F.lit(at).cast("long"))
    return rest if placed is None else placed.unionByName(rest)


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes within ``hops`` undirected steps of the seeds (node), with the least number of steps."""
    both = _both(edges).distinct()
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0).cast("long"))
    edge = seen
    for h in range(1, hops + 1):
        near = both.join(edge.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        edge = cut(near.join(seen, "node", "left_anti").withColumn("hop", F.lit(h).cast("long")))
        seen = seen.unionByName(edge)
    return seen


def stats(edges: DataFrame, strong: float = 0.7, clear: float = 0.3) -> DataFrame:
    """One row of figures on the edges (source, target, confidence): files, edges, strong edges, whether strong edges form
    a cycle, components, and pairs of files without an edge of ``clear`` confidence (counted, not listed)."""
    edges = cut(edges)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    e = edges.where(F.col("confidence") > strong).select("source", "target")
    at = layers(e)
    inside = e.join(at.select(F.col("node").alias("source"), F.col("layer").alias("ls")), "source").join(at.select(F.col("node").alias("target"), F.col("layer").alias("lt")), "target").where("ls = lt")
    parts = connected_components(edges.select("source", "target"), nodes)
    sure = edges.where((F.col("confidence") >= clear) & (F.col("source") != F.col("target"))).select(F.least("source", "target"), F.greatest("source", "target")).distinct()
    n = nodes.count()
    return edges.agg(
        F.lit(n).cast("long").alias("n_files"),
        F.count("*").alias("n_edges"),
        F.count_if(F.col("confidence") > strong).alias("n_strong"),
        F.lit(not inside.isEmpty()).alias("has_cycle"),
        F.lit(parts.select("component").distinct().count()).cast("long").alias("n_components"),
        F.lit(n * (n - 1) // 2 - sure.count()).cast("long").alias("n_ambiguous_pairs"),
    )
