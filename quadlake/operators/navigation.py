"""Navigation over call edges (source, target), for many start nodes at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlake.functions.session import cut


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, source, target): edges that leave a node within ``hops`` - 1 steps of each seed (column seed)."""
    edges = cut(edges.select("source", "target").distinct())
    seen = seeds.select("seed", F.col("seed").alias("node")).distinct()
    edge, out = seen, None
    for _ in range(hops):
        step = cut(edge.join(edges, edge["node"] == edges["source"]).select("seed", "source", "target"))
        out = step if out is None else out.unionByName(step)
        near = step.select("seed", F.col("target").alias("node")).distinct()
        edge = cut(near.join(seen, ["seed", "node"], "left_anti"))
        seen = seen.unionByName(edge)
    return out.distinct()


def chains(seed: str, onward: dict[str, list[str]], depth: int, limit: int) -> list[list[str]]:
    """At most ``limit`` paths without a repeated node, last target first; an edge is walked once for all paths.

    A path ends where nothing new follows it or once it has ``depth`` + 1 nodes; a lone seed is no path."""
    out: list[list[str]] = []
    walked: set[tuple[str, str]] = set()
    pending = [[seed]]
    while pending and len(out) < limit:
        way = pending.pop()
        fresh: list[str] = []
        if len(way) <= depth:
            fresh = [t for t in onward.get(way[-1], ()) if t not in way and (way[-1], t) not in walked]
        walked.update((way[-1], t) for t in fresh)
        pending += [[*way, t] for t in fresh]
        if not fresh and len(way) > 1:
            out.append(way)
    return out


def call_chains(edges: DataFrame, seeds: DataFrame, depth: int = 3, limit: int = 6, reverse: bool = False) -> DataFrame:
    """(seed, pos, chain): the call chains of each seed (column seed); ``limit`` is a feature of the report.

    Only the edges within ``depth`` steps of a seed reach the task that walks it. Targets of a node are in order of
    their names; a seed without edges has no row."""
    if reverse:
        edges = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        seed = part["seed"].iat[0]
        onward = {n: sorted(g) for n, g in part.groupby("source")["target"]}
        ways = chains(seed, onward, depth, limit)
        return pd.DataFrame({"seed": seed, "pos": range(len(ways)), "chain": [" -> ".join(w) for w in ways]}, columns=["seed", "pos", "chain"])

    return reach(edges, seeds, depth).groupBy("seed").applyInPandas(walk, "seed string, pos long, chain string")


def ego(edges: DataFrame, listed: int = 6) -> DataFrame:
    """(node, n_callers, n_callees, callees): both sides of every node that has an edge; the first ``listed`` callees by name."""
    e = edges.select("source", "target").distinct()
    out = e.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n_callees"), F.array_sort(F.collect_set("target")).alias("c"))
    into = e.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n_callers"))
    zero = F.lit(0).cast("long")
    return out.join(into, "node", "full").select("node", F.coalesce("n_callers", zero).alias("n_callers"), F.coalesce("n_callees", zero).alias("n_callees"), F.coalesce(F.array_join(F.slice("c", 1, listed), ","), F.lit("")).alias("callees"))
