"""Hop distances over the undirected reading of a graph."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.scratch import Scratch


def _neighbours(graph: Graph, scratch: Scratch) -> DataFrame:
    """(v, nbr), once each, without self-loops; written, as every level reads it."""
    return scratch.save(graph.symmetric().where("v <> nbr").select("v", "nbr").distinct(), "neighbours")


def bfs_levels(graph: Graph, source: int, max_levels: int = 1000) -> DataFrame:
    """(id, dist) of every vertex reachable from source; empty if source isn't a vertex."""
    scratch = Scratch(graph.spark, "bfs")
    start = graph.spark.range(source, source + 1).join(graph.ids(), "id", "left_semi").withColumn("dist", F.lit(0).cast("long"))
    around = _neighbours(graph, scratch)
    levels = [scratch.save(start, "level-0")]
    for level in range(1, max_levels + 1):
        # a new level's neighbours are in it, the level before and the one after only
        reached, before = levels[-1], levels[-2] if len(levels) > 1 else None
        ahead = around.join(reached.select(F.col("id").alias("v")), "v").select(F.col("nbr").alias("id")).distinct()
        ahead = ahead.join(reached.select("id"), "id", "left_anti")
        if before is not None:
            ahead = ahead.join(before.select("id"), "id", "left_anti")
        found = scratch.save(ahead.withColumn("dist", F.lit(level).cast("long")), f"level-{level}")
        if found.isEmpty():
            break
        levels.append(found)
    else:
        raise RuntimeError(f"more than {max_levels} levels")
    return graph.spark.read.schema(levels[0].schema).parquet(*(f"{scratch.path}/level-{k}" for k in range(len(levels))))


def shortest_distances(graph: Graph, pairs: Iterable[tuple[int, int]], max_levels: int = 1000, allow_partial: bool = False) -> DataFrame:
    """(src, dst, distance) for each pair; null without a path or if an end is no vertex.

    Both ends of all pairs grow balls in turn. When the rims of two balls first share a vertex, the sum of their radii is the
    pair's distance. A rim's neighbours are in the rim, the one before and the one after, so only rims are kept.
    Raises RuntimeError if a path could be longer than 2 * max_levels; with allow_partial such pairs are null.
    """
    pairs = sorted(set(pairs))
    spark, scratch = graph.spark, Scratch(graph.spark, "distance")
    asked = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, src long, dst long")
    ids = graph.ids()
    start = [scratch.save(asked.select("pair", F.col(end).alias("id")).join(ids, "id", "left_semi"), f"rim-{side}-0") for side, end in enumerate(("src", "dst"))]
    around = _neighbours(graph, scratch)
    found: dict[int, int] = {}

    def settled(new: DataFrame, other: DataFrame, length: int) -> list[int]:
        """Pairs that go on: both rims have vertices, and share none."""
        rows = new.join(other.withColumn("met", F.lit(True)), ["pair", "id"], "left").groupBy("pair").agg(F.bool_or("met").alias("met")).collect()  # a row per asked pair at most
        found.update({r["pair"]: length for r in rows if r["met"]})
        return [r["pair"] for r in rows if not r["met"]]

    going = settled(*start, 0)
    alive = {r["pair"] for r in start[1].select("pair").distinct().collect()}
    going = [k for k in going if k in alive]
    rims, before = start, [None, None]
    for step in range(max_levels * 2):
        if not going:
            break
        side, radius = step % 2, step // 2 + 1
        rim = rims[side].where(F.col("pair").isin(going))
        new = rim.join(around, rim.id == around.v).select("pair", F.col("nbr").alias("id")).distinct()
        for known in (rims[side], before[side]):
            if known is not None:
                new = new.join(known, ["pair", "id"], "left_anti")
        before[side], rims[side] = rims[side], scratch.save(new, f"rim-{side}-{radius}")
        scratch.drop(f"rim-{side}-{radius - 2}")
        going = settled(rims[side], rims[1 - side], step + 1)
    else:
        if going and not allow_partial:
            raise RuntimeError(f"{len(going)} pairs are further apart than {2 * max_levels} or have no path")
    rows = [(a, b, found.get(k)) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "src long, dst long, distance long")
