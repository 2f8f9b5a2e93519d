"""Connected components by alternating large-star and small-star contraction.

Kiveris et al., "Connected Components in MapReduce and Beyond", SoCC 2014. Every round replaces the
edge set by one whose components are flatter, until each component is a star around its smallest id;
the number of rounds grows with the logarithm of the size, not with the diameter. Before the first round, every task replaces the edges
it has, LOCAL at a time, by stars of their own components, which leaves fewer edges and rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import Scratch

#: Below this many edges a vertex's neighbours are held in one row. From it on, the minima are written and joined back, and
#: both sides of the join are exchanges that adaptive execution can split when one vertex holds most of the edges.
SPLIT_FROM = 1_000_000
#: Edges that a task holds and contracts at a time; 0 for none.
LOCAL = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its component) of the ids of these edges, but for the smallest ids themselves."""
    ids, places = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    label = np.arange(len(ids))
    while len(a):
        one, other = label[a], label[b]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    far = np.flatnonzero(label != np.arange(len(ids)))
    return ids[far], ids[label[far]]


def _contracted(edges: DataFrame, local: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= local:
                yield from emit(held)
                held, n = [], 0
        if held:
            yield from emit(held)

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = stars(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long") if local else edges


def _star(pairs: DataFrame, scratch: Scratch, split: bool) -> DataFrame:
    """pairs (u, v) with m, the smallest id among u and what it is paired with."""
    if not split:  # one exchange; no u has more than SPLIT_FROM ids
        around = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.collect_set("v").alias("vs"))
        return around.select("u", F.explode("vs").alias("v"), "m")
    mins = scratch.save(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "minima")
    return pairs.join(mins, "u")


def _large_star(edges: DataFrame, scratch: Scratch, split: bool) -> DataFrame:
    """Every larger neighbour of u points at the smallest id around u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    pointed = _star(both, scratch, split).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pointed.distinct() if split else pointed


def _small_star(edges: DataFrame, scratch: Scratch, split: bool) -> DataFrame:
    """u and its smaller neighbours point at the smallest of them; edges run from large to small."""
    starred = _star(edges, scratch, split)
    pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
    return starred.select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u <> v").distinct()


def _marks() -> dict[str, Column]:
    """Number and contents of an edge set."""
    return {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v"))}


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst", scratch: Scratch | None = None, max_rounds: int = 100) -> DataFrame:
    """(id, label) for every id that has an edge to another id; label is the smallest id reachable.

    Edges are read as undirected; self-loops, duplicates and edges with a null end add nothing.
    Ids without edges are absent: the caller joins from its vertices and keeps their own id.
    Raises RuntimeError if max_rounds are not enough.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    whole = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    whole = whole.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.save(_contracted(whole, LOCAL), "edges-0")
    seen = now.agg(*(x.alias(k) for k, x in _marks().items())).first().asDict()
    for k in range(1, max_rounds + 1):
        if seen["n"] == 0:
            break
        split = seen["n"] >= SPLIT_FROM
        large = scratch.save(_large_star(now, scratch, split), f"large-{k}") if split else _large_star(now, scratch, split)
        after, mark = scratch.save_observed(_small_star(large, scratch, split), f"edges-{k}", **_marks())
        scratch.drop(f"edges-{k - 1}", f"large-{k}", "minima")
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = now.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(own)
