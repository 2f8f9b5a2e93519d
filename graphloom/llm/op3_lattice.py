"""Near-duplicate vectors by lattice hashing: random projections decoded to points of the E8 lattice.

A table projects unit vectors to BLOCKS * 8 dimensions and decodes each eight to the nearest point of E8, the densest
packing there. The cell is a key; so are the PROBES cells next nearest to the projection, found by the
residual's product with the 240 shortest lattice vectors. Vectors that share a key in any table are compared by cosine
in double precision.

Equal vectors are first merged into classes, by 128 bits of hashes, and only a class's first row goes on, with the class's size as
its weight; so copies never meet, however many there are. A key's vectors are compared in tiles of at most about TILE rows,
and only a spanning forest of the links found leaves a tile pair, so what is emitted grows with the classes, not with
their pairs, and no key is gathered in one task. Components are those of the forests' union. Links are then counted exactly
inside each component, again tile by tile and by weight, which also finds links that no table had.

Defined results: vectors that are null, zero or hold null or non-finite components have no link and are
their own component; vectors of different lengths are not comparable and don't link; rows with equal vec_id
are separate vectors; a null vec_id is never a component's smallest id; a vector whose component has null ids only has a
null component_id and isn't kept; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table
from graphloom.llm.vectors import groups, matrix, numbered, tile_pairs, unit
from graphloom.operators.components import component_labels
from graphloom.scratch import Scratch

COSINE = 0.95
TABLES = 6
BLOCKS = 2
#: Mean size of a unit vector's projection to one dimension; lattice points are 2 ** 0.5 apart at least. With 6 tables and 7 probes,
#: 98.8 % of pairs at cosine 0.95, 99.7 % at 0.96 and all at 0.975 share a key (3,000 random pairs of 64 dimensions each).
SCALE = 0.8
PROBES = 7
SEED = 3
TILE = 2048


@functools.cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minuses."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum: round, and if the sum is odd the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(1)
    rows = np.flatnonzero(near.sum(1) % 2 != 0)
    at = worst[rows]
    near[rows, at] += np.where(off[rows, at] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row: of the even points, or of those moved by one half."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


@functools.cache
def _projection(number: int, dimension: int) -> np.ndarray:
    return np.random.default_rng([SEED, number, dimension]).standard_normal((dimension, 8 * BLOCKS)) * SCALE


def _keys_of(cells: np.ndarray, number: int, dimension: int) -> np.ndarray:
    out = np.full(len(cells), number * 1_000_003 + dimension + 1, np.uint64)
    for column in np.rint(cells * 2).astype(np.int64).view(np.uint64).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def keys(vectors: np.ndarray) -> np.ndarray:
    """(rows, TABLES * (1 + PROBES)) keys of unit vectors: own cell and neighbouring cells of each table."""
    out = []
    r = roots()
    for number in range(TABLES):
        x = vectors @ _projection(number, vectors.shape[1])
        blocks = [x[:, 8 * b : 8 * b + 8] for b in range(BLOCKS)]
        own = [decode_e8(b) for b in blocks]
        cell = np.concatenate(own, 1)
        out.append(_keys_of(cell, number, vectors.shape[1]))
        # a step by root v in one block brings the cell's centre nearer the more the residual points along v
        gain = np.concatenate([(b - c) @ r.T for b, c in zip(blocks, own)], 1)
        best = np.argsort(-gain, 1, kind="stable")[:, :PROBES]
        for k in range(PROBES):
            moved = cell.copy()
            block, root = np.divmod(best[:, k], len(r))
            for b in range(BLOCKS):
                rows = np.flatnonzero(block == b)
                moved[rows, 8 * b : 8 * b + 8] += r[root[rows]]
            out.append(_keys_of(moved, number, vectors.shape[1]))
    return np.stack(out, 1)


def _emit_keys(vectors: DataFrame) -> DataFrame:
    """(key, row) of every usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for places, values in matrix(batch.column(1)):
                for begin in range(0, len(places), 4096):
                    found = np.sort(keys(unit(values[begin : begin + 4096])), 1)
                    own = np.repeat(rows[places[begin : begin + 4096]], found.shape[1])
                    once = np.ones(found.shape, bool)
                    once[:, 1:] = found[:, 1:] != found[:, :-1]
                    yield pa.RecordBatch.from_arrays([pa.array(found[once]), pa.array(own[once.reshape(-1)])], names=["key", "row"])

    return vectors.select("row", "v").mapInArrow(run, "key long, row long")


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left = np.ones(len(adjacent), bool)
    out: list[tuple[int, int]] = []
    for begin in range(len(adjacent)):
        if not left[begin]:
            continue
        left[begin] = False
        waiting = [begin]
        while waiting:
            x = waiting.pop()
            new = np.flatnonzero(adjacent[x] & left)
            left[new] = False
            out.extend((x, y) for y in new.tolist())
            waiting.extend(new.tolist())
    return out


def _tiled(members: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, a, b, left, row, v, weight): members (key, row) of keys with at least two, dealt out by pairs of tiles."""
    sizes = members.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    met = members.join(sizes, key).select(key, "row", F.explode(tile_pairs(F.col("row"), F.ceil(F.col("n") / TILE))).alias("t"))
    dealt = met.select(F.col(key).alias("key"), "t.a", "t.b", "t.left", "row").join(vectors, "row")
    return dealt.select("key", "a", "b", "left", "row", "v", "weight").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")


def _vectors(group: pa.Table) -> np.ndarray:
    found = matrix(group.column("v").combine_chunks())
    return unit(found[0][1])  # of one length, as keys and components are


def links(vectors: DataFrame, emitted: DataFrame, cosine: float) -> DataFrame:
    """(src, dst) rows: spanning forests of the links among vectors that share a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, group in groups(batches, 3):
            rows, v = group.column("row").to_numpy(), _vectors(group)
            out.extend((rows[a], rows[b]) for a, b in forest(v @ v.T >= cosine))
            if len(out) >= 1 << 14:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return _tiled(emitted, vectors, "key").mapInArrow(run, "src long, dst long").distinct()


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["src", "dst"])


def count_links(vectors: DataFrame, labels: DataFrame, cosine: float) -> DataFrame:
    """(row, near): for each class in a component of at least two, the weight of those in it at that cosine, its own included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), group in groups(batches, 3):
            rows, left, weight, v = *(group.column(c).to_numpy() for c in ("row", "left", "weight")), _vectors(group)
            if a == b:
                near = v @ v.T >= cosine
                np.fill_diagonal(near, True)
                counts = near @ weight
            else:
                near = v[left] @ v[~left].T >= cosine
                counts = np.zeros(len(rows), np.int64)
                counts[left], counts[~left] = near @ weight[~left], near.T @ weight[left]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(counts.astype(np.int64))], names=["row", "n"])

    members = labels.select(F.col("label").alias("key"), F.col("id").alias("row"))
    return _tiled(members, vectors, "key").mapInArrow(run, "row long, n long").groupBy("row").agg(F.sum("n").alias("near"))


def near_vectors(table_: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    scratch = Scratch(table_.sparkSession, "lattice")
    rows = numbered(table_, scratch, id_col, vector_col)
    part = rows.where("v is not null").where(F.exists("v", lambda x: x != 0))
    hashed = scratch.save(part.select("row", *(F.xxhash64(F.lit(k), "v").alias(f"h{k}") for k in range(2))), "hashes")
    classes = scratch.save(hashed.groupBy("h0", "h1").agg(F.min("row").alias("first"), F.count("*").alias("weight")), "classes")
    vectors = scratch.save(part.select("row", "v").join(classes.select(F.col("first").alias("row"), "weight"), "row"), "vectors")
    emitted = scratch.save(_emit_keys(vectors), "keys")
    found = scratch.save(links(vectors, emitted, cosine), "links")
    scratch.drop("keys")
    labels = scratch.save(component_labels(found, "src", "dst", Scratch(table_.sparkSession, "lattice-components")), "labels")
    counts = scratch.save(count_links(vectors, labels, cosine), "counts")
    scratch.drop("links", "vectors")
    of_class = classes.join(labels, F.col("first") == F.col("id"), "left").join(counts, F.col("first") == counts.row, "left")
    of_class = of_class.select("h0", "h1", F.coalesce("label", "first").alias("label"), (F.coalesce("near", "weight") - 1).alias("n_links"))
    linked = rows.select("row", "vec_id").join(hashed.join(of_class, ["h0", "h1"]), "row", "left")
    named = scratch.save(linked.select("vec_id", F.coalesce("label", "row").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "named")
    scratch.drop("hashes", "classes", "labels", "counts", "numbered")
    smallest = scratch.save(named.groupBy("label").agg(F.min("vec_id").alias("component_id")), "smallest")
    return named.join(smallest, "label").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_lattice": op3_lattice}
ORACLE = {
    "op3_lattice": f"""WITH RECURSIVE numbered AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 part AS MATERIALIZED (
   SELECT n, v FROM numbered
   WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 link AS MATERIALIZED (
   SELECT a.n AS a, b.n AS b FROM part a JOIN part b ON a.n <> b.n
   WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= {COSINE} ELSE false END),
 reach(id, label) USING KEY (id) AS (
   SELECT n, n FROM numbered
   UNION
   SELECT link.b, min(reach.label) FROM reach JOIN link ON link.a = reach.id JOIN recurring.reach r ON r.id = link.b WHERE reach.label < r.label GROUP BY link.b),
 degree AS (SELECT a, count(*) AS n FROM link GROUP BY a),
 named AS (SELECT vec_id, id, min(vec_id) OVER (PARTITION BY label) AS component_id FROM reach JOIN numbered ON n = id)
 SELECT vec_id, coalesce(degree.n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
 FROM named LEFT JOIN degree ON degree.a = named.id"""
}
