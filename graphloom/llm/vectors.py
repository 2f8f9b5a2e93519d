"""Vectors as rows of numpy matrices, and groups of rows that come sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import Scratch


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def numbered(table: DataFrame, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, vec_id, v): rows numbered and written once, so that the numbers hold; v is null where it isn't usable, else of doubles.

    Floats are written as such.
    """
    vector = F.col(vector_col)
    if dict(table.dtypes)[vector_col] != "array<float>":
        vector = vector.cast("array<double>")
    chosen = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"))
    chosen = chosen.withColumn("v", F.when(usable(F.col("v")), F.col("v")))
    saved = scratch.save(chosen.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v"), "numbered")
    return saved.withColumn("v", F.col("v").cast("array<double>"))


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, rows) of a list column without nulls, for each length of vector in it."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = []
    for n in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == n)
        out.append((places, flat[offsets[places][:, None] + np.arange(n)]))
    return out


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows whose first n_keys columns, of whole numbers, are equal."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[:, a].tolist())
            if now is not None and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their lengths; scaled first, so that no square over- or underflows."""
    top = np.abs(vectors).max(1, keepdims=True, initial=0.0)
    scaled = np.divide(vectors, top, out=np.zeros(vectors.shape), where=top > 0)
    norms = np.sqrt((scaled * scaled).sum(1, keepdims=True))
    return np.divide(scaled, norms, out=np.zeros(vectors.shape), where=norms > 0)


def tile_pairs(row: Column, n_tiles: Column) -> Column:
    """Array of (a, b, left): the pairs of tiles a <= b that a row takes part in, and whether it is in a.

    A row of a group of one tile stands once; each two tiles of a larger group meet in one pair.
    """
    own = F.pmod(F.xxhash64(row, F.lit(3)), n_tiles).cast("int")
    other = F.sequence(F.lit(0), n_tiles.cast("int") - 1)
    return F.transform(other, lambda x: F.struct(F.least(own, x).alias("a"), F.greatest(own, x).alias("b"), (own <= x).alias("left")))
