"""What the operators share: table access, and Arrow batches as Python values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_bytes(path: str) -> bytes:
    """Read on the driver and broadcast, so that executors need no file of their own."""
    with open(path, "rb") as f:
        return f.read()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Rows whose Python values are held at a time.
ROWS = 1024


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ROWS rows, without copying."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            yield batch.slice(begin, ROWS)


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]]) -> DataFrame:
    """Apply to Arrow batches of df, of at most ROWS rows, the function that make() returns once per task.

    The function returns the columns of schema in order. Rows stay in the partition they are in.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = None
        for batch in pieces(batches):
            apply = apply or make()
            yield pa.RecordBatch.from_arrays(apply(batch), names=names)

    return df.mapInArrow(run, schema)


def once_per_worker(key: str, load: Callable[[], object]) -> object:
    """load()'s value, kept for the later tasks of the same Python worker."""
    if key not in _KEPT:
        _KEPT[key] = load()
    return _KEPT[key]


_KEPT: dict[str, object] = {}


def broadcast_file(spark: SparkSession, path: str) -> Broadcast[bytes]:
    """A vocabulary file of at most a few MB, whose size doesn't depend on the data."""
    raw = tokenizer_bytes(path)
    if len(raw) > 64 << 20:
        raise ValueError(f"{path} is too large for a vocabulary file: {len(raw)} bytes")
    return spark.sparkContext.broadcast(raw)


class WordCache:
    """Values of words, computed for many missing words at a time.

    When half of most is held, this half is set aside and its words come back as they are asked for, so frequent words
    aren't computed again. Words longer than longest, and those of a call that alone would fill the half, are kept for that
    call only, so memory stays bounded by most * (longest + a value's size) and what one text itself needs.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable], most: int = 1 << 19, longest: int = 48):
        self.compute, self.half, self.longest = compute, most // 2, longest
        self.kept: dict[str, object] = {}
        self.aside: dict[str, object] = {}

    def values(self, words: list[str]) -> list:
        """The value of each word, in order."""
        out = list(map(self.kept.get, words))
        if None not in out:
            return out
        holes = [k for k, value in enumerate(out) if value is None]
        missing = {words[k] for k in holes}
        found = {w: self.aside[w] for w in missing & self.aside.keys()}
        new = list(missing - found.keys())
        found.update(zip(new, self.compute(new)))
        for k in holes:
            out[k] = found[words[k]]
        if max(map(len, new), default=0) > self.longest:
            found = {w: v for w, v in found.items() if len(w) <= self.longest}
        if len(found) <= self.half:
            if len(self.kept) + len(found) > self.half:
                self.aside, self.kept = self.kept, {}
            self.kept.update(found)
        return out


class WordMap(dict):
    """Values of words, each computed when it is first looked up by [].

    When half of most is held, this half is set aside and its words come back as they are looked up, so frequent words
    aren't computed again. Words longer than longest aren't kept.
    """

    def __init__(self, compute: Callable[[str], object], most: int = 1 << 19, longest: int = 48):
        super().__init__()
        self.compute, self.half, self.longest = compute, most // 2, longest
        self.aside: dict[str, object] = {}

    def __missing__(self, word: str) -> object:
        value = self.aside.get(word)
        if value is None:
            value = self.compute(word)
        if len(word) <= self.longest:
            if len(self) >= self.half:
                self.aside = dict(self)
                self.clear()
            self[word] = value
        return value
