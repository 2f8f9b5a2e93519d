"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

A 64-bit fingerprint is cut into six blocks. Two fingerprints that differ in at most three bits differ
in at most three blocks, so at least three blocks are equal: joining on every choice of three equal
blocks (20 tables, keys of 31 to 33 bits) finds every pair within three bits, and no other pair
survives the verification. Documents are first merged into classes of equal fingerprints, so copies
never meet each other in the join, however many there are; each linked pair is emitted by
the first table it agrees in only.

Defined results: null and empty texts, and texts of white space only, have fingerprint zero and link
like any other; fewer words than a shingle make one shingle; rows with equal or null doc_id are each
fingerprinted, a null doc_id is never a component's smallest id (a component of null ids only has null);
further columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, map_batches, table
from graphloom.operators.components import component_labels
from graphloom.scratch import Scratch

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCK_WIDTHS = (11, 11, 11, 11, 10, 10)
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 18


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a UTF-8 text; bytes.lower and bytes.split know ASCII letters and white space only."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        parts, words = [b" ".join(parts)], 1
    count = len(parts) - words + 1
    hashes = map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(parts[k:] for k in range(words)))))
    ones = np.zeros(64, np.int64)
    for begin in range(0, count, CHUNK):
        n = min(CHUNK, count - begin)
        found = np.fromiter(hashes, np.dtype("<u8"), n) if n == count else np.array([next(hashes) for _ in range(n)], "<u8")
        ones += np.unpackbits(found.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def make():
        def apply(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [fingerprint(t or b"", words) for t in batch.column(1).to_pylist()]
            return [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))]

        return apply

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary")), "doc_id long, fp long", make)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks() -> list[int]:
    """For each choice of three of the six blocks, the bits of those blocks."""
    starts = np.cumsum((0, *BLOCK_WIDTHS)).tolist()
    blocks = [((1 << w) - 1) << s for s, w in zip(starts, BLOCK_WIDTHS)]
    return [sum(c) for c in combinations(blocks, len(BLOCK_WIDTHS) - MAX_BITS)]


def _first_table(differing: Column) -> Column:
    """Number of the first table whose blocks two fingerprints share, from their differing bits."""
    masks = block_masks()
    case = F.when(differing.bitwiseAND(F.lit(_signed(masks[0]))) == 0, F.lit(0))
    for k, mask in enumerate(masks[1:], 1):
        case = case.when(differing.bitwiseAND(F.lit(_signed(mask))) == 0, F.lit(k))
    return case


def links(classes: DataFrame) -> DataFrame:
    """(a, b) for each pair of distinct fp in classes that differ in at most MAX_BITS bits, a below b."""
    keys = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(block_masks())))
    dealt = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    one, other = dealt.withColumnRenamed("fp", "a"), dealt.withColumnRenamed("fp", "b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    return (
        one.join(other, ["t", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(differing) <= MAX_BITS) & (F.col("t") == _first_table(differing)))
        .select("a", "b")
    )


def _components(docs: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) per row of docs, and (fp, root, component_id) per class; root is one per component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    found = scratch.save(links(classes), "links")
    labels = component_labels(found, "a", "b", Scratch(docs.sparkSession, "simhash-components"))
    rooted = scratch.save(classes.join(labels, classes.fp == labels.id, "left").select("fp", "first_id", F.coalesce("label", "fp").alias("root")), "rooted")
    # only classes with links meet others; the rest are their own component
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked, scratch.save(rooted.join(smallest, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id: the smallest doc_id reachable by links."""
    marked, of_class = _components(docs, id_col, text_col, words)
    return marked.join(of_class, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, with the smallest doc_id.

    Of several rows of a component with that doc_id, or without any id in it, the one with the smallest hash of its
    text stays. Rows whose doc_id is null or repeated are numbered and fingerprinted once more, as their id doesn't tell them apart.
    """
    names, scratch = docs.columns, Scratch(spark, "simhash-kept")
    own, row, hashed = fresh(docs, "_id", "_row", "_hash")
    marked, of_class = _components(docs, "doc_id", "text", SHINGLE_WORDS)
    first = F.coalesce(F.bool_or(F.col("doc_id") == F.col("component_id")), F.lit(False))
    ids = marked.join(of_class, "fp").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias("n"), first.alias("first"))
    ids = scratch.save(ids.where(F.col("first") | F.col(own).isNull()).select(own, (F.col(own).isNotNull() & (F.col("n") == 1)).alias("plain")), "ids")
    # hashed ids, of few bytes a row, and no sort of the texts
    single = docs.join(ids.where("plain").select(own).hint("shuffle_hash"), F.col("doc_id") == F.col(own), "left_semi").select(names)
    odd = ids.where("not plain").select(own)
    if odd.isEmpty():
        return single
    rows = scratch.save(docs.join(odd, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi").withColumn(row, F.monotonically_increasing_id()), "repeated")
    placed = fingerprints(rows, row).withColumnRenamed("doc_id", row).join(of_class, "fp")
    placed = placed.join(rows.select(row, "doc_id", F.xxhash64("text").alias(hashed)), row).where("doc_id <=> component_id")
    stays = placed.groupBy("root").agg(F.min(F.struct(hashed, row)).alias("least")).select(F.col("least")[row].alias(row))
    return single.unionByName(rows.join(stays, row, "left_semi").select(names))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE: dict[str, str] = {}
