"""Token-id files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank by corpus frequency, so that frequent ids take one byte. A rank takes one
to four bytes; two bits per rank, four to a control byte, hold the number of bytes less one
(Lemire et al., "Stream VByte", 2018). Control bytes and data bytes are separate streams, so a file is decoded by
table lookup on whole numpy arrays.

File format, all integers little-endian:
    magic b"GLTOKEN1"; n_docs, n_ids, n_data (u64 each); doc_id (i64 each); doc_id present (u8 each);
    ids per document (u32 each); control bytes (ceil(n_ids / 4)); data bytes (n_data).
The folder also holds the table of ranks (ranks.parquet: id, rank) that decoding needs.

Files hold at most IDS_PER_FILE ids, or one document if that is longer; documents stand in ascending
doc_id order in a file and across files. Spark's text writer writes them, a file a row, so any store that Spark can write will
do, and a task that runs again commits its files once; files are in the order of the part and the number in their names, and a
newline follows the data.

Defined results: null counts as the empty text, which has the end id only; rows with equal doc_id are in
the order of their ids' bytes, a null doc_id stands first; further columns are ignored; an empty table
gives an empty folder and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WordMap, broadcast_file, map_batches, once_per_worker, pieces, table
from graphloom.llm.op6_byte_bpe import byte_letters
from graphloom.scratch import Scratch

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"GLTOKEN1"
IDS_PER_FILE = 1 << 22
#: Words whose ids a Python worker keeps, at most; about 200 bytes each.
CACHED = 1 << 20


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which this tokenizer lets encode word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in order; words are cut at blanks and newlines, and their ids kept in a bounded cache.
    Words of Latin letters, lower-cased, are one pre-token each, and go to the library's BPE model
    directly; all others go through its whole chain. A tokenizer that does other than STEPS encodes whole texts.
    """

    #: What is done with a text before its model sees it, for which the above holds.
    STEPS = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
        "post_processor": None,
    }

    _LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

    def __init__(self, raw: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        read = json.loads(raw)
        self.by_word = {k: read.get(k) for k in self.STEPS} == self.STEPS
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.words, self.heads = WordMap(self._ids, CACHED), WordMap(self._head)
        self.ends: dict[str, bytes] = {"": b""}

    def _ids(self, word: str) -> bytes:
        found = self._LATIN.fullmatch(word)
        if not found:
            return self._whole(word)
        head, end = found.groups()
        return self.heads[head.lower()] + (self.ends.get(end) or self._end(end)) if end else self._head(head.lower())

    def _head(self, head: str) -> bytes:
        if not head.isascii():  # ASCII letters stand for themselves
            head = head.encode().decode("latin-1").translate(self.letters)
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(head)])

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _end(self, end: str) -> bytes:
        ids = self._whole(end)
        if len(end) <= 4:
            self.ends[end] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


def tokenise(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as little-endian integers of two bytes, or four for a vocabulary over 65,536."""
    raw = broadcast_file(docs.sparkSession, path)

    def make():
        encoder = once_per_worker(f"words {path}", lambda: WordEncoder(raw.value))
        end = np.array([end_id], encoder.kind).tobytes()

        def apply(batch: pa.RecordBatch) -> list[pa.Array]:
            return [batch.column(0), pa.array([encoder.encode(t or "") + end for t in batch.column(1).to_pylist()], pa.binary())]

        return apply

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "doc_id long, ids binary", make)


def id_counts(tokens: DataFrame, kind: np.dtype) -> DataFrame:
    """(id, n) over the corpus; each task sends one row per id it has seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for column in (piece.column(0) for piece in pieces([batch])):
                ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]  # ids are never null
                found = np.bincount(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(total[seen])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of an array of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = extra
    control = padded[0::4] | padded[1::4] << 2 | padded[2::4] << 4 | padded[3::4] << 6
    used = USED[control].reshape(-1)[: 4 * len(ranks)]
    return control, ranks.view(np.uint8)[used]


#: For each control byte, which of the sixteen bytes of its four ranks are written.
USED = np.array([[k <= (c >> s & 3) for s in (0, 2, 4, 6) for k in range(4)] for c in range(256)], bool)


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(4 * n, np.uint8)
    out[USED[control].reshape(-1)[: 4 * n]] = data
    return out.view("<u4")


def pack_file(doc_ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = np.array([len(doc_ids), len(ranks), len(data)], "<u8").tobytes()
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    present = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    return b"".join((MAGIC, head, ids, present, np.array(counts, "<u4").tobytes(), control.tobytes(), data.tobytes()))


def unpack_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, present, counts, ranks) of a file's bytes."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    n_docs, n_ids, n_data = np.frombuffer(raw, "<u8", 3, 8).tolist()
    at = 32

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, present, counts = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    control, data = take("u1", -(-n_ids // 4)), take("u1", n_data)
    return doc_ids, present, counts, decode_ranks(control, data, n_ids)


def _rank_table(counted: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of id, id of rank): by falling frequency, then by id."""
    by_rank = np.array([i for i, _ in sorted(counted, key=lambda x: (-x[1], x[0]))], np.int64)
    rank_of = np.zeros(by_rank.max() + 1 if len(by_rank) else 0, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    return rank_of, by_rank.astype(np.uint32)


def write_files(tokens: DataFrame, folder: str, rank_of: np.ndarray, kind: np.dtype, per_file: int | None = None) -> None:
    """Write tokens (doc_id, ids) in ascending order."""
    ranks = tokens.sparkSession.sparkContext.broadcast(rank_of)  # at most the vocabulary's size
    per_file = per_file or IDS_PER_FILE
    ordered = tokens.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def file() -> pa.RecordBatch:
            nonlocal held
            content = pack_file(doc_ids, list(map(len, parts)), ranks.value[np.concatenate(parts)])
            doc_ids.clear()
            parts.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(ids, kind)
                if held and held + len(found) > per_file:
                    yield file()
                doc_ids.append(doc_id)
                parts.append(found)
                held += len(found)
        if doc_ids:
            yield file()

    files = ordered.mapInArrow(pack, "content binary").select(F.col("content").cast("string").alias("value"))  # the bytes as they are
    files.write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "none").text(folder)


_NAME = re.compile(r"part-(\d+)-.*-c(\d+)\b")


def read_files(spark: SparkSession, folder: str, id_of: np.ndarray) -> DataFrame:
    """(part, number, doc_id, before, n_tokens, ids_crc32): before counts the ids of earlier documents in the same file."""
    ids = spark.sparkContext.broadcast(id_of)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not len(content.as_buffer()):  # of a part without rows
                    continue
                doc_ids, present, counts, ranks = unpack_file(content.as_buffer())
                values = ids.value[ranks].astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                sums = [zlib.crc32(values[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                names = ["part", "number", "doc_id", "before", "n_tokens", "ids_crc32"]
                place = (pa.array([int(x)] * len(counts), pa.int64()) for x in _NAME.search(path.rpartition("/")[2]).groups())
                columns = [*place, pa.array(doc_ids, pa.int64(), mask=present == 0), pa.array(starts), pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.select("path", "content").mapInArrow(decode, "part long, number long, doc_id long, before long, n_tokens long, ids_crc32 long")


def encode_to_files(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, np.ndarray]:
    """Tokenise, rank, write. (folder of the files, id of each rank)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    kind = WordEncoder(broadcast_file(spark, path).value).kind
    tokens = scratch.save(tokenise(docs, path, end_id, id_col, text_col), "tokens")
    counted = [(r["id"], r["n"]) for r in id_counts(tokens, kind).collect()]  # at most the vocabulary's size
    rank_of, id_of = _rank_table(counted)
    spark.createDataFrame([(int(i), k) for k, i in enumerate(id_of)], "id long, rank int").coalesce(1).write.parquet(f"{scratch.path}/ranks.parquet")
    write_files(tokens, f"{scratch.path}/files", rank_of, kind)
    scratch.drop("tokens")
    return f"{scratch.path}/files", id_of


def with_starts(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of decoded documents; start adds up the files before.

    The running sum is over the table of files, which has one row for up to IDS_PER_FILE ids.
    """
    found = scratch.save(found, "decoded")
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n_ids"))
    bases = files.select("part", "number", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))
    return found.join(bases, ["part", "number"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, id_of = encode_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return with_starts(read_files(spark, folder, id_of), Scratch(spark, "token-starts"))


QUERIES = {"op4_token_files": op4_token_files}
ORACLE: dict[str, str] = {}
