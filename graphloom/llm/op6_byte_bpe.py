"""Byte-level BPE by a sentencepiece model that is serialised directly from the rank file.

Each byte string of the vocabulary becomes a piece spelled with one printable character per byte,
scored by its negative rank; the model does BPE merges by score, leaves the text as it is
(identity normalisation) and knows no word boundary. Texts are cut into pre-tokens by the pattern,
each pre-token is encoded by itself, and decoding maps ids back to bytes. A pre-token that is in
the vocabulary is its own id, as in the tiktoken library.

Encodings are kept per word in a bounded cache: the pattern never joins what stands
before a blank that follows a non-blank to what comes after, so words can be encoded one at a time.

Defined results: null counts as the empty text, which has no ids; texts of any length are encoded whole;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WordCache, broadcast_file, map_batches, once_per_worker, table

RANK_FILE = "byte_bpe_50k.tiktoken"
#: Words whose ids each of the two caches of a worker holds at most.
CACHED = 1 << 19


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 has a visible one, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(visible)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protocol buffer field: int as varint, float as 32 bits, bytes with their length."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces (1), trainer_spec (2), normalizer_spec (3).

    Piece k is the token of the k-th smallest rank; the unknown piece stands behind them.
    """
    letters = byte_letters()
    spell = lambda token: "".join(letters[b] for b in token).encode()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, spell(t)) + _field(2, float(-r)) + _field(3, normal) for t, r in sorted(ranks.items(), key=lambda x: x[1])]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, no removed or escaped blanks
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encodes and decodes with the ranks of a file."""

    def __init__(self, raw: bytes, pattern: str = public_tokenizers.PATTERN):
        import regex
        import sentencepiece

        self.ranks = read_ranks(raw)
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        self.ids = [r for _, r in by_rank]
        self.gapless = self.ids == list(range(len(self.ids)))
        self.bytes_of = dict((r, t) for t, r in by_rank)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.find = regex.compile(pattern).findall
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.words = WordCache(self._packed, CACHED)
        self.after_blank = WordCache(lambda words: self._packed([" " + w for w in words]), CACHED)

    def _packed(self, texts: list[str]) -> Iterable[bytes]:
        """Ids as little-endian 32-bit integers, which take less memory than lists."""
        return (struct.pack(f"<{len(ids)}I", *ids) for ids in self._cut(texts))

    def _cut(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text by itself; all pre-tokens go through the model in one call."""
        out: list[list[int]] = []
        waiting: list[str] = []
        places: list[tuple[int, int]] = []
        for k, text in enumerate(texts):
            ids: list = []
            for token in self.find(text):
                raw = token.encode()
                whole = self.ranks.get(raw)
                if whole is None:
                    places.append((k, len(ids)))
                    waiting.append(raw.decode("latin-1").translate(self.letters))
                ids.append(whole)
            out.append(ids)
        if waiting:
            found = self.model.encode(waiting, num_threads=1)
            for (k, at), ids in zip(reversed(places), reversed(found)):
                out[k][at : at + 1] = ids if self.gapless else map(self.ids.__getitem__, ids)
        return out

    #: White space, a blank, white space or the end: a run that must not be cut at that blank.
    _RUN = re.compile(r"\s (?=\s|\Z)")

    def encode(self, text: str) -> np.ndarray:
        """The ids, as 32-bit integers."""
        if self._RUN.search(text):
            found = self.words.values(re.split(r"(?<=\S)(?=\s)", text))
        else:
            first, *rest = text.split(" ")
            found = self.words.values([first]) + self.after_blank.values(rest)
        return np.frombuffer(b"".join(found), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _digits(most: int) -> list[str]:
    return [str(n) for n in range(most)]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) per row: ids as little-endian 32-bit integers."""
    raw = broadcast_file(docs.sparkSession, path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids

    def make():
        bpe = once_per_worker(f"byte_bpe {path}", lambda: ByteBpe(raw.value))
        spelled = once_per_worker(f"digits {path}", lambda: _digits(max(bpe.ids) + 1))

        def apply(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, shas, back, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                packed = bpe.encode(text or "")
                found = packed.tolist()
                counts.append(len(found))
                shas.append(hashlib.sha256(" ".join(map(spelled.__getitem__, found)).encode()).hexdigest())
                back.append(hashlib.sha256(bpe.decode(found)).hexdigest())
                if ids:
                    kept.append(packed.tobytes())
            return [batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())] + [pa.array(kept, pa.binary())] * ids

        return apply

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, make)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the ids of each document, and the digests of ids and decoded bytes."""
    return encode_documents(docs, public_tokenizers.path(RANK_FILE), ids=True)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
ORACLE: dict[str, str] = {}
