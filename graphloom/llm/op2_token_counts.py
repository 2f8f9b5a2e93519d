"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary entries that end at each character; dynamic programming
keeps, per character, the best score, the number of pieces of that path and whether it ends in an unknown
piece. No piece is ever built. Ties go as in the tokenizers library's Unigram model: among paths of
equal score to a place the one whose last piece starts first stays, an unknown character scores the
vocabulary's least score less 10 and is tried only where no one-character entry starts, and unknown
characters in a row count as one piece.

The vocabulary is the normal pieces of a sentencepiece model file, with the scores that the file gives;
those are whole numbers, so sums are exact in double precision. Blanks become U+2581, and one is
put before the text. No entry has U+2581 behind another character (this is checked), so the best path
passes through each place where a blank follows a non-blank, and words are searched one by one, with results
in a bounded cache.

Defined results: null and empty texts have no tokens and score zero; texts of any length are searched whole;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WordCache, broadcast_file, map_batches, once_per_worker, table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker holds at most.
CACHED = 1 << 20


def read_vocabulary(raw: bytes) -> list[tuple[str, float]]:
    """(piece, score) of the normal pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    normal = (k for k in range(model.get_piece_size()) if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k)))
    return [(model.id_to_piece(k), model.get_score(k)) for k in normal]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        if any(BLANK in p.lstrip(BLANK) for p, _ in vocabulary) or not any(p == BLANK for p, _ in vocabulary):
            raise ValueError("words can't be searched one by one with this vocabulary")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.words = WordCache(lambda words: map(self.search, words), CACHED)

    def search(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path through text."""
        n = len(text)
        best: list[float] = [0.0] * (n + 1)
        count = [0] * (n + 1)
        unknown = [False] * (n + 1)
        at, top, pieces, single = 0, None, 0, False  # of the place that matches now end at

        def settle(end: int) -> None:
            nonlocal top, pieces, single
            if not single and (top is None or best[end - 1] + self.unknown > top):
                top = best[end - 1] + self.unknown
                pieces = count[end - 1] + (not unknown[end - 1])
                unknown[end] = True
            best[end], count[end] = top, pieces
            top, single = None, False

        for last, (length, score) in self.automaton.iter(text):
            while at < last:
                at += 1
                settle(at)
            start = last + 1 - length
            if top is None or best[start] + score > top:  # longest first, so starts ascend
                top, pieces = best[start] + score, count[start] + 1
            single = single or length == 1
        while at < n:
            at += 1
            settle(at)
        return count[n], best[n]

    #: Where a blank follows a non-blank.
    _CUT = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if "  " in text or BLANK in text or text[0] == " " or text[-1] == " ":
            words = self._CUT.split(BLANK + text.replace(" ", BLANK))
        else:
            words = (BLANK + text.replace(" ", f" {BLANK}")).split(" ")
        found = self.words.values(words)
        return sum(n for n, _ in found), sum(s for _, s in found)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) per row: pieces of the best segmentation, and its score."""
    raw = broadcast_file(docs.sparkSession, path)

    def make():
        counter = once_per_worker(f"unigram {path}", lambda: UnigramCounter(read_vocabulary(raw.value)))

        def apply(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [counter.count(t or "") for t in batch.column(1).to_pylist()]
            return [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]

        return apply

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "doc_id long, n_tokens long, score double", make)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
