"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram binds the vectors of its
letters, the first rotated twice, the second once (word ends count as a letter). A document is the
bundle (sum) of its trigrams, a language the bundle of its documents' normalised vectors, and a
document's language is the one with the largest cosine.

Prototypes are fitted on labelled rows only, on at most about TRAIN_ROWS of them, chosen by a hash of doc_id;
prediction looks at the text alone. Sums are kept in whole numbers, so that prototypes don't depend on the order
of tasks.

Defined results: a text that is null or has no letter, and any text if no row can be learned from, is `und`
with score 0; a negative cosine scores 0; ties go to the lang that sorts first; rows with a null doc_id
aren't learned from and aren't held out; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, once_per_worker, pieces, table

DIMENSIONS = 2048
SEED = 5
#: Labelled rows that prototypes are fitted on, about, at most.
TRAIN_ROWS = 20_000
UNDETERMINED = "und"
#: Prototype sums are of whole multiples of 1 / SCALE.
SCALE = 1 << 20
#: Cells of the count matrix that is multiplied at once.
CELLS = 1 << 21
#: Characters that are turned into codes at a time, about.
CHARACTERS = 1 << 19


class Profiles:
    """Bundles texts into vectors."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= 1 << 14:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.letters[code]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """(len(texts), dimensions) sums of trigram vectors; zero where a text has no letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        begin = 0
        while begin < len(texts):  # about CHARACTERS at a time, or one text
            end, held = begin, 0
            while end < len(texts) and (end == begin or held + len(texts[end]) <= CHARACTERS):
                held += len(texts[end])
                end += 1
            codes = [np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4") for t in texts[begin:end]]
            self._bundle(codes, out[begin:end])
            begin = end
        return out

    def _bundle(self, codes: list[np.ndarray], out: np.ndarray) -> None:
        gap = np.zeros(1, np.uint32)
        flat = np.concatenate([x for c in codes for x in (gap, c)] + [gap])
        doc = np.repeat(np.arange(len(codes) + 1), [len(c) + 1 for c in codes] + [1])
        flat = np.where(self.is_letter[flat], flat, 0)
        keep = flat > 0
        keep[1:] |= flat[:-1] > 0
        keep[:-1] |= flat[1:] > 0
        flat, doc = flat[keep], doc[keep]
        if len(flat) < 3:
            return
        # where two words stand one gap apart, it ends the one and begins the other
        places = np.flatnonzero(flat[1:-1] > 0) + 1
        alphabet = np.flatnonzero(np.bincount(flat))
        k = len(alphabet)
        place_of = np.zeros(int(alphabet[-1]) + 1, np.int64)
        place_of[alphabet] = np.arange(k)
        dense = place_of[flat]
        keys = (dense[places - 1] * k + dense[places]) * k + dense[places + 1]
        if k**3 <= 1 << 22:
            seen = np.flatnonzero(np.bincount(keys, minlength=k**3))
            index = np.zeros(k**3, np.int64)
            index[seen] = np.arange(len(seen))
            keys = index[keys]
        else:
            seen, keys = np.unique(keys, return_inverse=True)
        vectors = np.stack([self.letter(int(c)) for c in alphabet])
        first, second = np.roll(vectors, 2, 1), np.roll(vectors, 1, 1)
        owners = doc[places]
        step = max(1, CELLS // self.dimensions)
        for low in range(0, len(seen), step):  # trigrams, then documents, in pieces of bounded size
            some = seen[low : low + step]
            bound = (first[some // (k * k)] * second[some // k % k] * vectors[some % k]).astype(np.float32)
            inside = (keys >= low) & (keys < low + step) if len(seen) > step else slice(None)
            own, key = owners[inside], keys[inside] - low
            rows = max(1, CELLS // len(some))
            for top in range(0, len(out), rows):
                a, b = np.searchsorted(own, [top, top + rows])
                n = min(rows, len(out) - top)
                counts = np.bincount((own[a:b] - top) * len(some) + key[a:b], minlength=n * len(some))
                out[top : top + n] += counts.reshape(n, len(some)).astype(np.float32) @ bound


def _normalised(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    return np.divide(x, norms, out=np.zeros(x.shape), where=norms > 0)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, text_col: str, lang_col: str, key_col: str, most: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and a unit vector for each, from at most about `most` rows with text and lang."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64(F.col(key_col), F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * most / n))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = once_per_worker("profiles", Profiles)
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            langs = batch.column(1).to_pylist()
            vectors = np.rint(_normalised(profiles.bundle(batch.column(0).to_pylist())) * SCALE).astype(np.int64)
            for lang in set(langs):
                total = vectors[[k for k, x in enumerate(langs) if x == lang]].sum(0)
                sums[lang] = sums.get(lang, 0) + total
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(bundle, "lang string, v array<long>")
    sums = parts.select("lang", F.posexplode("v").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    # a row per language and dimension
    found: dict[str, np.ndarray] = {}
    for lang, k, x in sums.collect():
        found.setdefault(lang, np.zeros(DIMENSIONS))[k] = x
    langs = sorted(lang for lang, v in found.items() if v.any())
    return langs, _normalised(np.stack([found[x] for x in langs])) if langs else np.zeros((0, DIMENSIONS))


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row."""

    def make():
        profiles = once_per_worker("profiles", Profiles)

        def apply(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(1).to_pylist()
            preds, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if langs:
                vectors = profiles.bundle([t or "" for t in texts])
                cosines = _normalised(vectors) @ prototypes.T
                best = cosines.argmax(1)
                for k in np.flatnonzero([_has_letter(t) for t in texts]).tolist():
                    preds[k], scores[k] = langs[best[k]], float(min(1.0, max(0.0, cosines[k, best[k]])))
            return [batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]

        return apply

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), "doc_id long, lang_pred string, score double", make)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, prototypes = fit(_learnable(docs), "text", "lang", "doc_id")
    found = predict(docs, langs, prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Cosines below this are no language that was learned, for texts of up to SHORT characters and for longer ones. Unrelated trigrams give
#: 0 +- 1 / sqrt(DIMENSIONS), about 0.02: 0.05 at the 95th percentile of random Cyrillic and Greek words, 0.08 at most. Documents of learned languages have
#: 0.08 at least with four words (check_l), and 0.22 with 50 letters or more (held-out documents of check_s).
SHORT, LEAST_COSINES = 100, (0.05, 0.12)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a letter, or unlike every learned language, go."""
    langs, prototypes = fit(_learnable(docs), "text", "lang", "doc_id")
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = once_per_worker("profiles", Profiles)
        at = names.index("text")
        for batch in pieces(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            best = (_normalised(profiles.bundle(texts)) @ prototypes.T).max(1, initial=0.0)
            least = np.where([len(t) <= SHORT for t in texts], *LEAST_COSINES)
            yield batch.filter(pa.array((best >= least) & np.array([_has_letter(t) for t in texts], bool)))

    return docs.mapInArrow(keep, kinds)


QUERIES = {"op5_language_id": op5_language_id}
ORACLE: dict[str, str] = {}
