"""Language profiles one trigram at a time, in plain Python but for the vectors themselves."""

import zlib
from collections import Counter

import numpy as np

DIMENSIONS, SEED, SCALE = 2048, 5, 1 << 20


def letter(code):
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8).astype(np.int64) * 2 - 1


def bundle(text, kept={}):
    """The sum of a text's trigrams; a word's ends are code 0."""
    trigrams, word = Counter(), []
    for c in [*(text or "").lower(), " "]:
        if c.isalpha():
            word.append(ord(c))
        elif word:
            ends = [0, *word, 0]
            trigrams.update(zip(ends, ends[1:], ends[2:]))
            word = []
    total = np.zeros(DIMENSIONS)
    for t, n in trigrams.items():
        if t not in kept:
            a, b, c = map(letter, t)
            kept[t] = np.roll(a, 2) * np.roll(b, 1) * c
        total += n * kept[t]
    return total


def unit(x):
    length = np.sqrt(x @ x)
    return x / length if length else x


def predict(rows):
    """(lang or None, cosine) of each (doc_id, text, lang), learned from those that aren't held out."""
    sums = {}
    for i, text, lang in rows:
        if text is not None and lang is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + np.rint(unit(bundle(text)) * SCALE)
    langs = sorted(x for x, v in sums.items() if v.any())
    out = []
    for _, text, _ in rows:
        v = unit(bundle(text))
        found = [float(v @ unit(sums[x])) for x in langs]
        best = int(np.argmax(found)) if found and v.any() else None
        out.append((None, 0.0) if best is None else (langs[best], found[best]))
    return out
