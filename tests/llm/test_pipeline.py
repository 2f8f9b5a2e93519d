"""The pipeline on the smallest tables: rows of each stage against plain Python, and of run()."""

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import op5_language_id, op6_byte_bpe, op8_mixing
from graphloom.llm.op9_pii import IBAN_LENGTHS

from . import brute_language, brute_pii
from .test_operators import brute_fingerprint

DATA = "/root/testdata/sf0.001"
LENGTHS = {c: n for n, countries in IBAN_LENGTHS.items() for c in countries.split()}


def brute_known(rows):
    found = brute_language.predict([(r["doc_id"], r["text"], r["lang"]) for r in rows])
    least = lambda t: op5_language_id.LEAST_COSINES[len(t or "") > op5_language_id.SHORT]
    return [r for r, (lang, cosine) in zip(rows, found) if lang and cosine >= least(r["text"])]


def brute_kept(rows):
    """One row of each group, with the smallest doc_id."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    prints = [brute_fingerprint(r["text"] or "") for r in rows]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            least = min(root[b] for b in range(len(rows)) if (prints[a] ^ prints[b]).bit_count() <= 3)
            if least < root[a]:
                root[a], changed = least, True
    return [r for k, r in enumerate(rows) if root[k] == k]


def is_iban(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def brute_redacted(text):
    ibans = "|".join(rf"{c}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for c, n in LENGTHS.items())
    expressions = brute_pii.EXPRESSIONS | {"iban": rf"(?<![A-Za-z0-9])(?:{ibans})(?![A-Za-z0-9])"}
    for kind in ("email", "iban", "phone", "card", "ip"):
        valid = is_iban if kind == "iban" else lambda t, kind=kind: brute_pii.valid(kind, t)
        text = re.sub(expressions[kind], lambda m: f"<{kind.upper()}>" if valid(m[0]) else m[0], text)
    return text


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, list(seen.values())[-1], DATA).write.parquet(f"{folder}/{name}")
        seen[name] = spark.read.parquet(f"{folder}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen[name].columns == docs.columns
    return {name: [r.asDict() for r in df.collect()] for name, df in seen.items()}


def by_id(rows):
    return sorted(rows, key=lambda r: (r["doc_id"], str(r)))


def test_language_stage(stages):
    assert by_id(stages["language_id"]) == by_id(brute_known(stages["documents"]))


def test_simhash_stage(stages):
    kept = brute_kept(stages["language_id"])
    assert by_id(stages["simhash_dedup"]) == by_id(kept) and len(kept) < len(stages["language_id"])


def test_pii_stage(stages):
    expected = [r | {"text": t, "n_chars": len(t)} for r in stages["simhash_dedup"] for t in [brute_redacted(r["text"])]]
    assert by_id(stages["pii"]) == by_id(expected) and any("<EMAIL>" in r["text"] for r in expected)


def test_mixing_stage(spark, stages):
    """Rows stand as often as the operator's rates say; a rate's fraction is a chance by the id's hash."""
    before = spark.createDataFrame(stages["pii"], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    rates, _ = op8_mixing.mixing_rates(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(op8_mixing.SEED)), F.lit(1 << 30)) / float(1 << 30)
    times = {r.doc_id: int(r.rate) + (r.chance < r.rate - int(r.rate)) for r in rates.select("doc_id", "rate", chance.alias("chance")).collect()}
    assert by_id(stages["mixing"]) == by_id([r for r in stages["pii"] for _ in range(times[r["doc_id"]])])
    assert len(times) == len(stages["pii"]) and 0 < len(stages["mixing"]) <= len(stages["pii"])


def test_byte_bpe_stage_and_run(spark, stages):
    ranks = op6_byte_bpe.read_ranks(open(public_tokenizers.path(op6_byte_bpe.RANK_FILE), "rb").read())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for r in stages["mixing"]:
        ids = theirs.encode_ordinary(r["text"])
        expected.append((r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha(r["text"].encode())))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r[c] for c in names) for r in stages["byte_bpe"]) == sorted(expected)
    assert sorted(tuple(r[c] for c in names) for r in corpus_pipeline.run(spark, DATA).collect()) == sorted(expected)
