"""Each operator on small tables: null, empty and long texts, repeated rows, further columns, empty tables."""

import hashlib
import html
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import op1_html_text, op2_token_counts, op3_lattice, op4_token_files, op5_language_id, op6_byte_bpe, op7_ball_tree, op8_mixing, op9_pii, op10_simhash

from . import brute_language
from .brute_pii import base_spans, digest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, label string, kept boolean"
ODD = [
    None, "", " \n\t", "a", "Word", "eins zwei", "The cat sat on the mat and the dog ran.", "The cat sat on the mat and the dog ran.",
    "mail me: a.b@c.de or +49 (30) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1", "emoji 😀 x@y.z é 漢字 ＡＢ ſ İ Σς", "a  b   c \n\n d ", "x" * 30_000, "1 " * 20_000, "wort " * 20_000, "<|endoftext|> '",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or ""), 1, "l", True) for k, t in enumerate(ODD)]
    rows += [(3, "again", None, None, None, None, None, None), (None, "no id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def folder(df, tmp_path, name):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.mark.parametrize("module", [op2_token_counts, op4_token_files, op5_language_id, op6_byte_bpe, op9_pii, op10_simhash])
def test_empty_documents(spark, docs, tmp_path, module):
    d = folder(docs.limit(0), tmp_path, "documents")
    assert next(iter(module.QUERIES.values()))(spark, d).count() == 0


@pytest.mark.parametrize("module", [op3_lattice, op7_ball_tree])
def test_empty_vectors(spark, tmp_path, module):
    d = folder(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
    assert next(iter(module.QUERIES.values()))(spark, d).count() == 0


def test_token_counts(spark, docs):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    path = public_tokenizers.path(op2_token_counts.MODEL)
    vocabulary = op2_token_counts.read_vocabulary(open(path, "rb").read())
    theirs = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], 0, False))
    expected = sorted((str(i), len(theirs.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for i, t in texts(docs))
    assert sorted((str(r.doc_id), r.n_tokens) for r in op2_token_counts.token_counts(docs, path).collect()) == expected


@pytest.mark.parametrize("per_file", [1 << 22, 50])
def test_token_files(spark, docs, tmp_path, monkeypatch, per_file):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op4_token_files, "IDS_PER_FILE", per_file)
    theirs = Tokenizer.from_file(public_tokenizers.path(op4_token_files.TOKENIZER))
    found = op4_token_files.op4_token_files(spark, folder(docs, tmp_path, "documents")).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((i for i, _ in texts(docs)), key=lambda i: (i is not None, i))
    ids = {(str(i), tuple(theirs.encode(t, add_special_tokens=False).ids + [2])) for i, t in texts(docs)}
    at = 0
    for r in found:
        assert r.start == at
        assert any(i == str(r.doc_id) and len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 for i, x in ids)
        at += r.n_tokens


def test_word_encoder():
    """Random strings, as the library encodes them whole; and another chain, which is not cut into words."""
    import json

    from tokenizers import Tokenizer

    raw = open(public_tokenizers.path(op4_token_files.TOKENIZER), "rb").read()
    theirs, mine, rng = Tokenizer.from_str(raw.decode()), op4_token_files.WordEncoder(raw), random.Random(2)
    alphabet = [*" \n\t\r aZéßİΣſ漢😀'19.,!?-", " the", "Word", "'ll", "\u00a0", "\u200d", "ＡＢ", "e\u0301", "<|x|>"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(14)))
        assert np.frombuffer(mine.encode(text), mine.kind).tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)
    other = json.dumps(json.loads(raw) | {"normalizer": None}).encode()
    theirs, mine = Tokenizer.from_str(other.decode()), op4_token_files.WordEncoder(other)
    assert not mine.by_word and np.frombuffer(mine.encode("The Cat"), mine.kind).tolist() == theirs.encode("The Cat", add_special_tokens=False).ids


def test_token_counts_of_random_strings():
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    vocabulary = op2_token_counts.read_vocabulary(open(public_tokenizers.path(op2_token_counts.MODEL), "rb").read())
    theirs, mine, rng = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], 0, False)), op2_token_counts.UnigramCounter(vocabulary), random.Random(3)
    alphabet = [*" \n aZé漢😀'19.,-▁", "  ", " the", "tion", "ing "]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(1, 14)))
        assert mine.count(text)[0] == len(theirs.encode("▁" + text.replace(" ", "▁")).ids), repr(text)


def test_rank_code():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1000):
        ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = op4_token_files.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and (op4_token_files.decode_ranks(control, data, n) == ranks).all()


def test_byte_bpe(spark, docs):
    import tiktoken

    path = public_tokenizers.path(op6_byte_bpe.RANK_FILE)
    ranks = op6_byte_bpe.read_ranks(open(path, "rb").read())
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = [(str(i), len(x := theirs.encode_ordinary(t)), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for i, t in texts(docs)]
    assert sorted((str(r[0]), *r[1:]) for r in op6_byte_bpe.encode_documents(docs, path).collect()) == sorted(expected)
    rng, mine = random.Random(1), op6_byte_bpe.ByteBpe(open(path, "rb").read())
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t\r  aZé漢😀'19.,!- tll\x00\x1c\x85") for _ in range(rng.randrange(14)))
        assert mine.encode(text).tolist() == theirs.encode_ordinary(text) and mine.decode(mine.encode(text).tolist()) == text.encode()


def test_pii(spark, docs, tmp_path):
    found = {str(r.doc_id) + r.base_sha256: r for r in op9_pii.op9_pii(spark, folder(docs, tmp_path, "documents")).collect()}
    for i, t in texts(docs):
        spans = base_spans(t)
        r = found[str(i) + digest(spans)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(x) for x in spans.values()]
    changed = {r.doc_id: r for r in op9_pii.without_pii(spark, docs, "").collect()}
    assert changed[8].text == "mail me: <EMAIL> or <PHONE>, card <CARD>, host <IP>" and changed[8].n_chars == len(changed[8].text)
    assert changed[6].text == ODD[6] and changed[0].text is None
    assert changed[6].asDict().keys() == {f.split()[0] for f in DOCS.split(", ")}
    iban = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00")], "doc_id long, text string")
    assert op9_pii.op9_pii(spark, folder(iban, tmp_path, "documents")).first().spans.endswith("iban:5:32")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, tmp_path):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in range(0, 400, 20)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    rows = texts(every)
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = min(root[a], root[b])
    smallest = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            smallest[r] = min(smallest.get(r, i), i)
    expected = sorted((str(i), f"{p:016x}", smallest.get(r)) for (i, _), p, r in zip(rows, prints, root))
    found = op10_simhash.op10_simhash(spark, folder(every, tmp_path, "documents")).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == expected
    kept = [r.doc_id for r in op10_simhash.keep_one(spark, docs, "").collect()]
    assert 6 in kept and 7 not in kept and {0, 1, 2} & set(kept) == {0}


def test_one_row_of_each_group_stays(spark, docs):
    """Rows repeated with id and text, one id with texts of two groups, and rows without id."""
    cat, dog = "the cat sat on the mat and went to sleep", "some dogs run after every ball that anyone throws"
    rows = [(1, cat), (2, dog), (2, dog), (2, cat), (7, "seven words that no other row has here"), (7, "another row of seven and not like it")]
    rows += [(None, cat), (None, "nobody has given this row a number"), (None, "nobody has given this row a number"), (9, None), (9, None)]
    kept = op10_simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)), "").collect()
    expected = [(1, cat), (2, dog), *rows[4:6], rows[7], (9, None)]
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(map(str, expected)) and {r.kept for r in kept} == {1}
    every = op10_simhash.keep_one(spark, docs, "")
    assert every.columns == docs.columns and every.count() == len({brute_fingerprint(t) for _, t in texts(docs)})


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_empty_and_odd_documents(spark, docs, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    folder(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    nothing = docs.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields))
    n = {"language_id": 0, "simhash_dedup": 1}.get(name, docs.count())
    assert stage(spark, nothing, str(tmp_path)).count() == n


def test_language(spark, docs, tmp_path):
    assert {r.lang_pred for r in op5_language_id.op5_language_id(spark, folder(docs.withColumn("lang", F.lit(None).cast("string")), tmp_path, "documents")).collect()} == {"und"}
    words = {"en": "the of and with this that from these", "de": "der die und nicht schön über weiß auch", "fr": "où les très après été aussi même avec"}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(words[lang].split(), k=rng.randrange(3, 60))), lang) for k in range(300) for lang in [rng.choice(list(words))]]
    rows += [(1000, None, "en"), (1001, "123 !", "en")]
    d = folder(spark.createDataFrame(rows, "doc_id long, text string, lang string"), tmp_path, "documents")
    found = {r.doc_id: r for r in op5_language_id.op5_language_id(spark, d).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in found.items())
    assert sum(found[k].lang_pred != lang for k, _, lang in rows if k < 1000) <= 3
    assert found[1000].lang_pred == found[1001].lang_pred == "und"


def test_language_against_brute_force(spark):
    """The query's rows over a whole table, and accuracy where it wasn't learned."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    expected = {r[0]: x for r, x in zip(rows, brute_language.predict(rows))}
    found = op5_language_id.op5_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(rows)
    for r in found:
        lang, cosine = expected[r.doc_id]
        assert (r.lang_pred, r.score) == (lang or "und", pytest.approx(min(1, max(0, cosine)), abs=1e-6))
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in found if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 20


def test_language_sample(spark):
    """A bound on the labelled rows leaves about so many, the same ones each time."""
    rows = [(k, "the of and with" if k % 2 else "der die und nicht", "en" if k % 2 else "de") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (op5_language_id.fit(docs.repartition(n), "text", "lang", "doc_id", 100) for n in (1, 3))
    assert one[0] == two[0] == ["de", "en"] and (one[1] == two[1]).all()


def vectors(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((20, 24))
    rows = [(k, (centres[k % 20] + rng.standard_normal(24) * (0.05 if k % 3 else 2)).tolist(), 1) for k in range(300)]
    rows += [(300, None, 1), (301, [0.0] * 24, 1), (302, [float("nan")] * 24, 1), (303, [None] + [1.0] * 23, 1), (304, rows[1][1], 1), (304, rows[1][1], 1), (305, [], 1), (None, rows[2][1], None)]
    rows += [(306, [2e6] + [0.0] * 23, 1), (350, [1e6] + [-3e5] * 23, 1)]
    return rows, folder(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tmp_path, "embeddings")


@pytest.mark.parametrize("module", [op3_lattice, op7_ball_tree])
def test_vector_sql(spark, tmp_path, module):
    _, d = vectors(spark, tmp_path)
    ((name, query),), con = module.QUERIES.items(), duckdb.connect()
    for folder_ in (d, "/root/testdata/sf0.001"):
        con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{folder_}/embeddings.parquet{'/*.parquet' * (folder_ == d)}'")
        sql = con.execute(module.ORACLE[name])
        names, expected = [c[0] for c in sql.description], sorted(map(str, sql.fetchall()))
        assert sorted(str(tuple(r[c] for c in names)) for r in query(spark, folder_).collect()) == expected != []


@pytest.mark.parametrize("tile", [2048, 4])
def test_lattice(spark, tmp_path, monkeypatch, tile):
    """Also with many pairs of tiles, copies among linked vectors, and columns named as inner ones."""
    monkeypatch.setattr(op3_lattice, "TILE", tile)
    rows, _ = vectors(spark, tmp_path)
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(24)
    near = [(1000 + k, (centre + 0.1 * rng.standard_normal(24)).tolist(), 1) for k in range(40)]
    rows += near + [(2000 + k, near[k % 3][1], 1) for k in range(30)] + [(2100 + k, rows[0][1], 1) for k in range(12)]
    d = folder(spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int").withColumn("label", F.lit("x")).withColumn("n_links", F.lit(1)).withColumn("h0", F.lit(2)), tmp_path, "embeddings")
    good = [v and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    unit = np.array([np.array(v) / np.linalg.norm(v) if g else np.zeros(24) for (_, v, _), g in zip(rows, good)])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    for _ in range(50):
        root = np.array([min([root[k], *root[near[k]]]) for k in range(len(rows))])
    smallest = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in root}
    expected = sorted((str(i), int(n), smallest[r], i is not None and i == smallest[r]) for (i, _, _), n, r in zip(rows, near.sum(1), root))
    found = op3_lattice.op3_lattice(spark, d).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in found) == expected


@pytest.mark.parametrize(("shard", "growth"), [(64, 2), (40, 8), (8192, 8)])
def test_ball_tree(spark, tmp_path, monkeypatch, shard, growth):
    """Several shards and rounds, components beyond 2**20 and 2**40, ids that are null or repeated, other lengths."""
    monkeypatch.setattr(op7_ball_tree, "SHARD", shard)
    monkeypatch.setattr(op7_ball_tree, "GROWTH", growth)
    monkeypatch.setattr(op7_ball_tree, "BATCH", 3)
    rows, _ = vectors(spark, tmp_path)
    rows += [(400, [2e6] + [0.0] * 23, 1), (401, [3e6, -7.3] + [1.5] * 22, 1), (402, [-(2.0**40) - 0.25], 1), (403, [2.0**-40] * 24, 1), (None, [5e6, 1.0], 1)]
    d = folder(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit(1)).withColumn("shard", F.lit("x")), tmp_path, "embeddings")
    whole = lambda v: [int(np.floor(256 * x)) for x in (v + [0.0] * 24)[:24]]
    part = [(i, whole(v)) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for q, (i, v) in enumerate(part):
        if i is not None and i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for k, (j, w) in enumerate(part) if k != q)[:5]
            expected += [(i, n + 1, j, -s) for n, (s, _, _, j) in enumerate(best)]
    found = op7_ball_tree.op7_ball_tree(spark, d).collect()
    assert sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in found) == sorted(map(str, expected))


def test_ball_tree_few_and_too_large(spark, tmp_path):
    few = [(0, [1.0, 2.0]), (50, [3.0]), (7, [0.0, -1.0])]
    d = folder(spark.createDataFrame(few, "vec_id long, embedding array<double>"), tmp_path, "embeddings")
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in op7_ball_tree.op7_ball_tree(spark, d).collect()}
    assert found == {(0, 1, 50, 256 * 768), (0, 2, 7, -512 * 256), (50, 1, 0, 256 * 768), (50, 2, 7, 0)}
    huge = [(0, [1e300, 1.0]), (50, [1e300, 0.0])]
    d = folder(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), tmp_path, "embeddings")
    with pytest.raises(Exception, match="Overflow"):
        op7_ball_tree.op7_ball_tree(spark, d).collect()
    opposite = [(0, [1e300, -1e300, 1.0]), (50, [1e300, 1e300, 2.0])]
    d = folder(spark.createDataFrame(opposite, "vec_id long, embedding array<double>"), tmp_path, "embeddings")
    assert {(r.query_id, r.vec_id, r.score) for r in op7_ball_tree.op7_ball_tree(spark, d).collect()} == {(0, 50, 2 << 16), (50, 0, 2 << 16)}


def test_mixing(spark, docs, tmp_path):
    rng = random.Random(6)
    good, bad = [f"good{k}" for k in range(50)], [f"bad{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choices(bad if k % 4 == 0 else good, k=rng.randrange(5, 40)))) for k in range(400)]
    d = folder(spark.createDataFrame([*rows, (400, None), (401, "")], "doc_id long, text string"), tmp_path, "documents")
    labels = [(k, int(k % 4 > 0), 0) for k in range(0, 400, 2)] + [(1, None, 0), (None, 1, 0), (9999, 1, 1)]
    folder(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    rates, domains = op8_mixing.mixing_rates(op8_mixing.table(spark, d, "documents"), op8_mixing.table(spark, d, "labels"), {"quality=1,toxic=0": 0.9, "quality=0,toxic=0": 0.1})
    found = rates.collect()
    totals = {x: sum(r.rate * r.n_tokens * r[f"p{k}"] for r in found) for k, x in enumerate(domains)}
    assert len(found) == 402 and min(r.rate for r in found) >= 0 and {r.unmet for r in found} == {found[0].unmet} and found[0].unmet < 0.001
    assert totals["quality=1,toxic=0"] / sum(totals.values()) == pytest.approx(0.9, abs=0.01)
    mixed = op8_mixing.mix(spark, docs, d)
    assert mixed.columns == docs.columns
    folder(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert {r.rate for r in op8_mixing.op8_mixing(spark, d).collect()} == {1.0}


def test_mixing_keeps_clean_texts(spark, tmp_path):
    """Long texts with a rare decisive word, and two dialects that lean to one domain without deciding."""
    rng = random.Random(9)
    dialects = [[f"a{k}" for k in range(400)], [f"b{k}" for k in range(400)]]
    rows, labels = [], []
    for k in range(600):
        toxic = int(k % 6 == 0)
        text = rng.choices(dialects[rng.random() < (0.7 if toxic else 0.4)], k=rng.randrange(20, 300))
        text += rng.sample([f"insult{j}" for j in range(4)], 2) * toxic
        rows.append((k, " ".join(text)))
        if k % 3 < 2:
            labels.append((k, 1, toxic))
    d = folder(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "documents")
    folder(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    targets = {"quality=1,toxic=0": 0.98, "quality=1,toxic=1": 0.02}
    rates, domains = op8_mixing.mixing_rates(op8_mixing.table(spark, d, "documents"), op8_mixing.table(spark, d, "labels"), targets)
    found = rates.collect()
    clean, bad = ([r.rate for r in found if bool(r.doc_id % 6) == x] for x in (True, False))
    assert max(clean) == pytest.approx(1) and sum(clean) / len(clean) > 0.97 and max(bad) < 0.2
    totals = [sum(r.rate * r.n_tokens * r[f"p{k}"] for r in found) for k in range(len(domains))]
    assert totals[1] / sum(totals) == pytest.approx(0.02, abs=0.01)


def test_mixing_out_of_reach(spark):
    """One posterior for all: no rates meet the targets, and none grow without bound."""
    members = spark.createDataFrame([(k, 10 + k, 0.7, 0.2, 0.1) for k in range(50)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    scratch = op8_mixing.Scratch(spark, "test")
    found = op8_mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.1, "b": 0.1, "c": 0.8}, scratch).collect()
    assert len({round(r.rate, 9) for r in found}) == 1 and 0 < found[0].rate <= 10 and found[0].unmet == pytest.approx(0.7)


def test_mixing_rates_are_least_squares(spark):
    """Rates that meet the targets, nearest to 1 by tokens: as found by plain alternating projections over all documents."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.6, 0.5, 0.4], 200)
    n = rng.integers(0, 60, 200)
    weights = np.array([0.7, 0.2, 0.1])
    members = spark.createDataFrame([(k, int(n[k]), *map(float, p[k])) for k in range(200)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    found = {r.doc_id: r for r in op8_mixing.fit_rates(members, list("abc"), dict(zip("abc", weights)), op8_mixing.Scratch(spark, "test")).collect()}
    t = weights * (n @ p[:, 0]) / weights[0]
    m = np.zeros(3)
    for _ in range(20_000):
        m += np.linalg.solve(p.T @ (n[:, None] * p), np.maximum(0, 1 - p @ m) * n @ p - t)
    rates = np.maximum(0, 1 - p @ m)
    rates /= rates[p[:, 0] >= p.max(1)].max()
    assert [found[k].rate for k in range(200)] == pytest.approx(rates.tolist(), abs=2e-3) and found[0].unmet < 1e-3


def test_rows_without_id_are_mixed_by_text(spark, tmp_path):
    rows = [(k, f"good{k % 7} good{k % 5} fine", 1) for k in range(60)] + [(k, f"bad{k % 7} bad{k % 5} awful", 0) for k in range(60, 120)]
    rows += [(None, "good1 good2 fine", 1), (None, "bad1 bad2 awful", 0), (None, None, 0)]
    folder(spark.createDataFrame([(k, q, 0) for k, _, q in rows if k is not None], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    rates, domains = op8_mixing.mixing_rates(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), {"quality=1,toxic=0": 1.0})
    found = rates.where("doc_id is null and n_tokens > 0").orderBy("p0").collect()
    assert len(found) == 2 and found[0].rate > 0.9 and found[1].rate < 0.1 and rates.count() == len(rows)


@pytest.mark.parametrize("k", range(4))
def test_stages_with_any_column_names(spark, tmp_path, k):
    """Columns named as inner ones come out as they went in."""
    _, stage = corpus_pipeline.STAGES[k]
    texts_ = ["the cat sat on the mat and the dog ran after it", "write to a.b@c.de or call +49 (30) 123-4567 today", "some other words are here for the third row"]
    rows = [(k, texts_[k % 3] + f" number {k}", "en", 9) for k in range(12)] + [(None, texts_[0], "en", 9)]
    names = ["_id", "_copies", "_copy", "_pairs", "_matches", "_between", "_row", "_hash", "_key", "fp", "root", "id", "label", "row", "plain", "first", "email_spans", "component_id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    for x in names:
        docs = docs.withColumn(x, F.concat(F.lit(f"{x} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    folder(spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    found = out.collect()
    assert 0 < len(found) <= 13 and all(r[x] == f"{x} {'none' if r.doc_id is None else r.doc_id}" for r in found for x in names)


PAGES = [
    (1, "http://h.org/a", "<body><div>Welcome to our site and please do accept all cookies</div><p>One unique text &amp; more</p></body>"),
    (2, "http://h.org/b", "<body><div>Welcome to our site and please do accept all cookies</div><p>Another\n  text &#233;</p></body>"),
    (3, None, None),
    (4, "http://x.org", ""),
    (5, "http://y.org", "<head><title>t</title><script>'<p>'</script></head><nav>menu</nav><article class=post><h1>H</h1><p><b>b<br>c<p title='a>b'>d<aside>s</aside></article><section id=comments><article>no</article></section><footer>f</footer>"),
    (5, "http://y.org", "<!-- <p>c</p> --><main><ul><li>i<li>j</ul><form>f</form><div hidden>h</div>tail"),
]


def test_html(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, text string")
    found = sorted((r.page_id, r.text, r.n_chars) for r in op1_html_text.op1_html_text(spark, folder(pages, tmp_path, "pages")).collect())
    expected = [(1, "One unique text & more"), (2, "Another text é"), (3, ""), (4, ""), (5, "H\nb c\nd"), (5, "i\nj\ntail")]
    assert found == [(i, t, len(t)) for i, t in expected]
    assert op1_html_text.op1_html_text(spark, folder(pages.limit(0), tmp_path, "pages")).count() == 0


def test_html_articles_whole():
    sql = "SELECT html FROM '/root/testdata/sf0.001/pages.parquet'"
    for (page,) in duckdb.connect().execute(sql).fetchall():
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        cut = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert [t for t, z in op1_html_text.blocks_of(page) if z == op1_html_text.CONTENT] == [b for b in cut if b]


def brute_unique(streams, window):
    """The tokens of each stream that no run of so many tokens in another page's stream covers."""
    out = []
    for s in streams:
        others = {tuple(o[k : k + window]) for o in streams if o is not s for k in range(len(o) - window + 1)}
        covered = {k + j for k in range(len(s) - window + 1) if tuple(s[k : k + window]) in others for j in range(window)}
        out.append([t for k, t in enumerate(s) if k not in covered])
    return out


def test_html_runs_across_blocks(spark):
    """Without <article>, what goes is what brute force over the pages' streams finds, wherever blocks begin."""
    rng = random.Random(12)
    common = [rng.choices([f"c{k}" for k in range(9)], k=rng.randrange(3, 30)) for _ in range(8)]
    hosts, streams, rows, menu = {}, {}, [], common[0][:3] * 4
    for k in range(120):
        tokens = [t for _ in range(rng.randrange(1, 5)) for t in (*rng.choice(common), *(f"u{rng.randrange(40)}" for _ in range(rng.randrange(6, 14))))]
        cuts = sorted(rng.sample(range(len(tokens) + 1), min(len(tokens), 4)))
        blocks = [" ".join(tokens[a:b]) for a, b in zip([0, *cuts], [*cuts, len(tokens)])]
        host = rng.choice("xxy")
        hosts.setdefault(host, []).append(k)
        streams[k] = tokens + menu
        rows.append((k, f"http://{host}/{k}", "".join(f"<p>{b}</p>" for b in blocks) + "<nav>" + " ".join(menu) + "</nav>"))
    expected = {k: t for ks in hosts.values() for k, t in zip(ks, brute_unique([streams[k] for k in ks], op1_html_text.WINDOW))}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = {r.page_id: r.text.split() for r in op1_html_text.main_text(pages).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert found == expected


def test_html_short_blocks_and_mirrors(spark):
    """Short blocks that pages share stay, and so do copies of an article beside other adverts, menus or dates."""
    rng = random.Random(13)
    article = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(4)]
    wrap = "please accept all the cookies of this site and of its many friends"
    page = lambda k, *blocks: (k, f"http://h.org/{k}", "".join(f"<p>{b}</p>" for b in (wrap, *blocks)))
    extra = lambda row, k: (*row[:2], f"{row[2]}<nav>menu {k} of {k}</nav><div class=ad>buy {k} things now</div>")
    own = {k: [f"{k} has {k} of these", "Conclusion", f"p{k} only", "Sh is.", " ".join(f"p{k}x{j}" for j in range(30))] for k in range(4)}
    mirrors = {10: article, 11: article, 12: [*article, "seen on Monday at noon"], 13: [article[0], "by Ann and Bob", *article[1:]]}
    rows = [page(k, *b) for k, b in own.items()] + [extra(page(k, *b), k) for k, b in mirrors.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in op1_html_text.main_text(pages).collect()}
    assert found == {k: "\n".join(b) for k, b in {**own, **mirrors}.items()}


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        ("<article><h1 class='entry-header'>H</h1><div class='social-history'>a</div><section id='menu-of-options'>b</section><header><h1>T</h1></header></article>", "H|a|b|T"),
        ("<article>x<div class='share-buttons'>s</div><p class=ad>a</p><div id=comments>c<article>d</article></div><nav>n</nav>y</article>", "x|y"),
        ("<main><p title=don't>Hello it's me</p><a href=x?a='b>link</a></main>", "Hello it's me|link"),
        ("<article><p style='display:none'>h</p><p style='color: red; Visibility : hidden'>i</p><p style='display:nonesuch'>k</p></article>", "k"),
        ("<article><b>a<div>b</b> c</div>d</article>", "a|b c|d"),
        ("<article><p>a<span>b</p>c</span>d</article>", "ab|cd"),
        ("<article><p data-x='1>2' y = \"<p>\">a</p><script>if (a</b) '</p>'</script><p>b &lt;i&gt; &#x41;&amp;amp;</article>tail", "a|b <i> A&amp;|tail"),
        ("<article><p>a<!-- <p>x</p> --> b<!doctype x>c<![CDATA[<d>]]></article><aside><article>e</article></aside>", "a bc<d>"),
        ("<div class=header>h</div><div class='post-header'>k</div><form>f<article>g</article></form>", "k|g"),
    ],
)
def test_html_markup(page, expected):
    assert [t for t, z in op1_html_text.blocks_of(page) if z != op1_html_text.REJECTED] == expected.split("|")


@pytest.mark.parametrize("piece", ["<div><span>word word</b>", "<b>x<p>word", "<p>a long word &amp; more</p>\n", "<ul><li>x", "<a href='", "word ", "</i><i>", "<table><tr><td>a"])
def test_html_long_pages(piece):
    """A page of a megabyte takes time in proportion: below ten seconds here."""
    import time

    page = "<article>" + piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    found = op1_html_text.blocks_of(page)
    assert time.perf_counter() - began < 10 and (found or not re.search("a|x|word", re.sub("<[^>]*>?", "", piece)))


def test_html_rejected_text_is_evidence(spark):
    """An unnamed block goes if it stands in another page's footer; the page's own unique text stays."""
    line = "all rights are reserved by the owners of this site since long ago"
    rows = [(1, "http://h/1", f"<div>{line}</div><p>one two three</p>"), (2, "http://h/2", f"<article>kept</article><footer>{line}</footer>"), (3, "http://k/1", f"<div>{line}</div>"), (4, None, f"<p>{line}</p>"), (5, None, f"<p>{line}</p><p>a text that is long enough to be no mirror of the one before</p>")]
    found = {r.page_id: r.text for r in op1_html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {1: "one two three", 2: "kept", 3: line, 4: "", 5: "a text that is long enough to be no mirror of the one before"}


def test_iban_ends(spark, tmp_path):
    """What stands behind an IBAN is no part of it: capitalised and upper-case words, numbers, another IBAN."""
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    ends = ["", " Bitte", " Please pay", " BIC X", " 12 34", " A", ". Next", ",DE", f" {ibans[1]}", " AB12 X"]
    cases = [("pay " + i + e, [i, *([ibans[1]] if "DE89" in e else [])]) for i in ibans for e in ends]
    cases += [("AB12 " + i, [i]) for i in ibans] + [(i + "0", []) for i in ibans] + [("x" + i, []) for i in ibans]
    texts = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in op9_pii.op9_pii(spark, folder(texts, tmp_path, "documents")).collect():
        text, expected = cases[r.doc_id]
        spans = [x.split(":") for x in r.spans.split(",") if x.startswith("iban")]
        assert [text[int(a) : int(b)] for _, a, b in spans] == expected, text
    changed = {r.doc_id: r.text for r in op9_pii.without_pii(spark, texts.withColumn("n_chars", F.length("text").cast("long")), "").collect()}
    assert changed[1] == "pay <IBAN> Bitte" and changed[13] == "pay <IBAN> BIC X" and changed[23] == "pay <IBAN> BIC X"


def test_mixing_tells_every_document_apart(spark, tmp_path):
    """Posteriors follow the scores of all domains, and are those that fit the kept rows best."""
    rng = random.Random(14)
    kinds = [(1, 0), (0, 0), (1, 1)]
    rows, labels = [], []
    for k in range(900):
        kind = k % 3
        mine = kind if rng.random() < 0.9 else rng.randrange(3)
        rows.append((k, " ".join([*(f"d{mine}w{rng.randrange(12)}" for _ in range(rng.randrange(1, 15))), *(f"d{rng.randrange(3)}w{rng.randrange(12)}" for _ in range(rng.randrange(3)))])))
        labels.append((k, *kinds[kind]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = op8_mixing.fit_classifier(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), op8_mixing.Scratch(spark, "test"))
    found = {r.doc_id: np.array([r.p0, r.p1, r.p2]) for r in op8_mixing.posteriors(docs, fitted).collect()}
    assert all(p.sum() == pytest.approx(1) for p in found.values())
    scored = {r["_id"]: np.array([r.s0, r.s1, r.s2]) for r in op8_mixing._scores(op8_mixing._with_features(docs, "doc_id", "text"), fitted).collect()}
    assert len({tuple(p.round(12)) for p in found.values()}) == len({tuple(x.round(9)) for x in scored.values()}) > 32
    kept = [r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(op8_mixing.SEED + 1)), F.lit(op8_mixing.CALIBRATE_EVERY)) == 0).collect()]
    names = [f"quality={q},toxic={t}" for q, t in kinds]

    def loss(scale, shifts):
        z = np.array([scale * scored[k] + shifts for k in kept])
        truth = [fitted.domains.index(names[k % 3]) for k in kept]
        return (np.log(np.exp(z).sum(1)) - z[range(len(kept)), truth]).sum() + op8_mixing.PRIOR / 2 * ((scale - 1) ** 2 + (np.array(shifts) ** 2).sum())

    least = loss(fitted.scale, fitted.shifts)
    for k in range(4):
        for step in (-0.05, 0.05):
            moved = np.array([fitted.scale, *fitted.shifts]) + step * (np.arange(4) == k)
            assert loss(moved[0], moved[1:]) > least


def test_word_map_stays_bounded_and_computes_frequent_words_once():
    from graphloom.llm.common import WordMap

    asked: list[str] = []
    kept = WordMap(lambda w: asked.append(w) or w.encode(), most=8, longest=5)
    for k in range(50):
        assert kept["often"] == b"often" and kept[f"w{k}"] == f"w{k}".encode() and kept["longer"] == b"longer"
        assert len(kept) + len(kept.aside) <= 8 and "longer" not in kept
    assert asked.count("often") == 1 and asked.count("longer") == 50


def test_words_are_encoded_alike_however_often_the_cache_turns_over():
    from graphloom.llm.common import WordMap

    with open(public_tokenizers.path(op4_token_files.TOKENIZER), "rb") as f:
        mine = op4_token_files.WordEncoder(f.read())
    mine.words, mine.heads = WordMap(mine._ids, 4), WordMap(mine._head, 4)
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join(rng.choice(["the", "The", "the,", "é", "École!", "naïve?!", "x" * 60, "a1", "", "|", "日本", "I'm"]) for _ in range(30))
        assert np.frombuffer(mine.encode(text), mine.kind).tolist() == mine.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_cache_stays_bounded_and_computes_frequent_words_once():
    from graphloom.llm.common import WordCache

    asked: list[str] = []
    kept = WordCache(lambda words: [asked.append(w) or w.encode() for w in words], most=8, longest=6)
    for k in range(50):
        words = ["often", f"w{k}", "often", "too long", f"w{k}"]
        assert kept.values(words) == [w.encode() for w in words]
        assert len(kept.kept) <= 4 and len(kept.aside) <= 4 and "too long" not in kept.kept
    assert asked.count("often") == 1 and asked.count("too long") == 50 and asked.count("w7") == 1
    many = [f"m{k}" for k in range(20)]  # more than half of the cache
    assert kept.values([*many, "often"]) == [w.encode() for w in [*many, "often"]]
    assert len(kept.kept) <= 4 and len(kept.aside) <= 4 and kept.values([]) == []


def test_words_are_tokenised_alike_however_often_the_cache_turns_over():
    from graphloom.llm.common import WordCache

    with open(public_tokenizers.path(op6_byte_bpe.RANK_FILE), "rb") as f:
        one, other = op6_byte_bpe.ByteBpe(raw := f.read()), op6_byte_bpe.ByteBpe(raw)
    with open(public_tokenizers.path(op2_token_counts.MODEL), "rb") as f:
        first, second = (op2_token_counts.UnigramCounter(v) for v in [op2_token_counts.read_vocabulary(f.read())] * 2)
    for cache in (one.words, one.after_blank, first.words):
        cache.half = 4
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(rng.choice(["the", "The", "the,", "é", "École!", "naïve?!", "x" * 60, "a1", "", "|", "日本", "I'm", "a\n\nb"]) for _ in range(rng.randrange(30)))
        assert one.encode(text).tolist() == other.encode(text).tolist() and one.decode(one.encode(text).tolist()) == text.encode()
        assert first.count(text) == second.count(text)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_rank_codes_go_there_and_back(n):
    ranks = np.random.default_rng(n).choice([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1], n).astype("<u4")
    control, data = op4_token_files.encode_ranks(ranks)
    assert len(control) == -(-n // 4) and len(data) == sum(max(1, -(-int(r).bit_length() // 8)) for r in ranks)
    assert op4_token_files.decode_ranks(control, data, n).tolist() == ranks.tolist()
