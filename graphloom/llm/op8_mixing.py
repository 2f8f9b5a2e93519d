"""Mixing to target weights: soft domain membership, and nonnegative rates by projected gradient.

Domains are the combinations of the label columns. The classifier is fitted on at most about TRAIN_ROWS labelled
documents. Its features are the words that a document has, hashed, and the levels of three shapes: the shares of symbols, of
capitals and of words that repeat the one before. A feature's evidence for a domain is the log ratio of its frequency
inside and outside the domain, moved towards zero by SHRINK_ERRORS standard errors and by SHRINK_BY, so that only decisive
features are left and the many weak ones of a long text can't outvote them. A document's score for a domain is the
log of its share plus the evidence. One in CALIBRATE_EVERY of the labelled rows is kept from this and turns scores s into
posteriors, softmax(scale * s + shift): the scale and each domain's shift are those that make these rows' labels likeliest
(multinomial logistic regression by Newton steps), held to the scores' own posterior, scale 1 and shifts 0, by PRIOR.
So a document's posterior depends on its scores of all domains.

With n the tokens (words) of a document, p its posterior and r its rate, a mixture has sum(r * n * p[d]) expected
tokens of domain d.
Projected gradient descent fits rates r >= 0 whose expected totals match the targets in the least-squares sense,
from r = 1 on. The step is the gradient of the W-weighted squares in the metric that n gives, taken before the projection:

    y <- y - p . W (A r - t),   r = max(0, y),   A r = sum(r * n * p),   W = inverse of sum(n * p p^T) + DAMPING * its mean diagonal

So y = 1 - p . m for one m of the domains' number, which is all that a step changes, and rates that meet the targets are the ones
nearest to 1. The damping keeps W bounded where domains can't be told apart. The first steps are taken on the
documents' cells, at most MOST_CELLS sums of documents with posteriors about equal, which come to the driver; from where these lead to,
each step aggregates all documents. Steps end when the targets are met, or when one gains less than LEAST_GAIN of the squares.
The greatest share of the mixture that is off its target is returned as unmet.
Rates may be scaled together without changing the mixture: the greatest rate of the documents that are likeliest of the domain with
the largest target weight becomes 1, so that none of these is repeated and the purest of them all stay.

All of it is DataFrame functions; what comes to the driver is of the size of the domains. The model has
BUCKETS rows at most whatever the corpus, and it is broadcast only if its counted rows are few.

Defined results: rows with one doc_id are one document with the sum of their words and evidence, and so are rows without one that have equal texts; documents
without words have no evidence but their shapes, and no tokens; a word counts once a row as evidence; equal scores go to the domain that sorts first; labels that are null, and labels of
unknown documents, aren't learned from; more than MOST_DOMAINS combinations of labels raise ValueError; several labels of one document each count; without labels there is one
domain and every rate is 1; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, table
from graphloom.scratch import Scratch

#: Labelled documents that the classifier is fitted on, about, at most.
TRAIN_ROWS = 20_000
#: Buckets of features; a document's first feature is one that all have.
BUCKETS = 1 << 20
#: Levels of a shape, from 0 to 1.
LEVELS = 20
SMOOTHING = 0.5
SHRINK_ERRORS = 1.0
SHRINK_BY = 2.0
CALIBRATE_EVERY = 4
#: Precision of the prior of scale and shifts.
PRIOR = 1.0
NEWTON_STEPS = 30
#: Rows of the model up to which it is broadcast.
BROADCAST_ROWS = 1 << 18
SEED = 8
TARGETS = {"quality=1,toxic=0": 0.90, "quality=0,toxic=0": 0.08, "quality=1,toxic=1": 0.01, "quality=0,toxic=1": 0.01}
MOST_DOMAINS = 64
STEPS = 60
#: Distance to the targets, as a share of their total, at which they count as met.
TOLERANCE = 1e-4
LEAST_GAIN = 1e-3
DAMPING = 0.1
#: Levels of the two greatest posteriors that make a cell, unless there are more than MOST_CELLS of them.
CELL_LEVELS = 32
MOST_CELLS = 1 << 14


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[ .,;:!?|\n\t]+"), "")


def text_key(id_: Column, text: Column) -> Column:
    """Tells rows without an id apart; null where there is one."""
    return F.when(id_.isNull(), F.xxhash64(text))


def _with_features(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(_id, _key, *keep, n_tokens, pos, bucket): a row per document and feature, and its number of words."""
    keep = ("_key", *keep)
    read = docs.select(F.col(id_col).alias("_id"), text_key(F.col(id_col), F.col(text_col).cast("string")).alias("_key"), *keep[1:], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    read = read.select("_id", *keep, "_text", words(F.col("_text")).alias("_words"))
    again = F.filter(F.zip_with("_words", F.slice("_words", 2, F.size("_words")), lambda a, b: a == b), lambda same: same)

    def level(part: Column, whole: Column) -> Column:
        return F.floor(LEVELS * part / F.greatest(whole, F.lit(1))).cast("string")

    symbols, capitals = (F.length(F.regexp_replace("_text", drop, "")) for drop in (r"[\p{L}\p{N}\s]+", r"[^\p{Lu}]+"))
    # words have no blanks, so shapes are none of them
    shapes = F.array(F.lit(" all"), *(F.concat(F.lit(f" {name} "), x) for name, x in (
        ("symbols", level(symbols, F.length("_text"))),
        ("capitals", level(capitals, F.length("_text"))),
        ("again", level(F.size(again), F.size("_words"))),
    )))
    listed = read.select("_id", *keep, F.size("_words").alias("n_tokens"), F.posexplode(F.concat(shapes, F.array_distinct("_words"))).alias("pos", "w"))
    return listed.select("_id", *keep, "n_tokens", "pos", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def domain_of(columns: list[str]) -> Column:
    """Name of a row's combination of labels; null if one of them is."""
    return F.concat(*(x for k, c in enumerate(columns) for x in (F.lit("," * bool(k) + f"{c}="), F.col(c).cast("string"))))


@dataclass
class Classifier:
    domains: list[str]
    shares: list[float]
    model: DataFrame  # (bucket, l0, l1, ...): evidence of a feature by domain, for features that have any
    model_rows: int
    scale: float = 1.0
    shifts: list[float] | None = None


def fit_classifier(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label_cols: tuple[str, ...] = ("quality", "toxic"), most: int = TRAIN_ROWS) -> Classifier:
    named = labels.select(F.col(id_col).alias("_label_id"), domain_of(list(label_cols)).alias("domain")).where("_label_id is not null and domain is not null")
    n = named.count()
    if n > most:
        named = named.where(F.pmod(F.xxhash64("_label_id", F.lit(SEED)), F.lit(1 << 20)) < int((1 << 20) * most / n))
    named = scratch.save(named, "labelled")
    if named.count() <= 2 * most:  # so by the hash, but for its scatter
        named = F.broadcast(named)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_sample_text")).join(named, F.col("_id") == F.col("_label_id"))
    sample = sample.select("_id", "_sample_text", "domain", (F.pmod(F.xxhash64("_id", F.lit(SEED + 1)), F.lit(CALIBRATE_EVERY)) == 0).alias("kept_out"))
    listed = _with_features(sample, "_id", "_sample_text", "domain", "kept_out")
    counted = scratch.save(listed.where("not kept_out").groupBy("domain", "bucket").agg(F.count("*").alias("n"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("docs")), "feature-counts")
    rows = {r["domain"]: r["n"] for r in counted.groupBy("domain").agg(F.sum("docs").alias("n")).orderBy("domain").limit(MOST_DOMAINS + 1).collect()}
    if len(rows) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} combinations of {label_cols}")
    if not rows:
        rows = {"all": 1}
    domains, whole = sorted(rows), sum(rows.values())
    evidence = []
    for d in domains:
        inside = F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)) + SMOOTHING
        outside = F.coalesce(F.sum(F.when(F.col("domain") != d, F.col("n"))), F.lit(0)) + SMOOTHING
        ratio = F.log(inside / (rows[d] + 2 * SMOOTHING)) - F.log(outside / (whole - rows[d] + 2 * SMOOTHING))
        error = F.sqrt(1 / inside + 1 / outside)
        evidence.append(F.signum(ratio) * F.greatest(F.lit(0.0), F.abs(ratio) - SHRINK_ERRORS * error - SHRINK_BY))
    every = counted.groupBy("bucket").agg(*(x.alias(f"l{k}") for k, x in enumerate(evidence)))
    model = scratch.save(every.where(reduce(or_, (F.col(f"l{k}") != 0 for k in range(len(domains))))), "model")
    fitted = Classifier(domains, [rows[d] / whole for d in domains], model, model.count())
    # a share of the sample, whatever the corpus, and read by every step
    kept_out = scratch.save(scratch.save(_scores(listed.where("kept_out"), fitted, "domain"), "kept-out").coalesce(1), "kept-out-rows")
    fitted.scale, fitted.shifts = _calibration(kept_out, domains)
    return fitted


def _scores(listed: DataFrame, fitted: Classifier, *keep: str) -> DataFrame:
    """(_id, _key, *keep, n_tokens, s0, s1, ...) per document, from the rows of _with_features()."""
    k = len(fitted.domains)
    model = F.broadcast(fitted.model) if fitted.model_rows <= BROADCAST_ROWS else fitted.model
    met = listed.join(model, "bucket", "left").where("pos = 0 or l0 is not null")  # a row per document, and those with evidence
    return met.groupBy("_id", "_key", *keep).agg(
        F.sum(F.when(F.col("pos") == 0, F.col("n_tokens")).otherwise(0)).alias("n_tokens"),
        *((F.coalesce(F.sum(f"l{d}"), F.lit(0.0)) + math.log(s)).alias(f"s{d}") for d, s in enumerate(fitted.shares)),
    )


def _softmax(scored: DataFrame, scale: float, shifts: list[float], *keep: str) -> DataFrame:
    """(*keep, top, whole, p0, p1, ...): the posteriors, of which top and whole are greatest exponent and sum."""
    k = len(shifts)
    raised = scored.select(*keep, *((F.lit(scale) * F.col(f"s{d}") + F.lit(b)).alias(f"_z{d}") for d, b in enumerate(shifts)))
    raised = raised.withColumn("top", F.greatest(*(F.col(f"_z{d}") for d in range(k))) if k > 1 else F.col("_z0"))
    raised = raised.select(*keep, "top", *(F.exp(F.col(f"_z{d}") - F.col("top")).alias(f"_e{d}") for d in range(k)))
    raised = raised.withColumn("whole", sum((F.col(f"_e{d}") for d in range(1, k)), F.col("_e0")))
    return raised.select(*keep, "top", "whole", *((F.col(f"_e{d}") / F.col("whole")).alias(f"p{d}") for d in range(k)))


def _calibration(kept_out: DataFrame, domains: list[str]) -> tuple[float, list[float]]:
    """Scale and shifts of the likeliest posteriors for the rows' domains. Each step is one aggregate of the domains' number squared."""
    k = len(domains)
    known = kept_out.where(F.col("domain").isin(domains))
    s, p, y = ([F.col(f"s{d}") for d in range(k)], [F.col(f"p{d}") for d in range(k)], [F.when(F.col("domain") == d, 1.0).otherwise(0.0) for d in domains])
    mean = sum((p[d] * s[d] for d in range(1, k)), p[0] * s[0])
    own = sum((y[d] * s[d] for d in range(1, k)), y[0] * s[0])
    square = sum((p[d] * s[d] * s[d] for d in range(1, k)), p[0] * s[0] * s[0]) - mean * mean

    def measured(at: list[float]) -> tuple[float, list[float], list[list[float]]]:
        """Loss, its gradient and its second derivatives, by scale and shifts."""
        shift = sum((y[d] * F.lit(at[1 + d]) for d in range(k)), F.lit(0.0))
        found = {"loss": F.col("top") + F.log("whole") - F.lit(at[0]) * own - shift, "g0": mean - own, "h0_0": square}
        found |= {f"g{1 + d}": p[d] - y[d] for d in range(k)} | {f"h0_{1 + d}": p[d] * (s[d] - mean) for d in range(k)}
        found |= {f"h{1 + a}_{1 + b}": p[a] * ((1.0 if a == b else 0.0) - p[b]) for a in range(k) for b in range(a, k)}
        row = _softmax(known, at[0], at[1:], "domain", *(f"s{d}" for d in range(k))).agg(*(F.sum(x).alias(name) for name, x in found.items())).first()
        held = [at[0] - 1, *at[1:]]
        loss = float(row["loss"] or 0) + PRIOR / 2 * sum(x * x for x in held)
        second = [[float(row[f"h{min(a, b)}_{max(a, b)}"] or 0) + PRIOR * (a == b) for b in range(k + 1)] for a in range(k + 1)]
        return loss, [float(row[f"g{a}"] or 0) + PRIOR * held[a] for a in range(k + 1)], second

    at = [0.0] * (k + 1)  # where no posterior is near 0 or 1
    loss, slope, second = measured(at)
    length = 1.0
    for _ in range(NEWTON_STEPS):
        move = _solve(second, slope, 0.0)
        gain = sum(x * y for x, y in zip(move, slope))
        if gain * length < 1e-9 * (1 + loss):
            break
        then = [x - length * m for x, m in zip(at, move)]
        new = measured(then)
        if new[0] <= loss - 1e-4 * length * gain:
            at, (loss, slope, second), length = then, new, 1.0
        else:
            length /= 2
    return at[0], at[1:]


def posteriors(docs: DataFrame, fitted: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_tokens, p0, p1, ...) per document."""
    scored = _scores(_with_features(docs, id_col, text_col), fitted)
    return _softmax(scored, fitted.scale, fitted.shifts, "_id", "_key", "n_tokens").drop("top", "whole").withColumnsRenamed({"_id": "doc_id", "_key": "text_key"})


def _solve(matrix: list[list[float]], right: list[float], damping: float = DAMPING) -> list[float]:
    """Gauss elimination, for a damped symmetric matrix of the domains' number."""
    n = len(right)
    ridge = damping * sum(matrix[k][k] for k in range(n)) / n
    rows = [[*matrix[k], right[k]] for k in range(n)]
    for k in range(n):
        rows[k][k] += ridge
    for k in range(n):
        at = max(range(k, n), key=lambda i: abs(rows[i][k]))
        rows[k], rows[at] = rows[at], rows[k]
        for i in range(n):
            if i != k:
                f = rows[i][k] / rows[k][k]
                rows[i] = [x - f * y for x, y in zip(rows[i], rows[k])]
    return [rows[k][n] / rows[k][k] for k in range(n)]


def _steps(measure, targets: list[float], gram: list[list[float]], total: float, move: list[float], steps: int) -> tuple[list[float], list[float]]:
    """m after at most so many steps from move, and the totals there; measure(m) gives the totals of rates max(0, 1 - p . m)."""
    got, before = measure(move), math.inf
    for _ in range(steps):
        off = [a - w * total for a, w in zip(got, targets)]
        change = _solve(gram, off)
        squares = sum(x * y for x, y in zip(off, change))
        if math.sqrt(sum(x * x for x in off)) <= TOLERANCE * total or before - squares <= LEAST_GAIN * before < math.inf:
            break
        before = squares
        move = [m + x for m, x in zip(move, change)]
        got = measure(move)
    return move, got


def _cells(members: DataFrame, k: int) -> list[tuple[float, list[float]]]:
    """(tokens, mean posterior) of documents whose two likeliest domains, and these posteriors by level, are the same."""
    levels = max(1, min(CELL_LEVELS, math.isqrt(MOST_CELLS // (k * k))))
    ordered = F.sort_array(F.array(*(F.struct(F.col(f"p{d}").alias("p"), F.lit(d).alias("d")) for d in range(k))), asc=False)
    level = lambda p: F.least(F.floor(p * levels), F.lit(levels - 1))
    key = [F.col("_o")[j][x] if x == "d" else level(F.col("_o")[j][x]) for j in range(min(k, 2)) for x in "dp"]
    n = F.col("n_tokens")
    found = members.withColumn("_o", ordered).groupBy(*(x.alias(f"_c{j}") for j, x in enumerate(key))).agg(F.sum(n).alias("n"), *(F.sum(n * F.col(f"p{d}")).alias(f"a{d}") for d in range(k)))
    return [(float(r["n"]), [r[f"a{d}"] / r["n"] for d in range(k)]) for r in found.where("n > 0").collect()]  # at most k * k * levels * levels


def fit_rates(members: DataFrame, domains: list[str], targets: dict[str, float], scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """members (n_tokens, p0, ...) with columns rate, fitted over all documents, and unmet, the same in all rows."""
    k = len(domains)
    weights = [targets.get(d, 0.0) for d in domains]
    if not sum(weights):
        weights = [1.0] * k
    weights = [w / sum(weights) for w in weights]
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    n = F.col("n_tokens")
    posterior = [F.col(f"p{d}") for d in range(k)]

    def rate(move: list[float]) -> Column:
        return F.greatest(F.lit(0.0), 1 - sum((F.lit(m) * p for m, p in zip(move, posterior)), F.lit(0.0)))

    def totals(move: list[float]) -> list[float]:
        row = members.agg(*(F.sum(rate(move) * n * p).alias(f"a{d}") for d, p in enumerate(posterior))).first()
        return [float(row[f"a{d}"] or 0) for d in range(k)]

    row = members.agg(*(F.sum(n * posterior[a] * posterior[b]).alias(f"g{a}_{b}") for a, b in pairs), *(F.sum(n * p).alias(f"a{d}") for d, p in enumerate(posterior))).first()
    gram = [[float(row[f"g{min(a, b)}_{max(a, b)}"] or 0) for b in range(k)] for a in range(k)]
    if not any(gram[d][d] for d in range(k)):
        return members.withColumns({"rate": F.lit(1.0), "unmet": F.lit(0.0)})
    got = [float(row[f"a{d}"] or 0) for d in range(k)]
    best = max(range(k), key=lambda d: weights[d])
    total = got[best] / weights[best] if got[best] else sum(got)
    cells = _cells(members, k)

    def cell_totals(move: list[float]) -> list[float]:
        rates = [n * max(0.0, 1 - sum(m * x for m, x in zip(move, p))) for n, p in cells]
        return [sum(r * p[d] for r, (_, p) in zip(rates, cells)) for d in range(k)]

    move, _ = _steps(cell_totals, weights, gram, total, [0.0] * k, steps)
    move, got = _steps(totals, weights, gram, total, move, steps)
    whole = sum(got)
    unmet = max(abs(a / whole - w) for a, w in zip(got, weights)) if whole else 1.0
    return _scaled(scratch.save(members.withColumns({"rate": rate(move), "unmet": F.lit(unmet)}), "rates"), best, k)


def _scaled(fitted: DataFrame, best: int, k: int) -> DataFrame:
    """Rates in the same proportions, with 1 as the greatest of the documents that are likeliest of the domain best."""
    likeliest = reduce(and_, (F.col(f"p{best}") >= F.col(f"p{d}") for d in range(k)))
    top = fitted.where(likeliest).agg(F.max("rate").alias("top")).first()["top"]
    return fitted.withColumn("rate", F.col("rate") / top) if top else fitted


def copies(rate: Column, key: Column) -> Column:
    """Whole copies whose mean is rate: a hash of the key decides on the rest."""
    chance = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """(doc_id, text_key, n_tokens, p0, ..., rate, unmet) per document, and the domains in order."""
    scratch = Scratch(docs.sparkSession, "mixing")
    fitted = fit_classifier(docs, labels, scratch)
    members = scratch.save(posteriors(docs, fitted), "members")
    return fit_rates(members, fitted.domains, targets or TARGETS, scratch), fitted.domains


def _copies_of(rates: DataFrame) -> Column:
    return copies(F.col("rate"), F.coalesce(F.col("doc_id"), F.col("text_key")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates, domains = mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    best = F.array_max(F.array(*(F.struct(F.col(f"p{k}").alias("p"), F.lit(d).alias("d")) for k, d in enumerate(domains))))
    return rates.select("doc_id", "n_tokens", best["d"].alias("top_domain"), best["p"].alias("top_p"), "rate", _copies_of(rates).alias("copies"), "unmet")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document stands as often as its rate says."""
    rates, _ = mixing_rates(docs, table(spark, sf_dir, "labels"))
    own, key, number, copy = fresh(docs, "_id", "_key", "_copies", "_copy")
    drawn = rates.select(F.col("doc_id").alias(own), F.col("text_key").alias(key), _copies_of(rates).alias(number)).where(F.col(number) > 0)
    met = docs.join(drawn, F.col("doc_id").eqNullSafe(F.col(own)) & text_key(F.col("doc_id"), F.col("text").cast("string")).eqNullSafe(F.col(key)))
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(number)))).select(docs.columns)


QUERIES = {"op8_mixing": op8_mixing}
ORACLE: dict[str, str] = {}
