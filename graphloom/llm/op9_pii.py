"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Everything is Column expressions. A kind's matches come from regexp_extract_all; their places come from
splitting the text at the same expression, as the lengths of what lies between and of the matches add up to the
offsets. The expressions start only where a run of their characters starts, or where the last match
ended, and repeat possessively, which gives the same leftmost matches in linear time without deep recursion. An iban's
repeats exactly as often as its country's length asks, so what follows after a blank is never taken for a part of it.

Base kinds: email; ip with parts at most 255; card, 13 to 19 digits that pass Luhn; phone, 9 to 15 digits. The
method adds iban, of a country of IBAN_LENGTHS and its length, confirmed by mod-97. Every span has a score: the kind's own
confidence, more if one of the kind's words stands near, less if one of the words stands there that such numbers have without being
personal. Near are the CONTEXT characters before and after the span, back to the match before last and on to the next match of the kind.
Scores rank spans; base spans stay whatever their score.

Defined results: null counts as the empty text; offsets are code points, the end exclusive; kinds may overlap
and each is listed; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fresh, table

CONTEXT = 40
BLOCK = 256

#: Countries by the length of their IBANs: the registry's, and those that use IBANs without being in it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBANS = "|".join(rf"(?:{'|'.join(countries.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, countries in IBAN_LENGTHS.items())


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # a Java expression
    words: str  # an expression for words that make it likelier
    score: float
    against: str  # an expression for words that make it less likely
    needs: str = ""  # an expression without which no match is possible; cheaper to test
    bonus: float = field(default=0.2)
    malus: float = field(default=0.3)


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"(?i)\b(e-?mail|mail|contact|write|correo|courriel)\b", 0.8, r"(?i)\b(example|noreply|no-reply)\b", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"(?i)\b(ip|address|host|server|adresse|direcci[oó]n)\b", 0.6, r"(?i)\b(version|release|section|chapter|v)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"(?i)\b(card|visa|credit|payment|karte|carte|tarjeta)\b", 0.7, r"(?i)\b(isbn|order|invoice|tracking|serial)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"(?i)\b(phone|call|tel|mobile|telefon|t[eé]l[eé]phone|tel[eé]fono)\b", 0.6, r"(?i)\b(fax|sum|total|offset)\b", "+"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS})(?![A-Za-z0-9])", r"(?i)\b(iban|account|bank|konto|compte|cuenta)\b", 0.8, r"(?i)\b(serial|part|order)\b"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test: from the right, every second digit doubled."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 by 97."""
    plain = F.regexp_replace(text, "\\x20", "")
    moved = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("string")).otherwise((F.ascii(c) - 55).cast("string"))
    numbers = F.transform(F.split(moved, ""), lambda c: value(c))
    step = lambda r, n: ((r * F.when(F.length(n) == 2, 100).otherwise(10) + F.coalesce(n.try_cast("int"), F.lit(0))) % 97).cast("int")
    return (F.aggregate(numbers, F.lit(0), step) == 1) & F.length(plain).between(15, 34)


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return text.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = _digits(text)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(text)).between(9, 15)
    if kind == "iban":
        return mod97(text)
    return F.lit(True)


def _matches(kind: Kind, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return F.when(F.instr(text, kind.needs) > 0, found).otherwise(none) if kind.needs else found


PAIR = "struct<before:string,m:string,lead:string,trail:string>"
SPAN = "struct<start:int,end:int,score:double>"


def _between(kind: Kind, text: Column, matches: Column) -> Column:
    """What lies before, between and after the matches."""
    return F.when(F.size(matches) > 0, F.split(text, kind.pattern, -1)).otherwise(F.array().cast("array<string>"))


def _pairs(between: Column, matches: Column) -> Column:
    """Each match with the text between the match before and it, and the CONTEXT characters around."""
    n = F.size(matches)
    none = F.array(F.lit(""))
    ahead = lambda x: F.concat(none, F.slice(x, F.lit(1), n - 1))
    back = F.zip_with(F.zip_with(ahead(between), ahead(matches), lambda x, y: F.concat(x, y)), F.slice(between, F.lit(1), n), lambda x, y: F.right(F.concat(x, y), F.lit(CONTEXT)))
    around = F.zip_with(back, F.slice(between, F.lit(2), n), lambda x, y: F.struct(x.alias("lead"), F.left(y, F.lit(CONTEXT)).alias("trail")))
    own = F.zip_with(F.slice(between, F.lit(1), n), matches, lambda x, y: F.struct(x.alias("before"), y.alias("m")))
    both = F.zip_with(own, around, lambda x, y: F.struct(x["before"].alias("before"), x["m"].alias("m"), y["lead"].alias("lead"), y["trail"].alias("trail")))
    return F.when(n > 0, both).otherwise(F.array().cast(f"array<{PAIR}>"))


def _spans(kind: Kind, pairs: Column) -> Column:
    """Array of (start, end, score) of the confirmed matches.

    Offsets are running sums. They are taken in blocks of BLOCK matches, as adding to an array copies it.
    """
    length = lambda x: F.length(x["before"]) + F.length(x["m"])
    near = lambda x, words: x["lead"].rlike(words) | x["trail"].rlike(words)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        end = start + F.length(x["m"])
        score = F.lit(kind.score) + F.when(near(x, kind.words), kind.bonus).otherwise(0.0) - F.when(near(x, kind.against), kind.malus).otherwise(0.0)
        span = F.struct(start.alias("start"), end.alias("end"), F.round(score, 2).alias("score"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.when(_valid(kind.name, x["m"]), span))).alias("spans"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda k: F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)))
    totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + length(x)))
    starts = F.aggregate(totals, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    walk = lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")), step, lambda s: s["spans"])
    walked = F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), walk))
    return F.when(F.size(pairs) > 0, F.filter(walked, lambda s: s.isNotNull())).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with an array of (start, end, score) spans per kind, named after it with `_spans`; a column of that name is replaced."""
    text, kept = F.coalesce(F.col(text_col).cast("string"), F.lit("")), [c for c in docs.columns if c not in {f"{k.name}_spans" for k in KINDS}]
    found, cut = (dict(zip(KINDS, fresh(docs, *(f"_{k.name}_{part}" for k in KINDS)))) for part in ("matches", "between"))
    return (
        docs.withColumns({found[k]: _matches(k, text) for k in KINDS})
        .withColumns({cut[k]: _between(k, text, F.col(found[k])) for k in KINDS})
        .withColumns({found[k]: _pairs(F.col(cut[k]), F.col(found[k])) for k in KINDS})
        .select(*kept, *(_spans(k, F.col(found[k])).alias(f"{k.name}_spans") for k in KINDS))
    )


def _listed(names: tuple[str, ...], *more: str) -> Column:
    """kind:start:end of the kinds' spans, and more of their fields, comma-joined."""
    spelled = lambda name: lambda s: F.concat_ws(":", F.lit(name), s["start"], s["end"], *(s[c] for c in more))
    return F.array_join(F.concat(*(F.transform(F.col(f"{n}_spans"), spelled(n)) for n in names)), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    every = tuple(k.name for k in KINDS)
    best = F.array_max(F.concat(*(F.transform(f"{n}_spans", lambda s: s["score"]) for n in every)))
    return found.select(
        "doc_id",
        *(F.size(f"{n}_spans").cast("long").alias(f"n_{n}") for n in BASE),
        F.sha2(_listed(BASE), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        _listed(every, "score").alias("scores"),
        best.alias("top_score"),
    )


#: Longest formats first, so that a part of one isn't taken for another kind.
REDACTED = ("email", "iban", "phone", "card", "ip")


def _masked(kind: Kind):
    return lambda m: F.when(_valid(kind.name, m), f"<{kind.name.upper()}>").otherwise(m)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every confirmed match replaced by its kind in angle brackets, one kind after the other.

    Where matches of two kinds overlap, the kind that is earlier in REDACTED is replaced first.
    """
    names, text = docs.columns, F.col(text_col)
    found, cut = fresh(docs, "_matches", "_between")
    for kind in sorted(KINDS, key=lambda k: REDACTED.index(k.name)):
        docs = docs.withColumn(found, _matches(kind, text)).withColumn(cut, _between(kind, text, F.col(found)))
        masked = F.transform(found, _masked(kind))
        pieces = F.zip_with(cut, F.concat(masked, F.array(F.lit(""))), lambda x, y: F.concat(x, y))
        docs = docs.withColumn(text_col, F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)).select(names)
    return docs


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is replaced; n_chars follows the new text."""
    changed = redact(docs)
    return changed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


QUERIES = {"op9_pii": op9_pii}
ORACLE: dict[str, str] = {}
