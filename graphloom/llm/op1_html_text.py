"""Main text of web pages: markup decides where it can, a suffix array per host where it can't.

A page is parsed into blocks. Blocks inside <article> or <main> are content, but for menus, sidebars, footers, forms, adverts,
notices and comments in them; outside, such blocks and headers are rejected. This goes by element, by role, and by names in class and
id that say nothing else: "ad" and "share-buttons" do, "social-history" and "entry-header" don't. What stands in
neither is undecided, and there the host's pages are compared: of the hosts that have such blocks, the pages' undecided and rejected blocks are
concatenated to one token stream a page, and all suffixes of the streams are put in order by their first WINDOW tokens, in sorted ranges.
Where neighbours of different pages have these tokens in common, the tokens are a repeated run, and a longer run is
covered by the suffixes that begin in it. Undecided tokens that a repeated run covers are removed, others stay. Runs go
across blocks, so a block of fewer tokens goes only as part of a longer run, and streams of fewer than WINDOW tokens
stay whole. Tokens are compared by 32 bits of their hashes, which order them.

The order is by host, tokens, page and place, dealt in ranges: a host with a third of all pages, or a line that all
pages have, is spread over several tasks. What stands equal across the end of a range is settled by the ranges' first and
last tokens, a row or two a range.

Articles are kept even where pages repeat them, as mirrored articles are main text: a host's mirrors, whose streams are
equal or have MIRROR_SHARE of their windows in common, count as one page, and so do mirrors of these. The common share is
estimated from MINIMA least hashes of the windows; candidates agree in one of BANDS groups of these, and are compared
with the group's first, so their number grows with the pages. Adverts and menus that markup rejects are evidence,
but don't part mirrors. Pages that differ in less than that from each other keep their common text
even if it is a template; where they differ more, only equal runs are removed.

Defined results: null and empty html give the empty text; a null url is a host of its own; rows with equal
page_id are separate pages; white space inside a block becomes one blank, blocks are joined by a newline; text
outside any element counts; unclosed elements end with the element around them; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, pieces, table
from graphloom.operators.components import component_labels
from graphloom.scratch import Scratch

#: Tokens that a run must have to count as repeated.
WINDOW = 8
#: Suffixes of a long page that are written at a time.
PIECE = 1 << 14

#: Of two pages' windows, the share in common from which they are mirrors.
MIRROR_SHARE = 0.8
MINIMA, BANDS = 64, 16

CONTENT, UNDECIDED, REJECTED = 0, 1, 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text.
HIDDEN = frozenset("script style template noscript head title svg math iframe object canvas audio video select textarea button datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
NOT_MAIN = frozenset("nav header footer aside form dialog menu".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption legend".split()
)
#: Elements that a new one of the same group ends.
ENDED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Words of class, id and role that name what isn't main text.
REJECT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside rail widget related recommended "
    "share sharing social newsletter subscribe subscription signup login comment comments disqus respond replies popup modal overlay "
    "contentinfo complementary search toolbar skip".split()
)
#: Words that may stand beside these in a name, and add nothing.
PLAIN_WORDS = frozenset("area bar block body bottom box button buttons container content form group inline inner item items left link links list main outer panel post posts right section site slot thread top unit wrap wrapper".split())
#: What stays rejected although an <article> begins in it.
FIRM_WORDS = frozenset("comment comments disqus respond replies related recommended ad ads advert adverts advertisement advertising sponsored".split())
#: Elements and names that are part of an article if they stand in it.
INNER_PART = frozenset("header masthead".split())
#: Words beside these that tell of a part's header, not of the page's.
PART_WORDS = frozenset("block content item items panel post posts section".split())
MAIN_WORDS = frozenset("article main".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)


def _named(value: str) -> tuple[set[str], set[str]]:
    """Of the names in an attribute's value: the rejecting words of those that say nothing else, and all words."""
    rejecting: set[str] = set()
    every: set[str] = set()
    for name in value.split():
        words = {w for w in _WORDS.findall(_CAMEL.sub(" ", name).lower()) if not w.isdigit()}
        every |= words
        found = words & REJECT_WORDS
        if found and not words - found - PLAIN_WORDS and not (found <= INNER_PART and words & PART_WORDS):
            rejecting |= found
    return rejecting, every


def _mood(name: str, attributes: str, now: int, firm: bool) -> tuple[int, bool, bool]:
    """(zone, firmly rejected, hidden) of an element inside a zone."""
    rejecting: set[str] = set()
    every: set[str] = set()
    hidden = name in HIDDEN
    if attributes and "=" in attributes or "hidden" in attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value):
                hidden = True
            elif key in ("class", "id", "role"):
                for found, words in zip((rejecting, every), _named(value)):
                    found |= words
    if firm:
        return now, True, hidden
    if now == CONTENT:
        inner = (name in NOT_MAIN or bool(rejecting)) and name not in INNER_PART and not (rejecting and rejecting <= INNER_PART)
        return (REJECTED, True, hidden) if inner else (CONTENT, False, hidden)
    if name in MAIN or every & MAIN_WORDS and not rejecting and not every & REJECT_WORDS:
        return (REJECTED, True, hidden) if rejecting & FIRM_WORDS else (CONTENT, False, hidden)
    if rejecting & FIRM_WORDS or name in ("aside", "footer"):
        return REJECTED, True, hidden
    if name in NOT_MAIN or rejecting:
        return REJECTED, False, hidden
    return now, False, hidden


class _Open:
    """The open elements, with where each name and the blocks among them stand, so that no end tag walks over all."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool, bool]] = []  # element, zone, firmly rejected, hidden
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: tuple[str, int, bool, bool]) -> None:
        self.places.setdefault(element[0], []).append(len(self.stack))
        if element[0] in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def mood(self) -> tuple[int, bool, bool]:
        return self.stack[-1][1:] if self.stack else (UNDECIDED, False, False)

    def pop(self, to: int) -> bool:
        """Whether a block was among them."""
        while len(self.stack) > to:
            name = self.stack.pop()[0]
            if name:
                self.places[name].pop()
        found = False
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()
            found = True
        return found

    def place(self, name: str) -> int | None:
        """Where the innermost element of that name stands."""
        found = self.places.get(name)
        return found[-1] if found else None

    def forget(self, name: str) -> None:
        """An inline element ends though blocks are open in it; these keep what they took from it."""
        at = self.places[name].pop()
        self.stack[at] = ("", *self.stack[at][1:])


def blocks_of(page: str) -> list[tuple[str, int]]:
    """(text, zone) of each block with text, in page order."""
    out: list[tuple[str, int]] = []
    pieces: list[str] = []
    opened = _Open()
    zone, firm, hidden = opened.mood()
    at = 0

    def close() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                out.append((text, zone))

    def pop(to: int) -> None:
        nonlocal zone, firm, hidden
        if opened.blocks and opened.blocks[-1] >= to:
            close()
        opened.pop(to)
        zone, firm, hidden = opened.mood()

    while at < len(page):
        found = _TAG.search(page, at)
        upto = found.start() if found else len(page)
        if upto > at and not hidden:
            pieces.append(html.unescape(page[at:upto]))
        if not found:
            break
        at = found.end()
        if found[3] is None:
            if found[1] and not hidden:
                pieces.append(found[1])
            continue
        name = found[3].lower()
        if found[2]:
            place = opened.place(name)
            if place is not None:
                if name not in BLOCKS and opened.blocks and opened.blocks[-1] > place:
                    opened.forget(name)
                else:
                    pop(place)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCKS:
            last = opened.blocks[-1] if opened.blocks else None
            if last is not None and name in ENDED_BY.get(opened.stack[last][0], ()):
                pop(last)  # an unclosed <p> or <li> ends, with what is open in it
            close()
        if name in VOID:
            continue
        inner = _mood(name, found[4], zone, firm)
        if name in RAW:  # up to its own end, whatever stands in it
            at = _RAW_ENDS[name].search(page, at).end()
            continue
        if found[4].endswith("/") and name in HIDDEN:
            continue
        opened.push((name, inner[0], inner[1], inner[2] or hidden))
        zone, firm, hidden = opened.mood()
    close()
    return out


_RAW_ENDS = {name: re.compile(rf"</{name}\b[^>]*>|\Z", re.I) for name in RAW}


def _hash(tokens: list[str]) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t in tokens]


def stream_of(texts: list[str], zones: list[int]) -> list[str]:
    """The tokens of a page's undecided and rejected blocks, in page order."""
    return [t for text, z in zip(texts, zones) if z != CONTENT for t in text.split()]


def windows(tokens: list[str], window: int = WINDOW) -> np.ndarray:
    """A row per suffix of at least so many tokens: the hashes of its first ones, in 32 bits each."""
    hashes = (np.array(_hash(tokens), np.uint64) >> np.uint64(32)).astype(">u4")
    if len(hashes) < window:
        return np.zeros((0, window), ">u4")
    return np.lib.stride_tricks.sliding_window_view(hashes, window)


def _host(url: str | None) -> str | None:
    found = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", url or "", re.I)
    return found[1].rpartition("@")[2].lower() if found else url


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, texts, zones): the blocks of each page."""

    def make():
        def apply(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [blocks_of(x or "") for x in batch.column(2).to_pylist()]
            hosts = pa.array([_host(u) for u in batch.column(1).to_pylist()], pa.string())
            texts = pa.array([[t for t, _ in b] for b in found], pa.list_(pa.string()))
            return [batch.column(0), batch.column(1), hosts, texts, pa.array([[z for _, z in b] for b in found], pa.list_(pa.int32()))]

        return apply

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(chosen, "page_id long, url string, host string, texts array<string>, zones array<int>", make)


_FACTORS = np.random.default_rng(1).integers(0, 1 << 63, MINIMA, np.uint64) << np.uint64(1) | np.uint64(1)


def minima(found: np.ndarray) -> list[int]:
    """MINIMA least hashes of a stream's windows, of one kind of hash each; none without windows."""
    if not len(found):
        return []
    hashes = np.zeros(len(found), np.uint64)
    for k in range(found.shape[1]):
        hashes = (hashes ^ found[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    out = []
    for factor in _FACTORS:
        mixed = hashes * factor
        mixed ^= mixed >> np.uint64(32)
        out.append(int((mixed * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(1)).min()))
    return out


def signatures(undecided: DataFrame) -> DataFrame:
    """(row, host, own, minima): a hash of each undecided stream, and the least hashes of its windows."""

    def make():
        def apply(batch: pa.RecordBatch) -> list[pa.Array]:
            streams = [[t for text, z in zip(texts, zones) if z == UNDECIDED for t in text.split()] for texts, zones in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            own = pa.array([_hash([" ".join(x)])[0] >> 1 for x in streams], pa.int64())
            return [batch.column(0), batch.column(1), own, pa.array([minima(windows(x)) for x in streams], pa.list_(pa.int64()))]

        return apply

    return map_batches(undecided.select("row", "host", "texts", "zones"), "row long, host string, own long, minima array<long>", make)


def with_streams(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages with a column stream, which mirrors have in common."""
    undecided = pages.where(F.array_contains("zones", UNDECIDED))
    marked = scratch.save(signatures(undecided), "signatures")
    distinct = scratch.save(marked.where(F.size("minima") > 0).groupBy("host", "own").agg(F.first("minima").alias("minima")), "streams")
    wide = MINIMA // BANDS
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.xxhash64(F.slice("minima", k * wide + 1, wide)).alias("key")) for k in range(BANDS)))
    dealt = distinct.select("host", "own", F.explode(bands).alias("b")).select("host", "own", "b.band", "b.key")
    firsts = dealt.groupBy(F.col("host").alias("_host"), F.col("band").alias("_band"), F.col("key").alias("_key")).agg(F.min("own").alias("other"), F.count("*").alias("n")).where("n > 1")
    pairs = dealt.join(firsts, F.expr("host <=> _host and band = _band and key = _key")).where("own <> other").select("host", "own", "other").distinct()
    one = distinct.select(F.col("host").alias("_host"), F.col("own").alias("_own"), F.col("minima").alias("a"))
    two = distinct.select(F.col("host").alias("_host2"), F.col("own").alias("_other"), F.col("minima").alias("b"))
    both = pairs.join(one, F.expr("host <=> _host and own = _own")).join(two, F.expr("host <=> _host2 and other = _other"))
    equal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda same: same))
    links = scratch.save(both.where(equal >= MIRROR_SHARE * MINIMA).select("own", "other"), "mirrors")
    labels = component_labels(links, "own", "other", Scratch(pages.sparkSession, "html-mirrors"))
    streams = marked.select(F.col("row").alias("_row"), "own").join(labels, F.col("own") == F.col("id"), "left").select("_row", F.coalesce("label", "own").alias("stream"))
    alone = F.xxhash64(F.lit("alone"), "row")  # a page without undecided blocks mirrors none
    return pages.join(streams, F.col("row") == F.col("_row"), "left").withColumn("stream", F.coalesce("stream", alone)).drop("_row")


def suffixes(pages: DataFrame) -> DataFrame:
    """(key, stream, row, at): each suffix of the streams of pages with_streams(), by its host's hash and its first WINDOW tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for row, host, texts, zones, stream in zip(*(batch.column(k).to_pylist() for k in range(5))):
                tokens = stream_of(texts, zones)
                found = windows(tokens)
                n = len(found)
                if not n:
                    continue
                place = struct.pack(">Q", 0 if host is None else _hash([host])[0] | 1)
                for begin in range(0, n, PIECE):
                    part = found[begin : begin + PIECE]
                    keys = [place + w.tobytes() for w in part]
                    columns = [pa.array(keys, pa.binary()), *(pa.array(np.full(len(part), x, np.int64)) for x in (stream, row)), pa.array(np.arange(begin, begin + len(part)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "stream", "row", "at"])

    return pages.select("row", "host", "texts", "zones", "stream").mapInArrow(run, "key binary, stream long, row long, at long")


def compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, at, key, lo, hi) of the repeated suffixes in a sorted range.

    lo and hi are the least and greatest stream with these tokens. The first and the last tokens of the range may go
    on in another one, so their suffixes have a key, whether repeated or not; key is null where the range decides.
    """
    names = ["row", "at", "key", "lo", "hi"]
    width = 8 + 4 * WINDOW

    def out(rows: np.ndarray, ats: np.ndarray, key: bytes | None, lo: int, hi: int) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ats), pa.array([key] * n, pa.binary()), pa.array(np.full(n, lo)), pa.array(np.full(n, hi))], names=names)

    last: bytes | None = None  # the tokens that the batches before end with
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    lo = hi = 0
    first = True

    def ended(edge: bool) -> Iterator[pa.RecordBatch]:
        if edge or lo != hi:
            for rows, ats in parts:
                yield out(rows, ats, last if edge else None, lo, hi)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        raw = b"".join(batch.column(0).to_pylist())
        keys = np.frombuffer(raw, np.uint8).reshape(n, width)
        streams, rows, ats = (batch.column(k).to_numpy() for k in (1, 2, 3))
        starts = np.concatenate(([0], 1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))))
        ends = np.append(starts[1:], n)
        own = lambda k: keys[starts[k]].tobytes()
        begin = 0
        if own(0) == last:
            parts.append((rows[: ends[0]], ats[: ends[0]]))
            hi, begin = int(streams[ends[0] - 1]), 1
        if begin == len(starts):
            continue
        if last is not None:
            yield from ended(first)
            first = False
        inner = np.arange(begin, len(starts) - 1)
        if first and len(inner):  # the range's first tokens end in this batch
            k = inner[0]
            yield out(rows[starts[k] : ends[k]], ats[starts[k] : ends[k]], own(k), int(streams[starts[k]]), int(streams[ends[k] - 1]))
            inner, first = inner[1:], False
        met = inner[streams[starts[inner]] != streams[ends[inner] - 1]]
        if len(met):
            at = np.concatenate([np.arange(starts[k], ends[k]) for k in met])
            yield out(rows[at], ats[at], None, 0, 1)
        k = len(starts) - 1
        last, parts, lo, hi = own(k), [(rows[starts[k] :], ats[starts[k] :])], int(streams[starts[k]]), int(streams[-1])
    if last is not None:
        yield from ended(True)


def repeated_runs(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, repeated): where in a page's stream the suffixes begin whose first WINDOW tokens another page has."""
    ordered = suffixes(with_streams(pages, scratch)).repartitionByRange("key", "stream", "row", "at").sortWithinPartitions("key", "stream")
    found = scratch.save(ordered.mapInArrow(compare_neighbours, "row long, at long, key binary, lo long, hi long"), "neighbours")
    ends = found.where("key is not null")
    # a row or two a range
    settled = ends.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("key")
    every = found.where("key is null").select("row", "at").unionByName(ends.join(F.broadcast(settled), "key", "left_semi").select("row", "at"))
    return every.groupBy("row").agg(F.collect_list("at").alias("repeated"))


def unique_runs(texts: list[str], zones: list[int], repeated: list[int], window: int = WINDOW) -> list[str]:
    """The blocks of a page without the undecided tokens that a repeated run covers."""
    covered = np.zeros(sum(len(t.split()) for t, z in zip(texts, zones) if z != CONTENT) + window, bool)
    for k in range(window):
        covered[np.array(repeated, np.int64) + k] = True
    out, at = [], 0
    for text, zone in zip(texts, zones):
        if zone != CONTENT:
            tokens = text.split()
            text = " ".join(t for t, c in zip(tokens, covered[at : at + len(tokens)].tolist()) if not c)
            at += len(tokens)
        if zone != REJECTED and text:
            out.append(text)
    return out


def _joined(parsed: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages whose repeated runs are known."""

    def make():
        def apply(batch: pa.RecordBatch) -> list[pa.Array]:
            out = ["\n".join(unique_runs(texts, zones, repeated or [])) for texts, zones, repeated in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            return [batch.column(0), batch.column(1), pa.array(out, pa.string())]

        return apply

    return map_batches(parsed.select("page_id", "url", "texts", "zones", "repeated"), "page_id long, url string, text string", make)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) per page."""
    scratch = Scratch(pages.sparkSession, "html-text")
    parsed = scratch.save(parse_pages(pages).withColumn("row", F.monotonically_increasing_id()), "parsed")
    decided = ~F.array_contains("zones", UNDECIDED)
    undecided = parsed.where(~decided)
    plain = parsed.withColumn("repeated", F.lit(None).cast("array<long>"))
    names = ["page_id", "url", "texts", "zones", "repeated"]
    if undecided.isEmpty():
        return _joined(plain.select(names))
    hosts = undecided.select(F.coalesce("host", F.lit("")).alias("_host"), F.col("host").isNull().alias("_none")).distinct()
    same = (F.coalesce("host", F.lit("")) == F.col("_host")) & (F.col("host").isNull() == F.col("_none"))
    covers = scratch.save(repeated_runs(parsed.join(hosts, same, "left_semi"), scratch), "covers")
    compared = undecided.join(covers, "row", "left")
    return _joined(plain.where(decided).select(names).unionByName(compared.select(names)))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op1_html_text": op1_html_text}
ORACLE: dict[str, str] = {}
