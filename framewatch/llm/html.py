"""The main text of web pages: structure of the page, and passages that pages of one host repeat.

A page becomes a list of text blocks; those inside its article (or main) element
are its text, and its paragraphs and headings there are not in doubt. In doubt are
list items and bare divisions inside an article, what lies in an element whose class
may or may not name clutter, and all blocks of a page that marks no article. On every page
what pages of the host repeat is boilerplate, and structure checks that: what lies in menus
and the like goes even if no page repeats it. The token streams of
the host's blocks (an article's prose left out) are laid end to end, a suffix array
sorts their suffixes, and neighbours with RUN tokens in common or more (its LCP
array) form the repeated runs, with the distinct pages that share each. Longer
repeated substrings are chains of such runs. Blocks mostly covered by runs of
PAGES pages or more go; the unique runs stay. Pages of equal tokens count as one; an
article that would lose half of its tokens keeps all, and a page without one of
which nothing would be left keeps the blocks that the fewest pages share. A host
with many pages is dealt into groups of about GROUP distinct pages, a suffix array
each; the groups' counts of each run are added up, so that grouping changes no
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

from framewatch.llm.common import kept, runs_of, slices, texts, widened
from framewatch.llm.fmindex import suffix_order
from framewatch.llm.words import Words, grams, words

#: Distinct pages of one host in one suffix array; hosts with more are dealt into groups, whose counts are added up.
GROUP = 512
#: Tokens of a repeated run at least, distinct pages that share it, share of a block that must be covered.
RUN, PAGES, COVERED = 6, 3, 0.8
#: Hosts whose list is broadcast, and pages that the array takes blocks from; beyond, they are joined.
BROADCAST_HOSTS, BROADCAST_PAGES = 100_000, 1_000_000
#: A block of prose among those that the array judges.
PROSE = "\x00prose\x00"

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
#: HTML elements by how their text counts.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "video", "audio", "head", "fieldset"}
BLOCKS = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "footer", "hgroup", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "thead", "tfoot", "tr", "ul", "aside", "caption",
}
SPACES = {"br", "td", "th", "wbr", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of a class, id or role that name something other than the article.
CLUTTER = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs",
    "header", "masthead", "footer", "sidebar", "aside", "complementary", "contentinfo", "widget", "related", "recommended", "share", "sharing", "social", "cookie", "cookies", "consent",
    "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "login", "signup", "search", "pagination", "pager", "toolbar", "comment", "comments",
    "disqus", "replies", "respond", "skip",
}
#: Elements of an article whose own text may be other than prose.
DOUBTED = {"div", "section", "ul", "ol", "li", "dl", "dt", "dd", "details", "summary", "address", "center"}
COMMENTS = {"comment", "comments", "disqus", "replies", "respond"}
#: Words that make of such a name a remark on what is beside it.
REMARKS = {"has", "with", "no", "not", "without", "is", "hide", "show", "js", "enable", "enabled", "disable", "disabled"}
#: Elements that may carry such a name. Articles and headings may not; an ``article`` or ``main`` inside one ends what it says.
_CONTAINERS = {"div", "section", "ul", "ol", "aside", "span", "table", "dl", "p", "details", "center"}


@dataclass
class Block:
    text: str
    main: bool
    dropped: bool
    doubt: bool


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with what its structure says of each."""
    out: list[Block] = []
    piece: list[str] = []
    mains: list[str] = []  # open article and main elements
    drop, depth, hard = "", 0, False  # the element whose text doesn't count, and how often its tag is open
    heading = False
    inner = ""  # the block element that was opened last and not closed
    vague, open_vague = "", 0  # the element whose name leaves its text in doubt, and how often its tag is open
    at, size = 0, len(page)

    def close() -> None:
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                out.append(Block(text, bool(mains), bool(drop) and not (heading and mains), inner in DOUBTED or bool(vague)))
            piece.clear()

    while at < size:
        found = _TAG.search(page, at)
        if not found:
            piece.append(page[at:])
            break
        if found.start() > at:
            piece.append(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in BLOCKS or name in DROPPED:
                close()
                inner = ""
            elif name in SPACES:
                piece.append(" ")
            if vague == name:
                open_vague -= 1
                if not open_vague:
                    close()
                    vague = ""
            if drop == name:
                depth -= 1
                if not depth:
                    close()
                    drop = ""
            elif name in mains:
                close()
                del mains[len(mains) - 1 - mains[::-1].index(name) :]
                if not hard:
                    drop, depth = "", 0
            if name in {"h1", "h2", "h3"}:
                heading = False
            continue
        if name in RAW:
            close_at = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = close_at.start() if close_at else size
            continue
        if name in BLOCKS or name in DROPPED:
            close()
            inner = name
        elif name in SPACES:
            piece.append(" ")
        if name in VOID or found[3].rstrip().endswith("/"):
            continue
        if name in {"h1", "h2", "h3"}:
            heading = drop == "header"
        if drop:
            if name == drop:
                depth += 1
            elif name in {"article", "main"} and not hard:  # an element that was never closed
                drop, depth = "", 0
        if vague == name:
            open_vague += name != "p"  # a paragraph ends the one before
            vague = "" if name == "p" else vague
        if not drop:
            clutter, spoken, doubt = _clutter(name, found[3])
            if doubt and not clutter and not vague:
                close()
                vague, open_vague = name, 1
            if name in DROPPED or clutter:
                close()
                drop, depth, hard = name, 1, spoken
            elif name in {"article", "main"} or name == "div" and 'role="main"' in found[3]:
                mains.append(name)
    close()
    return out


def _clutter(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's class, id or role names clutter, whether that is readers' comments, and whether it may name clutter.

    A name is what white space separates. It is clutter if it is such a word, or if
    the last of its parts is one (``site-header``); any other part being one
    (``share-price``, ``sidebar-left``) leaves it in doubt. One with a remark
    (``has-sidebar``) says nothing.
    """
    if name not in _CONTAINERS or not attributes.strip():
        return False, False, False
    sure: set[str] = set()
    vague = hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in {"class", "id", "role"}:
            for token in value.split():
                parts = _WORD.findall(_HUMP.sub(r"\1-\2", token).lower())
                if REMARKS.isdisjoint(parts):
                    sure.update(parts[-1:])
                    vague |= not CLUTTER.isdisjoint(parts[:-1])
        value = value.lower()
        hidden |= key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "")
    return hidden or not CLUTTER.isdisjoint(sure), not COMMENTS.isdisjoint(sure), vague


@dataclass
class Page:
    """What a page's structure gives: blocks, which of them go anyhow and which stay; the tokens of the latter; a hash of all its tokens."""

    blocks: list[str]
    dropped: list[bool]
    sure: list[bool]
    prose: int
    same: int

    text = None  # it waits for the host's array


def parsed(page: str) -> Page:
    found = blocks(page)
    same = int.from_bytes(blake2b(" ".join(b.text for b in found).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
    if all(b.dropped for b in found):
        return Page([], [], [], 0, same)
    marked = any(b.main and not b.dropped for b in found)
    sure = [b.main and not b.dropped and not b.doubt for b in found]
    dropped = [b.dropped or marked and not b.main for b in found]
    return Page([b.text for b in found], dropped, sure, sum(b.text.count(" ") + 1 for b, s in zip(found, sure) if s), same)


def _tokens(streams: list[list[str]]) -> tuple[Words, np.ndarray]:
    """The words of all blocks, and the page of each word."""
    w = words(texts(pa.array([b for s in streams for b in s], pa.string())))
    return w, np.repeat(np.arange(len(streams)), np.array([len(s) for s in streams], np.int64))[w.row_of_word()]


def shared_runs(streams: list[list[str]], run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``run`` tokens of some distinct pages, and how many of the pages have each: intervals of the suffix array whose neighbours have so many tokens in common."""
    w, page = _tokens(streams)
    n = len(w.hashes)
    if n < run:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    token = np.unique(w.hashes, return_inverse=True)[1]
    order = suffix_order(token, run)
    order = order[order <= n - run]
    order = order[page[order] == page[order + run - 1]]
    alike = np.ones(max(0, len(order) - 1), bool)
    for i in range(run):
        alike &= token[order[1:] + i] == token[order[:-1] + i]
    first = np.concatenate([[True][: len(order)], ~alike])
    pairs = np.unique(np.stack([np.cumsum(first) - 1, page[order]], axis=1), axis=0)
    return grams(w.hashes, run)[order[first]], np.bincount(pairs[:, 0], minlength=int(first.sum()))


def covered(streams: list[list[str]], runs: np.ndarray, times: np.ndarray, run: int = RUN) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each page's blocks: their tokens, the share of them in ``runs``, and the pages (``times``) that share the least shared of these."""
    w, page = _tokens(streams)
    n = len(w.hashes)
    most = np.zeros(n, np.int64)  # of the runs over each token
    if n >= run and len(runs):
        order = np.argsort(runs)
        runs, times = runs[order], times[order]
        g = grams(w.hashes, run)
        at = np.minimum(np.searchsorted(runs, g), len(runs) - 1)
        hit = np.flatnonzero((runs[at] == g) & (page[: len(g)] == page[run - 1 :]))
        for i in range(run):
            most[hit + i] = np.maximum(most[hit + i], times[at[hit]])
    count = np.diff(w.offsets)
    inside = np.concatenate([[0], np.cumsum(most > 0)])
    share = (inside[w.offsets[1:]] - inside[w.offsets[:-1]]) / np.maximum(1, count)
    never = np.iinfo(np.int64).max
    least = np.full(len(count), never)
    np.minimum.at(least, w.row_of_word(), np.where(most > 0, most, never))
    cuts = np.cumsum([len(s) for s in streams])[:-1]
    return list(zip(*(np.split(x, cuts) for x in (count, share, least)))) if len(streams) else []


def left(dropped: list[bool], sure: list[bool], count: np.ndarray, share: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which blocks of a page are left without those mostly covered: the array's verdict, then the structure's.

    A page with sure blocks keeps all where half of its tokens or more would go. Where
    no run of RUN tokens is left of another page, its main run stays too: from the
    first to the last of the blocks that the fewest pages share.
    """
    out, sure = np.array(dropped, bool), np.array(sure, bool)
    keep = ~out & (sure | (share < COVERED))
    gone = ~out & ~keep
    if gone.any() and sure.any():
        if 2 * count[gone].sum() >= count[~out].sum():
            keep |= gone
    elif gone.any() and count[keep].sum() < RUN:
        main = np.flatnonzero(gone & (least == least[gone].min()))
        keep[main[0] : main[-1] + 1] |= ~out[main[0] : main[-1] + 1]
    return keep


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        found = [parsed(p) for p in texts(batch.column("html")).to_pylist()]
        columns = [
            pa.array([p.blocks for p in found], pa.list_(pa.string())), pa.array([p.dropped for p in found], pa.list_(pa.bool_())), pa.array([p.sure for p in found], pa.list_(pa.bool_())),
            pa.array([p.prose for p in found], pa.int64()), pa.array([p.same for p in found], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("_host"), *columns], names=["page_id", "url", "_host", "_blocks", "_dropped", "_sure", "_prose", "_same"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each group of distinct pages; of a host's only group those that count alone."""
    for table in runs_of(batches, ["_host", "_part"]):
        runs, times = shared_runs(table.column("_blocks").to_pylist())
        if table.column("_parts")[0].as_py() == 1:
            runs, times = runs[times >= PAGES], times[times >= PAGES]
        for low in range(0, len(runs), 1 << 16):
            some = runs[low : low + (1 << 16)].view(np.int64)
            same = [pa.array([table.column(c)[0].as_py()] * len(some), kind) for c, kind in (("_host", pa.string()), ("_part", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(some), pa.array(times[low : low + (1 << 16)], pa.int64())], names=["_host", "_part", "run", "times"])


def _cover(pages: pa.Table, runs: pa.Table) -> pa.Table:
    """Which blocks of a group's distinct pages are left, given all of their runs that PAGES pages of the host share; only of pages that lose some by these."""
    streams, dropped, sure = (pages.column(c).to_pylist() for c in ("_blocks", "_dropped", "_sure"))
    shares = covered(streams, runs.column("run").to_numpy().view(np.uint64), runs.column("times").to_numpy())
    found, lost = [], []
    for d, s, prose, (count, share, least) in zip(dropped, sure, pages.column("_prose").to_pylist(), shares):
        if any(s):
            count = np.where(s, 0, count)
            count[s.index(True)] = prose
        found.append(left(d, s, count, share, least))
        lost.append(bool((~found[-1] & ~np.array(d, bool)).any()))
    table = pa.table({"_host": pages.column("_host"), "_key": pages.column("_key"), "_left": pa.array([f.tolist() for f in found], pa.list_(pa.bool_()))})
    return table.filter(pa.array(lost, pa.bool_()))


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null html gives an empty text, and so does a page without text; a null page_id or
    url stays null; pages without a host in their url form one host. Repeated rows have
    a result each and count as one page. Other columns of the table, whatever their names, play no part.
    One page is one value of a task; a host's pages are never gathered in one place.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    flags = ArrayType(BooleanType())
    schema = widened(pages.select("page_id", "url"), _host="string").add("_blocks", ArrayType(StringType())).add("_dropped", flags).add("_sure", flags).add("_prose", "long").add("_same", "long")
    read = kept(pages.select("page_id", "url", "html").withColumn("_host", host).mapInArrow(_parse, schema), "pages", codec="zstd")
    small = lambda df, rows: F.broadcast(df) if df.count() <= rows else df
    # The runs of the distinct pages of each host, counted in groups that have no page in common.
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    evidence = read.withColumn("_blocks", F.filter("_blocks", lambda b, i: ~F.get("_sure", i))).filter(F.size("_blocks") > 0)
    distinct = kept(evidence.groupBy("_host", "_same").agg(F.max(F.struct(F.size("_blocks"), "_blocks"))["_blocks"].alias("_blocks")), "distinct", codec="zstd")
    large = small(distinct.groupBy("_host").count().filter(F.col("count") > group).select("_host", F.ceil(F.col("count") / group).cast("long").alias("_parts")), BROADCAST_HOSTS)
    parted = lambda df: df.join(large, "_host", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_part", F.expr("pmod(xxhash64(_same), _parts)"))
    dealt = parted(distinct).select("_host", "_part", "_parts", "_blocks").repartition(n, "_host", "_part").sortWithinPartitions("_host", "_part")
    counted = kept(dealt.mapInArrow(_count, "_host string, _part long, run long, times long"), "runs")
    often = counted.groupBy("_host", "run").agg(F.sum("times").alias("times")).filter(F.col("times") >= PAGES)
    found = counted.drop("times").join(often, ["_host", "run"]).select("_host", "_part", "run", "times")
    # Each distinct page is covered once, in its group; a word that no evidence has stands for a block of prose.
    keyed = read.withColumn("_key", F.xxhash64("_same", "_blocks", "_dropped", "_sure"))
    bare = F.transform("_blocks", lambda b, i: F.when(F.get("_sure", i), F.lit(PROSE)).otherwise(b)).alias("_blocks")
    once = keyed.filter(F.exists("_sure", lambda s: ~s)).select("_host", "_same", "_key", bare, "_dropped", "_sure", "_prose").dropDuplicates(["_host", "_key"])
    both = parted(once).drop("_same", "_parts").groupBy("_host", "_part").cogroup(found.groupBy("_host", "_part"))
    verdicts = kept(both.applyInArrow(_cover, "_host string, _key long, _left array<boolean>"), "verdicts")
    judged = keyed.join(small(verdicts, BROADCAST_PAGES), ["_host", "_key"], "left")
    stays = F.coalesce("_left", F.transform("_dropped", lambda d: ~d))
    text = F.array_join(F.filter("_blocks", lambda b, i: F.get("_stays", i)), "\n")
    done = judged.withColumn("_stays", stays).select("page_id", "url", text.alias("text"))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))
