"""Operator 4 — main text of web pages by site template removal.

A page is read once, in time linear in its length, into blocks of text and the
block-level elements around them.  Elements that say what they are (menus,
headers, footers, sidebars, notices, adverts, forms, comments, hidden or
executable content) are left out by tag, role or class; the article, else the
main element, else the body is the region of the main text.

What a site repeats without saying so is found by counting: every element
subtree in the region is hashed, hashes are counted per host in Spark, and
subtrees that recur across many pages of their host are deleted.  A subtree
counts once per *different page*, so that thousands of copies of one page never
make its own paragraphs look like a template.  What recurs is only a candidate:
pages that differ in nothing but candidates count as one when the candidates
are counted again, so that an article copied under changing templates stays.
An article that many pages of a host repeat beside text of their own can't be
told from a template and goes.

Counting moves two 64-bit hashes per element, combined map-side; pages meet
their hashes again only if the crawl has candidates at all, in joins over
stored tables that adaptive execution can split at a hot host.
"""

from __future__ import annotations

import hashlib
import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, text_or_empty

#: A subtree is a template if it stands in at least MANY different pages and in SHARE of the host's.
MANY, SHARE = 20, 0.5

# FIXED VALUES: element names (HTML Living Standard) and the names that sites give their furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " select summary table tbody tfoot thead tr ul noscript template svg object canvas video audio button".split()
)
DROP = frozenset(
    "head nav footer aside form dialog menu search noscript template svg object canvas video audio button select".split()
)
DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form".split())
FURNITURE = re.compile(
    r"(?:site|page|main|global|top|bottom|left|right|primary|secondary)?[-_]?"
    r"(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|ads?|adverts?|advertisements?|adsbygoogle"
    r"|sponsor(?:ed)?|promo|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|signup|login|search"
    r"|share|sharing|social|related|recommended|pagination|pager|comments?|replies|respond|disqus|widget|toolbar|skip)"
    r"(?:[-_].*)?",
    re.IGNORECASE,
)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>\"']*+)>")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=]++)?(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?")
_END_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Page(NamedTuple):
    """Blocks of the main region, and its elements as (tag, first block, block after the last)."""

    blocks: list[str]
    elements: list[tuple[str, int, int]]


class _Open:
    __slots__ = ("tag", "dropped", "article", "main", "start")

    def __init__(self, tag, dropped, article, main, start):
        self.tag, self.dropped, self.article, self.main, self.start = tag, dropped, article, main, start


def attributes(raw: str) -> dict[str, str]:
    found, at = {}, 0
    while at < len(raw):
        m = _ATTRIBUTE.match(raw, at)
        if m.end() == at:
            at += 1
            continue
        at = m.end()
        if m[1]:
            found.setdefault(m[1].lower(), next((html.unescape(x) for x in m.groups()[1:] if x is not None), ""))
    return found


def _tag_end(page: str, at: int) -> int:
    """The position after a tag with quoted values; -1 if it runs to the end of the page."""
    quote = re.compile(r"[>\"']")
    while m := quote.search(page, at):
        if m[0] == ">":
            return m.end()
        at = page.find(m[0], m.end()) + 1
        if not at:
            return -1
    return -1


def _leaves(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether the element is furniture; ``inside``: it stands in an article or main element."""
    if tag in DROP or (tag == "header" and not inside):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in DROP_ROLE:
        return True
    if tag in ("html", "body", "main", "article", "h1"):
        return False
    return any(FURNITURE.fullmatch(c) for c in (attrs.get("class", "") + " " + attrs.get("id", "")).split())


def parse(page: str) -> Page:
    """One pass over the page.  Markup errors are tolerated; an unclosed tag, comment or script runs to the end."""
    blocks: list[tuple[str, bool, bool]] = []
    elements: list[tuple[str, int, int, bool, bool]] = []
    stack: list[_Open] = [_Open("", False, False, False, 0)]
    open_tags: dict[str, int] = {}
    text: list[str] = []

    def flush() -> None:
        if text:
            words = "".join(text).split()
            text.clear()
            if words:
                blocks.append((" ".join(words), stack[-1].article, stack[-1].main))

    def pop() -> None:
        if stack[-1].tag in BLOCK:
            flush()
        e = stack.pop()
        open_tags[e.tag] -= 1
        if not e.dropped and e.start < len(blocks):
            elements.append((e.tag, e.start, len(blocks), e.article and e.tag != "article", e.main and e.tag != "main"))

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not stack[-1].dropped:
            text.append(html.unescape(page[at:lt]))
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if m:
            closing, tag, rest, at = m[1], m[2].lower(), m[3], m.end()
        elif named := _NAME.match(page, lt):
            end = _tag_end(page, named.end())
            if end < 0:
                break
            closing, tag, rest, at = page[lt + 1] == "/", named[1].lower(), page[named.end() : end - 1], end
        elif page.startswith("<!--", lt):
            end = page.find("-->", lt + 2 if page.startswith("<!-->", lt) else lt + 4)
            if end < 0:
                break
            at = end + 3
            continue
        elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
            end = page.find(">", lt)
            if end < 0:
                break
            at = end + 1
            continue
        else:
            if not stack[-1].dropped:
                text.append("<")
            at = lt + 1
            continue
        if closing:
            if open_tags.get(tag):
                while stack[-1].tag != tag:
                    pop()
                pop()
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            end = _END_RAW[tag].search(page, at)
            if not end:
                break
            close = page.find(">", end.end())
            if close < 0:
                break
            at = close + 1
            continue
        if tag in ("br", "td", "th", "img") and not stack[-1].dropped:
            text.append(" " if tag != "img" else "")
        if tag in VOID and tag != "hr":
            continue
        attrs = attributes(rest) if rest and not rest.isspace() and rest != "/" else {}
        top = stack[-1]
        if tag in BLOCK:
            flush()
            # implied end tags: a paragraph ends at any block, an item at the next one
            if open_tags.get("p") and tag != "p" or tag == "p":
                while stack[-1].tag and stack[-1].tag not in BLOCK:
                    pop()
                if stack[-1].tag == "p":
                    pop()
            if tag in ("li", "dt", "dd", "tr", "option") and stack[-1].tag in (("dt", "dd") if tag in ("dt", "dd") else (tag,)):
                pop()
            if tag == "hr":
                continue
            top = stack[-1]
            inside = top.article or top.main
            dropped = top.dropped or _leaves(tag, attrs, inside)
            is_main = tag == "main" or attrs.get("role", "").lower() == "main"
            stack.append(_Open(tag, dropped, top.article or tag == "article", top.main or is_main, len(blocks)))
            open_tags[tag] = open_tags.get(tag, 0) + 1
        elif attrs and not top.dropped and _leaves(tag, attrs, top.article or top.main):
            stack.append(_Open(tag, True, top.article, top.main, len(blocks)))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    while len(stack) > 1:
        pop()
    flush()
    region = 1 if any(b[1] for b in blocks) else 2 if any(b[2] for b in blocks) else 0
    if not region:
        return Page([b[0] for b in blocks], [e[:3] for e in elements if e[0] not in ("html", "body")])
    place, kept = [], []
    for b in blocks:
        place.append(len(kept))
        if b[region]:
            kept.append(b[0])
    place.append(len(kept))
    return Page(kept, [(t, place[a], place[z]) for t, a, z, *in_ in elements if in_[region - 1]])


def _hash(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def subtrees(page: Page) -> list[tuple[int, int, int]]:
    """(hash, first block, block after the last) of each element.

    A subtree's hash comes from prefix hashes over its blocks' hashes, so deep
    nesting costs no more than flat pages.
    """
    own = [_hash(b) for b in page.blocks]
    prefix, power = [0], [1]
    for h in own:
        prefix.append((prefix[-1] * _BASE + h) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    out = []
    for tag, a, z in page.elements:
        inner = (prefix[z] - prefix[a] * power[z - a]) % _PRIME
        out.append((_hash(f"{tag} {z - a} {inner}"), a, z))
    return out


def main_text(page: str, templates: set[int] | frozenset[int] = frozenset()) -> str:
    """The blocks of the region that no template subtree covers, one per line."""
    found = parse(page)
    return _uncovered(found, subtrees(found) if templates else [], templates)


def _uncovered(found: Page, trees: list[tuple[int, int, int]], templates: set[int] | frozenset[int]) -> str:
    cover = [0] * (len(found.blocks) + 1)
    for h, a, z in trees:
        if h in templates:
            cover[a] += 1
            cover[z] -= 1
    out, depth = [], 0
    for block, step in zip(found.blocks, cover, strict=False):
        depth += step
        if not depth:
            out.append(block)
    return "\n".join(out)


# ---- over Spark ------------------------------------------------------------------------

def host(url: str = "url") -> Column:
    """The URL's host in lower case; empty for null or what has none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtree_column(page: Column) -> Column:
    @F.arrow_udf("struct<page:bigint,trees:array<bigint>>")
    def run(pages: pa.Array) -> pa.Array:
        rows = []
        for x in pages.to_pylist():
            found = parse(x)
            rows.append({"page": _hash("\n".join(found.blocks)), "trees": sorted({h for h, _, _ in subtrees(found)})})
        return pa.array(rows, pa.struct([("page", pa.int64()), ("trees", pa.list_(pa.int64()))]))

    return run(page)


def _rest_column(page: Column, candidates: Column) -> Column:
    """Hash of what the candidates leave of a page, and those that the page has."""

    @F.arrow_udf("struct<rest:bigint,trees:array<bigint>>")
    def run(pages: pa.Array, lists: pa.Array) -> pa.Array:
        rows = []
        for x, some in zip(pages.to_pylist(), lists.to_pylist(), strict=True):
            found, some = parse(x), frozenset(some)
            trees = subtrees(found)
            rows.append({"rest": _hash(_uncovered(found, trees, some)), "trees": sorted(some.intersection(h for h, _, _ in trees))})
        return pa.array(rows, pa.struct([("rest", pa.int64()), ("trees", pa.list_(pa.int64()))]))

    return run(page, candidates)


def _text_column(page: Column, templates: Column) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([main_text(x, frozenset(t or ())) for x, t in zip(pages.to_pylist(), lists.to_pylist(), strict=True)], pa.string())

    return run(page, templates)


def candidates(trees: DataFrame, many: int = MANY, share: float = SHARE) -> DataFrame:
    """(host, tree) of the subtrees in enough different pages; ``trees`` has (host, page, tree)."""
    pages = trees.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = trees.select("host", "tree", "page").distinct().groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= many)
    return seen.join(pages, "host").where(F.col("n") >= share * F.col("pages")).select("host", "tree")


def templates(rests: DataFrame, many: int = MANY) -> DataFrame:
    """(host, tree) of the candidates that ``many`` pages have which differ in more than candidates; ``rests`` has (host, rest, trees)."""
    seen = rests.select("host", F.explode("trees").alias("tree"), "rest").distinct()
    return seen.groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= many).select("host", "tree")


def extract(pages: DataFrame, many: int = MANY, share: float = SHARE) -> DataFrame:
    """(page_id, url, text) for every row of ``pages``.

    A null or empty page, or one without text, has an empty text; a null url
    belongs to the host without name; rows that repeat a page_id are extracted
    one by one; an empty table gives an empty table.  Further columns are not
    read.
    """
    kept = Staged(pages.sparkSession, "maintext")
    rows = pages.select("page_id", "url", host().alias("host"), text_or_empty("html").alias("html"))
    trees = rows.select("page_id", "host", _subtree_column(F.col("html")).alias("s"))
    trees = kept.keep(trees.select("page_id", "host", "s.page", F.explode("s.trees").alias("tree")), "trees")
    maybe = kept.keep(candidates(trees, many, share), "candidates")
    plain = rows.select("page_id", "url", _text_column(F.col("html"), F.lit(None).cast("array<bigint>")).alias("text"))
    if maybe.isEmpty():
        return plain
    hits = trees.select("page_id", "host", "tree").distinct().join(maybe, ["host", "tree"])
    some = kept.keep(hits.groupBy("page_id", "host").agg(F.collect_set("tree").alias("gone")), "hits")
    same = rows["page_id"].eqNullSafe(some["page_id"]) & (rows["host"] == some["host"])
    rests = rows.join(some, same).select(rows["host"], _rest_column(rows["html"], F.col("gone")).alias("r"))
    found = kept.keep(templates(rests.select("host", "r.*"), many), "templates")
    if found.isEmpty():
        return plain
    hits = some.select("page_id", "host", F.explode("gone").alias("tree")).join(found, ["host", "tree"])
    hits = kept.keep(hits.groupBy("page_id", "host").agg(F.collect_set("tree").alias("gone")), "hits")
    same = rows["page_id"].eqNullSafe(hits["page_id"]) & (rows["host"] == hits["host"])
    return rows.join(hits, same, "left").select(rows["page_id"], rows["url"], _text_column(rows["html"], F.col("gone")).alias("text"))
