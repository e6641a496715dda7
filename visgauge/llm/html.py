"""Main text of web pages, after the removal of subtrees that recur across the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import broadcast_up_to, checkpoint, in_arrow

#: Fixed values of the HTML standard: elements without an end tag, with raw text, and that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
#: An open element of the first kind ends where one of the others begins.
ENDS_AT = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}}
ENDS_AT |= {"p": BLOCK - {"td", "th", "tr", "tbody", "tfoot", "thead", "caption", "option", "body", "head", "html", "button"}, "head": {"body"}}
#: An end tag doesn't reach beyond these.
SCOPE = frozenset("table td th caption html body".split())
#: Never part of an article: by element, by role, and by words of a class or id.
DROPPED = frozenset("head nav footer aside button select option textarea script style noscript template iframe object svg math canvas audio video dialog menu search title input label fieldset datalist xmp noembed noframes".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus"
    " footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pagination pager popup promo promoted promotion related"
    " recommended respond sidebar share sharing social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
MAIN = frozenset(("article", "main"))
#: Blocks that are parts of a list, a table or a section: inside an article they go only with all of it.
PARTS = frozenset("caption dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup legend li option tbody td tfoot th thead title tr".split())
WHOLE = BLOCK - PARTS
#: Words that say nothing of an element: a class of words of either list is one of the page's furniture.
NEUTRAL = frozenset(
    "area bar block bottom box btn button buttons col column container content for form global group icons inner item items js left link links list main outer page panel post posts row"
    " section signup site sticky the top right wrap wrapper article articles user reader readers thread id block".split()
)
_OPEN = re.compile(r"<(?:([A-Za-z][^\s/>]*)|/([A-Za-z][^\s/>]*)|(!--)|[!?/])")
_IN_TAG = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


class _Element:
    """An open element: what of its subtree has been seen so far."""

    __slots__ = ("begin", "doubt", "drop", "holds", "inner", "inside", "linked", "main", "name", "size")

    def __init__(self, name: str, begin: int, drop: bool, main: bool, doubt: str) -> None:
        self.name, self.begin, self.drop, self.main, self.doubt = name, begin, drop, main, doubt
        self.inner: list[bytes] = []
        #: Characters of its text, of that in links, and of that in article and main elements.
        self.size = self.linked = self.inside = 0
        #: Whether it is an article or main element or holds one.
        self.holds = name in MAIN


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place of the `>` that ends a tag whose name ends at `at`, or -1. A quote without a partner, or whose partner
    can't end a value, is a character like others. last: the last place of each quote and of `>`; no part of a page is
    looked through more than a few times."""
    while True:
        m = _IN_TAG.search(page, at) if at <= last[">"] else None
        if m is None or m[0] == ">":
            return m.start() if m else -1
        at = m.end()
        if at <= last[m[0]]:
            end = page.find(m[0], at)
            through = page.find(">", at, end) >= 0
            if not through or (page[end - 1] != "=" and page[end + 1 : end + 2] in (" ", "\n", "\t", "\r", "/", ">", "")):
                at = end + 1


def _judge(name: str, attributes: str, in_main: bool, nested: bool) -> str:
    """`drop` for an element that is never part of an article, `doubt` for one that depends on what it holds, or nothing.
    nested: whether it is an article inside of another, such as a comment."""
    if name == "form":
        return "form"
    if name in DROPPED or (name == "header" and not in_main):
        return "drop"
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return ""
    out = ""
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        key = key.lower()
        if key in ("class", "id") and (nested or name not in MAIN) and name not in ("html", "body"):
            for token in value.split():
                words = set(_WORD.findall(token)) - ({"header"} if in_main else set())
                if not DROPPED_WORDS.isdisjoint(words):
                    if words <= DROPPED_WORDS | NEUTRAL and name != "p":
                        return "drop"
                    out = "doubt"
        elif key == "role" and value in DROPPED_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return "drop"
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "drop"
    return out


Piece = tuple[str, bool, bool]


Subtree = tuple[int, int, int, int, bool, bool]


def segments(page: str, menu: float = 0.9) -> tuple[list[Piece], list[Subtree]]:
    """A page as pieces of text and subtrees.

    pieces: (text, whether it is in a dropped element, whether it is in an article or main element); an empty text ends
    a block. subtrees: (hash of names and texts, first piece, end piece, number of characters, whether it is in an article
    or main element, whether its class leaves in doubt what it is) of each element that can be a template: none that is or holds an article or main element, and inside
    of these only blocks that are no part of a larger one.

    An element with a class of which only a part names furniture (`related-work`), and a paragraph with any such class, is
    in doubt: it is dropped if links make up `menu` of its text, as of a menu; otherwise it stays, whatever its length,
    unless it recurs on its host. A form is dropped, unless it holds an article or four fifths of the page's text. Time grows with the page's length
    only, however its quotes and elements are nested.
    """
    pieces: list[Piece] = []
    subtrees: list[Subtree] = []
    doubtful: list[tuple[int, int, int, bool]] = []
    stack = [_Element("", 0, False, False, "")]
    places: dict[str, list[int]] = defaultdict(list)  # of open elements, by name
    barriers = [0]  # places of open elements that an end tag doesn't reach beyond
    total = links = 0
    last = {c: page.rfind(c) for c in "\"'>"}

    def close() -> None:
        nonlocal links
        e = stack.pop()
        places[e.name].pop()
        if e.name in SCOPE:
            barriers.pop()
        if e.name == "a":
            links -= 1
        digest = xxhash.xxh3_64_digest(b"\0".join([e.name.encode(), *e.inner]))
        top = stack[-1]
        top.inner.append(digest)
        top.size += e.size
        top.linked += e.linked
        top.inside += e.inside
        top.holds = top.holds or e.holds
        if e.size and e.name not in ("html", "body") and not e.holds and (not e.main or e.name in WHOLE):
            subtrees.append((int.from_bytes(digest, "big", signed=True), e.begin, len(pieces), e.size, e.main, e.doubt == "doubt"))
        if e.doubt == "form" or e.doubt == "doubt" and (e.main or not e.holds) and e.linked >= menu * e.size:
            doubtful.append((e.begin, len(pieces), e.size if e.doubt == "form" else 0, e.holds and e.doubt == "form"))
        if e.name in BLOCK:
            pieces.append(("", False, False))

    def text(raw: str) -> None:
        nonlocal total
        if raw:
            top = stack[-1]
            found = entities.unescape(raw) if "&" in raw else raw
            pieces.append((found, top.drop, top.main))
            words = " ".join(found.split())
            if words:
                top.inner.append(words.encode(errors="replace"))
                top.size += len(words)
                top.linked += len(words) * (links > 0)
                top.inside += len(words) * top.main
                total += 0 if top.drop else len(words)

    at = 0
    while m := _OPEN.search(page, at):
        begin, name, ended = m.start(), m[1], m[2]
        if m[3]:
            end = page.find("-->", m.end())
            after = end + 3 if end >= 0 else len(page)
        else:
            end = _tag_end(page, m.end(), last) if name else page.find(">", m.end()) if m.end() <= last[">"] else -1
            after = end + 1 if end >= 0 else len(page)
            if end < 0 and not name and not ended:  # a `<` of the text
                text(page[at : m.end()])
                at = m.end()
                continue
        text(page[at:begin])
        at = after
        if ended:
            ended = ended.lower()
            depth = places[ended][-1] if places.get(ended) else 0
            if depth and (depth >= barriers[-1] or ended in SCOPE or ended in MAIN):
                while len(stack) > depth:
                    close()
            elif ended == "p":
                pieces.append(("", False, False))
        if not name:
            continue
        name, attributes = name.lower(), page[m.end() : max(end, m.end())]
        while len(stack) > 1 and name in ENDS_AT.get(stack[-1].name, ()):
            close()
        if name in BLOCK and name in ENDS_AT["p"] and any(e.name == "p" for e in stack[-4:]):  # <p><b>text<p>
            depth = places["p"][-1]
            if not any(e.name in BLOCK for e in stack[depth + 1 :]):
                while len(stack) > depth:
                    close()
        top = stack[-1]
        if name in BLOCK:
            pieces.append(("", False, False))
        if name in VOID:
            if name == "br":
                pieces.append((" ", top.drop, top.main))
            continue
        main = top.main or name in MAIN
        verdict = _judge(name, attributes, main, name == "article" and bool(places.get("article")))
        places[name].append(len(stack))
        if name in SCOPE:
            barriers.append(len(stack))
        links += name == "a"
        stack.append(_Element(name, len(pieces), top.drop or verdict == "drop", main, verdict))
        if name in RAW and not attributes.endswith("/"):
            closing = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            text(page[at : closing.start() if closing else len(page)])
            at = closing.end() if closing else len(page)
            close()
    text(page[at:])
    while len(stack) > 1:
        close()
    gone = _covered([(i, j) for i, j, size, holds in doubtful if not holds and 5 * size <= 4 * total], len(pieces))
    if gone is not None:
        pieces = [(f, d or g, m) if f else (f, d, m) for (f, d, m), g in zip(pieces, gone, strict=True)]
    return pieces, subtrees


def _covered(spans: list[tuple[int, int]], n: int) -> list[bool] | None:
    """Whether each of n places is in a span; None if there is no span."""
    if not spans:
        return None
    steps = [0] * (n + 1)
    for i, j in spans:
        steps[i] += 1
        steps[j] -= 1
    return [depth > 0 for depth in accumulate(steps[:-1])]


def _blocks(pieces: list[Piece]) -> str:
    out, block = [], []
    for found, _, _ in [*pieces, ("", False, False)]:
        if found:
            block.append(found)
        elif block:
            out.append(" ".join("".join(block).split()))
            block = []
    return " ".join(b for b in out if b)


def main_text(page: str | None, templates: set[int] | frozenset[int] = frozenset(), common: set[int] | frozenset[int] | None = None) -> str:
    """The text of a page less its template subtrees and what is never part of an article.

    A page with article or main elements has its text in them. There only the subtrees in `common` are templates (all
    templates if it is None), and those that are in doubt by their class; the article or main element itself never is. A
    subtree outside is a template only where it holds less than half of the text of the page, and
    those inside go only if all of them hold less than half of the text inside, as the page is a copy otherwise.
    """
    pieces, subtrees = segments(page or "")
    has_main = any(m and f.strip() for f, d, m in pieces if not d)
    if templates:
        total = sum(len(f) for f, d, _ in pieces if not d)
        surely = templates if common is None else common
        found = [(begin, end, inside) for h, begin, end, size, inside, doubt in subtrees if (h in templates if doubt or not inside else h in surely) and (inside or 2 * size < total)]
        gone = _covered([(i, j) for i, j, inside in found if not inside], len(pieces))
        inner = _covered([(i, j) for i, j, inside in found if inside], len(pieces))
        if inner is not None:
            lost = sum(len(f) for (f, d, m), g in zip(pieces, inner, strict=True) if g and m and not d)
            if 2 * lost >= sum(len(f) for f, d, m in pieces if m and not d):
                inner = None
        for which in (gone, inner):
            if which is not None:
                pieces = [(f, d or g, m) if f else (f, d, m) for (f, d, m), g in zip(pieces, which, strict=True)]
    return _blocks([p for p in pieces if not p[0] or (not p[1] and (p[2] or not has_main))])


def host_of(url: str) -> Column:
    """The host of a url column, lower-case and without a port; null if there is none."""
    host = F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.when(host != "", host))


def template_subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_share: float = 0.2) -> DataFrame:
    """host, subtree and common (on most pages of the host) of the element subtrees on min_pages and min_share of their
    host's pages, or more.

    Each page counts a subtree once, inside of article and main elements as well; hashes are summed on the map side.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, found = [], []
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = {s[0] for s in segments(page.as_py() or "")[1]}
                hosts += [host] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.int64())], ["host", "subtree"])

    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    totals = rows.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("host_pages"))
    counts = rows.transform(in_arrow, hashes, "host string, subtree bigint").groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") >= F.lit(min_share) * F.col("host_pages")).select("host", "subtree", (2 * F.col("n") > F.col("host_pages")).alias("common"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col and text for every row of pages; null and empty pages have the empty text.

    A subtree is a template outside of article and main elements if it is on a fifth of its host's pages; inside, where a
    passage may well stand on some pages, only if it is on most of them, or if its class leaves in doubt what it is.
    Pages without a host form a group of their own; repeated rows are pages of their own. A page is in memory whole, with
    its pieces; time grows with its length only. The templates of a host travel as one array, bounded by the share
    of pages that each must be on; they are broadcast up to a checked size and joined beyond it.
    """
    lists = checkpoint(template_subtrees(pages, url_col, html_col).groupBy("host").agg(F.collect_list("subtree").alias("_templates"), F.collect_list(F.when(F.col("common"), F.col("subtree"))).alias("_common")).withColumnRenamed("host", "_host"))
    rows = pages.select(id_col, url_col, F.col(html_col).cast("string").alias("_html"), host_of(url_col).alias("_of"))
    rows = rows.join(broadcast_up_to(lists, 8 * F.size("_templates") + 8 * F.size("_common") + 64), F.col("_of").eqNullSafe(F.col("_host")), "left").select(id_col, url_col, "_html", "_templates", "_common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page.as_py(), frozenset(t.as_py() or ()), frozenset(c.as_py() or ())) for page, t, c in zip(b.column(2), b.column(3), b.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], [*b.schema.names[:2], "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.transform(in_arrow, run, f"{fields}, text string")
