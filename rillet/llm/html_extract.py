"""Main text of web pages: markup first, then repeated runs found across a host's pages.

A page is read into blocks. Explicit markup decides most of them: what is inside article or
main (or a container named as content) is main text, what is inside menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles is not. Blocks that markup
leaves open (plain containers, pages without landmarks) are decided by the host's other pages:

* the open blocks' token streams of a host are its text; every run of ``RUN`` tokens that
  occurs on two or more distinct pages of the host is boilerplate. These are exactly the
  places that a suffix array of the concatenated streams would list with a common prefix of
  at least ``RUN`` tokens with a suffix of another page: suffixes are grouped by their first
  ``RUN`` tokens in a Spark shuffle instead of being sorted in one place, so a host's
  stream is never gathered, and a long repeat is the union of its runs;
* what stands in main but in no article is main text, and is given to the same step: there a run
  is boilerplate when ``PAGES`` pages of different html hold it, so that a text and its copy stay;
* covered tokens are removed, the unique runs around them stay, in page order.

The text of an article element stays whole. On a page that has main text by markup, open blocks
outside it are not text, unless the page has only article elements and they hold less than half
of what is left of it (a teaser beside the text). Only ids of repeated runs are shuffled, texts
never are, but for pages that have blocks with repeated runs.

Defined cases: null or empty html gives empty text; repeated rows and null ids are kept; a
page cut off in the middle of a tag, comment or script loses only that; very long pages are
read whole. A page repeated under its own id does not make its text boilerplate.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillet.llm.staging import staged
from rillet.llm.words import windows, words_of

#: Tokens of a run that, repeated on another page of the host, is boilerplate.
RUN = 8
#: Different pages of the host that must hold a run of main text for it to be boilerplate.
PAGES = 3

#: ARTICLE is inside an article, MAIN only inside main, NAMED inside a container named as content without either.
ARTICLE, NAMED, MAIN, OPEN, OUT = 4, 3, 2, 1, 0

# HTML's element classes.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "noembed", "noframes", "xmp"}
#: Those of them whose content runs to the end of the page where their end is missing.
UNENDED = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Elements that a slash before ">" closes.
SELF_CLOSED = {"svg", "math", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
OUT_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "head"}
MAIN_TAGS = {"article", "main"}
#: Words of class, id and role that name a part of a page.
OUT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "contentinfo", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promotion", "related", "replies", "reply", "search", "share",
    "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
AD_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored"}
MAIN_NAMES = {"article", "content", "entry", "main", "post", "story"}
#: Whole names of parts inside main text, where a word of a longer name says nothing ("market-share").
OUT_INSIDE = {
    "ad-banner", "ad-container", "ad-slot", "ad-unit", "comment-form", "comment-list", "comments-area", "comments-section", "cookie-banner",
    "cookie-notice", "newsletter-signup", "related-articles", "related-content", "related-links", "related-posts", "related-stories",
    "share-bar", "share-buttons", "share-links", "sidebar-widget", "social-buttons", "social-links", "social-share",
}

#: Elements that hold text: inside main text only names of adverts take them out.
_TEXT_TAGS = INLINE | {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figcaption", "td", "th"}

#: A quote opens a value only after "=".
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:[!?/][^>]*(?:>|\Z)|[a-zA-Z][^\s/>]*+"
    r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)|=)*+(?:>|\Z))",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_NAMED = re.compile(r"(?<![\w:-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that end a paragraph left open.
_ENDS_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}


def _part(name: str, tag: str, kind: int) -> int:
    """What an element inside a part of ``kind`` is part of."""
    if kind == OUT or name in OUT_TAGS:
        # The header of an article is its heading, not the page's.
        return kind if kind > OPEN and name == "header" else OUT
    whole: set[str] = set()
    ids: set[str] = set()
    if "=" in tag and name not in ("html", "body"):
        for m in _NAMED.finditer(tag):
            (ids if m[1].lower() == "id" else whole).update((m[2] or m[3] or m[4] or "").lower().split())
    if kind > OPEN and name not in MAIN_TAGS:
        # Inside main text only whole names count: parts of a heading's id are words of its topic.
        if name in _TEXT_TAGS:
            return OUT if whole & AD_NAMES else kind
        return OUT if whole & OUT_NAMES or (whole | ids) & OUT_INSIDE else kind
    # A landmark's names count whole ("comment"), a container's also in part ("site-menu").
    words = whole | ids
    if name not in MAIN_TAGS:
        words = {w for x in words for w in re.split(r"[^a-z0-9]+", x)}
    if words & OUT_NAMES:
        return OUT
    if name in MAIN_TAGS:
        return ARTICLE if name == "article" or kind == ARTICLE else MAIN
    if kind == OPEN and name in ("div", "section", "td") and words & MAIN_NAMES:
        return NAMED
    return kind


def blocks(html: str) -> list[tuple[int, str]]:
    """(ARTICLE, NAMED, MAIN or OPEN, text) of a page's blocks in page order; references decoded, white space single."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # names in the stack
    endless: set[str] = set()  # elements whose end does not come any more
    kind, at = OPEN, 0

    def flush() -> None:
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                out.append((kind, words))
            text.clear()

    def close(i: int) -> None:
        """The elements from place i on end."""
        nonlocal kind
        if stack[i][1] != kind:
            flush()
        kind = stack[i][1]
        opened.subtract(name for name, _ in stack[i:])
        del stack[i:]

    def add(chunk: str) -> None:
        if kind != OUT and chunk:
            text.append(chunk)

    while at < len(html):
        m = _MARKUP.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at, tag = m.end(), m[0]
        named = _NAME.match(tag)
        if named is None:
            continue  # a comment or declaration
        name = named[1].lower()
        if name not in INLINE:
            flush()
        if tag[1] == "/":
            # Close up to the nearest open element of that name, but no landmark around a stray end.
            if opened[name]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
        elif name in RAW:
            if not (name in SELF_CLOSED and tag.endswith("/>")) and name not in endless:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                if end is not None:
                    at = end.end()
                elif name in UNENDED:
                    at = len(html)
                else:
                    endless.add(name)
        elif name not in VOID and not tag.endswith("/>"):
            if name in _ENDS_P and opened["p"]:
                i = len(stack) - 1
                while stack[i][0] in INLINE:
                    i -= 1
                if stack[i][0] == "p":
                    flush()
                    close(i)
            inner = _part(name, tag, kind)
            stack.append((name, kind))
            opened[name] += 1
            if inner != kind:
                flush()
                kind = inner
    flush()
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _parts(html: str | None) -> tuple[bool, list[tuple[bool, str]]]:
    """(the page has main text by markup, (may lose repeated runs, text) of each block that is text).

    Without article or main, containers named as content are the main text if they hold most of
    the page's text; else they are blocks like the others.
    """
    found = blocks(html) if isinstance(html, str) else []
    kinds = {k for k, _ in found}
    total = sum(len(t) for _, t in found)
    sure = sum(len(t) for k, t in found if k != OPEN)
    if not kinds & {ARTICLE, MAIN}:
        if 2 * sure <= total:
            return False, [(True, t) for _, t in found]
        return True, [(False, t) for k, t in found if k != OPEN]
    with_open = MAIN not in kinds and 2 * sure <= total
    return True, [(k in (MAIN, OPEN), t) for k, t in found if k != OPEN or with_open]


def _read(html: str | None) -> tuple[str, list[str]]:
    """(main text by markup, tokens of the blocks that may lose repeated runs)."""
    marked, parts = _parts(html)
    return " ".join(t for _, t in parts) if marked else "", [w for loses, t in parts if loses for w in t.split(" ")]


def _runs(tokens: list[str], k: int) -> np.ndarray:
    """A 64-bit hash for each run of k tokens."""
    words = words_of(pa.array([" ".join(tokens)]), lower=False)
    return windows(words.hashes(), words.counts, k)[0].view(np.int64)


def _reader(k: int):
    @F.pandas_udf("text string, runs array<long>, open boolean, marked boolean")
    def read(html: pd.Series) -> pd.DataFrame:
        rows = []
        for page in html:
            main, tokens = _read(page)
            rows.append((main, _runs(tokens, k).tolist() if len(tokens) >= k else [], bool(tokens), bool(main)))
        return pd.DataFrame(rows, columns=["text", "runs", "open", "marked"])

    return read.asNondeterministic()  # it isn't; so a filter on its result doesn't run it again


def _cleaner(k: int):
    @F.pandas_udf("string")
    def clean(html: pd.Series, repeated: pd.Series) -> pd.Series:
        out = []
        for page, runs in zip(html, repeated, strict=True):
            _, parts = _parts(page)
            tokens = [w for loses, t in parts if loses for w in t.split(" ")]
            keep = np.ones(len(tokens), bool)
            if runs is not None and len(runs) and len(tokens) >= k:
                for i in np.flatnonzero(np.isin(_runs(tokens, k), runs)):
                    keep[i : i + k] = False
            kept, at = [], 0
            for loses, t in parts:
                if loses:
                    words = t.split(" ")
                    kept += [w for w, x in zip(words, keep[at : at + len(words)], strict=True) if x]
                    at += len(words)
                else:
                    kept.append(t)
            out.append(" ".join(kept))
        return pd.Series(out, dtype=object)

    return clean


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    read = pages.select("page_id", "url", "html", _reader(run)("html").alias("r"))
    by_markup = read.where(~F.col("r.open")).select("page_id", "url", F.col("r.text").alias("text"))

    # Pages with blocks left to the host: their runs, those repeated in the host, and what is left.
    key = F.xxhash64("page_id", "url", "html")
    left = staged(
        read.where(F.col("r.open")).select(
            host_of(F.col("url")).alias("host"),
            "page_id",
            key.alias("page"),
            F.xxhash64("html").alias("content"),
            F.col("r.marked").alias("marked"),
            F.col("r.runs").alias("runs"),
        ),
        "open-pages",
    )
    single = left.select("host", "page_id", "page", "content", "marked", F.explode(F.array_distinct("runs")).alias("run"))
    shared = single.groupBy("host", "run").agg((F.min("page_id") < F.max("page_id")).alias("two"), F.count_distinct("content").alias("contents"))
    boilerplate = F.when(F.col("marked"), F.col("contents") >= PAGES).otherwise(F.col("two"))
    repeated = (
        single.join(shared.where(F.col("two") | (F.col("contents") >= PAGES)), ["host", "run"])
        .where(boilerplate)
        .groupBy("page")
        .agg(F.collect_set("run").alias("repeated"))
    )
    open_pages = pages.withColumn("page", key).join(left.select("page").distinct().hint("shuffle_hash"), "page", "left_semi")
    undecided = open_pages.join(repeated, "page", "left").select(
        "page_id", "url", _cleaner(run)("html", "repeated").alias("text")
    )
    if left.isEmpty():
        return by_markup.withColumn("n_chars", F.length("text").cast("long"))
    return by_markup.union(undecided).withColumn("n_chars", F.length("text").cast("long"))


def digest(pages: DataFrame) -> DataFrame:
    return main_text(pages)
