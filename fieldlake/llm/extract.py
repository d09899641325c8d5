"""The main text of web pages: page differencing between nearest URLs, and what the markup says.

Every page becomes lines, one per block, with the chain of tags and classes it stands in. The pages
of a host are ordered by URL path; each page is aligned with the one before and the one after it by
the longest common subsequence of lines, and shared lines go. Outside a declared article (article,
main) two lines are also shared if they stand at the same place of the template, so menus, adverts
and footers go whatever they say. Lines of a declared article stay even if they are shared: copies
and quoted passages are text. On pages that declare none, shared lines go unless most of the page's
running text is shared, which makes the two copies of one text.

Differencing alone cannot judge a page without a neighbour, or furniture inside the article, so
what tags, roles and class names call furniture goes as well.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.sources.store import materialize

# -- fixed values: HTML's own element kinds, and words that name page furniture in classes, ids and roles
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes template svg math object select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav aside form footer button dialog fieldset menu datalist".split())
ARTICLE_ROLES = frozenset("main article".split())
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion adsense dfp "
    "cookie cookies consent gdpr notice notices notification notifications alert banner popup modal overlay "
    "newsletter subscribe subscription signup login register paywall form search "
    "nav navbar navigation navigations menu menus submenu breadcrumb breadcrumbs pagination pager toc skip "
    "sidebar sidebars aside widget widgets related recommended recommendations trending popular teaser teasers "
    "share sharing shares social follow comment comments commentlist disqus respond reply replies discussion "
    "footer masthead topbar toolbar copyright".split())
#: These words name furniture outside an article only: an article may have a head of its own.
HEADS = frozenset(["header", "head", "top"])
#: A word before them in a class name that says the page merely has such a thing.
_HAS = frozenset(["has", "no", "with", "without", "is", "not", "hide", "show"])
#: Running text: lines from this many characters on.
RUNNING = 80

_TOKEN = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_URL = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)")

OPEN, ARTICLE, FURNISHED = 0, 1, 2


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw else {}


def _words(names: str) -> set[str]:
    out: set[str] = set()
    for name in names.split():
        parts = [p.lower() for p in _NAME.findall(name)]
        # "page-with-sidebar" is no sidebar
        upto = next((k for k, p in enumerate(parts) if p in _HAS), len(parts))
        out.update(parts[:upto])
    return out


def _kind(tag: str, attributes: dict[str, str], now: int) -> int:
    """What an element makes of its lines, given what it stands in."""
    if tag == "main":
        return ARTICLE  # a page has one, so what it stands in was misjudged if it is called furniture
    if now == FURNISHED or tag in DROPPED:
        return FURNISHED
    roles = set(attributes.get("role", "").lower().split())
    if roles & DROPPED_ROLES:
        return FURNISHED
    if tag in ("html", "body"):
        return now
    declares = tag == "article" or bool(roles & ARTICLE_ROLES) or attributes.get("itemprop") == "articleBody"
    named = _words(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    if named & FURNITURE:
        return FURNISHED
    if declares:
        return ARTICLE
    if now == OPEN and (tag == "header" or named & HEADS):
        return FURNISHED
    return now


def lines(html: str) -> list[tuple[str, int, str, bool]]:
    """(text, OPEN / ARTICLE / FURNISHED, chain of tags and classes, whether it is all link) of each block with text, in page order.

    Scripts, styles and the like have no lines. Tags that never close end with what they stand in.
    """
    out: list[tuple[str, int, str, bool]] = []
    stack: list[tuple[str, int, str]] = [("", OPEN, "")]
    held: list[str] = []
    linked = plain = 0
    links = 0

    def flush() -> None:
        nonlocal linked, plain
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append((text, stack[-1][1], stack[-1][2], bool(linked and not plain)))
            held.clear()
        linked = plain = 0

    def say(raw: str) -> None:
        nonlocal linked, plain
        if raw:
            held.append(raw)
            if not raw.isspace():
                linked, plain = (linked + 1, plain) if links else (linked, plain + 1)

    def leave(tag: str, until: frozenset[str] = frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if stack[k][0] in until:
                return

    at = 0
    while True:
        m = _TOKEN.search(html, at)
        say(html[at : m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, raw = m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE:
            # an inline element is part of its block, unless its names call it furniture
            if tag == "a":
                links = 0 if closing else 1
            if closing:
                if any(s[0] == tag for s in stack):
                    flush()
                    leave(tag)
            elif stack[-1][1] != FURNISHED and _kind(tag, _attributes(raw), stack[-1][1]) == FURNISHED and not raw.rstrip().endswith("/"):
                flush()
                stack.append((tag, FURNISHED, f"{stack[-1][2]}/{tag}"))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                held.append(" ")
            continue
        flush()
        links = 0
        if closing:
            leave(tag)
            continue
        if tag in RAW:
            if not raw.rstrip().endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "body" or (stack[-1][0] == "head" and tag not in ("head",)):
            leave("head")
        if stack[-1][0] == "p":
            stack.pop()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            leave(tag, frozenset(["ul", "ol", "dl", "table", "menu", "select"]))
        attributes = _attributes(raw)
        place = f"{stack[-1][2]}/{tag}.{attributes.get('class', '')}"
        stack.append((tag, _kind(tag, attributes, stack[-1][1]), place))
    flush()
    return out


def page_lines(html: str) -> tuple[list[int], list[int], list[str], list[int], list[bool]]:
    """What a page is compared by and what may be kept of it.

    (token and characters of every line; texts, line numbers and fixed flags of the lines that the
    markup does not rule out). On a page that declares an article only its lines are kept, and fixed.
    """
    found = lines(html)
    declares = any(kind == ARTICLE for _, kind, _, _ in found)
    tokens, texts, places, fixed = [], [], [], []
    for k, (text, kind, place, link) in enumerate(found):
        name = f"at {place}" if declares and kind != ARTICLE else f"is {text}"
        tokens.append(int.from_bytes(blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
        if kind == ARTICLE if declares else kind == OPEN and not link:
            texts.append(text)
            places.append(k)
            fixed.append(declares)
    return tokens, [len(t[0]) for t in found], texts, places, fixed


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions (in a, in b) of a longest common subsequence.

    Rows of the usual table are bit sets held in whole numbers: a row costs a few operations on
    len(a) bits. Only every so many rows are kept and the rest made again on the way back, so memory
    is about len(a) * sqrt(len(b)) bits. Equal heads and tails are matched first.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[int, int] = {}
    for k, v in enumerate(x):
        where[v] = where.get(v, 0) | 1 << k
    kept = [k for k, v in enumerate(y) if v in where]  # other rows change nothing
    full = (1 << len(x)) - 1

    def advance(row: int, v: int) -> int:
        use = row & where[v]
        return ((row + use) | (row - use)) & full

    stride = max(1, int(len(kept) ** 0.5))
    starts, row = [], full
    for k, at in enumerate(kept):
        if k % stride == 0:
            starts.append(row)
        row = advance(row, y[at])
    middle: list[tuple[int, int]] = []
    i = len(x)
    for s in range(len(starts) - 1, -1, -1):
        part = kept[s * stride : (s + 1) * stride]
        rows = [starts[s]]
        for at in part:
            rows.append(advance(rows[-1], y[at]))
        k = len(part)
        while i and k:
            if x[i - 1] == y[part[k - 1]]:
                i, k = i - 1, k - 1
                middle.append((head + i, head + part[k]))
            elif rows[k] >> (i - 1) & 1:
                i -= 1
            else:
                k -= 1
    return [(k, k) for k in range(head)] + middle[::-1] + ends


def _is_copy(sizes: np.ndarray, shared: np.ndarray) -> bool:
    """Whether most of a page's running text is shared, so that the other page is a copy of it."""
    running = sizes >= RUNNING
    if not running.any():
        return bool(sizes[shared].sum() * 10 >= sizes.sum() * 9)
    return bool(sizes[shared & running].sum() * 2 >= sizes[running].sum())


def shared_lines(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[list[int]]:
    """Line numbers of each of two pages, given by (tokens, characters), that they share; none of a page the other is a copy of."""
    found = np.array(common(a[0].tolist(), b[0].tolist()), np.int64).reshape(-1, 2)
    out = []
    for (_, sizes), own in ((a, found[:, 0]), (b, found[:, 1])):
        shared = np.zeros(len(sizes), bool)
        shared[own] = True
        out.append([] if _is_copy(sizes, shared) else own.tolist())
    return out


def _parsed(pages: DataFrame) -> DataFrame:
    """Every page as lines, with its host and path; written, because it is read twice."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def split(batches):
        for b in batches:
            html = b["html"]
            for k in range(0, len(b), 500):
                part = [page_lines(h) for h in html.iloc[k : k + 500]]
                urls = [_URL.match(u) if isinstance(u, str) else None for u in b["url"].iloc[k : k + 500]]
                out = pd.DataFrame(part, columns=["tokens", "sizes", "texts", "places", "fixed"])
                out["page_id"], out["url"] = b["page_id"].iloc[k : k + 500].to_numpy(), b["url"].iloc[k : k + 500].to_numpy()
                out["host"], out["path"] = [m[1].lower() if m and m[1] else None for m in urls], [m[2] if m else None for m in urls]
                yield out

    found = pages.mapInPandas(split, f"page_id {kind}, url string, host string, path string, tokens array<long>, sizes array<int>, texts array<string>, places array<int>, fixed array<boolean>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "page-lines")


def _neighbours(parsed: DataFrame) -> DataFrame:
    """(row, tokens, sizes, next_row, next_tokens, next_sizes) of every two pages next to each other in their host.

    Pages are dealt to ranges of (host, path), so a host with a third of all pages is in many tasks; a
    page's number is its place in its range, and the last one of a range is followed by the first of
    the next.
    """
    order = ["host", "path", "url", "page_id", "row"]
    rows = parsed.where("host is not null").select(*order, "tokens", "sizes")
    placed = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("row", "host", "tokens", "sizes", F.monotonically_increasing_id().alias("pos"), F.spark_partition_id().alias("part")), "page-order")
    # one row per range: their number does not grow with a host
    ranges = placed.groupBy("part").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    after = ranges.select(F.col("last").alias("pos"), F.lead("first").over(Window.orderBy("part")).alias("jump"))
    ahead = placed.join(after, "pos", "left").withColumn("at", F.coalesce("jump", F.col("pos") + 1))
    following = placed.select(F.col("pos").alias("at"), F.col("host").alias("next_host"), F.col("row").alias("next_row"), F.col("tokens").alias("next_tokens"), F.col("sizes").alias("next_sizes"))
    return ahead.join(following, "at").where("host = next_host").select("row", "tokens", "sizes", "next_row", "next_tokens", "next_sizes")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text, blocks joined by one space.

    Null and empty html give an empty text, repeated rows a row each. A null url, or one without a
    host, has no neighbours. Pages that tie in the order are taken in any order: they have the same
    path, and lines are only taken from what is not a copy. Broken markup is read as far as it goes.
    An empty table gives an empty one; other columns are not read.
    """
    parsed = _parsed(pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html")))

    def compare(batches):
        for b in batches:
            out = [
                (row, found)
                for r in b.itertuples()
                for row, found in zip((r.row, r.next_row), shared_lines((r.tokens, r.sizes), (r.next_tokens, r.next_sizes)), strict=True)
                if found
            ]
            yield pd.DataFrame(out, columns=["row", "found"])

    found = _neighbours(parsed).mapInPandas(compare, "row long, found array<int>")
    shared = materialize(found.groupBy("row").agg(F.flatten(F.collect_list("found")).alias("shared")), "shared-lines")  # two at most
    lines_of = parsed.select("row", "page_id", "url", "texts", "places", "fixed")
    open_lines = F.exists("fixed", lambda x: ~x)
    # fixed lines stay whatever is shared, so pages with no others are not shuffled for the decisions
    judged = lines_of.where(open_lines).join(shared, "row", "left")
    gone = F.coalesce("shared", F.array().cast("array<int>"))
    stays = F.filter(F.arrays_zip("texts", "places", "fixed"), lambda x: x["fixed"] | ~F.array_contains(gone, x["places"]))
    judged = judged.select("page_id", "url", F.transform(stays, lambda x: x["texts"]).alias("texts"))
    every = judged.unionByName(lines_of.where(~open_lines).select("page_id", "url", "texts"))
    return every.select("page_id", "url", F.array_join("texts", " ").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
