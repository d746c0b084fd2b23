"""Main text of web pages by comparing each page with the page of the nearest URL.

A page is cut into lines, one for each block, in page order. Pages of a host are ordered by URL
path, and a page is paired with that neighbour whose path shares more with its own. The lines of
the two are aligned by a longest common subsequence, and what they share is the host's frame, not
the page's text, so it is deleted. Two things are known from the markup instead: lines inside an
article are the page's own even if another page repeats them, and menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments are not text even if no other page
has them. Lines outside an article are decided by the comparison; one that repeats a line of the
page's own articles is told once, in the article. A class name marks a frame if all its parts are
words for frames or places (`site-footer`), so `has-sidebar` on a wrapper does not.

The order of a host does not end at a directory or a number of pages. All pages are sorted by host,
path, URL and id, without their html, and the order is cut into blocks of at most `BLOCK` pages and
about `BLOCK_BYTES` of html. Each page is sent to its block, and the first and the last page of
a block also to the blocks beside it, if these go on with the same host. So every page meets the pages
before and after it, whatever the cuts, and no block grows with the tables; only rows with equal URL, id
and html are never cut apart. Two rows for a block, its first and last place, pass through the driver.
A host's only page is compared with none. Pages that are equal line by line, or without an article
and with all lines shared, are copies of each other, and nothing is deleted.

Nulls and odd input: null or empty html gives an empty text. Pages without a URL are one more host.
Null ids and repeated rows keep their rows. Broken markup is read as far as it goes; what is not
closed ends with the page. Other columns, whatever their names, are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollway.llm.columns import store

BLOCK = 1_000  # pages
BLOCK_BYTES = 16 << 20  # bytes of html, if one page does not have more

# Fixed lists: what the elements of HTML are for, and words that name parts of a page.
_UNSEEN = "script style noscript template iframe svg canvas audio video object textarea select title"
_FRAME = set("nav footer aside form dialog button".split())
_OWN = {"article", "main"}
_BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main"
    " menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_REGIONS = _FRAME | _OWN | {"header", "div", "section", "ul", "ol", "span", "p", "table", "head"}
_FRAME_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter"
    " notice pager pagination popup promo promoted recommended related respond share sharing sidebar"
    " skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
_PLACES = set("site main top bottom primary secondary global links".split())
_FRAME_ROLES = set(
    "alert banner complementary contentinfo dialog form menu menubar navigation search".split()
)

_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{"|".join(_UNSEEN.split())})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(
    r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I
)
_NAME_PART = re.compile(r"[a-z0-9]+")

TEXT, OWN, FRAME = 0, 1, 2  # what a line is by its markup


def _names_frame(attrs: str, inside_own: bool) -> bool:
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" and "=" not in m[0]:
            return True
        if name == "role":
            if value in _FRAME_ROLES:
                return True
        else:
            for whole in value.split():
                parts = set(_NAME_PART.findall(whole)) - _PLACES
                if not inside_own:
                    parts = {"menu" if x == "header" else x for x in parts}
                if parts and parts <= _FRAME_WORDS:
                    return True
    return False


def page_lines(html: str | None) -> tuple[list[str], list[int]]:
    """Lines of a page, and what each is by its markup."""
    lines: list[str] = []
    kinds: list[int] = []
    some: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in a frame, in an article or main
    frame = own = False

    def end_block() -> None:
        line = " ".join(unescape("".join(some)).split())
        some.clear()
        if line:
            lines.append(line)
            kinds.append(FRAME if frame else OWN if own else TEXT)

    html = html or ""
    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            some.append(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "br":
            some.append(" ")
        if tag in _BLOCKS:
            end_block()
        if tag not in _REGIONS:
            continue
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    end_block()
                    del stack[i:]
                    frame, own = stack[-1][1:] if stack else (False, False)
                    break
        elif not m["attrs"].endswith("/"):
            if tag == "p" and stack and stack[-1][0] == "p":
                end_block()
                stack.pop()  # a paragraph ends where the next begins
                frame, own = stack[-1][1:] if stack else (False, False)
            attrs = m["attrs"]
            starts = tag in _FRAME or tag == "head" or (tag == "header" and not own)
            starts = starts or bool(attrs and _names_frame(attrs, own))
            if starts and not frame:
                end_block()
            frame = frame or starts
            if tag in _OWN and not frame:
                own = True
            stack.append((tag, frame, own))
    if at < len(html):
        some.append(html[at:])
    end_block()
    return lines, kinds


def shared_lines(mine: list[str], other: list[str]) -> set[int]:
    """Positions of `mine` in a longest common subsequence with `other`."""
    first = len(commonprefix([mine, other]))
    last = len(commonprefix([mine[first:][::-1], other[first:][::-1]]))
    found = {*range(first), *range(len(mine) - last, len(mine))}
    where: dict[str, list[int]] = {}
    for j in range(len(other) - last - 1, first - 1, -1):
        where.setdefault(other[j], []).append(j)
    # ends[k]: least end in `other` of a common subsequence of k + 1 lines; the link leads back
    ends: list[int] = []
    links: list[tuple[int, tuple | None]] = []
    for i in range(first, len(mine) - last):
        for j in where.get(mine[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def own_text(lines: list[str], kinds: list[int], other: list[str] | None) -> str:
    """The page's text: its own lines, and of the rest what is neither frame nor shared."""
    shared = shared_lines(lines, other) if other else set()
    if lines == other or (OWN not in kinds and len(shared) == len(lines)):
        shared = set()
    own = {line for line, kind in zip(lines, kinds) if kind == OWN}
    return "\n".join(
        line
        for i, (line, kind) in enumerate(zip(lines, kinds))
        if kind == OWN or (kind == TEXT and i not in shared and line not in own)
    )


def _nearest(hosts: list[str], paths: list[str], i: int) -> int | None:
    """Of the places of the host before and after i, the one whose path has more in common with that of i."""
    near = [j for j in (i - 1, i + 1) if 0 <= j < len(paths) and hosts[j] == hosts[i]]
    return max(near, key=lambda j: len(commonprefix([paths[j], paths[i]])), default=None)


_PLACE = ["host", "path", "url_key", "id_key", "html_key"]  # what pages are ordered by
_PLACE_TYPES = "host string, path string, url_key string, id_key string, html_key bigint"


def _place(url: Column, id_: Column, html: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    return {
        "host": F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1)),
        "path": F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1),
        "url_key": url,
        "id_key": F.coalesce(id_.cast("string"), F.lit("")),
        "html_key": F.xxhash64(html),
    }


def _cut(block: int, block_bytes: int):
    """The first and last place of every block, of places in order; equal ones stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        pages = size = 0
        for batch in batches:
            blocks = []
            for *place, n in zip(*(c.to_pylist() for c in batch.columns)):
                if first is None:
                    first = place
                elif place != last and (pages >= block or size + n > block_bytes):
                    blocks.append((first, last))
                    first, pages, size = place, 0, 0
                last, pages, size = place, pages + 1, size + n
            yield ends(blocks)
        yield ends([(first, last)] if first else [])

    def ends(blocks) -> pa.RecordBatch:
        rows = [[*first, *last] for first, last in blocks]
        types = [pa.string()] * 4 + [pa.int64()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types + types)]
        return pa.RecordBatch.from_arrays(columns, [f"{e}_{c}" for e in "ab" for c in _PLACE])

    return run


def blocks_of(pages: DataFrame, block: int, block_bytes: int) -> list[tuple[tuple, tuple]]:
    """(first place, last place) of the blocks of pages (id, url, html), in order."""
    places = pages.select(
        *[c.alias(name) for name, c in _place(F.col("url"), F.col("id"), F.col("html")).items()],
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("bigint").alias("n"),
    )
    types = ", ".join(f"{e}_{c}" for e in "ab" for c in _PLACE_TYPES.split(", "))
    # stored, as the cuts are not the same each time they are made
    cut = store(
        places.repartitionByRange(*_PLACE).sortWithinPartitions(*_PLACE)
        .mapInArrow(_cut(block, block_bytes), types),
        "blocks-of-pages",
    )
    n = len(_PLACE)
    return sorted((tuple(r[:n]), tuple(r[n:])) for r in cut.collect())


_DEALT = ["block", "own", "id", "url", *_PLACE, "lines", "kinds"]


def _deal(blocks: list[tuple[tuple, tuple]]):
    """The lines of pages, sent to their blocks, and of those at an end also to the next block."""
    firsts = [a for a, _ in blocks]

    def homes(place: tuple) -> Iterator[tuple[int, bool]]:
        at = bisect_right(firsts, place) - 1
        yield at, True
        first, last = blocks[at]
        if place == first and at and blocks[at - 1][1][0] == place[0]:
            yield at - 1, False
        if place == last and at + 1 < len(blocks) and firsts[at + 1][0] == place[0]:
            yield at + 1, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(_PLACE)
        for batch in batches:
            pages = [page_lines(html.as_py()) for html in batch.column(n + 2)]
            places = zip(*(batch.column(i).to_pylist() for i in range(2, n + 2)))
            sent = [(r, at, own) for r, place in enumerate(places) for at, own in homes(place)]
            rows = pa.array([r for r, _, _ in sent], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([at for _, at, _ in sent], pa.int64()),
                    pa.array([own for _, _, own in sent], pa.bool_()),
                    *[batch.column(i).take(rows) for i in range(n + 2)],
                    pa.array([pages[r][0] for r, _, _ in sent], pa.list_(pa.string())),
                    pa.array([pages[r][1] for r, _, _ in sent], pa.list_(pa.int8())),
                ],
                _DEALT,
            )

    return run


def _differ(table: pa.Table) -> pa.Table:
    places = list(zip(*(table[c].to_pylist() for c in _PLACE)))
    own, lines, kinds = (table[c].to_pylist() for c in ("own", "lines", "kinds"))
    order = sorted(range(len(places)), key=places.__getitem__)
    hosts = [places[r][0] for r in order]
    in_order = [places[r][1] for r in order]
    text = [None] * len(places)
    for i, r in enumerate(order):
        if own[r]:
            j = _nearest(hosts, in_order, i)
            text[r] = own_text(lines[r], kinds[r], None if j is None else lines[order[j]])
    found = pa.table({"id": table["id"], "url": table["url"], "text": pa.array(text, pa.string())})
    return found.filter(table["own"])


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    block: int = BLOCK, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")
    )
    place = _place(F.col("url"), F.col("id"), F.col("html"))
    kind = pages.schema[id_col].dataType.simpleString()
    dealt = rows.select("id", "url", *[c.alias(name) for name, c in place.items()], "html").mapInArrow(
        _deal(blocks_of(rows, block, block_bytes)),
        f"block bigint, own boolean, id {kind}, url string, {_PLACE_TYPES},"
        " lines array<string>, kinds array<tinyint>",
    )
    found = dealt.groupBy("block").applyInArrow(_differ, f"id {kind}, url string, text string")
    return found.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
        F.char_length("text").cast("bigint").alias("n_chars"),
    )
