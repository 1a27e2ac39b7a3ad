"""Main text of web pages by differencing each page with the pages of nearest URL.

A page is read into lines of text, each with the element that contains it. Pages are ordered by host and URL path; each
is compared with the nearest different pages on either side, up to ``reach`` of them among the ``SPAN`` places next to
it. The lines of two pages are aligned by a longest common subsequence, and what both have is the site's template:

* the main region is the element that holds nearly all text of the page and its neighbours (elements of a name and place
  are weighed over all these pages, so that a short article is not taken for its advert), ``article`` and ``main`` first;
* outside the main region every shared line goes, and so does an element with a class or id of its own that the
  neighbour has as well, in the same place, although its words differ from page to page (an advert, a teaser): its
  place is aligned where its words can't be. Headings and elements of a quarter of the main region's text are no such
  places;
* inside the main region an element all of whose lines are shared with two different neighbours goes; single paragraphs
  stay, since articles quote each other. A region that is shared as a whole is none, and the next best is taken.

A neighbour that shares most of the main region, and its ``h1`` if there is one, is a copy of the page, not a sibling,
and is passed over. Pages whose host has no other page near are compared with the nearest pages of other hosts, but only
for named elements. Markup alone decides what can't be content: scripts, styles, forms, ``nav``, ``footer``, ``aside``,
``header`` outside an article, their ARIA roles, and elements named as reader comments.

One shuffle moves each page once: ranges of (host, path) are cut beforehand from the URLs alone, and the pages within
``SPAN`` places of a cut go to both sides of it. So a large host spreads over many tasks, each of which streams over its
range with a window, and the text does not depend on the number of ranges.

Null html counts as empty and gives an empty text. A null or malformed URL has no host; such pages have no neighbours
and are spread by a hash. Repeated rows are copies of each other. A null page_id passes through, first in the order. An
empty table gives an empty result. Lines that a page holds more than ``FREQUENT`` times are aligned exactly, by rows of
bits. Further columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.functions.sequences import lcs_pairs

SPAN = 8  # places on either side in which neighbours are looked for
FREQUENT = 64

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas textarea title select option button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark nobr q s samp small span strike strong del sub sup time tt u var wbr img ruby rt rp math mi mo mn ms mrow msup msub mfrac mtext semantics".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li tr td th dt dd blockquote pre".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
# fixed values: ARIA roles of what is no content, and names of reader comments
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENTS = frozenset("comments comment-list commentlist disqus_thread reader-comments".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I | re.S)
_DIGITS = re.compile(r"\d+")


@dataclass
class Page:
    """``elements``: (parent, place, kind) of every containing element, parents first; ``place`` stands for names and
    classes on the way to it. Kinds: 0 plain, 1 named by class or id, 2 article or main. ``lines``: (element, markup
    says it is no content, heading, text) in page order."""

    elements: list[list]
    lines: list[list]

    @cached_property
    def texts(self) -> list[str]:
        return [line[3] for line in self.lines]

    @cached_property
    def weights(self) -> list[int]:
        """Characters of content below every element."""
        out = [0] * len(self.elements)
        for e, off, _, text in self.lines:
            if not off:
                out[e] += len(text)
        for e in range(len(out) - 1, 0, -1):
            out[self.elements[e][0]] += out[e]
        return out

    @cached_property
    def by_place(self) -> Counter:
        """Characters of content by place."""
        found: Counter = Counter()
        for (_, place_, _), w in zip(self.elements, self.weights):
            found[place_] += w
        return found

    def within(self, top: int) -> set[int]:
        found = {top}
        for e in range(top + 1, len(self.elements)):
            if self.elements[e][0] in found:
                found.add(e)
        return found


def parse(page: str) -> Page:
    """Lines and elements of a page; broken markup ends elements as browsers do, roughly."""
    elements: list[list] = [[0, 0, 0]]
    lines: list[list] = []
    stack: list[tuple[str, int, bool, bool, int]] = []  # name, element, is no content, inside an article, heading
    depth: Counter = Counter()
    at, text = 0, []

    def flush() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            top = stack[-1] if stack else ("", 0, False, False, 0)
            lines.append([top[1], int(top[2]), top[4], line])

    def close(k: int) -> None:
        for name, *_ in stack[k:]:
            depth[name] -= 1
        del stack[k:]

    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if name not in INLINE:
            flush()
        if m.group(1):
            if name not in INLINE and depth[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else (len(page) if name in ("script", "style", "title", "textarea") else at)
            continue
        if name in VOID or name in INLINE or m.group(3).rstrip().endswith("/"):
            continue
        if name in LEAF and stack and stack[-1][0] == name and name not in ("blockquote", "pre"):
            close(len(stack) - 1)  # such an element ends where the next one begins
        _, parent, off, inside, heading = stack[-1] if stack else ("", 0, False, False, 0)
        named = {k.lower(): v.strip("\"'").lower() for k, v in _NAMED.findall(m.group(3))} if m.group(3) else {}
        words = f"{named.get('class', '')} {named.get('id', '')}".split()
        off = off or (name in ASIDE and not (name == "header" and inside)) or not ROLES.isdisjoint(named.get("role", "").split()) or not COMMENTS.isdisjoint(words)
        article = name in ("article", "main")
        if name in LEAF:
            element = parent  # leaves of the text belong to what is around them
        else:
            element = len(elements)
            label = f"{elements[parent][1]}>{name} {_DIGITS.sub('0', ' '.join(words))}"
            elements.append([parent, zlib.crc32(label.encode("utf-8", "surrogatepass")), 2 if article else int(bool(words))])
        stack.append((name, element, off, inside or article, (1 if name == "h1" else 2) if name in HEADING else heading))
        depth[name] += 1
    if at < len(page):
        tail = page[at:]
        text.append(html.unescape(tail.partition("<")[0] if re.match(r"[^<]*<[A-Za-z/!]", tail) else tail))
    flush()
    return Page(elements, lines)


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices into ``a`` of a longest common subsequence of lines: Hunt and Szymanski's way, which takes a step per pair
    of equal lines, or where a shared line is frequent by diagonals or rows of bits."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    if any(len(places.get(line, ())) > FREQUENT for line in set(a)):
        return {i for i, _ in lcs_pairs(a, b)}
    tops: list[int] = []
    chain: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(tops, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(tops):
                tops.append(j)
                chain.append(link)
            else:
                tops[k], chain[k] = j, link
    found, node = set(), chain[-1] if chain else None
    while node:
        found.add(node[0])
        node = node[1]
    return found


def main_region(page: Page, weight: Counter, gone: set[int]) -> int:
    """The element that holds the main text: ``weight`` is characters by place over page and neighbours."""
    live = [0] * len(page.elements)
    for i, (e, off, _, text) in enumerate(page.lines):
        if not off and i not in gone:
            live[e] += len(text)
    for e in range(len(live) - 1, 0, -1):
        live[page.elements[e][0]] += live[e]
    articles = [e for e, (_, _, kind) in enumerate(page.elements) if kind == 2 and live[e]]
    if articles:
        return max(articles, key=lambda e: (live[e], -e))
    children: dict[int, list[int]] = {}
    for e in range(1, len(live)):
        if live[e]:
            children.setdefault(page.elements[e][0], []).append(e)
    top = 0
    while top in children:
        best = max(children[top], key=lambda e: (weight[page.elements[e][1]], live[e], -e))
        if 4 * weight[page.elements[best][1]] < 3 * weight[page.elements[top][1]]:
            break
        top = best
    return top


def _copies(page: Page, shared: set[int], region: set[int]) -> bool:
    """The other page shares most of the main region and its first heading."""
    own = [(i, len(text), heading) for i, (e, off, heading, text) in enumerate(page.lines) if e in region and not off]
    if 2 * sum(n for i, n, _ in own if i in shared) <= sum(n for _, n, _ in own):
        return False
    first = next((i for i, line in enumerate(page.lines) if line[2] == 1 and not line[1]), None)
    return first is None or first in shared


def difference(page: Page, before: list[tuple[bool, Page]], after: list[tuple[bool, Page]], reach: int = 2) -> str:
    """The text of a page after differencing with its neighbours on either side: (same host, page), nearest first."""
    if not page.lines:
        return ""
    kin = bool(before and before[0][0] or after and after[0][0])
    sides = [[p for same, p in side if same or not kin] for side in (before, after)]
    weight = sum((p.by_place for side in sides for p in side[: 2 * reach]), page.by_place.copy())
    top = main_region(page, weight, set())
    region = page.within(top)
    siblings: list[tuple[Page, set[int]]] = []
    for side in sides:
        found = 0
        for other in side:
            if found == reach:
                break
            shared = shared_lines(page.texts, other.texts) if kin else set()
            if not _copies(page, shared, region):
                siblings.append((other, shared))
                found += 1
    different = [s for k, s in enumerate(siblings) if not any(_alike(s[0], t[0]) for t in siblings[:k])] if len(siblings) > 1 else siblings
    votes = Counter(i for _, shared in different for i in shared)
    by_element: dict[int, list[int]] = {}
    for i, line in enumerate(page.lines):
        by_element.setdefault(line[0], []).append(i)
    in_region = [i for e in region for i in by_element.get(e, ())]
    gone: set[int] = set()
    if in_region and all(votes[i] > 1 for i in in_region):  # template through and through
        gone.update(in_region)
        top = main_region(page, weight, gone)
        region = page.within(top)
    for e in region - {top}:
        own = [i for d in page.within(e) for i in by_element.get(d, ())]
        if own and all(votes[i] > 1 for i in own):
            gone.update(own)
    gone.update(i for i in votes if page.lines[i][0] not in region)
    above, e = {0}, top
    while e:
        e = page.elements[e][0]
        above.add(e)
    there = {place_ for other, _ in siblings for _, place_, kind in other.elements if kind == 1}
    for e, (_, place_, kind) in enumerate(page.elements):
        if kind == 1 and place_ in there and e not in region and e not in above and 4 * weight[place_] < weight[page.elements[top][1]]:
            own = [i for d in page.within(e) for i in by_element.get(d, ())]
            if not any(page.lines[i][2] for i in own):
                gone.update(own)
    return "\n".join(line[3] for i, line in enumerate(page.lines) if not line[1] and i not in gone)


def _alike(a: Page, b: Page) -> bool:
    """Most of the lines of ``a`` are lines of ``b``."""
    there = set(b.texts)
    return 2 * sum(len(t) for t in a.texts if t in there) > sum(map(len, a.texts))


# ---------------------------------------------------------------- ranges of URLs


def place(url: str | None) -> str | None:
    """Host and path of a URL as one key: path segments keep their order, a query comes last. None: no host."""
    try:
        parts = urlsplit(url or "")
        return f"{parts.hostname}\0{parts.path}" + ("?" + parts.query if parts.query else "") if parts.hostname else None
    except ValueError:
        return None


Key = tuple[str, int]  # place and page_id, null first


def _key(place_: str, page_id: int | None) -> Key:
    return place_, -(1 << 63) if page_id is None else page_id


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"place": pa.array([place(u) for u in batch.column("url").to_pylist()], pa.string()), "page_id": batch.column("page_id")})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last ``SPAN`` keys of a sorted range; all of a shorter one."""
    first: list[Key] = []
    last: deque[Key] = deque(maxlen=SPAN)
    n = 0
    for batch in batches:
        for k in zip(batch.column("place").to_pylist(), batch.column("page_id").to_pylist()):
            n += 1
            if len(first) < SPAN:
                first.append(_key(*k))
            last.append(_key(*k))
    if n:
        keys = first + list(last)[max(0, len(first) + len(last) - n) :]
        yield pa.RecordBatch.from_pydict({"places": pa.array([[k[0] for k in keys]], pa.list_(pa.string())), "ids": pa.array([[k[1] for k in keys]], pa.list_(pa.int64()))})


@dataclass
class Ranges:
    """``cuts``: first key of every range; ``low``, ``high``: keys from and up to which pages of other ranges are near."""

    cuts: list[Key]
    low: list[Key]
    high: list[Key]
    n: int

    def of(self, key: Key) -> tuple[int, list[int]]:
        own = max(0, bisect_right(self.cuts, key) - 1)
        near, j = [], own + 1
        while j < len(self.cuts) and self.low[j] <= key:
            near.append(j)
            j += 1
        j = own - 1
        while j >= 0 and self.high[j] >= key:
            near.append(j)
            j -= 1
        return own, near


def ranges(pages: DataFrame, n: int) -> Ranges:
    """At most ``n`` ranges, from the URLs alone. The driver gets at most ``2 * SPAN`` keys a range."""
    keys = pages.select("page_id", "url").mapInArrow(_places, "place string, page_id long").where("place IS NOT NULL")
    ends = keys.repartitionByRange(n, "place", "page_id").sortWithinPartitions("place", "page_id").mapInArrow(_ends, "places array<string>, ids array<long>")
    found = sorted(list(zip(r.places, r.ids)) for r in ends.collect())
    flat = [k for own in found for k in own]
    starts = [0]
    for own in found:
        starts.append(starts[-1] + len(own))
    low = [flat[max(0, s - SPAN)] for s in starts[:-1]]
    high = [flat[min(len(flat), e + SPAN) - 1] for e in starts[1:]]
    return Ranges([own[0] for own in found], low, high, max(1, n))


SENT = "range int, place string, page_id long, url string, halo boolean, page binary"


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Ranges = shared.value
        packer = zstandard.ZstdCompressor(level=6)
        kinds = pa.schema([("range", pa.int32()), ("place", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("halo", pa.bool_()), ("page", pa.binary())])
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part, out = batch.slice(a, 500), []
                for page_id, url, raw in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist()):
                    found, where = parse(raw or ""), place(url)
                    packed = packer.compress(json.dumps([found.elements, found.lines], ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))
                    if where is None:
                        own, near = zlib.crc32(f"{page_id} {url}".encode("utf-8", "surrogatepass")) % known.n, []
                    else:
                        own, near = known.of(_key(where, page_id))
                    out += [(r, where, page_id, url, r != own, packed) for r in (own, *near)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)], schema=kinds)

    return run


def _stream(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(packed: bytes) -> Page:
            return Page(*json.loads(zstandard.decompress(packed).decode("utf-8", "surrogatepass")))

        def near(k: int, step: int) -> list[tuple[bool, Page]]:
            own, out = window[k]["place"], []
            if own is None:
                return out
            for j in range(k + step, k + step * (SPAN + 1), step):
                if not 0 <= j < len(window):
                    break
                if window[j]["place"] is not None:
                    out.append((window[j]["place"].partition("\0")[0] == own.partition("\0")[0], window[j]["page"]))
            return out

        def result() -> pa.RecordBatch:
            text = pa.array([d[2].encode("utf-8", "replace").decode() for d in done], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), text], ["page_id", "url", "text"])

        window: list[dict] = []
        pending, done = 0, []  # pending: first page of the window that is not solved yet

        def solve(last: bool) -> None:
            nonlocal pending
            while pending < len(window) and (last or len(window) - pending > SPAN):
                own = window[pending]
                if not own["halo"]:
                    done.append((own["page_id"], own["url"], difference(own["page"], near(pending, -1), near(pending, 1), reach)))
                pending += 1
                if pending > SPAN:
                    window.pop(0)
                    pending -= 1

        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                for r in batch.slice(a, 100).to_pylist():
                    window.append({k: r[k] for k in ("place", "page_id", "url", "halo")} | {"page": unpack(r["page"])})
                    solve(False)
                if len(done) >= 200:
                    yield result()
                    done.clear()
        solve(True)
        if done:
            yield result()

    return run


def main_text(pages: DataFrame, reach: int = 2, n_ranges: int | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages`` (page_id, url, html). ``reach``: different pages that
    each page is compared with on either side. ``n_ranges``: the session's number of shuffle partitions unless given."""
    spark = pages.sparkSession
    n = n_ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    known = spark.sparkContext.broadcast(ranges(rows, n))
    sent = rows.mapInArrow(_read(known), SENT).repartitionById(n, "range").sortWithinPartitions("range", "place", "page_id", F.xxhash64("page"))
    return sent.mapInArrow(_stream(reach), "page_id long, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
