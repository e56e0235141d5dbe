"""Operator 6: main text by wrappers, union-free regular expressions inferred from the pages of a host.

A page is read as a stream of block tags and text (inline markup belongs to the text around it). Streams of a host are
aligned iteratively, level by level of nesting: equal tags are matched and their contents aligned in turn; neighbours
that repeat become a repeated group, also across a mismatch; what stands on one side only becomes optional; texts that
differ become a slot, texts that agree on all pages stay constant. The wrapper that results has no unions and matches
every page of its host. In it the main part is marked once: the article or main element with the most text, or else
the deepest part that holds most of the varying text outside links. Menus, headers, footers, sidebars, notices,
adverts, forms and reader comments are told by their tags, roles and class names and never marked. Each page is then
walked along its wrapper, and the texts in marked places are its main text.

Each task aligns the pages it reads, host by host, so a host of a third of all pages sends one partial wrapper from
each task; these are aligned in two steps, salted by task, of about the square root of the number of tasks each. The
finished wrappers are broadcast where they are small, and else joined by host (a hot host is a skewed join, which Spark
splits).

Defined results: null or empty html has the empty text; a url without a host, and a null one, count as host ``''``;
repeated rows get a row each; an empty table gives no rows; columns besides page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm import common

BROADCAST_BYTES = 32 << 20
#: Partial wrappers that a task holds at a time.
HOSTS = 2000
#: The longest group of neighbours whose repetition is looked for.
PERIOD = 3
#: The weight of a match in an alignment.
UNIT = 1 << 10

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp".split())
#: The tags that end an open one of the first kind.
ENDS = {
    "p": frozenset("address article aside blockquote details div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
ASIDE_TAGS = frozenset("aside button canvas datalist dialog footer form head header menu nav object select svg".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies dialog discussion"
    " disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices paywall popup promo promotion recommended related replies respond search share sharing"
    " sidebar skip social sponsor sponsored subscribe tags toolbar widget".split()
)
#: How a tag, comment or declaration begins, and what is behind a tag's name.
_START = re.compile(r"<(?:(?P<comment>!--)|(?P<cdata>!\[CDATA\[)|(?P<other>[!?])|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*))")
_REST = re.compile(r"(?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+>")
#: Elements below so many others are put beside these, as browsers do; no text is lost.
DEPTH = 100
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

# A page's element is [label, children]; a text is (text, characters inside links).
# A wrapper's item is [label, pages, repeated, main, characters, link characters, constant, children]: label "#" is a
# text, "(" a group. Lists, so that they go through JSON.
LABEL, PAGES, REPEATED, MAIN, CHARS, LINKED, CONSTANT, CHILDREN = range(8)


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """The tag with its class, id and role (without digits); whether the element is hidden."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag, False
    names, hidden = [], False
    for name, value in _ATTR.findall(attrs):
        if name.lower() == "hidden":
            hidden = True
        else:
            names += re.sub(r"\d+", "", value.strip("\"'").lower()).split()
    return ".".join([tag, *sorted(set(names))]), hidden


def parse(html: str) -> list:
    """The tree of block elements and texts of a page."""
    root: list = ["", []]
    stack, tags, text, linked, link = [root], [""], [], 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            found = " ".join("".join(text).split())
            if found:
                stack[-1][1].append((found, linked))
            text.clear()
            linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        raw = unescape(raw)
        text.append(raw)
        if link:
            linked += len(raw)

    def behind(mark: str, start: int) -> tuple[int, int]:
        """Where a mark stands, and the place behind it; the end where there is none."""
        found = html.find(mark, start)
        return (size, size) if found < 0 else (found, found + len(mark))

    at, size, last = 0, len(html), html.rfind(">")
    deep: Counter = Counter()  # open elements that stand beside their parent
    quotes = True  # False from the first tag on whose quotes never end: a tag then ends at the next ">"
    while at < size:
        m = _START.search(html, at)
        if m is None or m["tag"] and m.end() > last:  # what never ends is text
            add(html[at:])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            end, at = behind("-->" if m["comment"] else "]]>" if m["cdata"] else ">", at)
            if m["cdata"]:
                add(html[m.end():end])
            continue
        rest = _REST.match(html, at) if quotes else None
        quotes = rest is not None
        stop = rest.end() if rest else html.index(">", at) + 1
        attrs, at = html[at:stop - 1], stop
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                link = max(0, link - 1)
            elif deep[tag]:
                flush()
                deep[tag] -= 1
            elif tag in tags[1:]:
                flush()
                k = len(tags) - 1 - tags[::-1].index(tag)
                del stack[k:], tags[k:]
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
            at = behind(">", end.end())[1] if end else size
            continue
        label, hidden = _label(tag, attrs)
        if tag in INLINE and not (hidden or tag == "span" and _aside_words(label)):
            link += tag == "a" and not attrs.endswith("/")
            continue
        flush()
        if tag in VOID:
            continue
        for open_, by in ENDS.items():
            if tag in by and open_ in tags:
                k = len(tags) - 1 - tags[::-1].index(open_)
                if not any(t in SCOPES.get(open_, ("article", "section", "div", "table", "blockquote", "li", "td")) for t in tags[k + 1:]):
                    del stack[k:], tags[k:]
        if hidden:
            label = f"{label}.notice"
        node = [label, []]
        stack[-1][1].append(node)
        if attrs.endswith("/"):
            continue
        if len(stack) > DEPTH:
            deep[tag] += 1
        else:
            stack.append(node)
            tags.append(tag)
    flush()
    return root


def _aside_words(label: str) -> bool:
    return any(w in ASIDE_WORDS for name in label.split(".")[1:] for w in re.split(r"[-_]+", name))


def constant(text: str) -> str:
    """A short text itself, a longer one's digest behind a space, with which no text begins."""
    return text if len(text) <= 80 else f" {hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def item(node) -> list:
    """A page's element or text as a wrapper of one page, its repeated neighbours folded."""
    if isinstance(node, tuple):
        return ["#", 1, False, False, len(node[0]), node[1], constant(node[0]), []]
    return [node[0], 1, False, False, 0, 0, None, fold([item(c) for c in node[1]])]


def key(x: list) -> str:
    return f"({' '.join(c[LABEL] for c in x[CHILDREN])})" if x[LABEL] == "(" else x[LABEL]


def fold(items: list) -> list:
    """Neighbours that repeat become one repeated item, first single ones, then groups."""
    out: list = []
    for x in items:
        if out and out[-1][LABEL] == x[LABEL] and x[LABEL] != "(":
            out[-1] = merge(out[-1], x)
            out[-1][REPEATED] = True
        else:
            out.append(x)
    for n in range(2, PERIOD + 1):
        i = 0
        while i + 2 * n <= len(out):
            if [key(x) for x in out[i:i + n]] == [key(x) for x in out[i + n:i + 2 * n]] and not any(x[LABEL] == "(" for x in out[i:i + n]):
                group = [merge(a, b) for a, b in zip(out[i:i + n], out[i + n:i + 2 * n])]
                rest = i + 2 * n
                while [key(x) for x in out[rest:rest + n]] == [key(x) for x in group]:
                    group = [merge(a, b) for a, b in zip(group, out[rest:rest + n])]
                    rest += n
                out[i:rest] = [["(", 1, True, False, 0, 0, None, group]]
            i += 1
    return out


def grouped(items: list, other: list) -> list:
    """A single pass through what the other side has as a repeated group becomes that group as well."""
    for g in (x for x in other if x[LABEL] == "("):
        labels, n, i = [c[LABEL] for c in g[CHILDREN]], len(g[CHILDREN]), 0
        while i + n <= len(items):
            if [x[LABEL] for x in items[i:i + n]] == labels:
                items = [*items[:i], ["(", max(x[PAGES] for x in items[i:i + n]), True, False, 0, 0, None, items[i:i + n]], *items[i + n:]]
            i += 1
    return items


def merge(a: list, b: list) -> list:
    """Two items of one label aligned."""
    return [
        a[LABEL], a[PAGES] + b[PAGES], a[REPEATED] or b[REPEATED], False, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED],
        a[CONSTANT] if a[CONSTANT] == b[CONSTANT] else None, align(a[CHILDREN], b[CHILDREN]),
    ]


def align(a: list, b: list) -> list:
    if not a or not b:
        return a or b
    a, b = grouped(a, b), grouped(b, a)
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    if ka == kb:
        return [merge(x, y) for x, y in zip(a, b)]
    out = []
    i = k = 0
    for j, m in [*pairs(a, b), (len(a), len(b))]:  # between pairs, on one side only: optional
        out += a[i:j] + b[k:m]
        if j < len(a):
            out.append(merge(a[j], b[m]))
        i, k = j + 1, m + 1
    return fold_again(out)


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Which items of two sides are one, in order."""
    ka, kb = [key(x) for x in a], [key(x) for x in b]
    both = set(ka) & set(kb)
    ia, ib = [i for i, k in enumerate(ka) if k in both], [i for i, k in enumerate(kb) if k in both]
    if len(ia) == len(ib) == len(both) and all(ka[i] == kb[j] for i, j in zip(ia, ib)):
        return list(zip(ia, ib))
    ids: dict = {}
    found = best([shape(a[i], ids) for i in ia], [shape(b[j], ids) for j in ib])
    return [(i, ib[j]) for i, j in zip(ia, found) if j >= 0]


def shape(x, ids: dict) -> tuple:
    """The key, the label paths below (groups opened) and the constant text of an element, a text or an item."""
    if isinstance(x, tuple):
        return "#", frozenset(), constant(x[0])
    found = set()

    def down(children: list, at: int) -> None:
        for c in children:
            label = "#" if isinstance(c, tuple) else c[LABEL]
            if label == "(":
                down(c[-1], at)
                continue
            path = ids.setdefault((at, label), len(ids) + 1)
            found.add(path)
            if label != "#":
                down(c[-1], path)

    down(x[-1], 0)
    return key(x), frozenset(found), x[CONSTANT] if x[LABEL] == "#" else None


def likeness(a: tuple, b: tuple) -> int:
    """What a match of two shapes counts: the match, each label path below in both, and how much of all paths these are."""
    if a[0] != b[0]:
        return 0
    if a[0] == "#":
        return 2 * UNIT if a[2] is not None and a[2] == b[2] else UNIT
    common, size = len(a[1] & b[1]), len(a[1]) + len(b[1])
    return UNIT * (1 + common) + ((UNIT - 1) * 2 * common // size if size else UNIT - 1)


def best(children: list[tuple], places: list[tuple], again: np.ndarray | None = None, group: np.ndarray | None = None) -> list[int]:
    """The place of each child, or -1: the alignment in order whose matches count most.

    A place marked in ``again`` takes several children, and those of one ``group`` (its number, for each place) take turns.
    Exact at any length; a square root of all rows is kept, and those between are worked out again on the way back.
    """
    n, m = len(children), len(places)
    if not n or not m:
        return [-1] * n
    kinds, others = {s: i for i, s in enumerate(dict.fromkeys(children))}, {s: i for i, s in enumerate(dict.fromkeys(places))}
    table = np.array([[likeness(s, t) for t in others] for s in kinds], np.int64)
    of, to = [kinds[s] for s in children], np.array([others[t] for t in places])
    none = -(1 << 60)
    starts = np.flatnonzero(np.diff(group, prepend=-1)) if group is not None else None
    turn = np.cumsum(np.diff(group, prepend=-1) != 0) - 1 if group is not None else None

    def step(row: np.ndarray, i: int) -> np.ndarray:
        # row[j + 1]: the most with the last match at place j; row[0]: without a match.
        count, arrive = table[of[i]][to], np.maximum.accumulate(row)[:-1]
        if again is not None:
            arrive = np.where(again, np.maximum(arrive, np.maximum.reduceat(row[1:], starts)[turn]), arrive)
        new = row.copy()
        new[1:] = np.maximum(new[1:], np.where(count > 0, arrive + count, none))
        return new

    row = np.full(m + 1, none, np.int64)
    row[0] = 0
    every, kept = math.isqrt(n) + 1, [row]
    for i in range(n):
        row = step(row, i)
        if (i + 1) % every == 0:
            kept.append(row)
    at, found = int(row.argmax()), [-1] * n
    for block in range((n - 1) // every, -1, -1):
        rows = [kept[block]]
        for i in range(block * every, min(n, (block + 1) * every)):
            rows.append(step(rows[-1], i))
        for i in range(block * every + len(rows) - 2, block * every - 1, -1):
            before, now = rows[i - block * every], rows[i - block * every + 1]
            if not at or before[at] == now[at]:
                continue
            found[i] = at - 1
            rest = now[at] - table[of[i]][to[at - 1]]
            open_ = np.flatnonzero(before[:at] == rest)
            if len(open_):
                at = int(open_[-1])
            else:
                lo = int(starts[turn[at - 1]]) + 1
                at = lo + int(np.flatnonzero((before[lo:] == rest) & (turn[lo - 1:] == turn[at - 1]))[0])
    return found


def fold_again(items: list) -> list:
    """After a mismatch, neighbours of one label are one repeated item."""
    out: list = []
    for x in items:
        if out and key(out[-1]) == key(x):
            out[-1] = merge(out[-1], x)
            out[-1][REPEATED] = True
        else:
            out.append(x)
    return out


def tag_of(x: list) -> str:
    return x[LABEL].split(".", 1)[0]


def holds(x: list, tags: tuple[str, ...]) -> bool:
    return any(tag_of(c) in tags or holds(c, tags) for c in x[-1] if not isinstance(c, tuple))


def aside(x: list, inside: bool) -> bool:
    """Whether an item, or a page's element, is no part of an article; ``inside``: it stands in one."""
    tag = tag_of(x)
    if tag in ASIDE_TAGS:
        return not (tag == "header" and inside) and not (tag == "form" and holds(x, ("article", "main")))
    if tag in ("html", "body", "article", "main", "#", "("):
        return False
    return _aside_words(x[LABEL]) and not holds(x, ("article", "main", "h1"))


def weight(x: list, pages: int, inside: bool = False) -> int:
    """Characters outside links, of texts that vary where there are several pages; one that occurs once counts as such."""
    if aside(x, inside):
        return 0
    inside |= tag_of(x) in ("article", "main")
    own = max(0, x[CHARS] - x[LINKED]) if pages == 1 or x[PAGES] == 1 or x[CONSTANT] is None else 0
    return own + sum(weight(c, pages, inside) for c in x[CHILDREN])


def put(x: list, inside: bool) -> None:
    """An item and what is below it marked as main part, save what is no part of an article."""
    if aside(x, inside):
        return
    x[MAIN] = True
    for c in x[CHILDREN]:
        put(c, inside)


def mark(wrapper: list) -> list:
    """The wrapper with its main part marked."""
    pages, found = wrapper[PAGES], {"article": [], "main": []}

    def collect(x: list) -> None:
        if aside(x, False):
            return
        names = x[LABEL].split(".")
        kind = "article" if names[0] == "article" or "articlebody" in names[1:] else "main" if names[0] == "main" or "main" in names[1:] else None
        if kind:
            found[kind].append(x)
        for c in x[CHILDREN]:
            collect(c)

    def size(x: list) -> int:
        return weight(x, pages, True) or weight(x, 1, True)

    collect(wrapper)
    for kind in ("article", "main"):
        best = max(found[kind], key=size, default=None)
        if best is not None and size(best):
            put(best, True)
            return wrapper
    measure = pages if weight(wrapper, pages) else 1
    x = wrapper
    while x[CHILDREN]:
        best = max(x[CHILDREN], key=lambda c: weight(c, measure))
        if best[LABEL] == "#" or best[REPEATED] or weight(best, measure) < 0.6 * weight(x, measure):
            break
        x = best
    put(x, False)
    return wrapper


class Place:
    """An item of a marked wrapper with the places of its children, groups opened."""

    def __init__(self, x: list):
        self.item, self.main, self.places, self.again, self.group = x, x[MAIN], [], [], []
        for number, c in enumerate(x[CHILDREN]):
            for p in c[CHILDREN] if c[LABEL] == "(" else [c]:
                self.places.append(Place(p))
                self.again.append(c[REPEATED] or p[REPEATED])
                self.group.append(number)
        #: Whether all below is in the main part (True) or nothing (False); None: some is.
        self.whole = self.main if all(p.whole is self.main for p in self.places) else None
        self.by: dict[str, list[int]] = {}
        for i, p in enumerate(self.places):
            self.by.setdefault(p.item[LABEL], []).append(i)
        # Labels whose places give the same text, whichever of them a child has.
        self.clear = {k for k, at in self.by.items() if len(at) == 1 or self.places[at[0]].whole is not None and len({self.places[i].whole for i in at}) == 1}
        self.ids: dict = {}
        self.shapes: list[tuple] = []

    def of(self, children: list) -> list[int]:
        """The place of each of a page's elements and texts that stand here, or -1."""
        labels = ["#" if isinstance(c, tuple) else c[LABEL] for c in children]
        if all(k in self.clear or k not in self.by for k in labels):
            return [self.by[k][0] if k in self.by else -1 for k in labels]
        if not self.shapes:
            self.shapes = [shape(p.item, self.ids) for p in self.places]
        ids = dict(self.ids)
        return best([shape(c, ids) for c in children], self.shapes, np.array(self.again), np.array(self.group))


def main_text(page: list, wrapper: list | Place) -> str:
    """The texts of a page in the wrapper's marked places, joined by a space.

    Children are aligned with the items as in ``merge``. One without a place is kept where what it stands in is marked.
    """
    out: list[str] = []

    def loose(children: list) -> None:
        for c in children:
            if isinstance(c, tuple):
                out.append(c[0])
            elif not aside(c, True):
                loose(c[1])

    def walk(children: list, place: Place) -> None:
        if place.whole is False:
            return
        for c, i in zip(children, place.of(children)):
            if i < 0:
                if place.main:
                    loose([c])
            elif isinstance(c, tuple):
                if place.places[i].main:
                    out.append(c[0])
            else:
                walk(c[1], place.places[i])

    walk(page[1], wrapper if isinstance(wrapper, Place) else Place(wrapper))
    return " ".join(out)


def _merged(partial: DataFrame, salts: int, last: bool) -> DataFrame:
    """Partial wrappers of a host (and salt) aligned in the order of their tasks."""
    salted = partial.withColumn("salt", F.pmod("part", F.lit(salts)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "wrapper"))))
        for (host, salt), same in groupby(found, lambda x: x[:2]):
            wrapper = None
            for *_, text in same:
                x = json.loads(text)
                wrapper = x if wrapper is None else merge(wrapper, x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([host]), pa.array([salt], pa.int32()), pa.array([json.dumps(mark(wrapper) if last else wrapper)])], ["host", "part", "wrapper"]
            )

    return salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "part", "wrapper").mapInArrow(rows, "host string, part int, wrapper string")


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)``: the marked wrapper of each host, as JSON."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held)), pa.array([part] * len(held), pa.int32()), pa.array([json.dumps(x) for x in held.values()])], ["host", "part", "wrapper"]
            )

        for batch in common.slices(batches, "html", 4 << 20):
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                x = item(parse(html))
                held[host] = merge(held[host], x) if host in held else x
            if len(held) > HOSTS:
                yield full()
                held.clear()
        if held:
            yield full()

    tasks = pages.rdd.getNumPartitions()
    partial = with_host(pages).select("host", "html").mapInArrow(rows, "host string, part int, wrapper string")
    return _merged(_merged(partial, max(1, math.isqrt(tasks)), False), 1, True).select("host", "wrapper")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, and the main text of each page with its number of code points."""
    found = common.stored(wrappers(pages), "wrappers")
    size = found.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    together = with_host(pages).join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Place] = {}
        for batch in common.slices(batches, "html", 4 << 20):
            texts = []
            for html, wrapper in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist()):
                if wrapper not in known:
                    if len(known) > HOSTS:
                        known.clear()
                    known[wrapper] = Place(json.loads(wrapper))
                texts.append(main_text(parse(html), known[wrapper]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return together.select("page_id", "url", "html", "wrapper").mapInArrow(rows, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
