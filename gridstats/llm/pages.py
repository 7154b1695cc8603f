"""Main text of web pages, by wrappers inferred per host.

A page is a stream of opening and closing tags and texts. A wrapper is a regular
expression without unions over such streams: nested elements, each occurring
once, optionally, repeatedly or both, and text slots. A page's own wrapper
folds neighbouring repetitions into repeated groups. Wrappers of the same host
are aligned one after the other: elements that match are merged, a mismatch
becomes an optional or a repeated group, and a text becomes a slot that
counts the characters, the linked characters and the pages it was met in.
Pages are aligned inside their task first, then the tasks' wrappers of a host
up a reduction tree, so that no host is gathered in one task. Pages without
an element that is an article, and pages that have one inside so many elements
named like furniture, have wrappers of their own.

The slots of a host's wrapper that belong to the article are its main slots;
a page's main text is what stands in them, block by block. A page of another
template, which has nothing at their place, goes by its own wrapper.
"""

from __future__ import annotations

import html as entities
import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstats.shipping import ship
from gridstats.sources import keep

#: Wrappers that one task of the reduction tree aligns, about.
FAN_IN = 64
#: Levels of elements that a wrapper has; what lies deeper counts as lying at the last of them.
DEPTH = 200
#: Pairs of nodes that an alignment compares to find a longest common subsequence.
CELLS = 1_000_000

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements whose content is not markup, elements inside a line, and void elements.
RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements and names that tell page furniture from content.
FURNITURE = set(
    "nav header footer aside form script style noscript template iframe object svg button select "
    "textarea option datalist dialog menu head title canvas audio video map xmp noframes".split()
)
FURNITURE_ROLES = set(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split()
)
FURNITURE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies "
    "consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations comment comments disqus replies respond widget "
    "pagination pager toolbar".split()
)
ARTICLE = {"article", "main"}
ARTICLE_NAMES = set("article content main post entry story".split())
NO_ARTICLE = -1
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_LINES = {"p", "li", "h1", "h2", "h3", "blockquote", "pre", "td"}
_CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}


def label_of(tag: str, attributes: str) -> str:
    """The element's name in wrappers; ``!`` marks page furniture, ``*`` an article.

    ``~`` marks a name of furniture, which the wrapper as a whole may overrule.
    Digits in names are dropped, as they number pages and posts.
    """
    if tag in FURNITURE:
        return f"{tag}!"
    if not attributes.strip(" /\n\t\r"):
        return f"{tag}*" if tag in ARTICLE else tag
    names, roles = [], set()
    hidden = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            names += [n.lower() for n in _NAMES.findall(value)]
        elif name == "role":
            roles |= set(value.lower().split())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            hidden = True
    own = set(names)
    body = tag in ARTICLE or tag in _HEADINGS or tag in ("html", "body")
    furniture = hidden or roles & FURNITURE_ROLES
    called = not body and "main" not in roles and own & FURNITURE_NAMES
    article = tag in ARTICLE or "main" in roles or "article" in roles
    mark = "!" if furniture else "~" if called else "*" if article else ""
    return ".".join([tag, *sorted(own)]) + mark


class Page:
    """Blocks of text with the path of block elements that leads to them."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []  # path, text, linked characters
        self.tree: list = ["", "1", []]
        self._stack: list[tuple[str, list, bool]] = [("", self.tree, True)]  # label, node, whether the node is its own
        self._depth = 0
        self._text: list[str] = []
        self._links, self._in_link = 0, False
        self.kind = NO_ARTICLE
        self._read(html or "")

    def _read(self, html: str) -> None:
        at = 0
        while (found := _MARKUP.search(html, at)) is not None:
            if found.start() > at:
                self._add(html[at : found.start()])
            at = found.end()
            slash, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self._close(tag)
                continue
            self._open(tag, attributes or "")
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                self._close(tag)
        if at < len(html):
            self._add(html[at:])
        self._flush()

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._in_link:
            self._links += len(text)

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join(entities.unescape("".join(self._text)).split())
        if text:
            path = tuple(label for label, _, own in self._stack[1:] if own)
            links = min(self._links, len(text))
            self.blocks.append((path, text, links))
            self._stack[-1][1][2].append(["#", "1", [len(text), links, 1]])
        self._text, self._links = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._add(" ")
        if tag == "a":
            self._in_link = True
        label = label_of(tag, attributes)
        if tag in INLINE and label[-1] not in "!~":
            return
        self._flush()
        if tag in VOID:
            return
        if tag not in INLINE:
            self._leave({"p"})
        self._leave(_CLOSES.get(tag, set()))
        if label[-1] == "*":
            marks = [above[-1:] for above, _, _ in self._stack]
            if "!" not in marks and not 0 <= self.kind <= marks.count("~"):
                self.kind = marks.count("~")
        # Beyond DEPTH an element parts blocks but has no node, unless it takes its content out of the text.
        if self._depth >= DEPTH and (label[-1] != "!" or any(above[-1:] == "!" for above, _, _ in self._stack)):
            self._stack.append((label, self._stack[-1][1], False))
            return
        node = [label, "1", []]
        self._stack[-1][1][2].append(node)
        self._stack.append((label, node, True))
        self._depth += 1

    def _drop(self, depth: int) -> None:
        self._depth -= sum(own for _, _, own in self._stack[depth:])
        del self._stack[depth:]

    def _leave(self, tags: set[str]) -> None:
        """Elements at the top of the stack that the next one ends."""
        while len(self._stack) > 1 and tag_of(self._stack[-1][0]) in tags:
            self._drop(len(self._stack) - 1)

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        for depth in range(len(self._stack) - 1, 0, -1):
            if tag_of(self._stack[depth][0]) == tag:
                self._flush()
                self._drop(depth)
                return
        if tag not in INLINE and tag not in ("html", "body"):
            self._flush()


def tag_of(label: str) -> str:
    return label.rstrip("!*~").split(".")[0]


# A wrapper node is [label, times, content]: times is 1, ?, + or *; the content of a slot is its
# counts, that of an element or of a group "()" its nodes.


def with_times(node: list, times: str) -> list:
    """The node under both its own and the given number of times."""
    optional = "?" in (node[1], times) or "*" in (node[1], times)
    repeated = "+" in (node[1], times) or "*" in (node[1], times)
    return [node[0], {(0, 0): "1", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[optional, repeated], node[2]]


def merged(one: list, two: list) -> list:
    """Two nodes of one label as one that covers both."""
    times = with_times(one, two[1])[1]
    if one[0] == "#":
        return ["#", times, [a + b for a, b in zip(one[2], two[2], strict=True)]]
    return [one[0], times, aligned(one[2], two[2])]


def folded(nodes: list[list]) -> list[list]:
    """Neighbouring repetitions of one to three nodes as repeated groups."""
    nodes = [n if n[0] == "#" else [n[0], n[1], folded(n[2])] for n in nodes]
    out: list[list] = []
    at = 0
    while at < len(nodes):
        for period in (1, 2, 3):
            names = [n[0] for n in nodes[at : at + period]]
            count = 1
            while [n[0] for n in nodes[at + count * period : at + (count + 1) * period]] == names:
                count += 1
            if count > 1 and len(names) == period:
                square = nodes[at : at + period]
                for k in range(1, count):
                    again = nodes[at + k * period : at + (k + 1) * period]
                    square = [merged(a, b) for a, b in zip(square, again, strict=True)]
                out.append(with_times(square[0] if period == 1 else ["()", "1", square], "+"))
                at += count * period
                break
        else:
            out.append(nodes[at])
            at += 1
    return out


def name_of(node: list) -> str:
    """What two nodes must share to be aligned."""
    return "(" + " ".join(map(name_of, node[2])) + ")" if node[0] == "()" else node[0]


def common(names: list[str], others: list[str]) -> list[tuple[int, int]]:
    """Places of a common subsequence of two streams of names: a longest one, where CELLS allow to look for it.

    Equal ends are common. Between them only names of both streams count, so
    that generated names cost nothing. Where even those are too many, each name
    is met with its next occurrence.
    """
    start, end = 0, 0
    least = min(len(names), len(others))
    while start < least and names[start] == others[start]:
        start += 1
    while end < least - start and names[-1 - end] == others[-1 - end]:
        end += 1
    places: dict[str, list[int]] = {}
    for j in range(start, len(others) - end):
        places.setdefault(others[j], []).append(j)
    rows = [i for i in range(start, len(names) - end) if names[i] in places]
    met = {names[i] for i in rows}
    columns = [j for j in range(start, len(others) - end) if others[j] in met]
    pairs = [(k, k) for k in range(start)]
    if len(rows) * len(columns) <= CELLS:
        best = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
        for i in range(len(rows) - 1, -1, -1):
            for j in range(len(columns) - 1, -1, -1):
                same = best[i + 1][j + 1] + 1 if names[rows[i]] == others[columns[j]] else 0
                best[i][j] = max(same, best[i + 1][j], best[i][j + 1])
        i, j = 0, 0
        while i < len(rows) and j < len(columns):
            if names[rows[i]] == others[columns[j]] and best[i][j] == best[i + 1][j + 1] + 1:
                pairs.append((rows[i], columns[j]))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        after = start
        for i in rows:
            later = places[names[i]]
            at = bisect_left(later, after)
            if at < len(later):
                pairs.append((i, later[at]))
                after = later[at] + 1
    return pairs + [(len(names) - k, len(others) - k) for k in range(end, 0, -1)]


def aligned(one: list[list], two: list[list]) -> list[list]:
    """Two streams as one: common nodes are merged, the others become optional."""
    names, others = [name_of(n) for n in one], [name_of(n) for n in two]
    out, i, j = [], 0, 0
    for a, b in [*common(names, others), (len(one), len(two))]:
        out += [with_times(n, "?") for n in one[i:a]] + [with_times(n, "?") for n in two[j:b]]
        if a < len(one):
            out.append(merged(one[a], two[b]))
        i, j = a + 1, b + 1
    return again_folded(out)


def again_folded(nodes: list[list]) -> list[list]:
    """Neighbours of one name, which an alignment may leave, as one repeated node."""
    out: list[list] = []
    for node in nodes:
        if out and name_of(out[-1]) == name_of(node):
            out[-1] = with_times(merged(out[-1], node), "+")
        else:
            out.append(node)
    return out


def wrapper_of(page: Page) -> list:
    return ["", "1", folded(page.tree[2])]


def expression(node: list) -> str:
    """A wrapper as text, for people."""
    inner = "text" if node[0] == "#" else f"{node[0]}({' '.join(map(expression, node[2]))})"
    return inner + ("" if node[1] == "1" else node[1])


def slots(node: list, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], list]]:
    """Slots below a node, with the elements that lead to them and their counts."""
    for child in node[2]:
        if child[0] == "#":
            yield path, child[2]
        else:
            yield from slots(child, path if child[0] == "()" else (*path, child[0]))


def _is_article(label: str) -> bool:
    return label[-1] == "*"


def _is_named(label: str) -> bool:
    return label[-1] != "!" and bool(ARTICLE_NAMES & set(label.rstrip("*~").split(".")[1:]))


def main_slots(wrapper: list) -> list[tuple[str, ...]]:
    """Paths of the slots that hold the article.

    Slots inside page furniture never do. A name of furniture alone does not
    make an element furniture if articles are only inside such elements, or if
    it holds most of the unlinked text where the article is looked for. If the
    wrapper has an element that is an article, its slots do. Else the way goes
    down from the page to the element that still holds most of the text outside
    links, first by its name, then by weight; its slots do unless most of their
    text is linked.
    """
    every = [(path, counts) for path, counts in slots(wrapper) if not any(p[-1] == "!" for p in path)]
    layout: set[tuple[str, ...]] = set()  # elements named like furniture that are none

    def clear(path: tuple[str, ...]) -> tuple[str, ...]:
        """The way down to the first element that its name makes furniture."""
        for k, label in enumerate(path):
            if label[-1] == "~" and path[: k + 1] not in layout:
                return path[:k]
        return path

    articles = [path for path, _ in every if any(map(_is_article, path))]
    while articles and not any(_is_article(x) for path in articles for x in clear(path)):
        layout |= {path[: len(clear(path)) + 1] for path in articles}
    if articles:
        every = [(path, counts) for path, counts in every if any(map(_is_article, clear(path)))]
    while True:
        if articles:  # articles inside the article tell best where the text is
            told = [x for x in every if sum(map(_is_article, clear(x[0]))) > 1]
        else:
            told = [x for x in every if any(map(_is_named, clear(x[0])))]
        held: dict[tuple[str, ...], int] = {}
        for path, (chars, linked, _) in told or every:
            way = clear(path)
            if way != path:
                held[path[: len(way) + 1]] = held.get(path[: len(way) + 1], 0) + chars - linked
        most = sum(chars - linked for _, (chars, linked, _) in told or every) / 2
        found = {path for path, unlinked in held.items() if unlinked > most}
        if not found:
            break
        layout |= found
    every = [(path, counts) for path, counts in every if clear(path) == path]
    if articles:
        return sorted({path for path, _ in every})
    named = [path for path, _ in every if any(map(_is_named, path))]
    weight: dict[tuple[str, ...], int] = {}
    for path, (chars, linked, _) in every:
        if not named or path in named:
            for k in range(len(path) + 1):
                weight[path[:k]] = weight.get(path[:k], 0) + chars - linked
    top: tuple[str, ...] = ()
    while True:
        below = [(w, p) for p, w in weight.items() if len(p) == len(top) + 1 and p[: len(top)] == top]
        if not below or max(below)[0] < 0.8 * weight.get(top, 0):
            break
        top = max(below)[1]
    if top and tag_of(top[-1]) in _LINES:
        top = top[:-1]
    return sorted(
        {p for p, (chars, linked, _) in every if p[: len(top)] == top and 2 * linked <= chars}
    )


def own_slots(page: Page, main: set[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Main slots of a page that met none of its host's: its own, unless it has their place and no text there."""
    top = tuple(os.path.commonprefix(sorted(main)))
    while top and tag_of(top[-1]) in _LINES:
        top = top[:-1]
    places = [page.tree]
    for label in top:
        places = [child for place in places for child in place[2] if child[0] == label]
    return main if main and places else set(main_slots(wrapper_of(page)))


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))


def _merge_all(found: dict, key: object, wrapper: list) -> None:
    found[key] = merged(found[key], wrapper) if key in found else wrapper


def wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``kind`` and ``wrapper`` (JSON) of every host and kind of page, inferred from all such pages."""
    ship(pages.sparkSession)

    def infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for batch in batches:
            for host, html in zip(batch.column("host"), batch.column("html"), strict=True):
                page = Page(html.as_py())
                _merge_all(found, (host.as_py(), page.kind), wrapper_of(page))
        hosts, kinds = [host for host, _ in found], [kind for _, kind in found]
        texts = [json.dumps(wrapper) for wrapper in found.values()]
        columns = [pa.array(hosts, pa.string()), pa.array(kinds, pa.int32()), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["host", "kind", "wrapper"])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        found: dict[str, list] = {}
        for text in sorted(table.column("wrapper").to_pylist()):
            _merge_all(found, "", json.loads(text))
        host, kind, part = (k.as_py() for k in key)
        numbers = {"kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int64())}
        return pa.table({"host": [host], **numbers, "wrapper": [json.dumps(found[""])]})

    rows = pages.select(host_of("url").alias("host"), "html")
    rows = keep(rows.mapInArrow(infer, "host string, kind int, wrapper string"))
    most = rows.groupBy("host", "kind").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    parts = -(-most // FAN_IN)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(max(1, parts))))
    while most:
        # A host's wrappers share a bucket with those of the same part only.
        met = rows.groupBy("host", "kind", "part")
        rows = keep(met.applyInArrow(join, "host string, kind int, part bigint, wrapper string"))
        if parts <= 1:
            break
        parts = -(-parts // FAN_IN)
        rows = rows.withColumn("part", F.pmod("part", F.lit(parts)))
    return rows.select("host", "kind", "wrapper")


def with_main_slots(found: DataFrame) -> DataFrame:
    """``host`` and ``paths``: per kind of page the main slots, each path joined by blanks."""
    ship(found.sparkSession)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [[" ".join(p) for p in main_slots(json.loads(w))] for w in batch.column("wrapper").to_pylist()]
            columns = [batch.column("host"), batch.column("kind"), pa.array(paths, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "kind", "paths"])

    rows = found.select("host", "kind", "wrapper").mapInArrow(choose, "host string, kind int, paths array<string>")
    return rows.groupBy("host").agg(F.collect_list(F.struct("kind", "paths")).alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page: ``page_id``, ``url``, ``text`` and ``n_chars`` (code points).

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by two line breaks in page order. A page without main
    text, or without html, has the empty text. Pages without a host in their
    url form a group of their own. Other columns are not read; a row comes out
    per row that goes in.
    """
    ship(pages.sparkSession)
    chosen = keep(with_main_slots(wrappers(pages)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, paths in zip(batch.column("html"), batch.column("paths"), strict=True):
                page = Page(html.as_py())
                chosen_paths = next((p["paths"] for p in paths.as_py() or () if p["kind"] == page.kind), ())
                main = {tuple(p.split()) for p in chosen_paths}
                if page.kind == NO_ARTICLE and not any(path in main for path, _, _ in page.blocks):
                    main = own_slots(page, main)
                texts.append("\n\n".join(text for path, text, _ in page.blocks if path in main))
            columns = [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array(list(map(len, texts)), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), "url", "html", host_of("url").alias("host"))
    return rows.join(chosen, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(
        extract, "page_id bigint, url string, text string, n_chars bigint"
    )
