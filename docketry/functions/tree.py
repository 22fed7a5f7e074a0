"""Pages as trees: items by CSS selectors, titles of links, and the part of a page that is its content."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .html import BLOCKS, tidy

# Elements without content, those that hold no text, a page's frame, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT, FRAME = frozenset({"script", "style", "noscript", "svg", "template", "head"}), frozenset({"nav", "footer"})
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_SCOPES = frozenset("html body table ul ol dl select div section article td th".split())
# Texts of links that say nothing, and the least lengths of a link's text and of what stands around it.
GENERIC = ("incele", "git", "devamını oku", "devamını gör", "görüntüle", "görüntüle >", "indir", "detay", "tıklayınız", "tümü", "tümünü gör", ">", "»")
LEAST_LINK, LEAST_AROUND, STEPS_UP, SHORT_HEADER, LEAST_MAIN = 4, 12, 6, 2500, 50


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    content: list[Node | str] = field(default_factory=list)

    def children(self) -> list[Node]:
        return [x for x in self.content if isinstance(x, Node)]

    def walk(self) -> Iterator[Node]:
        """This node and all below it, in order; without recursion, as pages may nest as deep as they like."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.content) if isinstance(x, Node)]

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in SILENT:
                stack += reversed(x.content)

    def text(self) -> str:
        return " ".join(" ".join(self.texts()).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        closes, node = CLOSES.get(tag, ()), self.at
        while closes and node.parent and node.tag not in _SCOPES - closes:
            if node.tag in closes:
                self.at = node.parent
            node = node.parent
        if tag in BLOCKS and tag not in ("p", "br") and self.at.tag == "p":
            self.at = self.at.parent
        own = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.content.append(own)
        if tag not in VOID:
            self.at = own

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.content.append(data)


def parse(page: str | None, frame: bool = True) -> Node:
    """The tree of a page; without ``frame`` menus, footers and short headers are cut off."""
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    if not frame:
        for node in list(builder.root.walk()):
            if node.parent and (node.tag in FRAME or node.tag == "header" and len(node.text()) < SHORT_HEADER):
                node.parent.content = [x for x in node.parent.content if x is not node]
    return builder.root


# ---------------------------------------------------------------- selectors

_TOKEN = re.compile(r"""\s*([>+~,])\s*|(\s+)|(\*|[\w-]+)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~^$*|]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]|:not\(([^()]*)\)|:([\w-]+)(?:\(([^()]*)\))?""")


@dataclass(frozen=True)
class Step:
    """One element's conditions, and how it stands to the one before: below, child, next or later sibling."""

    relation: str
    tag: str = "*"
    tests: tuple[tuple, ...] = ()


def _place(node: Node) -> tuple[int, int]:
    """Place among the elements of its parent from 1, and how many there are."""
    every = node.parent.children() if node.parent else [node]
    return next(n for n, x in enumerate(every, 1) if x is node), len(every)


def _nth(spec: str) -> tuple[int, int]:
    spec = {"odd": "2n+1", "even": "2n"}.get(spec.strip(), spec.replace(" ", ""))
    found = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", spec)
    if not found:
        raise ValueError(f"no such place: {spec}")
    if found[3]:
        return 0, int(found[3])
    return int(found[1] + "1" if found[1] in ("", "+", "-") else found[1]), int(found[2] or 0)


def _fits(node: Node, step: Step) -> bool:
    if step.tag not in ("*", node.tag):
        return False
    for kind, *what in step.tests:
        value = node.attrs.get(what[0]) if kind == "attr" else None
        if kind == "not":
            ok = not any(_fits(node, s) for s in what[0])
        elif kind == "nth":
            place, of = _place(node)
            a, b = what[0]
            gap = (of + 1 - place if what[1] else place) - b
            ok = gap == 0 if a == 0 else gap % a == 0 and gap // a >= 0
        elif kind == "empty":
            ok = not any(isinstance(x, Node) or x for x in node.content)
        elif value is None:
            ok = False
        else:
            mark, wanted = what[1], what[2]
            ok = {
                "": True, "=": value == wanted, "~=": wanted in value.split(), "^=": bool(wanted) and value.startswith(wanted),
                "$=": bool(wanted) and value.endswith(wanted), "*=": bool(wanted) and wanted in value, "|=": value == wanted or value.startswith(f"{wanted}-"),
            }[mark]
        if not ok:
            return False
    return True


@cache
def compiled(selector: str) -> tuple[tuple[Step, ...], ...]:
    """A selector's alternatives, each a row of steps."""
    out, steps, relation, tag, tests, at = [], [], " ", None, [], 0

    def close() -> None:
        nonlocal relation, tag, tests
        if tag is None and not tests:
            raise ValueError(f"a part of the selector is empty: {selector}")
        steps.append(Step(relation, tag or "*", tuple(tests)))
        relation, tag, tests = " ", None, []

    text = selector.strip()
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"not understood in {selector}: {text[at:]}")
        at = found.end()
        sign, blank, name, ident, cls, attr, mark, value, without, pseudo, inner = found.groups()
        if sign or blank:
            close()
            if sign == ",":
                out.append(tuple(steps))
                steps = []
            else:
                relation = sign or " "
        elif name:
            tag = name.lower() if name != "*" else "*"
        elif ident:
            tests.append(("attr", "id", "=", ident))
        elif cls:
            tests.append(("attr", "class", "~=", cls))
        elif attr:
            tests.append(("attr", attr.lower(), mark or "", (value or "").strip("\"'")))
        elif without is not None:
            tests.append(("not", tuple(s[0] for s in compiled(without))))
        elif pseudo in ("first-child", "last-child"):
            tests.append(("nth", (0, 1), pseudo == "last-child"))
        elif pseudo in ("nth-child", "nth-last-child") and inner:
            tests.append(("nth", _nth(inner), pseudo == "nth-last-child"))
        elif pseudo == "empty":
            tests.append(("empty",))
        else:
            raise ValueError(f"not understood: {pseudo}")
    close()
    return (*out, tuple(steps))


def _found(root: Node, rules: tuple[tuple[Step, ...], ...]) -> Iterator[Node]:
    """As :func:`select`; with rules of one step each a node at a time, so that who wants the first one needn't see all."""
    if any(len(steps) > 1 for steps in rules):
        yield from select(root, rules)
        return
    for node in root.walk():
        for steps in rules:
            if node is not root and _fits(node, steps[0]):
                yield node
                break


def _kinds(root: Node, kinds: tuple[tuple[str, tuple[tuple[Step, ...], ...]], ...]) -> Iterator[tuple[Node, str]]:
    """The nodes below ``root`` that fit rules of any kind, in order, with the first kind that they fit."""
    if any(len(steps) > 1 for _, rules in kinds for steps in rules):
        of: dict[Node, str] = {}
        for name, rules in kinds:
            for node in select(root, rules):
                of.setdefault(node, name)
        yield from ((node, of[node]) for node in root.walk() if node in of)
        return
    # Nothing around a node counts, so all kinds are told in one walk, and once for all nodes of the same tag and attributes where only these count.
    lone = [(name, steps[0]) for name, rules in kinds for steps in rules]
    asked = sorted({what[0] for _, step in lone for kind, *what in step.tests if kind == "attr"})
    plain = all(test[0] == "attr" for _, step in lone for test in step.tests)
    told: dict[tuple, str | None] = {}
    for node in root.walk():
        if node is root:
            continue
        key = (node.tag, *map(node.attrs.get, asked))
        if not plain or key not in told:
            told[key] = next((name for name, step in lone if _fits(node, step)), None)
        if told[key] is not None:
            yield node, told[key]


def select(root: Node, rules: tuple[tuple[Step, ...], ...]) -> list[Node]:
    """The nodes below ``root`` that fit, in order.

    One pass from the top: a node's state is the set of steps that it can be,
    told from its own conditions and the states of its parent, of what is above,
    and of the siblings before it.
    """
    out: list[Node] = []
    nothing: frozenset[tuple[int, int]] = frozenset()
    stack = [(root, nothing, nothing, nothing, nothing)]
    while stack:
        node, parent, above, before, earlier = stack.pop()
        own = set()
        if node is not root:
            for r, steps in enumerate(rules):
                for k, step in enumerate(steps):
                    came = {" ": above, ">": parent, "+": before, "~": earlier}[step.relation]
                    if (k == 0 or (r, k - 1) in came) and _fits(node, step):
                        own.add((r, k))
            if any((r, len(steps) - 1) in own for r, steps in enumerate(rules)):
                out.append(node)
        below, last, seen, rows = above | own, nothing, nothing, []
        # Siblings depend on one another, so their states are worked out here and the nodes visited in order.
        for child in node.children():
            rows.append((child, frozenset(own), below, last, seen))
            last = _state(child, rules, frozenset(own), below, last, seen)
            seen = seen | last
        stack += reversed(rows)
    return out


def _state(node: Node, rules, parent, above, before, earlier) -> frozenset[tuple[int, int]]:
    """A sibling's state, for those after it; only needed where a selector speaks of siblings."""
    if not any(s.relation in "+~" for steps in rules for s in steps):
        return frozenset()
    came = {" ": above, ">": parent, "+": before, "~": earlier}
    return frozenset((r, k) for r, steps in enumerate(rules) for k, s in enumerate(steps) if (k == 0 or (r, k - 1) in came[s.relation]) and _fits(node, s))


# ---------------------------------------------------------------- items of listings


def _low(text: str) -> str:
    return text.replace("İ", "i").replace("I", "ı").lower()


def without_generic(text: str) -> str:
    """Text without the words of links that say nothing, longer phrases first."""
    words = text.split()
    for phrase in sorted((p.split() for p in GENERIC), key=len, reverse=True):
        out, k = [], 0
        while k < len(words):
            if [_low(w) for w in words[k : k + len(phrase)]] == phrase:
                k += len(phrase)
            else:
                out.append(words[k])
                k += 1
        words = out
    return _trim(" ".join(words))


def _trim(text: str) -> str:
    return text.strip(" –-—")


def link_title(link: Node) -> str:
    """A link's own text if it says something, else its title attribute, else the text of the nearest element around it that does."""
    text = _trim(link.text())
    if len(text) >= LEAST_LINK and _low(text) not in GENERIC:
        return text
    named = _trim(" ".join(link.attrs.get("title", "").split()))
    if len(named) >= LEAST_LINK:
        return named
    around, steps = link.parent, STEPS_UP
    while around is not None and steps:
        found = without_generic(around.text())
        if len(found) >= LEAST_AROUND:
            return found
        around, steps = around.parent, steps - 1
    return text


@dataclass(frozen=True)
class CssListing:
    """Selectors of a listing: its items, and within an item the link, title, date and summary.

    ``frame``: menus, footers and short headers are looked through too;
    ``around``: a link whose text says nothing is named by what stands around it.
    """

    item: str
    link: str | None = None
    title: str | None = None
    date: str | None = None
    summary: str | None = None
    frame: bool = False
    around: bool = False


def items(page: str | None, base: str | None, listing: CssListing) -> list[dict]:
    """Of each item that has a link: its address without fragment, title, and the texts of date, summary and the whole."""
    parts = {k: compiled(v) for k in ("item", "title", "date", "summary") if (v := getattr(listing, k))}
    link_rule, out = compiled(listing.link or "a[href]"), []

    def first(node: Node, name: str) -> Node | None:
        return next(iter(select(node, parts[name])), None) if name in parts else None

    for place, node in enumerate(select(parse(page, listing.frame), parts["item"])):
        link = node if node.tag == "a" and listing.link is None else next(iter(select(node, link_rule)), None)
        href = link.attrs.get("href", "").strip() if link else ""
        if not href or href.startswith(("javascript:", "mailto:", "#")):
            continue
        try:
            url = urldefrag(urljoin(base or "", href))[0]
        except ValueError:  # no address at all
            continue
        title = first(node, "title")
        text = title.text() if title else "" if "title" in parts else link_title(link) if listing.around else link.text()
        date, summary = first(node, "date"), first(node, "summary")
        out.append({"place": place, "url": url, "title": text or " ".join(link.attrs.get("title", "").split()), "date": date.text() if date else None, "summary": summary.text() or None if summary else None, "text": node.text()})
    return out


_ITEM = StructType([StructField("place", IntegerType()), *[StructField(c, StringType()) for c in ("url", "title", "date", "summary", "text")]])


def css_items(page: Column, base: Column, listing: CssListing) -> Column:
    """An array of a page's items (place, url, title, date, summary, text)."""

    @pandas_udf(ArrayType(_ITEM))
    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([items(p, b, listing) for p, b in zip(pages, bases, strict=True)])

    return run(page, base)


def outline(page: str | None, base: str | None, kinds: tuple[tuple[str, str], ...], within: str | None = None) -> list[dict]:
    """What of several kinds (name, selector) stands in a page, in order: kind, text, and address and text of the first link."""
    root, rule = parse(page), compiled("a[href]")
    top = next(_found(root, compiled(within)), None) if within else root
    if top is None:
        return []
    out = []
    for place, (node, kind) in enumerate(_kinds(top, tuple((name, compiled(selector)) for name, selector in kinds))):
        link = node if node.tag == "a" and "href" in node.attrs else next(_found(node, rule), None)
        try:
            url = urldefrag(urljoin(base or "", link.attrs["href"].strip()))[0] if link else None
        except ValueError:
            url = None
        out.append({"place": place, "kind": kind, "text": node.text(), "url": url, "title": link.text() if link else None})
    return out


_LINE = StructType([StructField("place", IntegerType()), *[StructField(c, StringType()) for c in ("kind", "text", "url", "title")]])


def outlines(page: Column, base: Column, kinds: tuple[tuple[str, str], ...], within: str | None = None) -> Column:
    """An array of what :func:`outline` finds in a page."""

    @pandas_udf(ArrayType(_LINE))
    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([outline(p, b, kinds, within) for p, b in zip(pages, bases, strict=True)])

    return run(page, base)


#: Rows that are handed on at a time.
OUTLINE_ROWS = 4096


def outlined(pages: DataFrame, keep: list[str], kinds: tuple[tuple[str, str], ...], within: str | None = None) -> DataFrame:
    """``keep`` and a row for all that :func:`outline` finds in pages (html, url): for pages of very many parts, as a task holds what one page has."""
    names = _LINE.fieldNames()
    schema = StructType([*pages.select(*keep).schema.fields, *_LINE.fields])

    def handed(own: pa.RecordBatch, of: list[int], found: list[dict]) -> pa.RecordBatch:
        kept = own.select(keep).take(pa.array(of, pa.int32()))
        lines = [pa.array([x[c] for x in found], pa.int32() if c == "place" else pa.string()) for c in names]
        return pa.RecordBatch.from_arrays([*kept.columns, *lines], names=[*keep, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, held = [], []
            for k, (page, base) in enumerate(zip(batch.column("_html").to_pylist(), batch.column("_url").to_pylist(), strict=True)):
                found = outline(page, base, kinds, within)
                of, held = of + [k] * len(found), held + found
                at = 0
                while len(held) - at >= OUTLINE_ROWS:
                    yield handed(batch, of[at : at + OUTLINE_ROWS], held[at : at + OUTLINE_ROWS])
                    at += OUTLINE_ROWS
                of, held = of[at:], held[at:]
            yield handed(batch, of, held)

    rows = pages.select(*keep, F.col("html").alias("_html"), F.col("url").alias("_url"))
    # Dealt out by number, as pages are few and dear, and small as files of them are.
    tasks = 4 * max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "_html").mapInArrow(run, schema)


# ---------------------------------------------------------------- main content

#: What a letter of a link takes from a stretch's worth, what every element takes, and the share of a page that is followed down.
LINK_COST, TAG_COST, SHARE = 3, 8, 0.8
_CONTAINERS = frozenset("html body div section article main table tbody tr td center form header".split())


def _worth(root: Node) -> tuple[dict[Node, int], dict[Node, int]]:
    """Of every node the letters of text below it, less those of links and a little for each element: menus come out below zero.

    First with all that is below it, then without the parts that are worth less than nothing.
    """
    worth: dict[Node, int] = {}
    gain: dict[Node, int] = {}
    order = list(root.walk())
    linked: dict[Node, bool] = {}
    for node in order:
        linked[node] = node.tag == "a" or (node.parent is not None and linked.get(node.parent, False))
    for node in reversed(order):
        if node.tag in SILENT or node.tag in FRAME:
            worth[node] = gain[node] = 0
            continue
        own = sum(len(x.strip()) for x in node.content if isinstance(x, str))
        own = (-LINK_COST if linked[node] else 1) * own - TAG_COST
        worth[node] = own + sum(worth[c] for c in node.children())
        gain[node] = own + sum(max(0, gain[c]) for c in node.children())
    return worth, gain


def _content_node(root: Node, gain: dict[Node, int]) -> Node:
    """Down from the top to the one element that the page names as its content, or that holds most of what there is."""
    node = root
    while True:
        inner = [c for c in node.children() if c.tag in _CONTAINERS and gain[c] > 0]
        named = [c for c in inner if c.tag in ("article", "main")]
        heavy = [c for c in inner if gain[c] >= SHARE * gain[node]]
        if not (named if len(named) == 1 else heavy):
            return node
        node = named[0] if len(named) == 1 else heavy[0]


def _rendered(node: Node, worth: dict[Node, int] | None) -> str:
    """Text with line ends at blocks; with ``worth``, blocks that are worth less than nothing, as menus inside, are left out."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x if x == "\n" else re.sub(r"\s+", " ", x))
            continue
        menu = worth is not None and x is not node and x.tag in BLOCKS and worth[x] < -TAG_COST and any(y.tag == "a" for y in x.walk())
        if x.tag in SILENT or x.tag in FRAME or menu:
            continue
        edge = ["\n"] if x.tag in BLOCKS else []
        stack += [*edge, *([" "] if x.tag in ("td", "th") else []), *reversed(x.content), *edge]
    return tidy("".join(out))


def main_content(page: str | None, selector: str | None = None) -> tuple[str, str]:
    """(text, method): what a selector names, else the part of the tree that holds most of its worth, else the whole body.

    Letters count for an element, links and elements against it, and what is
    worth less than nothing, as a menu, isn't part of the content.  Below 50
    letters the longer one of it and the body counts.
    """
    root = parse(page)
    if selector:
        named = next(iter(select(root, compiled(selector))), None)
        if named and (text := _rendered(named, None)):
            return text, "selector"
    worth, gain = _worth(root)
    main = _rendered(_content_node(root, gain), worth)
    if len(main) >= LEAST_MAIN:
        return main, "tree"
    body = _rendered(root, None)
    return (body if len(body) > len(main) else main), "body"


_CONTENT = StructType([StructField("text", StringType()), StructField("method", StringType())])


def content_of(page: Column, selector: str | None = None) -> Column:
    """Struct (text, method) of a page's content; of a null page the text is empty."""

    @pandas_udf(_CONTENT)
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_content(p, selector) for p in pages], columns=["text", "method"])

    return run(page)
