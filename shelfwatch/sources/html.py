"""HTML pages as a table of elements: the one place where page markup passes through Python."""

from __future__ import annotations

import html
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stored
from .markup import Scanner, attributes
from .selectors import PAGE, Selectors

# Elements without content, elements whose content is no markup, and elements whose start ends an open one of the same kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW, DECODED = frozenset("script style title textarea".split()), ("title", "textarea")
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDS = ("table", "ul", "ol", "div", "section", "article", "select")
#: Elements that lie deeper count as children of the element at this depth, as in browsers.
DEPTH = 512

_ELEMENT = (
    "ord int, last int, parent int, tag string, attrs map<string,string>, start int, length int, next_start int, next_length int, parent_start int, parent_length int,"
    " marks bigint, inside bigint, near array<int>"
)
SCHEMA = f"page_id bigint, url string, said binary, elements array<struct<{', '.join(f.replace(' ', ': ', 1) for f in _ELEMENT.split(', '))}>>"


class _Node:
    __slots__ = ("ord", "tag", "attrs", "parent", "next", "child", "start", "stop", "last", "marks", "inside", "below", "near")

    def __init__(self, order: int, tag: str, attrs: dict[str, str], parent: _Node | None, start: int, selectors: Selectors):
        self.ord, self.tag, self.attrs, self.parent, self.start, self.stop, self.last = order, tag, attrs, parent, start, start, order
        self.next = self.child = None
        above = (parent.below, parent.inside, parent.near) if parent else (0, 0, [None] * len(selectors.closest_bits))
        self.marks, self.below = selectors.step(tag, attrs, above[0])
        self.inside, self.near = above[1] | self.marks, above[2]
        if self.marks and any(self.marks & bit for bit in selectors.closest_bits):
            self.near = [order if self.marks & bit else old for bit, old in zip(selectors.closest_bits, above[2], strict=True)]


def _nodes(page: str, selectors: Selectors) -> tuple[list[_Node], bytes]:
    """Elements in document order, with their places in the page's text (in octets); end tags may be missing."""
    nodes: list[_Node] = []
    stack: list[_Node] = []
    deeper: dict[str, list[_Node]] = defaultdict(list)  # open elements below DEPTH, which are on no stack
    said: list[bytes] = []
    size = 0
    top = None  # the last element without a parent

    def say(text: str) -> None:
        nonlocal size
        said.append(text.encode("utf-8", "replace"))
        size += len(said[-1])

    def close(to: int) -> None:
        for node in stack[to:]:
            node.stop, node.last = size, len(nodes) - 1
        for node in (n for held in deeper.values() for n in held):
            node.stop = size
        del stack[to:]
        deeper.clear()

    for before, tag, is_end, rest, content in Scanner(page, RAW):
        if before:
            say(html.unescape(before))
        if not tag:
            continue
        if is_end:
            if deeper[tag]:
                deeper[tag].pop().stop = size
                continue
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), -1)
            if at >= 0:
                close(at)
            continue
        if tag in CLOSES_P or tag in ENDS:
            closed = ENDS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in closed:
                    close(k)
                    break
                if stack[k].tag in HOLDS:
                    break
        parent = stack[-1] if stack else None
        node = _Node(len(nodes), tag, attributes(rest), parent, size, selectors)
        before_it = parent.child if parent else top
        if before_it is not None:
            before_it.next = node
        if parent:
            parent.child = node
        else:
            top = node
        nodes.append(node)
        if content is not None:
            say(html.unescape(content) if tag in DECODED else content)
            node.stop = size
        elif tag not in VOID and not rest.endswith("/"):
            if len(stack) < DEPTH:
                stack.append(node)
            else:
                deeper[tag].append(node)
    close(0)
    return nodes, b"".join(said)


def page_elements(page: str, tags: frozenset[str], marked: int = 0, selectors: Selectors = PAGE) -> tuple[list[dict], bytes]:
    """Rows for the wanted tags and marks of one page, and the page's text."""
    nodes, said = _nodes(page, selectors)
    rows = []
    for node in nodes:
        if node.tag in tags or node.marks & marked:
            beside, above = node.next, node.parent
            rows.append({
                "ord": node.ord, "last": node.last, "parent": above.ord if above else None, "tag": node.tag, "attrs": list(node.attrs.items()), "start": node.start, "length": node.stop - node.start,
                "next_start": beside.start if beside else None, "next_length": beside.stop - beside.start if beside else None,
                "parent_start": above.start if above else None, "parent_length": above.stop - above.start if above else None,
                "marks": node.marks, "inside": node.inside, "near": node.near,
            })
    return rows, said


def html_elements(pages: DataFrame, tags: tuple[str, ...], marked: tuple[str, ...] = (), selectors: Selectors = PAGE) -> DataFrame:
    """(page_id, url, html) -> a row for each element of the wanted tags or of the ``marked`` lists of ``selectors``, in document order.

    ``ord`` numbers all elements of a page, ``last`` is the number of the last one inside: an element lies inside another if its
    number is over the other's and up to its ``last``. ``marks`` and ``inside`` are bit masks of the lists that the element, or it
    and what it lies in, are in; ``near`` tells the closest. ``text``, ``next_text`` and ``parent_text`` are the texts of the element, its next
    sibling and its parent.

    The table is stored once, a row for each page that holds the page's text a single time and its elements as places in
    it: it grows with the page, however elements nest, and however many branches a plan has, a page is parsed once. Texts are
    cut out where a plan asks for them. Filter pages before it. Null or empty pages have no elements.
    """
    wanted, bits = frozenset(tags), selectors.mask(*marked)
    text, attrs, number = pa.string(), pa.map_(pa.string(), pa.string()), pa.int32()
    kinds = {"tag": text, "attrs": attrs, "marks": pa.int64(), "inside": pa.int64(), "near": pa.list_(number)}
    element = pa.struct([(f.split(" ")[0], kinds.get(f.split(" ")[0], number)) for f in _ELEMENT.split(", ")])
    kind = pa.schema([("page_id", pa.int64()), ("url", text), ("said", pa.binary()), ("elements", pa.list_(element))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, said = page_elements(page or "", wanted, bits, selectors)
                rows.append({"page_id": page_id, "url": url, "said": said, "elements": found})
                size += len(found)
                if size > 5000:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = stored(source.mapInArrow(run, SCHEMA), "elements").select("page_id", "url", "said", F.explode("elements").alias("e"))
    cut = lambda at: F.substr("said", F.col(f"e.{at}start") + 1, F.col(f"e.{at}length")).cast("string")
    places = [F.col(f"e.{c}").alias(c) for c in ("ord", "last", "parent", "tag", "attrs", "marks", "inside", "near")]
    return rows.select("page_id", "url", *places, cut("").alias("text"), cut("next_").alias("next_text"), cut("parent_").alias("parent_text"))
