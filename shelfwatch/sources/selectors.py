"""Selectors of page elements, compiled once and matched while a page is read.

A list of selectors is a name with its text: tags, ``#id``, ``.class``, attributes (``[a]``, ``[a=v]``, ``[a*=v]``, ``[a^=v]``, ``[a$=v]``,
``[a~=v]``, with ``i`` for any case), ``:not(...)`` of these, and descendants. Every part of a selector is a state of one automaton
that runs down the tree: an element reaches a state if it fits the part and the state before was reached above it. So an
element takes one step whatever its depth, and a row needs two bit masks instead of all its ancestors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_PART = re.compile(r"\s*(?:(?P<tag>[a-z][a-z0-9]*|\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:\"(?P<q>[^\"]*)\"|'(?P<p>[^']*)'|(?P<v>[^\s\]]+))\s*(?P<i>i)?\s*)?\]|:not\((?P<no>[^()]*)\))")
#: What elements are told apart by is remembered for so many of them.
REMEMBERED = 1 << 16


def _compound(text: str) -> list[tuple]:
    """Tests (attribute, operator, value, any case, wanted) that an element has to pass; the tag is the attribute ''."""
    tests, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m[0][:1].isspace():
            raise ValueError(f"no selector: {text!r}")
        at = m.end()
        if m["no"] is not None:
            inner = _compound(m["no"].strip())
            if len(inner) != 1:
                raise ValueError(f"one test in :not() only: {text!r}")
            tests.append((*inner[0][:4], False))
        elif m["tag"]:
            tests += [("", "=", m["tag"], False, True)] if m["tag"] != "*" else []
        elif m["id"]:
            tests.append(("id", "=", m["id"], False, True))
        elif m["cls"]:
            tests.append(("class", "~=", m["cls"], False, True))
        else:
            value = next((m[k] for k in "qpv" if m[k] is not None), "")
            tests.append((m["attr"].lower(), m["op"] or "", value.lower() if m["i"] else value, bool(m["i"]), True))
    return tests


def _passes(test: tuple, value: str | None) -> bool:
    _, op, wanted, any_case, is_wanted = test
    if value is not None and any_case:
        value = value.lower()
    if value is None:
        found = False
    elif op == "~=":
        found = wanted in value.split()
    elif op in ("*=", "^=", "$="):
        found = wanted != "" and (wanted in value if op == "*=" else value.startswith(wanted) if op == "^=" else value.endswith(wanted))
    else:
        found = op == "" or value == wanted
    return found == is_wanted


class Selectors:
    """Named lists of selectors, each a bit of the masks; the names in ``nearest`` also tell which element is the closest."""

    def __init__(self, lists: dict[str, str], nearest: tuple[str, ...] = ()):
        if len(lists) > 62:
            raise ValueError("at most 62 lists fit the masks")
        self.bit = {name: 1 << k for k, name in enumerate(lists)}
        self.nearest = {name: k for k, name in enumerate(nearest)}
        self.closest_bits = [self.bit[n] for n in nearest]
        self.parts: list[list[tuple]] = []
        self.first = 0
        self.ends: dict[int, int] = {}  # state -> bit of its list
        for name, text in lists.items():
            for selector in re.split(r",(?![^\[]*\])", text):
                for k, part in enumerate(re.split(r"\s+(?![^\[]*\])(?![^(]*\))", selector.strip())):
                    self.first |= (1 << len(self.parts)) if k == 0 else 0
                    self.parts.append(_compound(part))
                self.ends[len(self.parts) - 1] = self.bit[name]
        self.read = sorted({t[0] for p in self.parts for t in p} - {""})
        self.fitting: dict[tuple, int] = {}
        self.marking: dict[int, int] = {}

    def _fit(self, tag: str, values: tuple) -> int:
        of = dict(zip(self.read, values, strict=True)) | {"": tag}
        return sum(1 << k for k, tests in enumerate(self.parts) if all(_passes(t, of[t[0]]) for t in tests))

    def step(self, tag: str, attrs: dict[str, str], above: int) -> tuple[int, int]:
        """(lists that the element is in, states for what lies below it)."""
        key = (tag, *map(attrs.get, self.read))
        fit = self.fitting.get(key)
        if fit is None:
            if len(self.fitting) > REMEMBERED:
                self.fitting.clear()
            fit = self.fitting[key] = self._fit(tag, key[1:])
        reached = fit & (self.first | above << 1)
        if not reached:
            return 0, above
        marks = self.marking.get(reached)
        if marks is None:
            marks = 0
            for state, bit in self.ends.items():
                marks |= bit if reached >> state & 1 else 0
            self.marking[reached] = marks
        return marks, above | reached

    def mask(self, *names: str) -> int:
        return sum(self.bit[n] for n in names)

    def marked(self, name: str) -> Column:
        """The element is in the list."""
        return F.col("marks").bitwiseAND(F.lit(self.bit[name]).cast("long")) != 0

    def within(self, name: str) -> Column:
        """The element or one above it is in the list."""
        return F.col("inside").bitwiseAND(F.lit(self.bit[name]).cast("long")) != 0

    def closest(self, name: str) -> Column:
        """The place of the element of the list that is closest, the element itself counted; null if there is none."""
        return F.get("near", F.lit(self.nearest[name]))


# Containers whose links are not the grid's, markers of grids, product cards, headings of cards, sections whose
# images are not the product's, containers of the product in order of preference, and lists of pages.
CHROME = """header, nav, footer, [class*="mega-menu" i], [class*="menu-drawer" i], [class*="site-nav" i],
    [class*="drawer" i]:not([class*="filter" i]):not([class*="collection" i]):not([class*="product" i]), [class*="mini-cart" i], [class*="cart-drawer" i],
    [class*="add-on" i], [class*="addon" i], [class*="upsell" i], [class*="cross-sell" i], [class*="recommend" i], [class*="related-product" i],
    [class*="also-like" i], [class*="you-may" i], [class*="frequently-bought" i], [class*="predictive" i], [class*="complementary" i]"""
GRID = """[data-section-type*="collection-grid" i], [data-section-type*="collection-template" i], [data-section-type*="main-collection" i], #product-grid,
    #ProductGridContainer, #CollectionProductGrid, #CollectionAjaxContent, [class*="product-grid" i], [class*="collection-grid" i], [class*="products-grid" i],
    [class*="collection-products" i]"""
CARD = """[data-product-handle], [data-product-id], .grid-product, .grid-product__content, li, article, [class*="product-card" i], [class*="product-item" i],
    [class*="grid-item" i], [class*="card-product" i], [class*="card" i]"""
HEADING = "h2, h3, h4, [class*=title], [class*=name], [class*=Title], [class*=Name]"
EXCLUDED = """nav, header, footer, aside, [role=navigation], [role=banner], [role=complementary], [role=contentinfo], .related, .upsell, .cross-sell,
    .recommendations, .recently-viewed, .also-bought, .reviews, .testimonials, [id*='reviews'], [class*='review'], [id*='cookie'], [class*='cookie'], [id*='gdpr'],
    [class*='gdpr'], [id*='newsletter'], [class*='newsletter'], [id*='popup'], [class*='popup']"""
SCOPES = (
    "[itemtype*='schema.org/Product']", "[itemtype*='schema.org/product']", ".product__media-gallery", ".product-gallery", ".product-images", ".product-single",
    ".product-detail", ".product-page", ".product--full", "#product-images", "#product-media", "#product-gallery", "main article", "[role=main] article", "main", "[role=main]",
)
PAGES = "nav[class*=pag i], ul[class*=pag i], div[class*=pag i], nav[aria-label*=pag i]"

SCOPE_NAMES = tuple(f"scope {k}" for k in range(len(SCOPES)))
PAGE = Selectors(
    {"chrome": CHROME, "grid": GRID, "card": CARD, "heading": HEADING, "product title": "[data-product-title]", "excluded": EXCLUDED, "picture source": "picture source", "background": "[style*='background']", "pages": PAGES}
    | dict(zip(SCOPE_NAMES, SCOPES, strict=True)),
    nearest=("card",),
)
