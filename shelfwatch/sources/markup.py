"""A scanner for page markup that takes linear time whatever the page holds."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: Up to the end of a tag or the quote that opens a value; other quotes mean nothing.
TO_END = re.compile(r"[^>=]*+(?:=(?!\s*+[\"'])[^>=]*+)*+(?:>|=\s*+(?P<quote>[\"']))")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")


def attributes(rest: str) -> dict[str, str]:
    """The attributes behind a tag's name: lower-cased names, decoded values, the first of repeated names."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(rest):
        quoted = value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1
        found.setdefault(name.lower(), html.unescape(value[1:-1] if quoted else value))
    return found


class Scanner:
    """The tags of a page: (text before, tag, is an end tag, what follows the name, content of a raw element or None).

    Elements named in ``raw`` are given whole, without looking for tags inside. The last item has no tag. A tag cut
    short by the end of the page is markup, a '<' that opens no tag is text. Comments and declarations have no tag.
    """

    def __init__(self, page: str, raw: frozenset[str]):
        self.page, self.raw, self.broken = page, raw, False
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.ends: dict[str, re.Pattern] = {}

    def _tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``; -1 if it is cut short. Values in quotes may hold '>'."""
        if at > self.last[">"]:
            return -1
        if not self.broken:
            to = at
            while found := TO_END.match(self.page, to):
                quote = found["quote"]
                if quote is None:
                    return found.end()
                if found.end() > self.last[quote]:
                    break  # the value is never closed
                to = self.page.find(quote, found.end()) + 1
            self.broken = True  # once quotes are out of step they don't count any more
        return self.page.find(">", at) + 1

    def _raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """Where the content of a raw element ends, and where its end tag does."""
        if tag not in self.ends:
            self.ends[tag] = re.compile(rf"</{re.escape(tag)}\s*+>", re.IGNORECASE)
        end = self.ends[tag].search(self.page, at)
        return (end.start(), end.end()) if end else (len(self.page), len(self.page))

    def __iter__(self) -> Iterator[tuple[str, str, bool, str, str | None]]:
        page, n, at, begun = self.page, len(self.page), 0, 0
        while True:
            start = page.find("<", at)
            if start < 0:
                yield page[begun:], "", False, "", None
                return
            follows = page[start + 1 : start + 2]
            if not follows or not (follows in "/!?" or follows.isascii() and follows.isalpha()):
                at = start + 1
                continue
            tag, rest, content, close = "", "", None, follows == "/"
            if follows in "!?":
                comment = page.startswith("<!--", start)
                end = page.find("-->", start + 4) if comment else -1 if start > self.last[">"] else page.find(">", start)
                stop = n if end < 0 else end + (3 if comment else 1)
                if end < 0 and not comment and page.find("<", start + 1) >= 0:
                    at = start + 1
                    continue
            else:
                name = TAG_NAME.match(page, start + 1 + close)
                stop = self._tag_end(name.end() if name else start + 1)
                if stop < 0:
                    if page.find("<", start + 1) >= 0:
                        at = start + 1
                        continue
                    stop = n
                elif name:
                    tag, rest = name[0].lower(), page[name.end() : stop - 1]
                    if tag in self.raw and not close and not rest.endswith("/"):
                        to, end = self._raw_end(tag, stop)
                        content, stop = page[stop:to], end
            yield page[begun:start], tag, close, rest, content
            at = begun = stop
