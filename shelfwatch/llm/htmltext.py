"""Main text of HTML pages: a host's suffix arrays find the boilerplate of all pages, in articles and around them.

A parser cuts each page into blocks, which are its token stream: those inside an article or main element, and the
others, menus and footers too. The streams of a host go into suffix arrays: suffixes are sorted and the longest common
prefix of each with its neighbour is taken.

Around articles, and on pages without one, suffixes that share LONG tokens or more are a class. A class whose suffixes
lie on enough distinct pages of the host is boilerplate; what such classes cover is removed and unique runs stay. Markup
names (nav, footer, class="ad") are needed besides: a text that only one page bears is no repeat, be it an advert.

Inside articles the longest repeats of the host decide: the runs that lie on nearly all of its articles and can't grow
without losing some of them. A block that such a repeat holds whole is a notice and goes, whatever its markup; what
fewer articles repeat, or a repeat holds in part, is their matter and stays.

Pages with equal articles, and near-equal pages without one, count as one page: a copy doesn't make itself boilerplate.
A notice is counted on articles that are not near-equal. A task builds arrays over parts of bounded size; what they find
is merged by host and content, so that a host of any size is counted and never gathered.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.markup import Scanner, attributes as attributes_of
from .common import cut_lineage, sized

#: Tokens of a repeated run at least, the most that suffixes are compared by, and the most tokens of one suffix array.
LONG, DEPTH, ARRAY_TOKENS = 8, 64, 1 << 20
#: Shares of a host's distinct pages that a long run, or a whole shorter block, has to lie on; LEAST pages in any case.
LONG_SHARE, SHORT_SHARE, LEAST = 0.05, 0.5, 3
#: Share of a host's distinct articles that a repeat inside them has to lie on; NOTICE_LEAST articles in any case.
NOTICE_SHARE, NOTICE_LEAST = 0.9, 8
#: Hosts with at least this many distinct articles look for notices in a QUARTER of them, which can't miss one.
MANY, QUARTER = 64, 4
#: Tokens and articles of a suffix array inside articles, if that keeps it under ARRAY_TOKENS.
NOTICE_TOKENS, NOTICE_ARTICLES = 1 << 16, 32
#: MinHash bands and values in each, for near-equal pages.
BANDS, ROWS = 8, 8
_RNG = np.random.default_rng(10)
FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
BOUNDS = np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(58)
#: Up to FEW runs of a page each value is a minimum over all of them, from ENOUGH runs on over one 64th of the keys.
FEW, ENOUGH = 320, 192

# Elements by role in a page.
RAW = frozenset("script style noscript template svg math iframe object select textarea canvas audio video title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
OUT = set("nav footer aside form head menu dialog button search".split())
MAIN_TAGS = {"article", "main"}
OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
OUT_NAMES = set(
    "ad ads advert adverts advertisement advertising adsbygoogle banner banners breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination paywall popup promo promotion promoted recommendations recommended related "
    "replies respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
#: Names that wrappers of a whole page bear too (has-sidebar, search-page): an article or main inside reopens them.
LAYOUT_NAMES = set(
    "banner banners breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr header login masthead menu menus nav navbar navigation "
    "newsletter notice notices notification pager pagination paywall search share sharing sidebar sidebars signup social subscribe subscription toolbar widget widgets".split()
)

#: Words that names of boilerplate are put together with. Inside an article only names that hold nothing else count: a
#: share-price or related-work is its matter, share-buttons and related-posts are not.
STRUCTURE = set(
    "area article articles bar block body bottom box btn button buttons center col column container content foot form grid group head header heading icon icons id inline "
    "inner item items js label left link links list main module native outer page panel post posts region right row section sections slot small space stories story text "
    "the this title top unit wrap wrapper your".split()
)

SKIP_CLOSED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

NAME = re.compile(r"[a-z0-9]+")
OPEN, MAIN, GONE, REOPENED = range(4)


def _is_out(tag: str, rest: str, in_main: bool) -> tuple[bool, bool, bool]:
    """(is boilerplate, is main, is boilerplate by a layout name only) of an element by its tag and attributes.

    Names that layouts use (share, notice) say nothing about a main element itself.
    """
    named, out, main = False, tag in OUT or tag == "header" and not in_main, tag in MAIN_TAGS
    if rest and not rest.isspace():
        attributes = {k: v.lower() for k, v in attributes_of(rest).items()}
        tokens = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        if in_main:
            parted = [NAME.findall(token) for token in tokens.split()]
            names = {part for parts in parted for part in parts if all(p in OUT_NAMES or p in STRUCTURE or p.isdigit() for p in parts)}
        else:
            names = set(NAME.findall(tokens))
        role = attributes.get("role", "")
        main |= role in ("main", "article") or attributes.get("itemprop") == "articlebody"
        if tag not in ("html", "body"):
            out |= bool(names & (OUT_NAMES - LAYOUT_NAMES))
            named = not main and (bool(names & OUT_NAMES) or not in_main and "header" in names)
        out |= role in OUT_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        out |= "display:none" in attributes.get("style", "").replace(" ", "")
    return out or named, main, named and not out


class _Stack:
    """Open elements with their states, with the places of each name and of blocks, so that no search walks the stack."""

    def __init__(self):
        self.items = [("", False, False, False, False)]  # tag, inside boilerplate, inside main, all that by layout names, reopened
        self.places, self.blocks = defaultdict(list), [0]

    def push(self, item: tuple) -> None:
        self.places[item[0]].append(len(self.items))
        if item[0] in BLOCK:
            self.blocks.append(len(self.items))
        self.items.append(item)

    def cut(self, to: int) -> None:
        while len(self.items) > to:
            tag = self.items.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, words) of each block in page order: OPEN, MAIN, GONE by markup, or REOPENED.

    The last is an article in a wrapper that only a layout name rules out; it counts where no other is sure.
    """
    found: list[tuple[int, str]] = []
    text: list[str] = []
    stack = _Stack()

    def flush() -> None:
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            _, out, main, _, again = stack.items[-1]
            if words:
                found.append((GONE if out else REOPENED if again else MAIN if main else OPEN, words))

    for before, tag, close, rest, content in Scanner(page, RAW):
        if before:
            text.append(before)
        if not tag or content is not None:
            continue
        if close:
            if tag in BLOCK:
                flush()
            place = stack.places[tag][-1] if stack.places[tag] else 0
            if place and (tag in BLOCK or stack.blocks[-1] < place):  # an inline end tag doesn't close a block
                if stack.blocks[-1] >= place or stack.items[-1][1] != stack.items[place - 1][1]:
                    flush()
                stack.cut(place)
        elif tag == "br":
            text.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            if tag == "body" or stack.items[-1][0] == "head":  # the end tag of the head may be left out
                flush()
                stack.cut(1 if tag == "body" else len(stack.items) - 1)
            if tag in BLOCK:
                flush()
                nearest = stack.blocks[-1]  # its end tag may be left out
                if nearest and (stack.items[nearest][0] == "p" or stack.items[nearest][0] in SKIP_CLOSED.get(tag, ())):
                    stack.cut(nearest)
            if rest.endswith("/"):
                continue
            _, out, main, named, again = stack.items[-1]
            more_out, more_main, more_named = _is_out(tag, rest, main)
            if tag not in BLOCK and more_out and not out:
                flush()
            if more_main and not main and out and named and not more_out:
                stack.push((tag, False, True, False, True))
            else:
                only_names = (named or not out) and (more_named or not more_out)
                stack.push((tag, out or more_out, main or more_main and not (out or more_out), only_names, again))
    flush()
    return found


def main_blocks(found: list[tuple[int, str]]) -> list[str]:
    """The blocks that markup protects: of articles, else of articles in wrappers that a layout name rules out."""
    return [w for kind, w in found if kind == MAIN] or [w for kind, w in found if kind == REOPENED]


def _host(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0].split("@")[-1]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def run_keys(h: np.ndarray) -> np.ndarray:
    """A 64-bit key of each run of LONG tokens; none if there are fewer."""
    if len(h) < LONG:
        return np.empty(0, np.uint64)
    key = np.zeros(len(h) - LONG + 1, np.uint64)
    for k in range(LONG):
        key = (key ^ h[k : k + len(key)]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        key ^= key >> np.uint64(29)
    return key


def block_key(h: np.ndarray) -> int:
    """The key of a whole block with fewer than LONG tokens."""
    return xxhash.xxh64_intdigest(h.tobytes(), LONG)


def _bands(found: list[str]) -> list[int]:
    """Keys by which near-equal pages meet."""
    hashes = [_hashes(b.split()) for b in found]
    keys = run_keys(np.concatenate([np.empty(0, np.uint64), *hashes]))
    left = np.concatenate([np.empty(0, np.int64), *(np.arange(len(h), 0, -1) for h in hashes)])
    keys = np.unique(keys[left[: len(keys)] >= LONG])  # no run crosses the end of a block
    if not len(keys):
        return []
    bands = {}
    if len(keys) < FEW:
        mixed = keys[:, None] * FACTORS
        bands |= dict(enumerate((mixed ^ mixed >> np.uint64(32)).min(axis=0).reshape(BANDS, ROWS)))
    if len(keys) >= ENOUGH:
        least = keys[np.searchsorted(keys, BOUNDS) % len(keys)]
        bands |= dict(enumerate(least.reshape(BANDS, ROWS), BANDS))
    return [_signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in bands.items()]


def _packed(found: list[str]) -> bytes:
    """Blocks, which hold no line ends, in a few bytes."""
    return zlib.compress("\n".join(found).encode(), 1)


def _unpacked(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode().split("\n")


def _streams(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, host, free, label, bands, gone, words, article, size, first).

    ``words`` are the blocks around an article, or all of a page without one, which is ``free``; ``article`` has the
    others packed and ``size`` their tokens. ``label`` is one for equal articles, or for equal pages without one; the
    ``first`` of a host in a task is marked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows = []
            for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = blocks(page or "")
                sure = main_blocks(found)
                rest = [(kind == GONE, w) for kind, w in found if not sure or kind not in (MAIN, REOPENED)]
                host, label = _host(url), _signed(xxhash.xxh64_intdigest("\n\n".join(sure or [w for _, w in rest])))
                first = (host, label, not sure) not in seen
                seen.add((host, label, not sure))
                bands = _bands(sure or [w for gone, w in rest if not gone]) if first else []
                article = (_packed(sure), sum(w.count(" ") + 2 for w in sure)) if sure else (None, 0)
                rows.append((page_id, url, host, not sure, label, bands, [g for g, _ in rest], [w for _, w in rest], *article, first))
            columns = list(zip(*rows, strict=True)) or [[]] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["page_id", "url", "host", "free", "label", "bands", "gone", "words", "article", "size", "first"]
    lists = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.string()))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), *lists, pa.binary(), pa.int64(), pa.bool_())
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    schema = "page_id long, url string, host string, free boolean, label long, bands array<long>, gone array<boolean>, words array<string>"
    return source.mapInArrow(run, f"{schema}, article binary, size long, first boolean")


def suffix_array(tokens: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, by their first ``depth`` tokens at least, and how many tokens each shares with the one before it."""
    levels, step = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)], 1
    while step < depth and int(levels[-1].max()) + 1 < len(tokens):
        rank, after = levels[-1], np.zeros(len(tokens), np.int64)
        after[:-step] = rank[step:] + 1
        levels.append(np.unique(rank * (len(tokens) + 2) + after, return_inverse=True)[1].astype(np.int64))
        step *= 2
    order = np.argsort(levels[-1], kind="stable")
    left, right, shared = order[:-1], order[1:], np.zeros(len(order) - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = left + shared, right + shared
        inside = np.maximum(i, j) < len(tokens)
        same = inside & (levels[k][np.where(inside, i, 0)] == levels[k][np.where(inside, j, 0)])
        shared += np.where(same, 1 << k, 0)
    return order, np.r_[0, shared]


def array_classes(found: list[list[str]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, is a whole short block, label) of the suffixes of pages' blocks; equal keys are one class."""
    hashes, page_of, left, short = [], [], [], []
    for p, page in enumerate(found):
        for block in page:
            h = _hashes(block.split())
            if len(h) < LONG:
                short.append((block_key(h), labels[p]))
                continue
            hashes += [h, np.zeros(1, np.uint64)]
            page_of.append(np.full(len(h) + 1, p))
            left.append(np.arange(len(h), -1, -1))
    keys, owners = np.empty(0, np.uint64), np.empty(0, np.int64)
    if hashes:
        h, page_of, left = np.concatenate(hashes), np.concatenate(page_of), np.concatenate(left)
        ids = np.unique(h, return_inverse=True)[1].astype(np.int64)
        ends = left == 0
        ids[ends] = ids.max() + 1 + np.arange(ends.sum())  # an end is like no other, so that no repeat crosses it
        order, shared = suffix_array(ids)
        number = np.cumsum(shared < LONG)
        long_enough = left[order] >= LONG
        number, order = number[long_enough], order[long_enough]
        first = np.nonzero(np.diff(number, prepend=-1))[0]
        at = order[first]
        key = np.zeros(len(at), np.uint64)
        for k in range(LONG):
            key = (key ^ h[at + k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            key ^= key >> np.uint64(29)
        keys = np.repeat(key, np.diff(np.r_[first, len(order)]))
        owners = labels[page_of[order]]
    whole = np.r_[np.zeros(len(keys), bool), np.ones(len(short), bool)]
    keys = np.r_[keys, np.array([k for k, _ in short], np.uint64)].view(np.int64)
    owners = np.r_[owners, np.array([x for _, x in short], np.int64)]
    distinct = np.unique(np.stack([keys, owners, whole.astype(np.int64)], axis=1), axis=0)
    return distinct[:, 0], distinct[:, 2].astype(bool), distinct[:, 1]


def _parts(rows: list) -> Iterator[list]:
    """Sorted (host, label, words) rows in parts of one host and about ARRAY_TOKENS tokens, or one longer page."""
    part, held = [], 0
    for row in rows:
        size = sum(w.count(" ") + 2 for w in row[2])
        if part and (held + size > ARRAY_TOKENS or part[-1][0] != row[0]):
            yield part
            part, held = [], 0
        part.append(row)
        held += size
    if part:
        yield part


def repeated_runs(streams: DataFrame) -> DataFrame:
    """(host, label, free, words) -> (host, key): runs and whole short blocks on enough distinct pages of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                key, whole, label = array_classes([r[2] for r in part], np.array([r[1] for r in part], np.int64))
                hosts = pa.array([part[0][0]] * len(key), pa.string())
                yield pa.RecordBatch.from_arrays([hosts, pa.array(key), pa.array(whole), pa.array(label)], ["host", "key", "whole", "label"])

    ordered = streams.select("host", "label", "words").sortWithinPartitions("host", "label")
    found = ordered.mapInArrow(run, "host string, key long, whole boolean, label long")
    support = found.groupBy("host", "key", "whole").agg(F.countDistinct("label").alias("support")).where("support > 1")
    hosts = streams.where("size(words) > 0 or not free").groupBy("host").agg(F.countDistinct("label").alias("pages")).where("pages > 1")
    share = F.when(F.col("whole"), SHORT_SHARE).otherwise(LONG_SHARE)
    enough = F.greatest(F.least(F.lit(LEAST), F.col("pages")), F.ceil(F.col("pages") * share))
    return support.join(sized(cut_lineage(hosts)), "host").where(F.col("support") >= enough).select("host", "key")


def _near(streams: DataFrame) -> DataFrame:
    """(host, label, head) of pages that meet a near-equal one with a lesser label."""
    met = streams.select("host", "label", F.explode("bands").alias("band")).distinct()
    heads = met.groupBy("host", "band").agg(F.min("label").alias("head"))
    least = met.join(heads, ["host", "band"]).groupBy("host", "label").agg(F.min("head").alias("head"))
    return cut_lineage(least.where("head <> label"))


def near_equal(streams: DataFrame) -> DataFrame:
    """The streams with one label for near-equal pages of a host that have no article: that of the least of them met."""
    moved = _near(streams.where("free"))
    return streams.join(sized(moved), ["host", "label"], "left").withColumn("label", F.coalesce("head", "label")).drop("head")


def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, hashes, tokens left) of sequences one after another; an end is like no other, so that no repeat crosses it."""
    h = np.concatenate([x for f in found for x in (f, np.zeros(1, np.uint64))])
    left = np.concatenate([np.arange(len(f), -1, -1) for f in found])
    ids = np.unique(h, return_inverse=True)[1].astype(np.int64)
    ends = left == 0
    ids[ends] = ids.max() + 1 + np.arange(ends.sum())
    return ids, h, left


def longest_repeats(found: list[tuple[int, np.ndarray]], least: int) -> list[np.ndarray]:
    """(owner, block) -> the runs of LONG tokens or more that ``least`` owners have and that can't grow without losing some.

    Suffixes next to one another share the least of the common prefixes between them, so each smallest stretch of the
    array that has ``least`` owners gives the longest run that these share.
    """
    if not found:
        return []
    ids, h, left = _joined([b for _, b in found])
    owner = np.repeat([o for o, _ in found], [len(b) + 1 for _, b in found])
    order, shared = suffix_array(ids, len(ids))
    number, within = np.cumsum(shared < LONG) - 1, left[order] >= LONG
    pairs = np.unique(np.stack([number[within], owner[order[within]]], axis=1), axis=0)[:, 0]
    classes, owners = np.unique(pairs, return_counts=True)
    firsts = np.r_[np.nonzero(shared < LONG)[0], len(order)]
    length = np.zeros(len(ids) + 1, np.int64)
    for c in classes[owners >= least].tolist():
        places, share = (x[firsts[c] : firsts[c + 1]].tolist() for x in (order, shared))
        held, lows, low = defaultdict(int), deque(), 0
        for k, (place, common) in enumerate(zip(places, share, strict=True)):
            held[int(owner[place])] += 1
            while lows and lows[-1][1] >= common:
                lows.pop()
            lows.append((k, common))
            while len(held) - (held[int(owner[places[low]])] == 1) >= least:
                gone = int(owner[places[low]])
                held[gone] -= 1
                if not held[gone]:
                    del held[gone]
                low += 1
            while lows and lows[0][0] <= low:
                lows.popleft()
            if len(held) >= least:
                length[place] = lows[0][1] if lows else left[place]
    longer = np.r_[0, length[:-1]] > length  # the run of the token before holds this one
    return [h[k : k + length[k]] for k in np.nonzero((length >= LONG) & ~longer)[0].tolist()]


def shared_lengths(runs: list[np.ndarray], found: list[np.ndarray]) -> list[np.ndarray]:
    """For each token of each run, how many tokens from there on a block of ``found`` has in sequence too."""
    ids, _, _ = _joined(runs + found)
    order, shared = suffix_array(ids, len(ids))
    border = sum(len(r) + 1 for r in runs)
    best = np.zeros(border, np.int64)
    for places, common in ((order, shared), (order[::-1], np.r_[0, shared[:0:-1]])):
        held = 0  # what the suffix here shares with the last one of a block
        for place, share in zip(places.tolist(), common.tolist(), strict=True):
            held = min(held, share)
            if place >= border:
                held = len(ids)
            elif held > best[place]:
                best[place] = held
    return [x[:-1] for x in np.split(best, np.cumsum([len(r) + 1 for r in runs])[:-1])]


def _article_hashes(packed: bytes) -> list[np.ndarray]:
    return [h for h in (_hashes(words.split()) for words in _unpacked(packed)) if len(h) >= LONG]


def notices(streams: DataFrame) -> DataFrame:
    """(host, repeats): the longest repeats inside articles, as hashes of tokens, on nearly all of a host's articles.

    First arrays of bounded size give candidates. A run on ``least`` of ``n`` articles misses ``n - least``, so any
    ``met`` of them have it ``met - (n - least)`` times, and one part of these at least its share of that: a quarter
    of a large host's articles yields every run. Then each article of the host tells how far it follows the
    candidates from each of their tokens, and the length that ``least`` articles reach is the repeat's.
    """

    def find(group: pa.Table) -> pa.Table:
        articles = dict(zip(group["label"].to_pylist(), group["article"].to_pylist(), strict=True))
        need, met = group["need"][0].as_py(), group["met"][0].as_py()
        found = [(k, h) for k, label in enumerate(sorted(articles)) for h in _article_hashes(articles[label])]
        runs = sorted({r.tobytes() for r in longest_repeats(found, -(-need * len(articles) // met))})
        return pa.table({"host": pa.array([group["host"][0].as_py()] * len(runs), pa.string()), "run": pa.array(runs, pa.binary())})

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, label, article, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lengths = shared_lengths([np.frombuffer(r, np.uint64) for r in runs], _article_hashes(article))
                rows = [(r, k, int(own[k])) for r, own in enumerate(lengths) for k in np.nonzero(own >= LONG)[0].tolist()]
                run, start, length = zip(*rows, strict=True) if rows else ((), (), ())
                columns = [pa.array([host] * len(rows), pa.string()), pa.array([label] * len(rows), pa.int64())]
                columns += [pa.array(c, pa.int32()) for c in (run, start, length)]
                yield pa.RecordBatch.from_arrays(columns, ["host", "label", "run", "start", "length"])

    articles = streams.where("not free")
    units = articles.where("first").join(sized(_near(articles)), ["host", "label"], "left_anti").select("host", "label", "article", "size")
    labels = units.groupBy("host", "label").agg(F.max("size").alias("size"))
    hosts = labels.groupBy("host").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")).where(F.col("n") >= NOTICE_LEAST)
    hosts = hosts.withColumn("least", F.greatest(F.lit(NOTICE_LEAST), F.ceil(F.col("n") * NOTICE_SHARE)))
    times = F.when(F.col("n") >= MANY, QUARTER).otherwise(1)
    many = F.least(F.ceil(F.col("tokens") / times / NOTICE_TOKENS), F.ceil(F.col("n") / times / NOTICE_ARTICLES))
    hosts = hosts.withColumn("parts", F.greatest(F.ceil(F.col("tokens") / times / ARRAY_TOKENS), many)).withColumn("dealt", times * F.col("parts"))
    part = F.pmod(F.xxhash64("label"), F.col("dealt"))
    hosts = labels.join(hosts, "host").groupBy("host", "n", "least", "parts", "dealt").agg(F.count_if(part < F.col("parts")).alias("met"))
    need = F.col("met") - F.col("n") + F.col("least")
    for name, some, every in (("parts", F.col("parts"), "dealt"), ("need", need, "least"), ("met", F.col("met"), "n")):
        hosts = hosts.withColumn(f"{name}_", F.when(need > 0, some).otherwise(F.col(every)))
    hosts = cut_lineage(hosts.select("host", "least", "dealt", *(F.col(f"{name}_").alias(name) for name in ("parts", "need", "met"))))

    dealt = units.join(sized(hosts), "host").withColumn("part", part).where("part < parts").select("host", "part", "label", "need", "met", "article")
    candidates = dealt.groupBy("host", "part").applyInArrow(find, "host string, run binary").distinct()
    # They lie on most articles of a part, so a host has no more of them than one article and its parts have tokens.
    of_host = cut_lineage(candidates.groupBy("host").agg(F.sort_array(F.collect_list("run")).alias("runs")))
    followed = units.join(sized(of_host, 1000), "host").select("host", "label", "article", "runs").mapInArrow(follow, "host string, label long, run int, start int, length int")
    each = followed.groupBy("host", "run", "start", "label").agg(F.max("length").alias("length"))
    reached = each.groupBy("host", "run", "start", "length").agg(F.count("*").alias("articles"))
    so_far = F.sum("articles").over(Window.partitionBy("host", "run", "start").orderBy(F.desc("length")))
    lengths = reached.withColumn("articles", so_far).join(sized(hosts.select("host", "least")), "host").where("articles >= least")
    lengths = lengths.groupBy("host", "run", "start").agg(F.max("length").alias("length"))
    before = Window.partitionBy("host", "run").orderBy("start").rangeBetween(-1, -1)
    lengths = lengths.withColumn("before", F.max("length").over(before)).where("before is null or before <= length")
    repeats = lengths.join(of_host, "host").select("host", F.expr("substring(runs[run], start * 8 + 1, length * 8)").alias("repeat"))
    return cut_lineage(repeats.groupBy("host").agg(F.collect_set("repeat").alias("repeats")))


def without_notices(found: list[str], repeats: list[bytes]) -> list[str]:
    """The blocks of an article but those that a repeat holds whole."""

    def held(words: str) -> bool:
        run = _hashes(words.split()).tobytes()
        return len(run) >= 8 * LONG and any(run in repeat for repeat in repeats)

    return [words for words in found if not held(words)]


def unique_runs(found: list[str], gone: list[bool], repeated: np.ndarray) -> list[str]:
    """The blocks that markup leaves, without what the repeated keys cover."""
    kept = []
    for words, out in zip(found, gone, strict=True):
        tokens = words.split()
        h = _hashes(tokens)
        if out or len(h) < LONG and block_key(h) in repeated:
            continue
        covered = np.zeros(len(h) + 1, np.int64)
        at = np.nonzero(np.isin(run_keys(h), repeated))[0]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + LONG, -1)
        stay = np.cumsum(covered[:-1]) == 0
        if stay.any():
            kept.append(" ".join(t for t, s in zip(tokens, stay.tolist(), strict=True) if s))
    return kept


def extract_main(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, ...) -> (page_id, url, text, n_chars), a row for each input row.

    ``text`` is the article: blocks in page order with an empty line between, each with character references
    decoded and white space turned into single spaces; '' where there is none. A null or empty html has ''.
    An article keeps what other pages hold too, but for blocks inside repeats of nearly all articles of its host.
    Other pages keep what their host doesn't repeat; pages with a null url are one host. Other columns are ignored;
    an empty table gives an empty table.
    """

    def protected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            text = ["\n\n".join(without_notices(_unpacked(a), r) if r else _unpacked(a)) for a, r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            text = ["\n\n".join(unique_runs(w, g, np.array(k or [], np.int64).view(np.uint64))) for w, g, k in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    streams = cut_lineage(_streams(pages))
    # A run that counts lies on LONG_SHARE of a host's pages, so a host has no more keys than 1 / LONG_SHARE pages have tokens.
    of_host = cut_lineage(repeated_runs(near_equal(streams)).groupBy("host").agg(F.collect_list("key").alias("keys")))
    schema = "page_id long, url string, text string"
    rest = streams.where("free").join(sized(of_host, 1000), "host", "left").select("page_id", "url", "words", "gone", "keys")
    sure = streams.where("not free").join(sized(notices(streams), 1000), "host", "left").select("page_id", "url", "article", "repeats")
    return sure.mapInArrow(protected, schema).unionByName(rest.mapInArrow(uncovered, schema)).withColumn("n_chars", F.char_length("text"))
