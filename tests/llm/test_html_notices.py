"""Notices inside articles, which only the longest repeats of a host tell, against plain forms and on the tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwatch.llm import htmltext

NOTICE = "every morning our editors choose ten stories for readers who like to know more"


def has(block, run):
    return any(block[k : k + len(run)] == run for k in range(len(block) - len(run) + 1))


@pytest.mark.parametrize("kinds,owners,least", [(2, 6, 4), (3, 9, 9), (2, 4, 1), (40, 12, 8), (2, 3, 2)])
def test_longest_repeats_equal_plain_ones(kinds, owners, least):
    rng = np.random.default_rng(kinds * owners)
    common = rng.integers(1, kinds + 1, 30).astype(np.uint64)
    found = []
    for owner in range(owners):
        for _ in range(3):
            a, b = sorted(rng.integers(0, 31, 2))
            found.append((owner, np.r_[rng.integers(1, kinds + 1, rng.integers(0, 9)).astype(np.uint64), common[a:b], common[: rng.integers(0, 31)]]))
    blocks = [(o, tuple(b.tolist())) for o, b in found]
    runs = {b[k:end] for _, b in blocks for k in range(len(b)) for end in range(k + htmltext.LONG, len(b) + 1)}
    frequent = {r for r in runs if len({o for o, b in blocks if has(b, r)}) >= least}
    got = [tuple(r.tolist()) for r in htmltext.longest_repeats(found, least)]
    assert set(got) <= frequent
    assert {r[k:end] for r in got for k in range(len(r)) for end in range(k + htmltext.LONG, len(r) + 1)} == frequent


def test_shared_lengths_equal_plain_ones():
    rng = np.random.default_rng(4)
    for _ in range(20):
        runs, found = ([rng.integers(1, 4, rng.integers(1, 25)).astype(np.uint64) for _ in range(3)] for _ in range(2))
        plain = [tuple(f.tolist()) for f in found]
        for run, got in zip(runs, htmltext.shared_lengths(runs, found), strict=True):
            wanted = [max(n for n in range(len(run) - k + 1) if any(has(f, tuple(run[k : k + n].tolist())) for f in plain)) for k in range(len(run))]
            assert got.tolist() == wanted


@pytest.mark.parametrize("array_tokens", [1 << 20, 400])
def test_notices_without_class_go_from_articles(spark, monkeypatch, array_tokens):
    """In arrays of any size: what nearly all articles hold goes, what fewer hold, hold in part, or hold in copies stays."""
    monkeypatch.setattr(htmltext, "ARRAY_TOKENS", array_tokens)
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(20))
    rows, wanted = [], {}

    def add(host, blocks, keeps):
        k = len(rows)
        rows.append((k, f"http://{host}/{k}", "<nav>Home</nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article>"))
        wanted[k] = "\n\n".join(keeps)

    for k in range(100):  # one article in twenty is without the notice; others hold it in a larger block
        own, more = text(), text()
        if k % 20 == 7:
            add("a", [own, more], [own, more])
        elif k % 5 == 1:
            add("a", [own, f"{NOTICE} {more}"], [own, f"{NOTICE} {more}"])
        else:
            add("a", [own, NOTICE, more], [own, more])
    for k in range(100):  # too few articles: a quotation
        own = text()
        add("b", [own, NOTICE] if k % 10 < 8 else [own], [own, NOTICE] if k % 10 < 8 else [own])
    for _ in range(htmltext.NOTICE_LEAST - 1):  # too small a host
        own = text()
        add("c", [own, NOTICE], [own, NOTICE])
    body = " ".join(text() for _ in range(20))
    for k in range(30):  # copies of an article, exact and near, are no notices
        add("d", [body, f"seen on day {k // 2}"], [body, f"seen on day {k // 2}"])
    for _ in range(12):  # short headings are the article's own
        own = text()
        add("e", ["Summary of it", own], ["Summary of it", own])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in htmltext.extract_main(pages).collect()} == wanted


def test_notices_on_the_given_pages(spark):
    """A notice put into every article of the tables goes from hosts with enough of them, and nothing else does."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    hosts = {r[0]: r[1] for r in pages.groupBy(host).agg(F.countDistinct(F.regexp_extract("html", "(?s)<article>.*</article>", 0))).collect()}
    assert max(hosts.values()) >= htmltext.NOTICE_LEAST > min(hosts.values())
    plain = {r.page_id: r.text for r in htmltext.extract_main(pages).collect()}
    put = pages.withColumn("html", F.regexp_replace("html", "</article>", f"<p>{NOTICE}</p></article>"))
    for r in htmltext.extract_main(put).collect():
        few = hosts[re.match("[a-z]+://([^/?#]*)", r.url)[1]] < htmltext.NOTICE_LEAST
        assert r.text == plain[r.page_id] + (f"\n\n{NOTICE}" if few else "")
