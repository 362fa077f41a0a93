"""The host suffix array of the HTML operator against plain forms, on pages without markup to go by, and on the tables."""

import random
from collections import defaultdict

import numpy as np
import pytest

from shelfwatch.llm import htmltext


@pytest.mark.parametrize("kinds,n", [(2, 300), (5, 500), (1, 90), (400, 300)])
def test_suffix_array_equals_sorted_suffixes(kinds, n):
    tokens = np.random.default_rng(kinds).integers(0, kinds, n)
    order, shared = htmltext.suffix_array(tokens)
    heads = [tuple(tokens[k : k + htmltext.DEPTH]) for k in range(n)]
    assert [heads[k] for k in order] == sorted(heads)
    for k in range(1, n):
        a, b = tokens[order[k - 1] :], tokens[order[k] :]
        common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert min(shared[k], htmltext.DEPTH) == min(common, htmltext.DEPTH)


def plain_runs(pages):
    """(run, is whole) -> labels, for runs of LONG tokens and whole shorter blocks."""
    found = defaultdict(set)
    for label, blocks in pages:
        for block in blocks:
            words = block.split()
            if len(words) < htmltext.LONG:
                found[tuple(words), True].add(label)
            for k in range(len(words) - htmltext.LONG + 1):
                found[tuple(words[k : k + htmltext.LONG]), False].add(label)
    return found


def test_classes_equal_plain_runs():
    rng = random.Random(2)
    lines = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(30)]
    pages = [(k, rng.choices(lines, k=5)) for k in range(20)]
    key, whole, label = htmltext.array_classes([p for _, p in pages], np.arange(20))
    got = defaultdict(set)
    for k, w, x in zip(key.tolist(), whole.tolist(), label.tolist(), strict=True):
        got[k, w].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, plain_runs(pages).values()))


def site(rng, host, n, sentence):
    menu = "<div>Home Products About our company Contact us Terms of service Privacy Log in</div>"
    end = "<div>Powered by a small engine in the north since nineteen ninety nine all day long</div>"
    return [(f"http://{host}/{k}", f"<body>{menu}<div><b>Menu</b></div><p>{(body := ' '.join(f'w{rng.randrange(9999)}' for _ in range(40)))}</p><p>{sentence(k)}</p>{end}</body>", body) for k in range(n)]


def test_repeats_decide_pages_without_article_class_or_id(spark):
    rng, quote = random.Random(6), "a sentence of ten words that two pages both like"
    sites = site(rng, "a", 30, lambda k: quote if k in (3, 9) else f"own {k}") + site(rng, "b", 5, lambda k: "Summary" if k < 2 else f"end {k}")
    rows = [(k, url, page) for k, (url, page, _) in enumerate(sites)]
    wanted = {k: f"{body}\n\n{page.split('<p>')[2].split('</p>')[0]}" for k, (_, page, body) in enumerate(sites)}
    # A print version and a dated copy of page 0: near-equal pages don't wipe each other.
    for k, more in ((100, "printed on monday"), (101, "printed on friday")):
        rows.append((k, f"http://a/print{k}", sites[0][1].replace("own 0", more)))
        wanted[k] = wanted[0].replace("own 0", more)
    # Two pages of a host of two: what both bear goes, unless they are near-equal.
    rows += [(200, "http://c/1", sites[0][1]), (201, "http://c/2", sites[1][1]), (202, "http://d/1", sites[0][1]), (203, "http://d/2", sites[0][1].replace("own 0", "changed"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract_main(pages.repartition(3)).collect()}
    assert {k: got[k] for k in wanted} == wanted
    assert (got[200], got[201]) == (wanted[0], wanted[1])
    assert all("Home Products" in got[k] for k in (202, 203))


def test_an_article_is_protected_and_counts(spark):
    """Pages with an article keep repeats inside it; what they repeat outside is boilerplate of a page without one."""
    line = "read this notice about our services every time that you come"
    rows = [(k, f"http://h/{k}", f"<div>{line}</div><article><p>{line}</p><p>text {k}</p></article>") for k in range(4)]
    rows.append((9, "http://h/9", f"<div>{line}</div><p>only here</p>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract_main(pages).collect()}
    assert got == {**{k: f"{line}\n\ntext {k}" for k in range(4)}, 9: "only here"}


def test_all_pages_of_the_tables_reach_the_arrays(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    streams = htmltext._streams(pages).cache()
    assert streams.where("size(words) > 0").count() == pages.count() == streams.where("not free").count()
    found = streams.selectExpr("host", "label", "explode(words) as block").collect()
    by_host = defaultdict(lambda: defaultdict(list))
    for r in found:
        by_host[r.host][r.label].append(r.block)
    wanted = set()
    for host, own in by_host.items():
        for (run, whole), labels in plain_runs(own.items()).items():
            n = max(min(htmltext.LEAST, len(own)), -(-len(own) * (htmltext.SHORT_SHARE if whole else htmltext.LONG_SHARE) // 1))
            if len(own) > 1 and len(labels) > 1 and len(labels) >= n:
                h = htmltext._hashes(list(run))
                wanted.add((host, htmltext.block_key(h) if whole else int(htmltext.run_keys(h)[0])))
    got = {(r.host, r.key % (1 << 64)) for r in htmltext.repeated_runs(streams).collect()}
    streams.unpersist()
    assert got == wanted and got  # menu entries and the like
