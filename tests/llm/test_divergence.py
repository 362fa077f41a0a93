"""Divergence of sources against counting by hand. The query is held to its SQL in test_queries."""

import random
import re
from collections import Counter, defaultdict

from shelfwatch.llm import divergence


def plain_divergence(rows, least, top):
    groups, seen, counts = set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in seen.items()}
    out = []
    for lang, source in groups:
        terms = kept[lang]
        own = sorted(s for g, s in groups if g == lang)
        whole = sum((counts[lang, s] for s in own), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in terms) + 5 * len(terms)) for t in terms}
        shares, q = {s: share(counts[lang, s]) for s in own}, share(whole)
        pairs = [(sum(abs(shares[source][t] - shares[s][t]) for t in terms), s) for s in own if s != source]
        above = [(shares[source][t] - q[t], t) for t in terms if counts[lang, source][t] and shares[source][t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", above, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def test_equals_counting_by_hand(spark):
    rng, words = random.Random(2), ["Abe", "abe", "can", "don", "éß", "ÉSS", "漢字", "漢", "zz-top", "o'er", "a1b", "x_y", "\U0001f600", "é", "ÀB", "ⅣX", "ΑΣ", "ǅ", "\U00010570A", "İI"]
    rows = [(rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "S2", "é", None]), " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for _ in range(400)]
    rows += [("xx", "s1", "rare words"), ("xx", "s2", None), ("yy", "s1", ""), ("", "s9", "  \x00 12 [] "), *[("hot", "one", "same text " * 50)] * 40, ("hot", "two", "other"), ("hot", "none", "")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, rank int, term string, value int")
    for least, top in ((1, 3), (4, 50), (30, 2), (10_000, 5)):
        assert sorted(map(tuple, divergence.divergence(docs, least, top).collect())) == plain_divergence(rows, least, top)
    found = divergence.divergence(docs.limit(0))
    assert found.count() == 0 and found.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_counts_beyond_a_long(spark):
    found = spark.createDataFrame([(10**16, 3 * 10**16, 7)], "n long, total long, v long").select(divergence._share("n", "total", "v").alias("p")).first().p
    assert found == 1 + 10**9 * (10**16 + 5) // (3 * 10**16 + 35)
