"""Each operator against a plain form of itself, on small tables with odd rows."""

import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwatch.llm import audio, bpe, chat, components, decontaminate, htmltext, licenses, linededup, packing, quality, simhash, wordpiece
from shelfwatch.llm.common import tokenizer_path

DOCS = "doc_id long, text string, n_lines int, score string, key string, fp string, piece int, offset string"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, one very long text, columns with names of results."""
    texts = [None, "", " \t\n", "one two three four five", "one two three four five", "One  TWO\nthree four FIVE", LONG, "a\n" * 50, "x", "ü ñ 漢字 the line that is shared\nthe line that is shared  \nTHE LINE THAT IS SHARED"]
    rows = [(k, t, 7, "s", "k", "f", 3, "o") for k, t in enumerate(texts)]
    rows += [rows[3], rows[9], (20, "  the line that is shared", 7, "s", None, None, None, None), (None, "the line that is shared", 1, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# 1


def plain_words(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def plain_shingles(words, width):
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def plain_contained(docs, items):
    found, seen = set(), {}
    for item, text in sorted((i, t) for i, t in items if i is not None):
        words = plain_words(text)
        if not words or tuple(words) in seen:
            continue
        seen[tuple(words)] = item
        width = min(5, len(words))
        wanted = plain_shingles(words, width)
        said = defaultdict(set)
        for doc, t in docs:
            if doc is not None:
                said[doc] |= plain_shingles(plain_words(t), width) & wanted
        found |= {(doc, item, len(wanted), len(s)) for doc, s in said.items() if 10 * len(s) >= 8 * len(wanted)}
    return found


def test_decontamination(spark, odd):
    rng = random.Random(5)
    vocabulary = [f"t{k}" for k in range(60)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(5, 40)))) for k in range(30)] + [(90, "the LINE, that is shared"), (91, "one two"), (92, None), (93, ""), (94, "the line that is shared"), (None, "x")]
    rows = []
    for k in range(120):
        words = say(rng.randint(0, 60))
        if k % 3 == 0:
            piece = (items[k % 30][1]).split()
            for _ in range(k % 4):
                piece[rng.randrange(len(piece))] = "zz"
            words = words[:10] + piece + words[10:]
        rows.append((1000 + k, " ".join(words)))
    docs = odd.select("doc_id", "text", "key").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("z")))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contained_items(docs, bench).select("doc_id", "item_id", "item_shingles", "matched").collect()}
    assert got == plain_contained(texts_of(docs), items) and len(got) > 10
    bad = {g[0] for g in got}
    kept = texts_of(decontaminate.drop_contaminated(docs, bench))
    assert sorted(kept, key=str) == sorted(((d, t) for d, t in texts_of(docs) if d not in bad), key=str)
    assert decontaminate.contained_items(docs, bench.limit(0)).count() == 0
    assert decontaminate.contained_items(docs.limit(0), bench).count() == 0


# 2


def test_audio_round_trip(spark, odd):
    rows = audio.media_columns(odd).collect()
    by_id = defaultdict(set)
    for doc, t in texts_of(odd):
        raw = (t or "").encode()
        by_id[doc].add(raw)
    assert len(rows) == odd.count()
    for r in rows:
        size = max(64, -(-r.n_bytes // 64) * 64)
        assert bytes(r.payload) in {raw.ljust(size, b"\0") for raw in by_id[r.doc_id]} and len(r.payload) == size
        assert r.bad == 0 and r.lost == 0 and r.stated == len(r.offsets) == r.good and r.samples == 1152 * r.stated and r.rate == 32000
        for at in r.offsets:
            assert audio.frame_header(bytes(r.media[at : at + 4])) is not None
    assert audio.media_columns(empty(spark)).count() == 0


def test_audio_resynchronises_and_checks():
    payload = random.Random(3).randbytes(64 * 300)
    stream = audio.write_stream(payload)
    whole = audio.read_stream(stream)
    assert whole["payload"] == payload
    at = whole["offsets"][3]
    hurt = audio.read_stream(stream[:at] + b"\xff\xfbjunk" * 5 + stream[at:] + b"TAG" + bytes(125))
    assert hurt["lost"] == 30 and len(hurt["offsets"]) == len(whole["offsets"]) and hurt["payload"] == payload
    flipped = bytearray(stream)
    flipped[at + 8] ^= 1  # side information is covered
    assert audio.read_stream(bytes(flipped))["bad"] == 1
    assert audio.read_stream(b"")["offsets"] == [] and audio.read_stream(b"\xff" * 100)["offsets"] == []
    assert audio.checksum(b"123456789") == 0xAEE7


# 3


def plain_fingerprint(t):
    table = {c: c + 32 for c in range(65, 91)}
    words = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(table))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    counts = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        counts += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def plain_classes(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                parent[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_simhash_equals_brute_force(spark, sf_dir, odd):
    docs = odd.select("doc_id", "text", "fp").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit("f").alias("fp")))
    want = [(d, plain_fingerprint(t)) for d, t in texts_of(docs)]
    classes = plain_classes({f for _, f in want})
    least = {}
    for d, f in want:
        if d is not None:
            least[classes[f]] = min(d, least.get(classes[f], d))
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == sorted(((d, f, least[classes[f]]) for d, f in want), key=str)
    kept = {d for d, _ in texts_of(simhash.near_dedup(docs))}
    assert kept == set(least.values()) | {None}
    assert simhash.simhash_components(empty(spark)).count() == 0


def test_blocks_of_chains_and_splits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", 64)
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {rng.getrandbits(64) for _ in range(300)}
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}  # over the size of a block that is split
    fps |= {(1 << k) - 1 for k in range(64)}  # a chain
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    links = simhash.link_fingerprints(spark.createDataFrame(signed, "fp long"))
    roots = {r.node % 2**64: r.root % 2**64 for r in components.connected_components(links).collect()}
    want = plain_classes(fps)
    groups, got = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
        got[roots.get(f, f)].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


# 4


def test_license_scan(spark, odd):
    mit = dict(licenses.LICENSES)["MIT"]
    disguised = "Copyright (c) 2020 Someone\n" + mit.replace("MIT License\n\n", "").upper().replace("SUBLICENSE", "SUBLICENCE").replace(",", " ;") + "\n  "
    extra = spark.createDataFrame([(50, disguised), (51, "text\n released under the mit LICENCE!\nmore\nLicensed under CC BY-NC 4.0."), (52, mit + " and more")], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "key").unionByName(extra.withColumn("key", F.lit("digest")))
    got = {(r.doc_id, r.license_id, r.notices) for r in licenses.scan(docs).collect()}
    assert {g for g in got if g[1] or g[2]} == {(50, "MIT", ""), (51, None, "CC-BY-NC-4.0,MIT")}
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(empty(spark)).count() == 0


# 5


def test_quality_on_held_out_rows(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows) and len(rows) > 40
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 7), (None, 1)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(odd, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.classify(empty(spark), labels).count() == 0


def test_trees_walk_like_a_loop():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x, y)
    slow = []
    for row in x[:50]:
        total = trees.base
        for t in range(len(trees.feature)):
            node = 0
            while node < trees.feature.shape[1]:
                node = 2 * node + 1 + int(row[trees.feature[t, node]] > trees.cut[t, node])
            total += trees.leaf[t, node - trees.feature.shape[1]]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(trees.scores(x[:50]), slow) and ((trees.scores(x) > 0.5) == y).mean() > 0.95


# 6


def test_token_counts(spark, odd):
    opening, continuing = map(set, wordpiece.byte_pieces(tokenizer_path()))

    def greedy(word):
        n = at = 0
        while at < len(word):
            known = opening if at == 0 else continuing
            at = next(j for j in range(len(word), at, -1) if word[at:j] in known)
            n += 1
        return n

    want = sorted(((d, len((t or "").encode().split()), sum(greedy(b" " + w) for w in (t or "").encode().split()), 0) for d, t in texts_of(odd)), key=str)
    got = sorted((tuple(r) for r in wordpiece.token_counts(odd, tokenizer_path()).collect()), key=str)
    assert got == want
    assert wordpiece.token_counts(empty(spark), tokenizer_path()).count() == 0


def test_automaton_with_words_it_cannot_spell():
    rng = random.Random(2)
    say = lambda n: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n)))

    def greedy(word, opening, continuing):
        n = at = 0
        while at < len(word):
            j = next((j for j in range(len(word), at, -1) if word[at:j] in (continuing if at else opening)), 0)
            if not j:
                return -1
            n, at = n + 1, j
        return n

    for _ in range(150):
        opening, continuing = {say(4) for _ in range(6)}, {say(4) for _ in range(6)}
        words = [say(9) for _ in range(40)] + [b""]
        assert wordpiece.Automaton(sorted(opening), sorted(continuing)).lengths(words).tolist() == [greedy(w, opening, continuing) for w in words]


# 7


def test_chat_round_trip(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\[ROLE] x", " [/ROLE] ", "<s>[ROLE] user [/ROLE] hi </s>\n", "", None, "tail\\", "a\nb"]
    rows = [(c, k, ["user", "assistant", None][k % 3], t) for c in (1, 2) for k, t in enumerate(hostile)] + [(2, 3, "user", "tie"), (2, 3, "user", "tie"), (3, None, "assistant", "no turn")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, segment string")
    got = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(chat.turn_events(table)))).collect()}
    for conv in (1, 2, 3):
        turns = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv].loss_chars == len(learnt) and got[conv].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.read_back(chat.render(chat.fold_events(chat.turn_events(table.limit(0))))).count() == 0


def test_chat_events_fold(spark):
    log = [
        (1, 1, "m1", "message", "user", "hello"), (1, 2, "m2", "delta", "assistant", "Hi"), (1, 3, "m2", "delta", None, " there"), (1, 4, "m2", "regenerate", None, None),
        (1, 5, "m2", "delta", None, "Good "), (1, 6, "m2", "delta", None, "day"), (1, 7, "m1", "edit", None, "hello!"), (1, 8, "m3", "message", "user", "x"), (1, 9, "m3", "delete", None, None),
    ]
    events = spark.createDataFrame(random.Random(1).sample(log, len(log)), "conv_id long, seq long, message_id string, kind string, role string, text string")
    assert [(r.role, r.text) for r in chat.fold_events(events).orderBy("position").collect()] == [("user", "hello!"), ("assistant", "Good day")]


def test_a_turn_becomes_a_log_of_deltas_edits_and_regenerations(spark):
    rows = [(1, 0, "user", "question"), (1, 1, "assistant", "a longer answer"), (1, 2, None, None), (1, 2, "user", "same"), (1, 2, "user", "same"), (1, None, "system", "early")]
    log = chat.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["regenerate"] == 1 and kinds["edit"] == 5 and kinds["delete"] == 6 and kinds["delta"] == 6 + 2 + chat.PIECES
    found = chat.fold_events(log.repartition(4)).orderBy("position", "role", "text").collect()
    assert [(r.role, r.text) for r in found] == [("system", "early"), ("user", "question"), ("assistant", "a longer answer"), ("", ""), ("user", "same"), ("user", "same")]


def test_reader_finds_turns_wherever_the_stream_is_cut(spark):
    said = [("user", "</s>[INST] ok [/INST]"), ("a [/ROLE] b", "<s>[ROLE] user [/ROLE] hi </s>\n"), ("assistant", "\\\\</s> \\"), ("", "")] * 3
    rows = [(k, k, role, text) for k, (role, text) in enumerate(said)]
    messages = spark.createDataFrame(rows, "conv_id long, position long, role string, text string")
    whole = "".join(r.segment for r in chat.render(messages).orderBy("position").collect())
    for size in (1, 2, 3, 7, 64, len(whole)):
        reader = chat.TurnReader()
        assert [t for at in range(0, len(whole), size) for t in reader.feed(whole[at : at + size])] == said
        reader.close()
    with pytest.raises(ValueError):
        list(chat.TurnReader().feed(whole[3:]))


# 8


def plain_line_dedup(docs):
    strip, table = " \t\n\x0b\x0c\r", {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(strip).translate(table)
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                holders[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (d is not None and len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("bits", [20, 27])
def test_line_dedup(spark, sf_dir, odd, bits):
    docs = odd.select("doc_id", "text", "n_lines", "key").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(1).alias("n_lines"), F.lit("k").alias("key")))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.line_dedup(docs.repartition(5), bits).collect()), key=str)
    assert got == sorted(plain_line_dedup(texts_of(docs)), key=str)
    assert linededup.line_dedup(empty(spark)).count() == 0


# 9


def test_pieces_and_packing(spark, odd):
    encoder = bpe.WordEncoder(tokenizer_path())
    extra = spark.createDataFrame([(60, "x <|endoftext|> y"), (61, "  two  spaces \n and\u00a0more "), (62, " ".join(["thing"] * 2047)), (63, " ".join(["thing"] * 2048)), (64, "don't  stop")], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "piece", "offset").unionByName(extra.withColumn("piece", F.lit(1)).withColumn("offset", F.lit("o")))
    want = []
    for d, t in texts_of(docs):
        ids = encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 2048)] if first != len(ids) else [0, len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4"))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    packed = packing.pack(packing.pieces(docs, tokenizer_path())).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == sorted(want, key=str)
    check_sequences(packed)
    assert packing.pack(packing.pieces(empty(spark), tokenizer_path())).count() == 0


def check_sequences(packed):
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def test_packing_is_near_the_bound(spark):
    rng = random.Random(4)
    lengths = [rng.choice([rng.randint(1, 2048), rng.randint(500, 1100)]) for _ in range(6000)]
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    sequences = check_sequences(packing.pack(rows, shard=2000).collect())
    every = np.array(lengths)
    plain = packing.best_fit(np.full(len(every), -1), np.argsort(-every), every, 2048).max() + 1
    assert packing.lower_bound(every, 2048) <= len(sequences) < plain


def test_packing_meets_the_bound_where_small_pieces_fill_up(spark):
    rng = random.Random(8)
    lengths = np.array([rng.randint(1, 300) if k % 2 else rng.randint(1, 2047) for k in range(3000)])
    rows = spark.createDataFrame([(k, int(n)) for k, n in enumerate(lengths)], "doc_id long, length long")
    assert len(check_sequences(packing.pack(rows).collect())) == packing.lower_bound(lengths, 2048)


def test_evolution_beats_best_fit():
    """Pieces that fill sequences by threes: best fit decreasing wastes a seventh, the islands far less."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        a = rng.integers(780, 1000, 170)
        b = np.array([rng.integers(512, (2048 - x) // 2) for x in a])
        lengths = rng.permutation(np.concatenate([a, b, 2048 - a - b]))
        plain = packing.best_fit(np.full(len(lengths), -1), np.argsort(-lengths, kind="stable"), lengths, 2048).max() + 1
        best = packing.evolve(lengths, [], 2048, np.random.default_rng(1))
        fill = np.bincount(best, weights=lengths)
        assert fill.max() <= 2048 and fill.min() > 0 and len(fill) >= packing.lower_bound(lengths, 2048) == 170
        assert len(fill) < plain - 10


def test_packing_of_rows_with_names_of_its_own(spark):
    rows = [(k, 1, "r", 2, 700, "i", 5, 6, 7) for k in range(9)]
    names = "doc_id long, row int, own string, shard int, length int, items string, size int, sequence_id int, offset int"
    got = packing.pack(spark.createDataFrame(rows, names))
    assert got.columns == ["doc_id", "row", "own", "shard", "length", "items", "size", "sequence_id", "offset"]
    found = got.collect()
    assert sorted(tuple(r)[:7] for r in found) == [r[:7] for r in rows] and len({r.sequence_id for r in found}) == 5


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1500, 500)
    nothing = np.full(500, -1)
    a, b = (packing.best_fit(nothing, rng.permutation(500), lengths, 2048) for _ in range(2))
    child = packing.crossover(a, b, lengths, 2048, rng)
    fill = np.bincount(child, weights=lengths)
    assert (child >= 0).all() and fill.max() <= 2048 and fill.min() > 0


# 10


def test_main_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in htmltext.extract_main(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article.replace("<br>", " "))]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_markup_that_is_not_article():
    page = """<head><title>T</title><body><div id="cookie-banner">We use cookies</div><header><h1>Site</h1></header><main><article class="post"><header><h1>Title &amp; more</h1></header>
    <p>One<br>two <b>bo</b>ld<p>Three<ul><li>a<li>b</ul><aside>side</aside><form>f</form><div class="share-buttons">share</div><script>if (a < b) {}</script></article>
    <section id="comments"><article class="comment">nice</article></section></main><footer>foot</footer>"""
    assert htmltext.main_blocks(htmltext.blocks(page)) == ["Title & more", "One two bold", "Three", "a", "b"]


def test_host_boilerplate_without_articles(spark):
    menu = "<div>Home About Us Our Products Contact Us Terms Of Service Privacy Policy Login</div>"
    rows = [(k, f"http://h/{k}", f"<body>{menu}<p>Only page {k} says w{k} x{k} y{k} z{k} q{k}.</p><div>Powered by x</div>") for k in range(12)]
    rows += [(50, "http://h/copy", rows[3][2]), (51, None, None), (52, "http://other/", "<div>Powered by x</div>"), (53, "http://h/e", ""), rows[5]]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = defaultdict(set)
    for r in htmltext.extract_main(pages.repartition(3)).collect():
        got[r.page_id].add(r.text)
    for k in (*range(12), 50):
        n = 3 if k == 50 else k
        assert got[k] == {f"Only page {n} says w{n} x{n} y{n} z{n} q{n}."}
    assert (got[51], got[52], got[53]) == ({""}, {"Powered by x"}, {""})
    assert htmltext.extract_main(pages).count() == len(rows) and htmltext.extract_main(pages.limit(0)).count() == 0
