"""The encoder and decoder against the library, on odd texts and on the whole table."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from shelfwatch.llm import queries, sentencepieces
from shelfwatch.llm.common import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(7)
    texts = ["", " ", "  ", "a", " a  b ", "▁a", "▁▁ ▁x▁", "a\x00b", "tab\tline\n\nend\r\n", " \n \n  ", "<s> </s> <unk> <0x41>", "é\U0001f600漢字 é‍", "ａＢ１２ ﬁ", "x" * 5000, " " * 77, "ab" * 3000, "." * 999, "aA1_" * 700]
    alphabet = "abcdehilnorst  ▁.,'-019ÄßñеЖ漢\n\t" + "\U0001f468‍�"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    texts += ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return texts


def ids_of(own, *texts):
    flat, ends = own.encode(list(texts))
    return [x.tolist() for x in np.split(flat, ends[:-1])]


def test_encoder_equals_library(library):
    own = sentencepieces.encoder(MODEL)
    texts = odd_texts()
    assert ids_of(own, *texts) == library.encode(texts)
    for text in texts[:40]:
        assert ids_of(own, text) == [library.encode(text)], text[:80]


def test_every_piece_beside_others_equals_library(library):
    own, rng = sentencepieces.encoder(MODEL), random.Random(3)
    pieces = sorted(own.ids)
    texts = ["".join(rng.choices(pieces, k=rng.choice((1, 2, 3, 6)))).replace("▁", rng.choice(" ▁")) for _ in range(20_000)]
    for text, ids in zip(texts, ids_of(own, *texts), strict=True):
        assert ids == library.encode(text), text
    long = "".join(rng.choices([p for p in pieces if "▁" not in p], k=20_000))  # one chunk: the bitfield and going back
    assert ids_of(own, long, "x", long[:70]) == library.encode([long, "x", long[:70]])


def test_memory_that_starts_anew_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "REMEMBERED", 3)
    monkeypatch.setattr(sentencepieces, "PAIRS", 7)
    monkeypatch.setattr(sentencepieces, "TOGETHER", 2)
    with open(MODEL, "rb") as file:
        own = sentencepieces.Encoder(file.read())
    for text in odd_texts()[-300:]:
        assert ids_of(own, text) == [library.encode(text)]


def test_other_kinds_of_models_are_refused():
    with pytest.raises(ValueError):
        sentencepieces.Model(b"\x12\x02\x18\x01")  # a unigram model


def test_tables(spark, library):
    rows = [(k, t, 1, "x") for k, t in enumerate(odd_texts()[:30])] + [(100, None, 1, "x"), (3, "a", 1, "x"), (None, "no id", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, pieces string")
    got = sentencepieces.decode(sentencepieces.encode(docs, MODEL), MODEL)
    want = sorted((str(d), library.encode(t or ""), library.decode(library.encode(t or "")) if t else "") for d, t, _, _ in rows)
    assert sorted((str(r.doc_id), list(r.ids), r.text) for r in got.collect()) == want
    assert sentencepieces.encode(docs.limit(0), MODEL).count() == 0
    ids = spark.createDataFrame([(1, None), (2, []), (3, [3, 4, 228, 131, 171, 1])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentencepieces.decode(ids, MODEL).collect()} == {1: "", 2: "", 3: library.decode([3, 4, 228, 131, 171, 1])}


def test_query_equals_library(spark, sf_dir, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = library.encode(r.text)
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids) if ids else "")))
    found = queries.QUERIES["op11_sentencepiece"](spark, sf_dir)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want)
