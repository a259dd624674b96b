import random

import pytest

tokenizers = pytest.importorskip("tokenizers")

from paperloom.llm import corpus_tokens as ct


def reference(texts):
    t = tokenizers.Tokenizer.from_file(ct.default_vocab())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(texts):
    offsets, ids = ct.encoder(ct.default_vocab()).encode_batch(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_random_texts_equal_the_library():
    rng = random.Random(7)
    pick = lambda: chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x1F000, 0x1FAFF), 32, 32, 97, 10, 0x1C, 0x85]))
    texts = ["".join(pick() for _ in range(rng.randrange(50))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab \n\t.1é") for _ in range(rng.randrange(30))) for _ in range(5000)]
    assert encoded(texts) == reference(texts)


def test_edge_texts():
    texts = [None, "", " ", "   ", "<|endoftext|> x", "a" * 4000, " " * 3000, "x  \n y", "\n \n", "é́", "it's we'll"]
    assert encoded(texts) == reference(texts)
    assert encoded([None, ""]) == [[], []]


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(ct, "CACHE_WORDS", 50)
    bpe = ct.SpeculativeBpe(ct.default_vocab())
    texts = [" ".join(f"w{k}x{n}" for n in range(40)) for k in range(5)]
    for t in texts:
        offsets, ids = bpe.encode_batch([t])
        assert ids.tolist() == reference([t])[0]


def test_dataframe(spark):
    df = spark.createDataFrame([(1, "Hello world", 5), (2, None, 6), (3, "", 7), (3, "", 7)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id, list(r.ids)) for r in ct.encode_corpus(df, "doc_id", "text").collect())
    assert got == [(1, reference(["Hello world"])[0]), (2, []), (3, []), (3, [])]
    assert ct.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
