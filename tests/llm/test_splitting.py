import random

from pyspark.sql import functions as F

from paperloom.llm import splitting as sp


def joined(pieces, overlap):
    return "".join(p[3] if n == 0 else p[3][overlap:] for n, p in enumerate(pieces))


def test_round_trip_and_size():
    rng = random.Random(1)
    for _ in range(300):
        parts = ["".join(rng.choice(["a", "b", " ", ". ", "\n", "\n\n", "é", "。", "😀"]) for _ in range(rng.randrange(0, 200))) if rng.random() > 0.1 else None for _ in range(rng.randrange(1, 4))]
        text = "".join(p or "" for p in parts)
        out = sp.pieces(parts, 50, 7)
        if len(text) <= 50:
            assert out == []
            continue
        assert joined(out, 7) == text
        assert all(len(p[3]) <= 50 and text[p[0] : p[1]] == p[3] for p in out)
        assert all(b[0] == a[1] - 7 for a, b in zip(out, out[1:]))


def test_strongest_then_rightmost():
    rng = random.Random(2)
    for _ in range(50):
        at = sorted(rng.sample(range(1, 200), 60))
        rank = [rng.randrange(1, 6) for _ in at]
        import numpy as np

        table = sp.StrongestCut(np.array(at), np.array(rank))
        for _ in range(50):
            lo, hi = sorted((rng.randrange(0, 210), rng.randrange(0, 210)))
            inside = [(r, a) for a, r in zip(at, rank) if lo <= a <= hi]
            assert table.best(lo, hi) == (max(inside)[::-1] if inside else None)


def test_page_beats_paragraph():
    out = sp.pieces(["word " * 6 + "\n\n", "more words here " * 4], 60, 5)
    assert out[0][2] == "page" and out[0][1] == 32
    assert sp.pieces(["x" * 100], 40, 5)[0][2] == "hard"


def test_dataframe(spark):
    rows = [("a", [(2, "second " * 5), (1, None), (1, "first " * 5)], 1), ("b", None, 2), ("c", [], 3), ("d", [(1, "short")], 4)]
    df = spark.createDataFrame(rows, "doc_id string, pages array<struct<page_number int, text string>>, piece int")
    out = sp.split_oversized(df, F.col("doc_id"), sp.pages_in_order(), 40, 4).orderBy("piece_no").collect()
    assert {r.item_key for r in out} == {"a"}
    assert joined([(0, 0, 0, r.piece) for r in out], 4) == "first " * 5 + "second " * 5
    assert sp.split_oversized(df.limit(0), F.col("doc_id"), sp.pages_in_order(), 40, 4).count() == 0
