import random

from paperloom.llm import leakage as lk


def brute(docs, items, n):
    grams = {}
    for i, t in items:
        w = lk.words_of(t).split()
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    return {(d, i) for d, t in docs for w in [lk.words_of(t).split()] for k in range(len(w) - n + 1) for i in grams.get(tuple(w[k : k + n]), ())}


def edit(a, b):
    """Least edits of the whole of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def cases(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(5, 40)))) for i in range(15)]
    docs = []
    for d in range(60):
        _, t = rng.choice(items)
        w = t.split()
        a = rng.randrange(len(w))
        w = [rng.choice("abcdefg") for _ in range(5)] + w[a : a + rng.randrange(8, 20)] + [rng.choice("hijk") for _ in range(5)]
        docs.append((d, ", ".join(w).upper()))
    return docs, items


def test_exact_equals_brute_force():
    for seed in range(20):
        docs, items = cases(seed)
        f = lk.LeakFinder(items, 12, 0)
        assert {(d, i) for d, t in docs for i in f.find(t)} == brute(docs, items, 12)


def test_near_equals_brute_force():
    for seed in range(6):
        docs, items = cases(seed)
        f = lk.LeakFinder(items, 12, 1)
        want = set()
        for d, t in docs:
            w = lk.words_of(t).split()
            for i, s in items:
                v = lk.words_of(s).split()
                if any(edit(v[k : k + 12], w) <= 1 for k in range(len(v) - 11)):
                    want.add((d, i))
        assert {(d, i) for d, t in docs for i in f.find(t)} == want


def test_myers_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(500):
        a = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
        b = [rng.choice("abc") for _ in range(rng.randrange(0, 20))]
        assert lk.myers_within(a, b, 0)[0] == edit(a, b)


def test_dataframe(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"x {text.upper()}, y", "z"), (2, None, "z"), (3, "", "z"), (4, text[4:], "z"), (1, f"x {text}", "z")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, text), (8, "too short"), (9, None), (7, text)], "item_id bigint, text string")
    for block in (lk.BLOCK_WORDS, 1):
        got = lk.leaked_items(docs.drop("item_id"), items, block_words=block).collect()
        assert [tuple(r) for r in got] == [(1, 7, 12, 0)]
    assert lk.leaked_items(docs.drop("item_id"), items.limit(0)).count() == 0
    assert lk.leaked_items(docs.drop("item_id").limit(0), items).count() == 0
