import random
from collections import Counter

import numpy as np

from paperloom.llm import stuffing as st

NOUNS = "invoice ledger survey lease permit tender guarantee receipt parcel harbour office clerk".split()


def prose(rng, n):
    return " ".join(f"The {rng.choice(NOUNS)} of the {rng.choice(NOUNS)} was sent to {rng.choice(['Kestle', 'Oxmere', 'Vennick'])} and filed by the {rng.choice(NOUNS)} in {rng.randrange(1990, 2030)}." for _ in range(n))


def corpus(rng):
    rows = [(k, prose(rng, 8) + "\n\n" + prose(rng, 6)) for k in range(200)]
    stuffed = {
        1000: ", ".join(rng.choice(["cheap lease permit", "lease permit online", "lease permit"]) for _ in range(60)),
        1001: "\n".join(f"http://www.{rng.randrange(10**6)}.example/x" for _ in range(30)),
        1002: " ".join(rng.choice(["#cheap", "#best", "lease_permit"]) for _ in range(60)),
        1003: prose(rng, 1) + "\n\n" + " | ".join(rng.choice(["permit lease buy", "tender maker", "permit lease"]) for _ in range(80)),
    }
    fine = {
        2000: prose(rng, 12) + "\n\n#cheap, #best, #top",
        2001: "\n".join(f"| {rng.choice(NOUNS)} | {rng.randrange(200)} | ${rng.randrange(10**4)}.50 |" for _ in range(40)),
        2002: "A guide can be found at https://www.x.example/y, but the original is kept in Oxmere.",
    }
    return rows + [*stuffed.items()] + [*fine.items()] + [(3000, None), (3001, ""), (3002, "  \n"), (3003, "!!!")], set(stuffed)


def test_found(spark):
    rows, want = corpus(random.Random(5))
    df = spark.createDataFrame(rows + rows[200:204], "doc_id bigint, text string").selectExpr("*", "1 AS n", "'x' AS stuffed_share")
    got = st.stuffed_documents(df, "doc_id").collect()
    assert {r.doc_id for r in got} == want and len(got) == 2 * len(want)
    assert st.stuffed_documents(df.limit(0), "doc_id").count() == 0


def test_counts_equal_brute_force(spark):
    rows, _ = corpus(random.Random(6))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = st.chunk_counts(st.word_ids(df, "doc_id", "text", 4)).collect()
    assert len(got) == len({(r.chunk, r.key) for r in got})
    words, want = st.Words(), Counter()
    for _, t in rows:
        for block in st.blocks(t) if t else ():
            ids = [i for i in np.frombuffer(words.of(block), np.int32).tolist() if i >= 0]
            want.update((i << 32) | st.ALONE for i in ids if i != st.NUMBER)
            want.update((a << 32) | b for a, b in zip(ids, ids[1:]) if st.NUMBER not in (a, b))
    assert {r.key: r.n for r in got} == want


def test_information_leaves_a_documents_own_counts_out():
    words = st.Words()
    documents = [words.document(t) for t in ("alpha beta gamma alpha beta", "alpha beta delta", "beta, alpha")]
    read = st.Read(documents)
    keys, n = read.counts()
    assert dict(zip(keys.tolist(), n.tolist()))[(words_id(words, "alpha") << 32) | words_id(words, "beta")] == 3
    assert st._same(read.document, read.words)[:2].tolist() == [2, 2]
    assert read.within.tolist() == [True, True, True, True, True, True, False]
    assert st._distinct(read.block, read.words, 3).tolist() == [3, 3, 2]


def words_id(words, w):
    return int(np.frombuffer(words.of(w), np.int32)[0])


def test_repeated_sentences_are_spared_and_stuffed_sentences_found(spark):
    rng = random.Random(9)
    rows = [(k, prose(rng, 12)) for k in range(300)]
    looking = "Looking for lease permit? Our lease permit is the best lease permit for every lease permit user. "
    rows += [(k, looking * 6) for k in range(1000, 1002)] + [(2000, ("The invoice of the ledger was sent to Kestle and filed by the clerk in 2020. ") * 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in st.stuffed_documents(df, chunks=3).collect()} == {1000, 1001}
