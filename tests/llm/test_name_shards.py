import random
from itertools import combinations, permutations

from paperloom.llm import name_links as nl


def edited(rng, text, edits):
    for _ in range(edits):
        k = rng.randrange(len(text))
        c = rng.choice("abcdefg")
        text = rng.choice([text[:k] + c + text[k:], text[:k] + text[k + 1 :], text[:k] + c + text[k + 1 :], text[:k] + text[k + 1 : k + 2] + text[k : k + 1] + text[k + 2 :]])
    return text


def test_names_within_the_bound_share_a_shard():
    rng = random.Random(4)
    seen = 0
    for _ in range(60_000):
        a = "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 16)))
        b = edited(rng, a, rng.randrange(0, 3))
        if b and (d := nl.distance(a, b, 2)) <= 2 and nl.same_letters(a, b, d):
            seen += 1
            assert nl.walked_shards(a) & nl.held_shards(b) and nl.walked_shards(b) & nl.held_shards(a), (a, b)
            assert nl.letter_shards(a, len(b)) & nl.letter_shards(b, len(b)), (a, b)
    assert seen > 20_000


def test_orders_equal_all_permutations():
    rng = random.Random(5)
    for _ in range(150):
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(5)]
        text = edited(rng, "".join(rng.sample(words, 5)), rng.randrange(0, 3))
        want = {(o, d) for o in map("".join, permutations(words)) if (d := nl.distance(o, text, 2)) <= 2}
        assert set(nl.orders_within(words, text, 2)) == want


def test_edits_at_both_ends_and_long_names(spark):
    groups = [
        ["Bonvartelmuk Hardware Ltd.", "Bpnvartelmjk Hardware Ltd."],  # an edit in the first and in the last four letters
        ["Alpen Bonvar Corvek Dulmit Felkos Hardware Ltd.", "Blpen Bonvar Corvek Dulmit Felkos Hardware Ltd.", "Zlpen Felkos Bonvar Corvek Dulmit Hardware Ltd.", "Corvek Bonvaralpen Dulmit Felkos Hardware Ltd."],
        ["Ruth Lemtanpol"],
    ]
    got = {tuple(r) for r in nl.linked_pairs(spark.createDataFrame([(n,) for g in groups for n in g], "name string")).collect()}
    assert got == {tuple(sorted(p, key=str.encode)) for g in groups for p in combinations(g, 2)}
