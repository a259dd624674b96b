import random
from itertools import combinations

from paperloom.llm import name_links as nl

SAME = [
    ["Bonvar & Telmuk Hardware Ltd.", "bonvar and telmuk hdwe. ltd", "The Telmuk & Bonvar Hardware Limited", "BONVAR TELMUK HARDWARE", "Bonvr & Telmuk Hardware Ltd.", "Bonvar  Telmkuk (Hardware) Ltd.", "Hardware Bonvar Telmuk Ltd.", "bonvartelmuk hardware ltd.", "Telmukbonvr Hardware Ltd."],
    ["Bonvar & Telmuk Shipping Ltd."], ["Bonvar & Telmuk Hardware II Ltd."], ["Bonvar & Telmuk Hardware West Ltd."],
    ["Bonvartelpok Hardware Ltd."],
    ["Elizabeth Kordanvel", "Elizie Kordanvel", "Liz Kordanvel", "Kordanvel, Elizabeth", "Dr. Elizabeth A. Kordanvel", "ELIZABETH KORDNAVEL", "E. Kordanvel"],
    ["Robert Kordanvel"], ["Ruth Lemtanpol"], ["Rita Lemtanpol"], ["R. Lemtanpol"],
]


def pairs(groups):
    return {tuple(sorted(p, key=str.encode)) for g in groups for p in combinations(g, 2)}


def test_pairs(spark):
    rows = [(n, 1) for g in SAME for n in g] + [(None, 1), ("", 2), ("  ", 3), (" Ruth Lemtanpol ", 4), ("!!!", 5)]
    df = spark.createDataFrame(rows, "name string, party int").select("name")
    got = [tuple(r) for r in nl.linked_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == pairs(SAME)
    assert nl.linked_pairs(df.limit(0)).count() == 0


def test_trie_equals_pairwise_distance():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    trie = nl.Trie()
    for w in words:
        trie.add(w, w)
    for q in words[:60]:
        for most in (0, 1, 2):
            want = sorted((w, nl.distance(q, w, most)) for w in words if nl.distance(q, w, most) <= most)
            assert sorted(trie.within(q, most)) == want


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(260)] + [(f"c{k:03}", f"c{k + 1:03}") for k in range(60)]
    links = [(a, b) for a, b in links if a != b]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in nl.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {n: find(n) for n in root}


def test_long_name(spark):
    long = " ".join(f"word{k}" for k in range(3000))
    df = spark.createDataFrame([(long + " Hardware Ltd.",), (long + " Hdwe. Ltd.",)], "name string")
    assert nl.linked_pairs(df).count() == 1
