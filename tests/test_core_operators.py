import random

from pyspark.sql import functions as F

from paperloom.operators import evaluation, segmentation, simhash


def fnv(shingle):
    h = 0xCBF29CE484222325
    for c in shingle:
        for b in ord(c).to_bytes(4, "little"):
            h = ((h ^ b) * 0x100000001B3) % (1 << 64)
    return h


def test_simhash_equals_plain_loop():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefé1") for _ in range(6)) for _ in range(60))
    flat = simhash.normalized(text.upper() + "!!")
    weights = [0] * 64
    for k in range(len(flat) - 4):
        h = fnv(flat[k : k + 5])
        for b in range(64):
            weights[b] += 1 if h >> b & 1 else -1
    want = sum(1 << b for b in range(64) if weights[b] > 0)
    assert simhash.simhash(text.upper() + "!!") % (1 << 64) == want
    assert simhash.simhash(None) is None and simhash.simhash("short") is None


def test_near_classes_equal_all_pairs(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 9))) for b in base for _ in range(3)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(signed + signed[:5])] + [(999, None)], "doc_id bigint, fingerprint bigint")
    got = {(r.fingerprint_a, r.fingerprint_b, r.distance) for r in simhash.near_classes(df, "doc_id").collect()}
    want = {(a, b, bin((a ^ b) % (1 << 64)).count("1")) for a in set(signed) for b in set(signed) if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 6}
    assert got == want and want


def test_blocks(spark):
    df = spark.createDataFrame([(1, "TITLE LINE\n\nText one.\nText two.\n| a | b |\n| --- | --- |\n| 1 | 2 |\n- item", 0), (2, None, 0), (3, "", 0)], "doc_id bigint, text string, kind int")
    got = [(r.block_no, r.kind, r.n_lines) for r in segmentation.blocks_of(segmentation.lines_of(df.select("doc_id", "text"))).orderBy("block_no").collect()]
    assert got == [(1, "heading", 1), (2, "text", 2), (3, "table", 3), (4, "list_item", 1)]
    rows = segmentation.table_rows(segmentation.lines_of(df)).collect()
    assert [(r.header, r.cells) for r in rows] == [("a|b", "1|2")]


def test_distribution_is_nearest_rank(spark):
    df = spark.createDataFrame([("x", float(v)) for v in range(1, 21)] + [("x", None)], "d string, v double")
    r = evaluation.distributions(df, "d", "v").first()
    assert (r.n, r.p50, r.p90, r.p95, r.max, r["mean"]) == (20, 10.0, 18.0, 19.0, 20.0, 10.5)


def test_compared(spark):
    a = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True)], "id int, ok boolean")
    b = spark.createDataFrame([(1, True), (2, True), (3, False), (5, True)], "id int, ok boolean")
    assert {r.id: r.verdict for r in evaluation.compared(a, b, "id", "ok").collect()} == {1: "aligned", 2: "fixed", 3: "broken", 4: "only_before", 5: "only_after"}


def test_longest_increasing_equals_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        v = [rng.randrange(8) for _ in range(8)]
        best = max((bin(m).count("1") for m in range(256) if (s := [x for k, x in enumerate(v) if m >> k & 1]) == sorted(set(s))), default=0)
        assert evaluation.longest_increasing(v) == best


def test_bands_hold_all_pairs_whatever_their_number():
    import random
    from itertools import combinations

    rng = random.Random(2)
    for n in (10, 10**5, 10**7, 10**9, 10**12):
        blocks, take = simhash.bands_for(n, 6)
        assert blocks - take == 6
        edges = [64 * k // blocks for k in range(blocks + 1)]
        for _ in range(50):
            spoilt = {max(b for b in range(blocks) if edges[b] <= bit) for bit in rng.sample(range(64), 6)}
            assert any(not spoilt & set(c) for c in combinations(range(blocks), take))


def test_members_of_near_classes(spark):
    rows = [(1, 5), (2, 5), (3, 7), (4, -1), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, fingerprint bigint")
    pairs = simhash.near_classes(df, "doc_id")
    got = sorted(map(tuple, simhash.near_members(df, "doc_id", pairs).collect()))
    assert got == [(1, 1, 2, 1), (2, 1, 2, 1), (3, 3, 1, 1), (4, 4, 1, 0)]


def test_ranks_equal_sorting(spark):
    import math
    import random

    from paperloom.operators import ranks

    rng = random.Random(7)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), 1.0, rng.random(), rng.random()])) for _ in range(3000)] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in ranks.ranked(df, ["g"], "v", {"p10": ranks.nearest(0.1), "p95": ranks.nearest(0.95), "median": ranks.upper_median}).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        own = sorted(v for k, v in rows if k == g and v is not None and not math.isnan(v))
        assert (r.n, r.least, r.most) == (len(own), own[0], own[-1]) and abs(r["mean"] - sum(own) / len(own)) < 1e-9
        assert (r.p10, r.p95, r.median) == (own[math.ceil(0.1 * len(own)) - 1], own[math.ceil(0.95 * len(own)) - 1], own[len(own) // 2])
    assert ranks.ranked(df.limit(0), ["g"], "v", {"p": ranks.nearest(0.5)}).count() == 0
