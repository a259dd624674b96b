import random

from pyspark.sql import functions as F

from paperloom.functions.arrow import log2_in_1024ths
from paperloom.operators import evidence_index as E, segmentation as S


def blocks(spark, *texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, unit_id string").drop("unit_id")
    return S.blocks_of(S.lines_of(df))


def test_sections_equal_a_stack_of_open_headings(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(30):
        texts.append("\n".join(rng.choice([f"{'#' * rng.randrange(1, 5)} Head {n}", f"HEADING {'ABCDEFG'[n % 7]}", f"words of text {n}.\n"]) for n in range(12)))
    got = {}
    for r in E.linked(blocks(spark, *texts)).orderBy("doc_id", "block_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    for rows in got.values():
        opened = []
        for r in rows:
            if r.level is not None:
                while opened and opened[-1][0] >= r.level:
                    opened.pop()
            assert r.parent == (opened[-1][1] if opened else None)
            assert r.path == [t for _, _, t in opened]
            if r.level is not None:
                opened.append((r.level, r.block_no, r.text.strip("# \n:")))


def test_units(spark):
    text = "# Rent\nThe rent is due.\nIt is paid monthly.\n\n- first item\n- second item\n\nLandlord: Acme Ltd.\nTenant: Bode LLC\n\n| Item | Cost |\n| --- | --- |\n| desk | 5 |\n| lamp | 7 |"
    rows = {r.unit_id: r for r in E.units(blocks(spark, text, "", None)).collect()}
    assert list(sorted(rows)) == ["b1", "b2", "b3.i0", "b3.i1", "b4.f0", "b4.f1", "b5.r2", "b5.r3"]
    assert rows["b2"].text == "The rent is due. It is paid monthly." and rows["b5.r3"].header == "| Item | Cost |" and {r.heading for u, r in rows.items() if u != "b1"} == {"Rent"}
    weights = {(r.unit_id, r.term): r.weight for r in E.weighted_terms(E.units(blocks(spark, text))).collect()}
    assert weights["b2", "rent"] == 3 and weights["b5.r3", "lamp"] == 2 and weights["b5.r3", "cost"] == 1


def test_log2_equals_integers(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(1, 10**rng.randrange(1, 8)), rng.randrange(1, 10**rng.randrange(1, 6))) for _ in range(500)] + [(0, 1), (5, 0), (8, 8), (1 << 20, 1)]
    got = spark.createDataFrame(pairs, "n bigint, d bigint").select("n", "d", E.log2_fixed(F.col("n"), F.col("d")).alias("v")).collect()
    assert all(r.v == log2_in_1024ths(r.n, r.d) for r in got)


def test_bm25_equals_integers(spark):
    texts = ["# Lease date\nThe lease date is 5 May.\n\nOther words about rent and rent.\n\n- date of rent\n- a much longer item about deposits, keys, windows and doors", "No such word here."]
    terms = E.weighted_terms(E.units(blocks(spark, *texts)))
    lexicon = spark.createDataFrame([("when", "date"), ("when", "leas"), ("what", "rent"), ("none", "zebra")], "field string, term string")
    rows = [tuple(r) for r in terms.collect()]
    known = {t for *_, t, _ in rows}
    want = {}
    for field, words in {"when": ["date", "leas", "lease"], "what": ["rent"]}.items():
        words = [w for w in words if w in known and w != "lease"]
        own = [r for r in rows if r[0] == 0]
        units, total = len({r[1] for r in own}), sum(r[3] for r in own)
        raw = {}
        for _, unit, term, weight in own:
            if term in words:
                df = sum(r[2] == term for r in own)
                length = sum(r[3] for r in own if r[1] == unit)
                raw[unit] = raw.get(unit, 0) + log2_in_1024ths(2 * units + 2, 2 * df + 1) * (11000 * weight * total // (5 * weight * total + 3 * total + 9 * length * units))
        want |= {(field, 0, u): v * 100 // max(raw.values()) for u, v in raw.items() if v}
    got = {(r.field, r.doc_id, r.unit_id): r.score for r in E.bm25_units(terms, lexicon).collect()}
    assert got == want and want
