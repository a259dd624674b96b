import pytest
from pyspark.sql import functions as F

from paperloom.operators import scoring as C


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_types_and_parties(spark):
    rows = [("Statement of Work", "Statement of Work No. 4"), ("Notice of Termination", "Employment Termination"), ("", "x"), ("the and", "")]
    assert [g[0] for g in one(spark, rows, "a string, b string", C.type_matches(F.col("a"), F.col("b")))] == [True, False, True, True]
    rows = [("Halvorsen Fixture Works, LLC", "Halvorsen Fixture Works LLC"), ("Acme", "Acme Holdings"), ("Acme", "Bode"), ("...", "Acme")]
    assert [g[0] for g in one(spark, rows, "a string, b string", C.party_matches(F.col("a"), F.col("b")))] == [True, True, False, False]
    df = spark.createDataFrame([(1, ["Acme, Inc.", "Bode"], ["acme inc", "Cole"]), (2, None, ["x"]), (3, ["x"], None)], "id int, gold array<string>, made array<string>")
    assert sorted(map(tuple, C.judged_parties(df, "id", "gold", "made").collect())) == [(1, 1, 2, 1), (2, 0, 0, 1), (3, 0, 1, 0)]
    assert one(spark, [("| a | “b”’s  c\n",)], "t string", C.comparable(F.col("t"))) == [("a \"b\"'s c",)]


def test_gates(spark):
    values = spark.createDataFrame([("up", 1.0, 1.2), ("up", 1.0, 0.5), ("up", 1.0, 1.1), ("down", 1.0, 0.5), ("down", 1.0, 2.0), ("free", 1.0, 9.0)], "metric string, was double, now_is double")
    metrics = spark.createDataFrame([("up", 0.1, False), ("down", 0.0, True)], "metric string, tolerance double, lower_is_better boolean")
    got = {(r.metric, r.now_is): r.better for r in C.moved(values, metrics).collect()}
    assert got == {("up", 1.2): True, ("up", 0.5): False, ("up", 1.1): None, ("down", 0.5): True, ("down", 2.0): False}
    rows = [(12, 200, 121), (12, 200, 120), (9, 200, 200), (12, 99, 99)]
    assert [g[0] for g in one(spark, rows, "p int, d int, c int", C.short_of_reduction(F.col("p"), F.col("d"), F.col("c")))] == [True, False, False, False]
    rows = [(1.0, 0.5, None), (1.0, 1.0, None), (0.9, 0.5, 0.5), (None, 0.1, 0.1)]
    assert [g for g in one(spark, rows, "d double, a double, b double", C.violates(F.col("d"), F.col("a"), F.col("b")), C.loses(F.col("a"), F.col("d")))] == [(True, True), (False, False), (False, True), (False, False)]


def test_same_document(spark):
    rows = [(6, "2024-01-02 Invoice.pdf", "2024-01-02", True), (2, "2024-01-02 Invoice.pdf", "2024-02-02", False), (1, "Invoice.pdf", "2024-02-02", True), (2, "Invoice.pdf", None, False), (7, "2024-01-02", "2024-01-02", False)]
    got = one(spark, rows, "d int, n string, t string, want boolean", C.same_document(F.col("d"), F.col("n"), F.col("t")), "want")
    assert all(a == b for a, b in got)


def test_lists_and_lookups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id int, h string").withColumn("name", F.concat(F.lit("f"), "id"))
    assert sorted(map(tuple, C.staged_copies(df, "id", "h", "name").collect())) == [(2, 1, "COPY - f2"), (4, 1, "COPY - f4")]
    assert C.selected(df, "id", [1, 3]).count() == 2
    with pytest.raises(ValueError):
        C.selected(df, "id", [1, 9])
    assert C.searched(df, ["h", "name"], " F3 ").count() == 1 and C.searched(df, ["h"], "").count() == 4
    rows = [("A\\b", "a/B/c", True), ("a/b", "a/bc", False), ("a/", "A", True)]
    assert all(g[0] == g[1] for g in one(spark, rows, "a string, b string, want boolean", C.paths_overlap(F.col("a"), F.col("b")), "want"))
    names = one(spark, [([" Acme Ltd", "acme, ltd", "", "Bode"],)], "n array<string>", C.first_spellings(F.col("n"), C.plain_name))
    assert names == [(["Acme Ltd", "Bode"],)]
    cited, known = spark.createDataFrame([(1, "p1"), (1, "p2"), (2, "p9")], "m int, b string"), spark.createDataFrame([("p1",), ("p2",), ("p2",)], "b string")
    assert {r.m: (r.cited, r.unknown, r.rate) for r in C.citation_scores(cited, known, "m", ["b"]).collect()} == {1: (2, 0, 1.0), 2: (1, 1, 0.0)}


def test_nearest_filed_and_lookups(spark):
    prints = spark.createDataFrame([(1, 0), (2, 7), (3, -1), (4, None)], "id int, fingerprint bigint")
    filed = spark.createDataFrame([("b", 0), ("a", 0), ("c", 1), ("d", 15)], "marker string, fingerprint bigint")
    assert sorted(map(tuple, C.nearest_filed(prints, filed, "id").collect())) == [(1, "a", 0), (2, "d", 1)]
    h = "a" * 64
    files, old = spark.createDataFrame([(1, h), (2, "b" * 64), (3, "xyz"), (4, None)], "id int, h string"), spark.createDataFrame([(h, "m2"), (h, "m1"), ("xyz", "m3")], "h string, marker string")
    assert {r.id: r.marker for r in C.filed_by_hash(files, old, "id", "h").collect()} == {1: "m1", 2: None, 3: None, 4: None}
    assert sorted(r.id for r in C.without(files, files.where("id IN (1, 4)"), "h").collect()) == [2, 3, 4]
    assert sorted(r.id for r in C.orphans(files, old, "h").collect()) == [2, 4]
    wide = spark.createDataFrame([(1, 2, None), (2, 3, 4.5)], "id int, a int, b double")
    assert sorted(map(tuple, C.flattened(wide, ["id"], ["a", "b"]).collect())) == [(1, "a", 2.0), (2, "a", 3.0), (2, "b", 4.5)]
    seen = spark.createDataFrame([("x", 0), ("x", 1000), ("y", 400), ("z", 399), (None, 5000)], "m string, s bigint").selectExpr("m", "timestamp_seconds(s) AS at")
    assert {r.m: r.active for r in C.present(seen, "m", "at").collect()} == {"x": True, "y": True, "z": False}
