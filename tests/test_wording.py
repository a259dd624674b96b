import pytest
from pyspark.sql import functions as F

from paperloom.functions import wording as W


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_whole_words(spark):
    rows = [("agreement with john smithson", "john smith"), ("agreement with john smith.", "john smith"), ("in order to form", "order form"), ("x (a+b) y", "(a+b)"), ("n", ""), ("émile zola", "mile"), ("a.b", "axb"), (None, "a"), ("line one\nacme", "acme")]
    got = one(spark, rows, "h string, n string", W.contains_whole(F.col("h"), F.col("n")))
    assert [g[0] for g in got] == [False, True, False, True, False, False, False, None, True]
    got = one(spark, [("Contoso Worldwide, Inc.", "contoso worldwide inc"), ("Quill & Vane", "quill and vane"), ("AT&T", "at&t")], "a string, b string", W.loosely(F.col("a")) == W.loosely(F.col("b")))
    assert all(g[0] for g in got)


def test_enumerators(spark):
    cases = {"25. Term of lease": "Term of lease", "(iv) Payment": "Payment", "Section 4. Notices": "Notices", "ARTICLE IV Scope": "Scope", "4.2 Fees": "Fees", "I agree": "I agree", "a party": "a party", "Section 4. (a) Rent": "Rent", "1. 2. 3. 4. x": "4. x", "": ""}
    got = one(spark, [(k,) for k in cases], "t string", W.strip_enumerators(F.col("t")))
    assert [g[0] for g in got] == list(cases.values())


def test_months(spark):
    cases = {"January 5": 1, "jan. 5": 1, "janitor": None, "Mayor": 5, "sept 1": None, "September": 9, " dec-1": 12, "": None}
    assert [g[0] for g in one(spark, [(k,) for k in cases], "t string", W.leading_month(F.col("t")))] == list(cases.values())


def test_labels(spark):
    rows = [("Project: Aurora Catalog",), ("Bill to: Acme",), ("Aurora",), ("Order 12: x",), ("a b c d e: x",), ("Re: ",), (None,)]
    got = one(spark, rows, "t string", W.label_of(F.col("t")), W.value_of(F.col("t")), W.subject_value(F.col("t")))
    assert got == [("Project", "Aurora Catalog", "Aurora Catalog"), ("Bill to", "Acme", None), (None, None, "Aurora"), (None, None, "Order 12: x"), (None, None, "a b c d e: x"), (None, None, "Re:"), (None, None, None)]


def test_dates_keep_their_own_labels(spark):
    line = "Invoice Date: April 30, 2025    Due Date: 05/30/2025"
    rows = [(line,), ("This report is dated as of 2024-01-02. Released: 3 March 2024",), ("Ship Date: 2024-01-02",), ("Date: 2024-01-02",), ("Case No. 1042 Date: 2024-01-02",), ("no date",)]
    df = spark.createDataFrame(rows, "t string").select("t", F.posexplode(W.date_windows(F.col("t"))).alias("k", "d")).select("t", "k", "d.date", F.col("d.wording").alias("w"))
    got = {(r.t, r.k): r for r in df.select("*", W.date_role(F.col("w")).alias("role"), W.labels_the_issue_date(F.col("w")).alias("own"), W.labels_another_date(F.col("w")).alias("another")).collect()}
    assert (got[line, 0].date, got[line, 0].role, got[line, 0].own) == ("april 30, 2025", "invoice", True)
    assert (got[line, 1].date, got[line, 1].role, got[line, 1].own, got[line, 1].another) == ("05/30/2025", None, False, True)
    assert got[rows[1][0], 0].role == "effective" and got[rows[1][0], 1].own and got[rows[1][0], 1].role is None
    assert [got[t, 0].own for t, in rows[2:5]] == [False, True, True] and len(got) == 7


def test_titles_and_codes(spark):
    cases = {"NON-DISCLOSURE AGREEMENT OF THE NDA": "Non-disclosure Agreement of the NDA", "Mixed Case OF": "Mixed Case OF", "THE LEASE": "The Lease", "": ""}
    assert [g[0] for g in one(spark, [(k,) for k in cases], "t string", W.title_case(F.col("t")))] == list(cases.values())
    codes = {"W-9": True, "10-K": True, "1099-MISC": True, "CP161": True, "INV-2024-001": False, "plain": False, "2024": False}
    assert [g[0] for g in one(spark, [(k,) for k in codes], "t string", W.is_form_code(F.col("t")))] == list(codes.values())


def test_file_names(spark):
    rows = [("a.PDF.pdf", "pdf"), ("a.pdf", ""), ("a.b+", "b+"), ("pdf", "pdf")]
    assert [g[0] for g in one(spark, rows, "n string, e string", W.strip_duplicate_extension(F.col("n"), F.col("e")))] == ["a", "a.pdf", "a", "pdf"]
    names = {"2024-02-29 x": "2024-02-29", "2024-02-30 x": None, "2024-01-01x": None, "2024-01-01": "2024-01-01", "x 2024-01-01": None}
    assert [g[0] for g in one(spark, [(k,) for k in names], "t string", W.leading_date(F.col("t")))] == list(names.values())
    assert [g[0] for g in one(spark, [("1899-01-01",), ("2036-01-01",), ("2037-01-01",), ("x",)], "t string", W.year_is_plausible(F.col("t"), 2026))] == [False, True, False, True]


@pytest.mark.parametrize("phrase, want", [(["minute"], [0, 2]), (["minutes", "of"], [0]), (["of", "the"], []), ([], [0, 1, 2])])
def test_phrases(spark, phrase, want):
    got = one(spark, [(["minutes", "of", "minute"],)], "w array<string>", W.phrase_positions(F.col("w"), phrase))
    assert [k for k in got[0][0] if phrase or k < 3] == want


def test_words_from_the_end(spark):
    rows = [("date: update date",), ("update",), ("",), (None,), ("x\ndate",)]
    assert [g[0] for g in one(spark, rows, "t string", W.last_word_at(F.col("t"), "date"))] == [13, None, None, None, 2]
    assert one(spark, [("a­b​c",)], "t string", W.without_invisible(F.col("t"))) == [("abc",)]
