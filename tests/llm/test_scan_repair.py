from pyspark.sql import functions as F

from paperloom.llm import scan_repair as sr

LINE = "doc_id string, page int, block_id string, line_no int, text string, bbox array<int>, confidence int, machine_id string, extra int"
RUN = "doc_id string, page int, run_no int, text string, bbox array<int>, bold boolean, confidence int, machine_id string"
SENTENCE = "the tenant shall photograph the customer list for the agreement with the carrier and the third-party consents".split()


def line(doc, page, no, text, block="b"):
    return (doc, page, block, no, text, None, None, "m", 1)


def corpus():
    """Plain lines that make the words known."""
    return [line(f"plain{k}", 1, n, "x " + " ".join(SENTENCE), "b") for k in range(10) for n in range(10)]


def pages():
    out = []
    for p in range(1, 5):
        head = ["Bonvar Ltd. - Confidential", "Bonvar Ltd. - C0nfidenfial", "Bonvar Ltd. - Confidential", "B�nvar Ltd. - Confidential"][p - 1]
        own = ["Alpha opens.", "Second words.", "Gamma goes on.", "Delta ends it."][p - 1]
        out += [line("d", p, 1, head), line("d", p, 2, own), line("d", p, 3, "the tenant shall photo-"), line("d", p, 4, "graph the customer list"), line("d", p, 5, "for the third-"), line("d", p, 6, "party consents and fhe (ustomer lisf."), line("d", p, 7, own[::-1]), line("d", p, 8, f"P@ge {p}" if p == 2 else f"Page {p}")]
    return out


def test_found_and_paragraphs(spark):
    lines = spark.createDataFrame(corpus() + pages() + pages() + [line("d", 1, 9, None), line("d", 1, 10, "  ")], LINE)
    runs = spark.createDataFrame([], RUN)
    got = {tuple(r) for r in sr.noise_found(lines, runs).where("doc_id = 'd'").collect()}
    want = set()
    for p in range(1, 5):
        want |= {("layout_line", "d", p, 1, "running"), ("layout_line", "d", p, 3, "hyphen"), ("layout_line", "d", p, 6, "misread"), ("layout_line", "d", p, 8, "page_number")}
    assert got == want
    text = sr.paragraphs(lines, runs).where("doc_id = 'd'").orderBy("para_no").agg(F.array_join(F.collect_list("text"), " ").alias("t")).first().t
    assert text.count("the tenant shall photograph the customer list for the third-party consents and the customer list.") == 4
    assert "onfident" not in text and "P@ge" not in text


def test_runs_in_reading_order(spark):
    lines = spark.createDataFrame(corpus(), LINE)
    rows = [
        ("r", 1, 1, "3", [5, 900, 9, 910], False, 1, "m"), ("r", 1, 2, "the tenant shall", [5, 100, 9, 110], False, 1, "m"), ("r", 1, 3, "photo­", [50, 100, 90, 110], False, 1, "m"),
        ("r", 1, 4, "graph tbe customer", [5, 120, 9, 130], False, 1, "m"), ("r", 1, 4, "graph tbe customer", [5, 120, 9, 130], False, 1, "m"), ("r", 1, 5, "list", None, False, 1, "m"),
    ]
    runs = spark.createDataFrame(rows, RUN)
    got = {tuple(r)[2:] for r in sr.noise_found(lines, runs).where("doc_id = 'r'").collect()}
    assert (1, 3, "hyphen") in got and (1, 4, "misread") in got and (1, 2, "hyphen") not in got


def test_page_values():
    assert [sr.page_value(t) is not None for t in ("12", "[3]", "- 4 -", "Page 5 of 9", "P a g e  7", "Pag� 2", "iv", "3/17", "p. 8")] == [True] * 9
    assert [sr.page_value(t) is not None for t in ("170.07", "2021.", "5,827.33", "7/13/2019", "Total: 5", "Page setup", "12 hedges", "€12", "2019-02-03")] == [False] * 9


def test_short_documents_have_no_running_lines():
    assert sr.edge_noise({1: ["Head", "body text", "1"], 2: ["Head", "other text", "2"]}) == {(1, 2): "page_number", (2, 2): "page_number"}
    assert sr.edge_noise({}) == {}


def test_empty(spark):
    assert sr.noise_found(spark.createDataFrame([], LINE), spark.createDataFrame([], RUN)).count() == 0
    assert sr.paragraphs(spark.createDataFrame([], LINE), spark.createDataFrame([], RUN)).count() == 0


def test_very_long_line(spark):
    lines = spark.createDataFrame([line("long", 1, 1, "word " * 100_000), line("long", 1, 2, "x" * 200_000)], LINE)
    assert sr.noise_found(lines, spark.createDataFrame([], RUN)).count() == 0
