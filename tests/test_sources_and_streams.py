import json

from pyspark.sql import functions as F

from paperloom.functions import arrow as A
from paperloom.sources import readers, writers
from paperloom.streaming import intake


def test_text_and_mail(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfcaf\xc3\xa9")
    (tmp_path / "b.md").write_bytes("über".encode("utf-16"))
    (tmp_path / "c.exe").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.eml").write_bytes(b"From: a@x.test\r\nTo: b@x.test\r\nSubject: Hi\r\nContent-Type: text/html\r\n\r\n<title>T</title><p>One<p>Two &amp; three<table><tr><td>1</td><td>2</td></tr></table>")
    found = readers.files(spark, str(tmp_path))
    assert {r.name for r in found.select("name").collect()} == {"a.txt", "b.md", "d.eml"}
    assert {r.name: r.pages[0].text for r in readers.read_text(found).collect()} == {"a.txt": "café", "b.md": "über"}
    mail = readers.read_mail(found).first()
    assert (mail.sender, mail.subject) == ("a@x.test", "Hi") and mail.body.split("\n") == ["T", "", "One", "", "Two & three", "", "1 | 2"] or "1 | 2" in mail.body


def test_delimiters(spark, tmp_path):
    for d in ",;\t|":
        (tmp_path / "t.csv").write_text(f'name{d}n\n"a{d}b"{d}1\nc{d}2\n')
        got = readers.read_delimited(spark, str(tmp_path / "t.csv")).collect()
        assert [(r["name"], r["n"]) for r in got] == [(f"a{d}b", "1"), ("c", "2")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": 1, "text": "x"}\nnot json\n')
    got = readers.read_json_lines(spark, str(tmp_path / "r.jsonl"), "id int, text string").collect()
    assert [(r.id, r.broken) for r in got] == [(1, None), (None, "not json")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "=1+1"), (1, "plain"), (3, None)], "id int, cell string")
    writers.export_history(df, str(tmp_path / "h"), [F.desc("id")])
    back = spark.read.csv(str(tmp_path / "h"), header=True).collect()
    assert {(r.id, r.cell) for r in back} == {("3", None), ("2", "'=1+1"), ("1", "plain")}
    assert json.loads(writers.json_report(df.groupBy("id").count(), ["id"]))[0] == {"id": 1, "count": 1}
    ledger = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "record_key string, filed_at int, name string")
    first = writers.upsert_ledger(spark, str(tmp_path / "l"), ledger)
    first.write.parquet(str(tmp_path / "l"))
    second = writers.upsert_ledger(spark, str(tmp_path / "l"), spark.createDataFrame([("b", 9, "new")], "record_key string, filed_at int, name string"))
    assert {tuple(r) for r in second.collect()} == {("a", 2, "y"), ("b", 9, "new")}
    filed = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-02-03 00:00:00' AS filed_at, 'Letter' AS document_type UNION ALL SELECT 2, NULL, NULL")
    writers.write_by_layout(filed, str(tmp_path / "f"), "year_type")
    assert {p.name for p in (tmp_path / "f").iterdir() if p.is_dir()} == {"year=2024", "year=Undated"}


def test_files_at_rest(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("a", 1, 5.0, 0.0), ("a", 1, 5.0, 4.0), ("a", 1, 5.0, 11.0), ("a", 1, 5.0, 30.0), ("b", 1, 5.0, 0.0), ("b", 2, 5.0, 9.0), ("b", 2, 5.0, 12.0), ("c", 1, 1.0, 5.0), ("c", 1, 1.0, 1.0), ("c", 1, 1.0, 10.0)]
    schema = "path string, size bigint, modified double, at double"
    spark.createDataFrame(rows[:6], schema).coalesce(1).write.parquet(str(src))
    spark.createDataFrame(rows[6:], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).parquet(str(src))
    got = {tuple(r) for r in intake.drained(intake.files_at_rest(stream), "rest", "append").collect()}
    assert got == {("a", 1, 5.0, 11.0)}


def test_python_functions():
    assert A.normalize_text("“Café­”  — ＡＢ") == '"café" - ab'
    assert A.normalize_name("Fox & Co., Ltd.") == "fox and co ltd"
    text = "One two. Three $1,248.00 four! Five six seven. " * 20
    chunks = A.sentence_chunks(text, 100)
    assert "".join(chunks) == text and all(len(c) <= 200 for c in chunks)
    assert A.word_distance("a b c", "a x c d") == 2
    assert [A.log2_in_1024ths(n, 1) for n in (1, 2, 3, 8)] == [0, 1024, 1623, 3072]
