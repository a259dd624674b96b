import pytest
from pyspark.sql import functions as F

from paperloom.sources import readers, writers


def test_own_exports_are_no_documents(spark, tmp_path):
    for name in ("a.txt", "Paperloom-History-2024.CSV", "history.csv", ".hidden.txt", "b.exe"):
        (tmp_path / name).write_text("x,y")
    assert {r.name for r in readers.files(spark, str(tmp_path)).collect()} == {"a.txt", "history.csv"}


def test_versioned_records_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", None, "x")], "id string, score double, note string")
    path = str(tmp_path / "records")
    writers.write_versioned(df, path, 3)
    assert sorted(map(tuple, readers.read_versioned(spark, path, "id string, score double, note string", 3).collect())) == [("a", 1.5, None), ("b", None, "x")]
    with pytest.raises(ValueError, match="version 4"):
        readers.read_versioned(spark, path, "id string, score double", 4)
    writers.write_versioned(df.union(df), path, 3)
    with pytest.raises(ValueError, match="twice"):
        readers.read_versioned(spark, path, "id string, score double", 3)


def test_markdown_report(spark):
    df = spark.createDataFrame([("b|c", 2, 0.5), ("a\nz", 1, None)], "name string, n int, rate double")
    assert writers.markdown_report("Run", df, ["n"]) == "# Run\n\n| name | n | rate |\n| --- | --- | --- |\n| a z | 1 | – |\n| b\\|c | 2 | 0.5 |\n"
    assert writers.markdown_report("None", df.where(F.lit(False)), ["n"]).count("|") == 8
