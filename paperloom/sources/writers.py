"""Writers: exports, reports, ledgers, folders by layout."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T


def export_history(df: DataFrame, path: str, order: list, columns: list[str] | None = None) -> None:
    """All rows, sorted, as CSV with a header; cells that read as formulas are guarded. Sorted files keep their order by name."""
    names = columns or df.columns
    guarded = df.orderBy(*order).select(*[F.when(F.col(n).cast("string").rlike(r"^[=+\-@\t\r]") & F.lit(dict(df.dtypes)[n] == "string"), F.concat(F.lit("'"), F.col(n))).otherwise(F.col(n).cast("string")).alias(n) for n in names])
    guarded.write.mode("overwrite").csv(path, header=True, escape='"')


def json_report(figures: DataFrame, keys: list[str]) -> str:
    """A bounded table of aggregates as JSON with sorted keys."""
    rows = [r.asDict(recursive=True) for r in figures.orderBy(*keys).toLocalIterator()]
    return json.dumps(rows, sort_keys=True, ensure_ascii=False, default=str, indent=1)


def markdown_report(title: str, figures: DataFrame, keys: list[str]) -> str:
    """A bounded table of aggregates as a Markdown page; bars and line ends in cells are escaped."""
    def cell(v: object) -> str:
        return "–" if v is None else f"{v:.4g}" if isinstance(v, float) else " ".join(str(v).split()).replace("|", "\\|")

    rows = [[cell(r[c]) for c in figures.columns] for r in figures.orderBy(*keys).toLocalIterator()]
    lines = [f"# {title}", "", "| " + " | ".join(map(cell, figures.columns)) + " |", "| " + " | ".join("---" for _ in figures.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in rows), ""])


def write_versioned(df: DataFrame, path: str, version: int) -> None:
    """Records as JSON lines, each with the version of its schema."""
    df.select(F.lit(version).alias("schema_version"), "*").write.mode("overwrite").json(path)


def upsert_ledger(spark: SparkSession, path: str, new: DataFrame, key: str = "record_key") -> DataFrame:
    """The ledger with new records in place of old ones of their key; the newest of a key wins."""
    fresh = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), "filed_at").alias("r")).select(key, "r.*")
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return fresh
    return spark.read.parquet(path).join(fresh, key, "left_anti").unionByName(fresh)


def write_by_layout(df: DataFrame, path: str, layout: str) -> None:
    """Rows in folders by year, type or both; rows without a date or type go to named folders."""
    year = F.coalesce(F.year("filed_at").cast("string"), F.lit("Undated"))
    kind = F.coalesce(F.when(F.length(T.strip(F.col("document_type"))) > 0, F.col("document_type")), F.lit("Unsorted"))
    folders = {"flat": [], "year": [year.alias("year")], "type": [kind.alias("type")], "year_type": [year.alias("year"), kind.alias("type")]}[layout]
    names = {"flat": [], "year": ["year"], "type": ["type"], "year_type": ["year", "type"]}[layout]
    out = df.select("*", *folders)
    (out.write.mode("overwrite").partitionBy(*names) if names else out.write.mode("overwrite")).parquet(path)
