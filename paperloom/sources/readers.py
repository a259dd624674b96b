"""Readers of files into documents: text, delimited tables, mail, recorded JSON lines."""

from __future__ import annotations

import csv
import io
from email import policy
from email.parser import BytesParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paperloom.functions import text as T
from paperloom.functions.arrow import html_text

DELIMITERS = ",;\t|"
SNIFF_BYTES, SNIFF_RECORDS = 65536, 50


def decode_text(raw: bytes) -> str:
    """Text of bytes by their mark, else UTF-8, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def sniff_delimiter(raw: bytes) -> str:
    """The delimiter that cuts the first records into the most even number of fields."""
    lines = decode_text(raw[:SNIFF_BYTES]).splitlines()[:SNIFF_RECORDS]

    def evenness(d: str) -> tuple[float, int]:
        sizes = [len(r) for r in csv.reader(lines, delimiter=d) if r]
        most = max(set(sizes), key=sizes.count) if sizes else 1
        return (sizes.count(most) / len(sizes) if most > 1 else 0.0, most)

    return max(DELIMITERS, key=evenness)


#: How the names of our own exports begin; they are never read back as documents.
OWN_EXPORTS = "paperloom-history"


def is_own_export(name: Column, stem: str = OWN_EXPORTS) -> Column:
    """Is a file an export of ours, whatever the case of its name?"""
    return F.lower(name).startswith(stem) & F.lower(name).endswith(".csv")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Supported files below a folder but for our own exports: path, name, length, modified, content."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    supported = [e for group in T.READERS.values() for e in group]
    return listed.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"), "content").where(
        T.extension(F.col("name")).isin(supported) & ~F.col("name").startswith(".") & ~is_own_export(F.col("name"))
    )


def read_text(found: DataFrame) -> DataFrame:
    """One page of text per text file."""
    @F.pandas_udf(StringType())
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(decode_text)

    return found.where(T.reader(F.col("name")) == "text").select("path", "name", F.array(F.struct(F.lit(1).alias("page_number"), decoded("content").alias("text"), F.lit("plain_text").alias("origin"))).alias("pages"))


def read_delimited(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A delimited file of any size; only its beginning is read to find the delimiter."""
    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, SNIFF_BYTES).alias("c")).first()
    raw = bytes(first.c) if first else b""
    encoding = "UTF-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "UTF-8"
    return spark.read.csv(path, sep=sniff_delimiter(raw), header=header, encoding=encoding, mode="PERMISSIVE", multiLine=True, escape='"')


MAIL = StructType([StructField(n, StringType()) for n in ("sender", "recipients", "copies", "date", "subject", "body", "attachments")])


def parse_mail(raw: bytes) -> dict:
    """Headers, body (plain, else the text of its HTML) and names of attachments."""
    m = BytesParser(policy=policy.default).parsebytes(raw)
    body = m.get_body(("plain", "html"))
    text = body.get_content() if body else ""
    if body and body.get_content_type() == "text/html":
        text = html_text(text)
    names = ", ".join(a.get_filename() or "unnamed" for a in m.iter_attachments())
    return {"sender": m["from"], "recipients": m["to"], "copies": m["cc"], "date": m["date"], "subject": m["subject"], "body": text.strip(), "attachments": names}


def read_mail(found: DataFrame) -> DataFrame:
    """path, name and the parts of each mail file."""
    @F.pandas_udf(MAIL)
    def parsed(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{k: None if v is None else str(v) for k, v in parse_mail(b).items()} for b in raw], columns=MAIL.names)

    return found.where(T.reader(F.col("name")) == "eml").select("path", "name", parsed("content").alias("m")).select("path", "name", "m.*")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; lines that aren't JSON come with their text in ``broken``."""
    return spark.read.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE").json(path)


def tsv_of(block: list[list[str]]) -> str:
    """A copied block as tab-separated text with guarded cells."""
    out = io.StringIO()
    guarded = [["'" + c if c[:1] in "=+-@\t\r" and c else c for c in row] for row in block]
    csv.writer(out, delimiter="\t", lineterminator="\r\n").writerows(guarded)
    return out.getvalue()


def read_versioned(spark: SparkSession, path: str, schema: str, version: int, key: str = "id") -> DataFrame:
    """Records of a JSON-lines file that all carry ``schema_version`` and their own ``key``; anything else in it is an error."""
    rows = read_json_lines(spark, path, f"schema_version int, {schema}")
    bad = rows.select(F.count(F.when(F.col("broken").isNotNull() | F.col(key).isNull() | ~F.col("schema_version").eqNullSafe(version), 1)).alias("bad")).first().bad
    if bad:
        raise ValueError(f"{bad} records of {path} aren't of version {version} with a {key}")
    twice = rows.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} stands twice in {path}")
    return rows.drop("schema_version", "broken")
