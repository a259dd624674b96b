"""Streams drained over whole tables, and functions that need Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import arrow as A
from paperloom.plans.scalars import documents
from paperloom.session import table
from paperloom.streaming import intake


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events from a stream."""
    return intake.drained(intake.event_windows(intake.event_stream(spark, sf_dir)), "event_windows", "complete")


def stream_failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures since the last success per item, from a state per item."""
    found = intake.drained(intake.failure_counts(intake.event_stream(spark, sf_dir)), "failure_counts", "update", ["user_id"])
    return found


def py_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts."""
    return documents(spark, sf_dir).select("doc_id", A.normalize("text").alias("value"))


def py_normalize_loosely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised names of rules."""
    return table(spark, sf_dir, "house_rules").dropDuplicates(["id"]).select("id", A.normalize_loosely("from_value").alias("value"))


def py_split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole sentences of at most 700 characters."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(A.split_sentences(700)("text")).alias("chunk_no", "chunk"))


def py_word_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance over words between the sides of a rule."""
    return table(spark, sf_dir, "house_rules").dropDuplicates(["id"]).select("id", A.levenshtein_words("from_value", "to_value").alias("distance"))


QUERIES = {
    "stream_event_windows": stream_event_windows, "stream_failure_counts": stream_failure_counts, "py_normalize": py_normalize, "py_normalize_loosely": py_normalize_loosely,
    "py_split_sentences": py_split_sentences, "py_word_distance": py_word_distance,
}
ORACLE_SQL = {
    "stream_event_windows": "SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_failure_counts": """WITH s AS (SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), -1) AS last FROM events GROUP BY user_id)
        SELECT user_id, (count(*) FILTER (WHERE event_type = 'error' AND event_id > last))::INT AS failures, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND event_id > last) >= 2 THEN 'failed' ELSE 'queued' END AS status
        FROM events JOIN s USING (user_id) GROUP BY user_id""",
}
