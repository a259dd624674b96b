"""Scores of documents summarised, compared and gated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import ranks


def distributions(df: DataFrame, dimension: str, value: str) -> DataFrame:
    """dimension, n, p50, p90, p95, max, mean of the finite values of a column by one dimension; percentiles are nearest ranks."""
    source = df.select(F.col(dimension).alias("dimension"), F.col(value).cast("double").alias("value"))
    found = ranks.ranked(source, ["dimension"], "value", {"p50": ranks.nearest(0.5), "p90": ranks.nearest(0.9), "p95": ranks.nearest(0.95)})
    return found.select("dimension", "n", "p50", "p90", "p95", F.col("most").alias("max"), F.round("mean", 3).alias("mean"))


def summary(scores: DataFrame) -> DataFrame:
    """metric, n, total: of long scores (metric, value); absent scores count neither way."""
    return scores.where("value IS NOT NULL").groupBy("metric").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def compared(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, verdict of two reports: aligned, fixed, broken, only_before, only_after."""
    a, b = before.select(key, F.col(value).alias("was")), after.select(key, F.col(value).alias("is_now"))
    verdict = (
        F.when(F.col("is_now").isNull(), "only_before").when(F.col("was").isNull(), "only_after")
        .when(~F.col("was") & F.col("is_now"), "fixed").when(F.col("was") & ~F.col("is_now"), "broken").otherwise("aligned")
    )
    return a.join(b, key, "full_outer").select(key, verdict.alias("verdict"))


def longest_increasing(values: list[int]) -> int:
    """Length of the longest increasing run of positions, gaps allowed."""
    from bisect import bisect_left

    tails: list[int] = []
    for v in values:
        at = bisect_left(tails, v)
        tails[at : at + 1] = [v]
    return len(tails)
