"""Term statistics and BM25 over units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T


def unit_terms(units: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, term, n: how often each term stands in a unit."""
    return units.select(*keys, F.explode(T.terms_of(F.col(text_col))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def document_frequency(terms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, term, units: in how many units of its document a term stands."""
    return terms.groupBy(doc, "term").agg(F.count("*").alias("units"))


def bm25(terms: DataFrame, queries: DataFrame, unit: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, unit, score of all units that share a term with a query (query_id, term).

    Only the queries' terms are looked up, so postings of other terms are never shuffled.
    """
    lengths = terms.groupBy(unit).agg(F.sum("n").alias("length"))
    total = lengths.agg(F.count("*").alias("n_units"), F.avg("length").alias("mean_length"))
    wanted = queries.select("term").distinct()
    postings = terms.join(wanted, "term", "left_semi")
    df = postings.groupBy("term").agg(F.countDistinct(unit).alias("df"))
    idf = F.ln(1 + (F.col("n_units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = postings.join(df, "term").join(lengths, unit).crossJoin(F.broadcast(total)).select("term", unit, weight.alias("w"))  # one row of totals
    return scored.join(queries, "term").groupBy("query_id", unit).agg(F.sum("w").alias("score"))
