"""An index of a document's evidence: headings and what falls under them, units, weighted terms, integer BM25.

All steps group by document, so rows are shuffled once by document and every
later window and aggregation stays in place. The index is a table of units and
one of terms: write both, and retrieval reads them without the texts.

Defined results: documents without text have no units; blank lines belong to no
unit; a block before any heading has no parent and an empty path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: The level of a heading that shows none: the innermost.
UNKNOWN = 7
HEADINGS = ("heading", "markdown_heading")


def heading_level(kind: Column, text: Column) -> Column:
    """1 to 6 by the marks of a heading, ``UNKNOWN`` for a heading without, null for other blocks."""
    return F.when(kind == "markdown_heading", F.length(F.regexp_extract(text, r"^\s*(#+)", 1))).when(kind == "heading", UNKNOWN)


def linked(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks with ``level``, ``parent`` (block_no of the heading they fall under) and ``path`` (the texts of all headings above, outermost first).

    A heading falls under the nearest one before it with a lower level; other blocks
    under the nearest of any level. The last heading of each level says which: it is
    open if none of a lower level came later.
    """
    before = Window.partitionBy(id_col).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    level = heading_level(F.col("kind"), F.col("text"))
    bare = F.regexp_replace("text", r"^[#\s]+|[:\s]+$", "")
    leveled = blocks.withColumns({"level": level, "own": F.when(level.isNotNull(), F.struct("block_no", bare.alias("text")))})
    lasts = {f"last_{n}": F.last(F.when(F.col("level") == n, F.col("own")), ignorenulls=True).over(before) for n in range(1, UNKNOWN + 1)}
    seen = leveled.withColumns(lasts)
    above = [F.when(F.col("level").isNull() | (F.col("level") > n), F.col(f"last_{n}")) for n in range(1, UNKNOWN + 1)]
    opened = [
        F.when(F.coalesce(a["block_no"], F.lit(0)) > F.greatest(F.lit(0), F.lit(0), *[F.coalesce(b["block_no"], F.lit(0)) for b in above[:n]]), a) for n, a in enumerate(above)
    ]
    chain = F.filter(F.array(*opened), lambda x: x.isNotNull())
    return seen.withColumn("chain", chain).select(
        *blocks.columns, "level", F.array_max(F.transform("chain", lambda x: x["block_no"])).alias("parent"), F.transform("chain", lambda x: x["text"]).alias("path")
    )


def units(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, unit_id, kind, text, heading, header: headings and paragraphs whole, list items, fields and rows of tables one by one."""
    placed = linked(blocks, id_col)
    rows = F.split("text", "\n")
    headed = F.coalesce(T.is_table_separator(F.get(rows, F.lit(1))), F.lit(False))
    single = F.col("kind").isin("list_item", "key_value", "table")
    parts = placed.select(
        id_col, "block_no", "kind", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit("")).alias("heading"),
        F.when((F.col("kind") == "table") & headed, F.get(rows, F.lit(0))).otherwise("").alias("header"),
        F.posexplode(F.when(single, rows).otherwise(F.array(F.regexp_replace("text", "\n", " ")))).alias("k", "part"), ((F.col("kind") == "table") & headed).alias("headed"),
    )
    kept = parts.where((F.col("kind") != "table") | (~T.is_table_separator(F.col("part")) & ~(F.col("headed") & (F.col("k") == 0))))
    mark = F.when(F.col("kind") == "table", ".r").when(F.col("kind") == "key_value", ".f").when(F.col("kind") == "list_item", ".i")
    unit = F.concat(F.lit("b"), F.col("block_no").cast("string"), F.when(mark.isNotNull(), F.concat(mark, F.col("k").cast("string"))).otherwise(""))
    return kept.select(id_col, unit.alias("unit_id"), "kind", F.col("part").alias("text"), "heading", "header")


def weighted_terms(unit_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, unit_id, term, weight: a unit's own words count twice, those of its heading and of its table's header once."""
    def weighed(c: str, n: int) -> Column:
        return F.transform(T.terms_of(F.col(c)), lambda t: F.struct(t.alias("term"), F.lit(n).alias("w")))

    each = unit_rows.select(id_col, "unit_id", F.explode(F.concat(weighed("text", 2), weighed("heading", 1), weighed("header", 1))).alias("t"))
    return each.groupBy(id_col, "unit_id", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("weight"))


def log2_fixed(n: Column, d: Column) -> Column:
    """1024 times the logarithm to base 2 of a ratio, rounded down, from integers alone; 0 for ratios up to 1."""
    whole = F.length(F.bin(F.expr("1") * F.floor(n / d).cast("bigint"))) - 1
    start = F.struct(F.floor(F.shiftleft(n.cast("bigint"), 30) / (d * F.pow(F.lit(2), whole))).cast("bigint").alias("ratio"), (whole * 1024).cast("bigint").alias("out"))

    def step(at: Column, bit: Column) -> Column:
        squared = F.shiftright(at["ratio"] * at["ratio"], 30)
        over = squared >= F.lit(2 << 30)
        return F.struct(F.when(over, F.shiftright(squared, 1)).otherwise(squared).alias("ratio"), F.when(over, at["out"] + bit).otherwise(at["out"]).alias("out"))

    return F.when((d <= 0) | (n <= d), F.lit(0).cast("bigint")).otherwise(F.aggregate(F.array(*[F.lit(1 << b).cast("bigint") for b in range(9, -1, -1)]), start, step)["out"])


def bm25_units(terms: DataFrame, lexicon: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """field, id, unit_id, score from 0 to 100: BM25 within each document for each field's words (field, term), scaled to its best unit.

    Integers throughout (k1 1.2, b 0.75), so results are equal on every machine.
    """
    by_unit, by_doc = Window.partitionBy(id_col, "unit_id"), Window.partitionBy(id_col)
    measured = terms.withColumns({"length": F.sum("weight").over(by_unit), "first": F.when(F.row_number().over(by_unit.orderBy("term")) == 1, 1).otherwise(0)}).withColumns({
        "total": F.sum("weight").over(by_doc), "units": F.sum("first").over(by_doc), "df": F.count("*").over(Window.partitionBy(id_col, "term")),
    })
    found = measured.join(F.broadcast(lexicon.select("field", "term").distinct()), "term")  # a lexicon is a short list of words
    f, total = F.col("weight"), F.col("total")
    saturation = F.floor((f * 11000 * total) / F.greatest(F.lit(1), f * 5 * total + total * 3 + F.col("length") * 9 * F.col("units"))).cast("bigint")
    idf = log2_fixed(F.col("units") * 2 + 2, F.col("df") * 2 + 1)
    scored = found.groupBy("field", id_col, "unit_id").agg(F.sum(idf * saturation).alias("raw")).where("raw > 0")
    best = F.max("raw").over(Window.partitionBy("field", id_col))
    return scored.select("field", id_col, "unit_id", F.expr("raw * 100").alias("raw100"), best.alias("best")).select("field", id_col, "unit_id", F.expr("raw100 div best").alias("score"))
