"""Documents as lines, blocks, sections, rows and units, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T


def lines_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, line_no (from 0), line, kind."""
    out = df.where(F.col(text_col).isNotNull()).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    # the stripped line is a column of its own, so that the tests of its kind share it
    return out.withColumn("bare", T.strip(F.col("line"))).withColumn("kind", T.line_kind(F.col("bare"), stripped=True)).drop("bare")


def islands(df: DataFrame, keys: list[str], order: str, change: Column, out: str) -> DataFrame:
    """Numbers the runs of rows between changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.sum(F.when(change, 1).otherwise(0)).over(w).cast("int"))


def blocks_of(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, block_no, kind, first_line, n_lines, text: runs of like lines; a blank line or a heading ends a block."""
    w = Window.partitionBy(id_col).orderBy("line_no")
    kind = F.when(F.col("kind").isin("table_row", "table_separator"), "table").otherwise(F.col("kind"))
    marked = lines.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    change = F.col("before").isNull() | (F.col("kind") != F.col("before")) | F.col("kind").isin("heading", "markdown_heading")
    numbered = islands(marked, [id_col], "line_no", change, "run").where("kind <> 'blank'")
    grouped = numbered.groupBy(id_col, "run").agg(
        F.first("kind").alias("kind"), F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("own")
    )
    order = Window.partitionBy(id_col).orderBy("run")
    return grouped.select(
        id_col, F.row_number().over(order).alias("block_no"), "kind", "first_line", "n_lines", F.array_join(F.transform("own", lambda x: x["line"]), "\n").alias("text")
    )


def with_heading(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks with the text of the last heading above them."""
    w = Window.partitionBy(id_col).orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when(F.col("kind").isin("heading", "markdown_heading"), F.col("text"))
    return blocks.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def table_rows(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, line_no, header, cells: rows of tables with the header row that stands over them."""
    w = Window.partitionBy(id_col).orderBy("line_no")
    near = lines.withColumns({"next": F.lead("kind").over(w), "is_header": (F.col("kind") == "table_row") & (F.lead("kind").over(w) == "table_separator")})
    in_table = near.where(F.col("kind").isin("table_row", "table_separator"))
    header = F.last(F.when(F.col("is_header"), F.col("line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = in_table.withColumn("header", header).where((F.col("kind") == "table_row") & ~F.col("is_header"))
    return rows.select(id_col, "line_no", F.array_join(T.table_cells(F.col("header")), "|").alias("header"), F.array_join(T.table_cells(F.col("line")), "|").alias("cells"))


def running_shapes(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, shape, pages, n_pages: digit-masked lines of at most 120 characters on at least max(3, half) of a document's pages."""
    lines = pages.select(id_col, "page", F.explode(F.split("text", "\n")).alias("line")).where((F.length(T.strip(F.col("line"))) > 0) & (F.length("line") <= 120))
    counts = pages.groupBy(id_col).agg(F.countDistinct("page").alias("n_pages"))
    shapes = lines.groupBy(id_col, T.digit_masked(T.strip(F.col("line"))).alias("shape")).agg(F.countDistinct("page").alias("pages"))
    return shapes.join(counts, id_col).where("n_pages >= 3 AND pages >= greatest(3, n_pages / 2)").select(id_col, "shape", "pages", "n_pages")


def outline(blocks: DataFrame, most: int = 40, characters: int = 1500, id_col: str = "doc_id") -> DataFrame:
    """id, outline: headings joined by bars, cut at whole headings with an ellipsis."""
    heads = blocks.where(F.col("kind").isin("heading", "markdown_heading")).select(id_col, "block_no", F.regexp_replace("text", r"^[# ]+|[: ]+$", "").alias("h"))
    w = Window.partitionBy(id_col).orderBy("block_no")
    sized = heads.withColumns({"n": F.row_number().over(w), "size": F.sum(F.length("h") + 3).over(w) - 3})
    kept = sized.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when((F.col("n") <= most) & (F.col("size") <= characters), F.struct("n", "h")))).alias("kept"), F.count("*").alias("all")
    )
    cut = F.size("kept") < F.col("all")
    return kept.select(id_col, F.concat(F.array_join(F.transform("kept", lambda x: x["h"]), " | "), F.when(cut, F.lit(" | …")).otherwise("")).alias("outline"))
