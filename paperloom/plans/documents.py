"""Segmentation, ranking and duplicates over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import ranking, segmentation as S, simhash
from paperloom.plans.scalars import _HEADING, _KIND, _LINES, TERMS_SQL, documents
from paperloom.session import spread, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines_of(documents(spark, sf_dir))


def blocks_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of like lines as blocks."""
    return S.blocks_of(_lines(spark, sf_dir))


def blocks_with_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the heading they fall under."""
    return S.with_heading(S.blocks_of(_lines(spark, sf_dir))).select("doc_id", "block_no", "kind", "section")


def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last block of each section of a document."""
    b = S.islands(S.blocks_of(_lines(spark, sf_dir)), ["doc_id"], "block_no", F.col("kind").isin("heading", "markdown_heading"), "section_no")
    return b.groupBy("doc_id", "section_no").agg(F.min("block_no").alias("first_block"), F.max("block_no").alias("last_block"))


def opening_and_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four and last three blocks of each document."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id")
    b = S.blocks_of(_lines(spark, sf_dir)).withColumn("n", F.count("*").over(w))
    return b.select("doc_id", "block_no", (F.col("block_no") <= 4).alias("opening"), (F.col("block_no") > F.col("n") - 3).alias("closing"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables with their header."""
    return S.table_rows(_lines(spark, sf_dir))


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of each document in one line."""
    return S.outline(S.blocks_of(_lines(spark, sf_dir)))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "worker_document").dropDuplicates(["doc_id"])
    return papers.select("doc_id", F.explode("pages").alias("p")).where("p.text IS NOT NULL").select("doc_id", F.col("p.page_number").alias("page"), F.col("p.text").alias("text"))


def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of lines that return on most pages of a document."""
    return S.running_shapes(_pages(spark, sf_dir))


def linearized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a document in order as one text."""
    return _pages(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each document and how often they stand there."""
    return ranking.unit_terms(documents(spark, sf_dir), ["doc_id"])


def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents of a source a term stands."""
    terms = ranking.unit_terms(documents(spark, sf_dir), ["source", "doc_id"])
    return terms.groupBy("source", "term").agg(F.count("*").alias("units"))


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of all documents for the document types as queries."""
    terms = ranking.unit_terms(documents(spark, sf_dir), ["doc_id"])
    types = table(spark, sf_dir, "expected_fixture").where("document_type IS NOT NULL").select("document_type").distinct()
    from paperloom.functions import text as T

    asked = types.select(F.col("document_type").alias("query_id"), F.explode(F.array_distinct(T.terms_of(F.col("document_type")))).alias("term"))
    return ranking.bm25(terms, asked, "doc_id").select("query_id", "doc_id", F.round("score", 4).alias("score"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy of a text with the first document that has it."""
    hashed = documents(spark, sf_dir).where("text <> ''").select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return hashed.join(first, "h").where("doc_id <> first_id").select("doc_id", "first_id", "copies")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document's text as 16 hexadecimal digits."""
    f = simhash.fingerprints(spread(table(spark, sf_dir, "documents")), "doc_id", "text")
    return f.select("doc_id", F.when(F.col("fingerprint").isNotNull(), F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))).alias("fingerprint"))


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal fingerprints of each document, and how many other classes are within six bits."""
    prints = simhash.fingerprints(spread(table(spark, sf_dir, "documents")), "doc_id", "text").where("fingerprint IS NOT NULL")
    return simhash.near_members(prints, "doc_id", simhash.near_classes(prints, "doc_id"))


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different fingerprints within six bits."""
    return simhash.near_classes(simhash.fingerprints(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), "doc_id")


_K2 = f"CASE WHEN {_KIND} IN ('table_row', 'table_separator') THEN 'table' ELSE {_KIND} END"
_BLOCKS = f"""
    l AS (SELECT doc_id, line_no, line, {_K2} AS kind FROM {_LINES}),
    m AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l),
    r AS (SELECT *, sum(CASE WHEN before IS NULL OR kind <> before OR kind IN ('heading', 'markdown_heading') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM m),
    g AS (SELECT doc_id, run, any_value(kind) AS kind, min(line_no)::INT AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text FROM r WHERE kind <> 'blank' GROUP BY doc_id, run),
    b AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run))::INT AS block_no, kind, first_line, n_lines, text FROM g)"""
_IS_HEAD = "kind IN ('heading', 'markdown_heading')"
_CELLS = "array_to_string(list_transform(string_split(regexp_replace(replace(trim({0}), '\\|', chr(1)), '^\\||\\|$', '', 'g'), '|'), lambda x: replace(regexp_replace(x, '^[ \\t\\r\\n\\x0B\\f]+|[ \\t\\r\\n\\x0B\\f]+$', '', 'g'), chr(1), '|')), '|')"
_CELLS = _CELLS.replace("trim({0})", "regexp_replace({0}, '^[ \\t\\r\\n\\x0B\\f]+|[ \\t\\r\\n\\x0B\\f]+$', '', 'g')")
_PAGES = "(SELECT doc_id, p.page_number AS page, p.text AS text FROM (SELECT doc_id, unnest(pages) AS p FROM (SELECT DISTINCT ON (doc_id) doc_id, pages FROM worker_document)) WHERE p.text IS NOT NULL)"
_STRIPPED = "regexp_replace(line, '^[ \\t\\r\\n\\x0B\\f]+|[ \\t\\r\\n\\x0B\\f]+$', '', 'g')"
_TERMS = f"SELECT doc_id, source, unnest({TERMS_SQL.format('text')}) AS term FROM documents WHERE text IS NOT NULL"

QUERIES = {
    "blocks_of_documents": blocks_of_documents, "blocks_with_heading": blocks_with_heading, "section_spans": section_spans, "opening_and_closing": opening_and_closing, "table_rows": table_rows,
    "outlines": outlines, "running_lines": running_lines, "linearized_pages": linearized_pages, "term_weights": term_weights, "document_frequencies": document_frequencies, "bm25_scores": bm25_scores,
    "exact_duplicates": exact_duplicates, "fingerprints": fingerprints, "near_duplicate_classes": near_duplicate_classes, "near_duplicate_pairs": near_duplicate_pairs,
}
ORACLE_SQL = {
    "blocks_of_documents": f"WITH {_BLOCKS} SELECT * FROM b",
    "blocks_with_heading": f"WITH {_BLOCKS} SELECT doc_id, block_no, kind, last_value(CASE WHEN {_IS_HEAD} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM b",
    "section_spans": f"WITH {_BLOCKS}, s AS (SELECT doc_id, block_no, (sum(CASE WHEN {_IS_HEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no))::INT AS section_no FROM b) SELECT doc_id, section_no, min(block_no) AS first_block, max(block_no) AS last_block FROM s GROUP BY ALL",
    "opening_and_closing": f"WITH {_BLOCKS} SELECT doc_id, block_no, block_no <= 4 AS opening, block_no > count(*) OVER (PARTITION BY doc_id) - 3 AS closing FROM b",
    "table_rows": f"""WITH l AS (SELECT doc_id, line_no, line, {_KIND} AS kind FROM {_LINES}),
        n AS (SELECT *, kind = 'table_row' AND coalesce(lead(kind) OVER (PARTITION BY doc_id ORDER BY line_no), '') = 'table_separator' AS is_header FROM l),
        t AS (SELECT *, last_value(CASE WHEN is_header THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM n WHERE kind IN ('table_row', 'table_separator'))
        SELECT doc_id, line_no, {_CELLS.format('h')} AS header, {_CELLS.format('line')} AS cells FROM t WHERE kind = 'table_row' AND NOT is_header""",
    "outlines": f"""WITH {_BLOCKS}, h AS (SELECT doc_id, block_no, regexp_replace(text, '^[# ]+|[: ]+$', '', 'g') AS h FROM b WHERE {_IS_HEAD}),
        s AS (SELECT doc_id, h, row_number() OVER w AS n, sum(length(h) + 3) OVER w - 3 AS size FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))
        SELECT doc_id, coalesce(string_agg(h, ' | ' ORDER BY n) FILTER (WHERE n <= 40 AND size <= 1500), '') || CASE WHEN count(*) > count(*) FILTER (WHERE n <= 40 AND size <= 1500) THEN ' | …' ELSE '' END AS outline FROM s GROUP BY doc_id""",
    "running_lines": f"""WITH p AS {_PAGES}, l AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line FROM p),
        c AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM p GROUP BY doc_id),
        s AS (SELECT doc_id, lower(regexp_replace({_STRIPPED}, '[0-9]+', '#', 'g')) AS shape, count(DISTINCT page) AS pages FROM l WHERE {_STRIPPED} <> '' AND length(line) <= 120 GROUP BY ALL)
        SELECT doc_id, shape, pages, n_pages FROM s JOIN c USING (doc_id) WHERE n_pages >= 3 AND pages >= greatest(3, n_pages / 2)""",
    "linearized_pages": f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page, text) AS text FROM {_PAGES} GROUP BY doc_id",
    "term_weights": f"SELECT doc_id, term, count(*) AS n FROM ({_TERMS}) GROUP BY ALL",
    "document_frequencies": f"SELECT source, term, count(DISTINCT doc_id) AS units FROM ({_TERMS}) GROUP BY ALL",
    "bm25_scores": f"""WITH t AS (SELECT doc_id, term, count(*) AS n FROM ({_TERMS}) GROUP BY ALL), len AS (SELECT doc_id, sum(n) AS length FROM t GROUP BY doc_id),
        a AS (SELECT count(*) AS n_units, avg(length) AS mean_length FROM len), q AS (SELECT document_type AS query_id, unnest(list_distinct({TERMS_SQL.format('document_type')})) AS term FROM (SELECT DISTINCT document_type FROM expected_fixture WHERE document_type IS NOT NULL)),
        d AS (SELECT term, count(*) AS df FROM t GROUP BY term)
        SELECT query_id, doc_id, round(sum(ln(1 + (n_units - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * length / mean_length))), 4) AS score
        FROM t JOIN d USING (term) JOIN len USING (doc_id) JOIN q USING (term), a GROUP BY ALL""",
    "exact_duplicates": "WITH f AS (SELECT text, min(doc_id) AS first_id, count(*) AS copies FROM documents WHERE text <> '' GROUP BY text HAVING count(*) > 1) SELECT doc_id, first_id, copies FROM documents JOIN f USING (text) WHERE doc_id <> first_id",
}
