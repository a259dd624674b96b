"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.packed_values import split_values
from paperloom.session import spread, table

from . import corpus_tokens, leakage, name_links, personal_data, scan_repair, splitting, stuffing


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return corpus_tokens.encode_corpus(spread(table(spark, sf_dir, "documents")), "doc_id", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy lines and runs of scanned pages, by kind."""
    return scan_repair.noise_found(table(spark, sf_dir, "layout_line"), table(spark, sf_dir, "text_run")).distinct()


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired paragraphs of every scanned document."""
    return scan_repair.paragraphs(table(spark, sf_dir, "layout_line"), table(spark, sf_dir, "text_run"))


#: Key of the replacements; a deployment passes its own secret.
PII_KEY = b"paperloom-example-key"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All mentions of personal information in the recorded exchanges."""
    found = personal_data.find_mentions(spread(table(spark, sf_dir, "chat_message")), "message_id", "content")
    return found.select("message_id", "pii_kind", "start_pos", "end_pos").distinct()


def p2_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with placeholders, and with surrogates, for its personal information."""
    return personal_data.replaced(table(spark, sf_dir, "chat_message"), "message_id", "content", PII_KEY)


def _party_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = split_values(table(spark, sf_dir, "sample_contract"), "contract_id", "parties", out="name").select("name")
    fixtures = table(spark, sf_dir, "expected_fixture").select(F.explode("parties").alias("name"))
    rules = table(spark, sf_dir, "house_rules").where("kind = 'party'").select(F.explode(F.array("from_value", "to_value")).alias("name"))
    return contracts.unionByName(fixtures).unionByName(rules)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different spellings of one party."""
    return name_links.linked_pairs(_party_spellings(spark, sf_dir))


def _split_items(spark: SparkSession, sf_dir: str, distinct: bool) -> DataFrame:
    chats = table(spark, sf_dir, "chat_message").select("message_id", "content")
    papers = table(spark, sf_dir, "worker_document").select("doc_id", "pages")
    if distinct:
        chats = chats.where(F.length("content") > CHAT_LIMIT).dropDuplicates(["message_id"])
        papers = papers.where("aggregate(pages.text, 0L, (n, t) -> n + coalesce(length(t), 0)) > " + str(PAPER_LIMIT)).dropDuplicates(["doc_id"])
    return splitting.split_oversized(chats, F.col("message_id"), F.array("content"), CHAT_LIMIT).withColumn("item_table", F.lit("chat_message")).unionByName(
        splitting.split_oversized(papers, F.col("doc_id"), splitting.pages_in_order(), PAPER_LIMIT).withColumn("item_table", F.lit("worker_document"))
    )


CHAT_LIMIT, PAPER_LIMIT = 4000, 12000


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that the splitter cuts."""
    return _split_items(spark, sf_dir, distinct=False).where("piece_no = 1").select("item_table", "item_key").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all oversized items."""
    return _split_items(spark, sf_dir, distinct=True).select("item_table", "item_key", "piece_no", "start_pos", "end_pos", "boundary", "piece")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 12 or more consecutive words of an item."""
    return leakage.leaked_items(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_item")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 12 words of an item with at most one word edit."""
    return leakage.leaked_items(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_item"), max_errors=1).select("doc_id", "item_id", "errors")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly stuffed keywords, links or tags."""
    return stuffing.stuffed_documents(spread(table(spark, sf_dir, "documents"))).select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p2_found": p2_found, "p2_replaced": p2_replaced, "p3_found": p3_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_ids": p6_ids, "p7_found": p7_found, "p7_near": p7_near, "p8_found": p8_found}
ORACLE_SQL: dict[str, str] = {
    "p5_found": """
        SELECT DISTINCT 'chat_message' AS item_table, CAST(message_id AS VARCHAR) AS item_key FROM chat_message WHERE length(content) > 4000
        UNION ALL
        SELECT DISTINCT 'worker_document', doc_id FROM worker_document
        WHERE list_sum(list_transform(pages, lambda p: coalesce(length(p.text), 0))) > 12000""",
    "p7_found": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_item),
        dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
        ig AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
