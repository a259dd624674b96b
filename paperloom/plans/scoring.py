"""Answers, runs and filed items compared over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import scoring as C, simhash
from paperloom.plans.scalars import _LINES, lines
from paperloom.session import spread, table

_FIX = "(SELECT DISTINCT fixture_id, document_type, acceptable_types, parties, forbidden_parties FROM expected_fixture)"
_CON = "(SELECT contract_id, min(sha256) AS sha256, min(source_path) AS source_path, min(document_name) AS document_name FROM sample_contract GROUP BY contract_id)"


def _fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "expected_fixture").select("fixture_id", "document_type", "acceptable_types", "parties", "forbidden_parties").distinct()


def _contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_contract").groupBy("contract_id").agg(*[F.min(c).alias(c) for c in ("sha256", "source_path", "document_name")])


def score_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each acceptable type carry the words of the reviewed one?"""
    each = _fixtures(spark, sf_dir).where("document_type IS NOT NULL").select("fixture_id", "document_type", F.explode("acceptable_types").alias("actual")).distinct()
    return each.select("fixture_id", "actual", C.type_matches(F.col("document_type"), F.col("actual")).alias("fits"))


def score_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the reviewed parties against the forbidden ones and the first of their own."""
    none = F.array().cast("array<string>")
    produced = F.concat(F.coalesce("forbidden_parties", none), F.coalesce(F.slice("parties", 1, 1), none))
    return C.judged_parties(_fixtures(spark, sf_dir).withColumn("produced", produced), "fixture_id", "parties", "produced")


def score_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as their readings are compared."""
    return lines(spark, sf_dir).select("doc_id", "line_no", C.comparable(F.col("line")).alias("value"))


#: Tolerances of figures of pages, and whether less is better.
TOLERANCES = [("garbage", 20.0, True), ("replacement", 5.0, True), ("chars", 100.0, False)]


def score_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Did figures of a document's pages get better or worse from its first page to its last?"""
    pages = table(spark, sf_dir, "page_signal").select("doc_id", "page", F.expr("stack(3, 'garbage', garbage, 'replacement', replacement, 'chars', chars) AS (metric, v)"))
    ends = pages.groupBy("doc_id", "metric").agg(F.min(F.struct("page", "v"))["v"].cast("double").alias("was"), F.max(F.struct("page", "v"))["v"].cast("double").alias("now_is"))
    return C.moved(ends, spark.createDataFrame(TOLERANCES, "metric string, tolerance double, lower_is_better boolean"))


def score_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents whose first two pages hold over six tenths of their characters."""
    papers = table(spark, sf_dir, "worker_document").groupBy("doc_id").agg(F.max(F.struct(F.size("pages").alias("n"), F.transform("pages", lambda p: F.coalesce(F.length(p["text"]), F.lit(0))).alias("sizes")))["sizes"].alias("sizes"))
    total, first = (F.aggregate(x, F.lit(0), lambda a, b: a + b) for x in (F.col("sizes"), F.slice("sizes", 1, 2)))
    return papers.select("doc_id", C.short_of_reduction(F.size("sizes"), total, first).alias("short"))


def score_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of recorded replies that lead to a block of their document."""
    replies = table(spark, sf_dir, "chat_message").where("turn_role = 'assistant' AND content IS NOT NULL").select("message_id", "doc_id", "content").distinct()
    cited = replies.select("message_id", "doc_id", F.explode(F.regexp_extract_all("content", F.lit(r'"(p[0-9]+\.b[0-9]+)"'), 1)).alias("block_id"))
    return C.citation_scores(cited, table(spark, sf_dir, "layout_line"), "message_id", ["doc_id", "block_id"])


def newest_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event, newest purchase and newest other event of each user."""
    done = F.col("event_type") == "purchase"
    return C.newest_of_kinds(table(spark, sf_dir, "events"), "user_id", "event_id", {"newest": F.lit(True), "complete": done, "unsettled": ~done})


def first_spelled_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parties of fixtures, one spelling of each."""
    return _fixtures(spark, sf_dir).where("parties IS NOT NULL").select("fixture_id", F.array_join(C.first_spellings(F.col("parties"), T.name_key), "; ").alias("parties"))


def staged_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts whose file an earlier one has."""
    return C.staged_copies(_contracts(spark, sf_dir).where("sha256 IS NOT NULL"), "contract_id", "sha256", "document_name")


def ranked_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machines by pages that failed, pages in doubt and mean confidence."""
    pages = table(spark, sf_dir, "page_signal").where("machine_id IS NOT NULL").select("machine_id", "doc_id", "page", "garbage", "replacement").distinct()
    sums = pages.groupBy("machine_id").agg(F.count(F.when(F.col("garbage") >= 40, 1)).alias("bad"), F.sum("replacement").alias("lost"), F.count("*").alias("n"))
    return C.ranked_configs(sums, ["machine_id", "bad", "lost", "n"], [F.col("bad"), F.col("lost"), F.desc("n"), F.col("machine_id")])


def path_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a contract's path lie in its own first folder, and in the folder of finance?"""
    p = _contracts(spark, sf_dir)
    return p.select("contract_id", C.paths_overlap(F.col("source_path"), F.upper(F.substring_index("source_path", "/", 1))).alias("own"), C.paths_overlap(F.col("source_path"), F.lit("finance/")).alias("other"))


def searched_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts that hold ``lease`` in their name or path."""
    return C.searched(_contracts(spark, sf_dir), ["document_name", "source_path"], " Lease ").select("contract_id")


def merge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many recorded messages a second turn replaced and how many stayed."""
    m = table(spark, sf_dir, "chat_message").select("message_id", "turn").distinct()
    return m.agg(F.count(F.when(F.col("turn") == 2, 1)).alias("replaced"), F.count(F.when(F.coalesce(F.col("turn") != 2, F.lit(True)), 1)).alias("kept"))


def set_without_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages but those of truncated documents."""
    messages = table(spark, sf_dir, "chat_message").select("message_id", "doc_id").distinct()
    return C.without(messages, table(spark, sf_dir, "worker_document").where("truncated"), "doc_id").select("message_id", "doc_id")


def set_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose type no fixture has."""
    rules = table(spark, sf_dir, "house_rules").where("kind = 'type' AND to_value IS NOT NULL").select("id", F.col("to_value").alias("document_type")).distinct()
    return C.orphans(rules, table(spark, sf_dir, "expected_fixture").where("document_type IS NOT NULL"), "document_type").select("id", "document_type")


def filed_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract that was first filed with the content of each contract."""
    own = _contracts(spark, sf_dir)
    return C.filed_by_hash(own, own.select("sha256", F.col("contract_id").alias("marker")), "contract_id", "sha256")


def nearest_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document from the web, the nearest one of the others."""
    papers = spread(table(spark, sf_dir, "documents")).select("doc_id", "source", "text")
    prints = [simhash.fingerprints(papers.where(f"coalesce(source, '') {op} 'web-capture'"), "doc_id", "text") for op in ("=", "<>")]
    return C.nearest_filed(prints[0], prints[1].withColumnRenamed("doc_id", "marker"), "doc_id")


def flattened_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of pages, one row each."""
    figures = "chars segments image_coverage replacement invisible garbage column_count overlap".split()
    return C.flattened(table(spark, sf_dir, "page_signal").select("doc_id", "page", *figures).distinct(), ["doc_id", "page"], figures)


def present_machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each machine last read a line, and whether it is active."""
    return C.present(table(spark, sf_dir, "layout_line"), "machine_id", "read_at")


def history_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many purchases and sign-ups belong to a user."""
    return table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IN ('purchase', 'signup')").agg(F.count("*").alias("n"))


_PLAIN = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_FITS = f"({_PLAIN.format('x')} <> '' AND {_PLAIN.format('y')} <> '' AND (contains({_PLAIN.format('x')}, {_PLAIN.format('y')}) OR contains({_PLAIN.format('y')}, {_PLAIN.format('x')})))"
_KEY = "lower(trim(regexp_replace(regexp_replace(x, '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g')))"

QUERIES = {f.__name__: f for f in (
    score_types, score_parties, score_comparable, score_moved, score_reduction, score_citations, newest_receipts, first_spelled_parties, staged_copies, ranked_machines,
    path_overlaps, searched_contracts, merge_summary, set_without_items, set_orphans, filed_by_hash, nearest_filed, flattened_signals, present_machines, history_count,
)}
ORACLE_SQL = {
    "score_types": f"""SELECT fixture_id, actual, len(list_filter(regexp_split_to_array(lower(document_type), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with') AND NOT contains(lower(actual), w))) = 0 AS fits
        FROM (SELECT DISTINCT fixture_id, document_type, unnest(acceptable_types) AS actual FROM {_FIX} WHERE document_type IS NOT NULL)""",
    "score_parties": f"""WITH f AS (SELECT fixture_id, coalesce(parties, []) AS g, list_concat(coalesce(forbidden_parties, []), coalesce(parties, [])[1:1]) AS p FROM {_FIX})
        SELECT fixture_id, len(list_filter(g, lambda x: len(list_filter(p, lambda y: {_FITS})) > 0)) AS matched, len(g) AS expected, len(list_filter(p, lambda y: len(list_filter(g, lambda x: {_FITS})) = 0)) AS spurious FROM f""",
    "score_comparable": f"SELECT doc_id, line_no, trim(regexp_replace(translate(line, '|‘’‚‛“”„‟', ' ''''''''\"\"\"\"'), '[\\s\\x0B\\p{{Z}}]+', ' ', 'g')) AS value FROM {_LINES}",
    "score_moved": f"""WITH l AS (SELECT doc_id, page, unnest(['garbage', 'replacement', 'chars']) AS metric, unnest([garbage, replacement, chars]) AS v FROM page_signal),
        e AS (SELECT doc_id, metric, arg_min(v, (page, v))::DOUBLE AS was, arg_max(v, (page, v))::DOUBLE AS now_is FROM l GROUP BY ALL),
        t AS (SELECT * FROM (VALUES {', '.join(f"('{m}', {x}, {str(b).lower()})" for m, x, b in TOLERANCES)}) AS t(metric, tolerance, low)),
        g AS (SELECT e.*, tolerance, CASE WHEN low THEN was - now_is ELSE now_is - was END AS gain FROM e JOIN t USING (metric))
        SELECT metric, doc_id, was, now_is, CASE WHEN gain < -tolerance - 1e-9 THEN false WHEN gain > tolerance + 1e-9 THEN true END AS better FROM g""",
    "score_reduction": """WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, list_transform(pages, lambda p: coalesce(length(p.text), 0)) AS s FROM worker_document)
        SELECT doc_id, len(s) >= 10 AND list_sum(s) >= 100 AND list_sum(s[1:2]) * 10 > list_sum(s) * 6 AS short FROM d""",
    "score_citations": r"""WITH m AS (SELECT DISTINCT message_id, doc_id, unnest(regexp_extract_all(content, '"(p[0-9]+\.b[0-9]+)"', 1)) AS block_id FROM chat_message WHERE turn_role = 'assistant' AND content IS NOT NULL),
        k AS (SELECT DISTINCT doc_id, block_id, true AS there FROM layout_line)
        SELECT message_id, count(*) AS cited, count(*) FILTER (WHERE there IS NULL) AS unknown, (count(*) - count(*) FILTER (WHERE there IS NULL)) / count(*) AS rate FROM m LEFT JOIN k USING (doc_id, block_id) GROUP BY message_id""",
    "newest_receipts": "SELECT user_id, max(event_id) AS newest, max(event_id) FILTER (WHERE event_type = 'purchase') AS complete, max(event_id) FILTER (WHERE event_type <> 'purchase') AS unsettled FROM events GROUP BY user_id",
    "first_spelled_parties": f"""WITH f AS (SELECT fixture_id, list_filter(list_transform(parties, lambda x: regexp_replace(x, '^[\\s\\x0B\\p{{Z}}]+|[\\s\\x0B\\p{{Z}}]+$', '', 'g')), lambda x: x <> '') AS p FROM {_FIX} WHERE parties IS NOT NULL)
        SELECT fixture_id, array_to_string(list_filter(p, lambda x, k: list_position(list_transform(p, lambda x: {_KEY}), {_KEY}) = k), '; ') AS parties FROM f""",
    "staged_copies": f"SELECT contract_id, original, 'COPY - ' || document_name AS staged FROM {_CON} JOIN (SELECT sha256, min(contract_id) AS original FROM {_CON} GROUP BY sha256) USING (sha256) WHERE contract_id <> original",
    "ranked_machines": """WITH p AS (SELECT DISTINCT machine_id, doc_id, page, garbage, replacement FROM page_signal WHERE machine_id IS NOT NULL),
        s AS (SELECT machine_id, count(*) FILTER (WHERE garbage >= 40) AS bad, sum(replacement) AS lost, count(*) AS n FROM p GROUP BY machine_id) SELECT *, row_number() OVER (ORDER BY bad, lost, n DESC, machine_id) AS place FROM s""",
    "path_overlaps": f"""WITH p AS (SELECT contract_id, regexp_replace(lower(source_path), '/+$', '') || '/' AS x, lower(split_part(source_path, '/', 1)) || '/' AS y FROM {_CON})
        SELECT contract_id, starts_with(x, y) OR starts_with(y, x) AS own, starts_with(x, 'finance/') OR starts_with('finance/', x) AS other FROM p""",
    "searched_contracts": f"SELECT contract_id FROM {_CON} WHERE contains(lower(document_name), 'lease') OR contains(lower(source_path), 'lease')",
    "set_without_items": "SELECT DISTINCT message_id, doc_id FROM chat_message m WHERE NOT EXISTS (SELECT 1 FROM worker_document w WHERE w.truncated AND w.doc_id = m.doc_id)",
    "set_orphans": "SELECT DISTINCT id, to_value AS document_type FROM house_rules r WHERE kind = 'type' AND to_value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM expected_fixture f WHERE f.document_type = r.to_value)",
    "filed_by_hash": f"SELECT c.contract_id, m.marker FROM {_CON} c LEFT JOIN (SELECT sha256, min(contract_id) AS marker FROM {_CON} GROUP BY sha256) m ON m.sha256 = c.sha256 AND regexp_full_match(c.sha256, '[0-9a-f]{{32,128}}')",
    "flattened_signals": "SELECT doc_id, page, metric, value FROM (SELECT DISTINCT doc_id, page, chars::DOUBLE AS chars, segments::DOUBLE AS segments, image_coverage::DOUBLE AS image_coverage, replacement::DOUBLE AS replacement, invisible::DOUBLE AS invisible, garbage::DOUBLE AS garbage, column_count::DOUBLE AS column_count, overlap::DOUBLE AS overlap FROM page_signal) UNPIVOT (value FOR metric IN (chars, segments, image_coverage, replacement, invisible, garbage, column_count, overlap))",
    "present_machines": "SELECT machine_id, last, epoch((SELECT max(read_at) FROM layout_line WHERE machine_id IS NOT NULL))::BIGINT - epoch(last)::BIGINT <= 600 AS active FROM (SELECT machine_id, max(read_at) AS last FROM layout_line WHERE machine_id IS NOT NULL GROUP BY machine_id)",
    "history_count": "SELECT count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IN ('purchase', 'signup')",
    "merge_summary": "SELECT count(*) FILTER (WHERE turn = 2) AS replaced, count(*) FILTER (WHERE turn IS DISTINCT FROM 2) AS kept FROM (SELECT DISTINCT message_id, turn FROM chat_message)",
}
