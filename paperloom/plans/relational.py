"""Joins, aggregations, windows, set operations and upserts over whole tables.

Queries that read the same in both engines are written once; Spark gets its
tables as DataFrames, so pruning and pushdown reach their scans.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import ranks
from paperloom.operators.evaluation import distributions
from paperloom.session import table

_TABLE = re.compile(r"\{([a-z_]+)\}")


def _both(sql: str, spark_sql: str | None = None) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """A query for Spark and for the oracle from one text, or from one for each."""
    own = spark_sql or sql

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(own, **{t: table(spark, sf_dir, t) for t in set(_TABLE.findall(own))})

    return run, _TABLE.sub(r"\1", sql)


_ITEMS = "(SELECT user_id AS item, max(event_id) AS newest FROM {events} GROUP BY user_id)"
_SCORES = """(SELECT fixture_id, coalesce(file_kind, 'none') AS kind, expected_readiness AS readiness, expected_routing AS route, document_date IS NOT NULL AS dated,
    document_type IS NOT NULL AS typed, size(parties) AS n_parties FROM (SELECT DISTINCT * FROM {expected_fixture}))"""
_SCORES_DUCK = _SCORES.replace("size(parties)", "len(parties)")
_BUCKET = "CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 24 THEN '10-24' WHEN n <= 49 THEN '25-49' WHEN n <= 99 THEN '50-99' ELSE '100+' END"
_PAPERS = "(SELECT doc_id, size(any_value(pages)) AS n FROM {worker_document} GROUP BY doc_id)"
_PAPERS_DUCK = _PAPERS.replace("size(any_value(pages))", "len(any_value(pages))")
_DATES = r"""(SELECT contract_id, agreement_date AS token, CAST(regexp_extract(agreement_date, '^([0-9]+)[/.]([0-9]+)[/.][0-9]+$', 1) AS STRING) AS a,
    CAST(regexp_extract(agreement_date, '^([0-9]+)[/.]([0-9]+)[/.][0-9]+$', 2) AS STRING) AS b, substring(source_path, 1, 26) AS folder
    FROM (SELECT DISTINCT contract_id, agreement_date, source_path FROM {sample_contract}) WHERE agreement_date IS NOT NULL)"""
_ORDER = """(SELECT folder, CASE WHEN max(CASE WHEN CAST(a AS INT) > 12 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN CAST(b AS INT) > 12 THEN 1 ELSE 0 END) = 0 THEN 'day_first'
    WHEN max(CASE WHEN CAST(b AS INT) > 12 THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN CAST(a AS INT) > 12 THEN 1 ELSE 0 END) = 0 THEN 'month_first' END AS date_order
    FROM """ + _DATES + " WHERE a <> '' GROUP BY folder)"

_MARKED = "áéíóúàèìòùâêîôûäëïöüãõñçåæøß"
_BYTES = " || ".join(f"chr({k + 1})" for k in range(len(_MARKED)))

PAIRS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    # joins
    "join_history_of_items": _both("SELECT e.event_id, e.ts, e.event_type, i.item FROM {events} e JOIN " + _ITEMS + " i ON e.user_id = i.item WHERE e.event_type IN ('purchase', 'signup')"),
    "join_doubts_by_kind": _both("SELECT e.event_type AS kind, count(*) AS n FROM {events} e JOIN " + _ITEMS + " i ON e.user_id = i.item AND e.event_id = i.newest GROUP BY e.event_type"),
    "join_unclaimed_items": _both("""WITH e AS (SELECT user_id, date_trunc('day', ts) AS at_day, event_type, value FROM {events})
        SELECT DISTINCT a.user_id, a.at_day FROM e a WHERE a.event_type = 'view'
        AND NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.at_day = a.at_day AND b.event_type = 'purchase')
        AND NOT EXISTS (SELECT 1 FROM e c WHERE c.user_id = a.user_id AND c.at_day = a.at_day AND c.event_type = 'error')"""),
    "join_unread_receipts": _both("SELECT message_id, doc_id FROM (SELECT DISTINCT message_id, doc_id FROM {chat_message}) m WHERE EXISTS (SELECT 1 FROM {worker_document} w WHERE w.doc_id = m.doc_id AND w.truncated)"),
    "join_aligned_reports": _both("""WITH a AS (SELECT user_id AS id, count(*) AS n FROM {events} WHERE event_type = 'click' GROUP BY user_id), b AS (SELECT user_id AS id, count(*) AS n FROM {events} WHERE event_type = 'purchase' GROUP BY user_id)
        SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_before' WHEN a.id IS NULL THEN 'only_after' WHEN b.n > a.n THEN 'fixed' WHEN b.n < a.n THEN 'broken' ELSE 'same' END AS verdict
        FROM a FULL OUTER JOIN b ON a.id = b.id"""),
    "join_prompt_lookup": _both("""WITH asked AS (SELECT DISTINCT message_id, sha256(coalesce(content, '')) AS prompt FROM {chat_message} WHERE turn_role = 'user'), kept AS (SELECT prompt, min(message_id) AS reply FROM asked GROUP BY prompt)
        SELECT a.message_id, k.reply, k.reply IS NULL AS stale FROM asked a LEFT JOIN kept k ON a.prompt = k.prompt""",
        """WITH asked AS (SELECT DISTINCT message_id, sha2(coalesce(content, ''), 256) AS prompt FROM {chat_message} WHERE turn_role = 'user'), kept AS (SELECT prompt, min(message_id) AS reply FROM asked GROUP BY prompt)
        SELECT a.message_id, k.reply, k.reply IS NULL AS stale FROM asked a LEFT JOIN kept k ON a.prompt = k.prompt"""),
    "join_cited_lines": _both(r"""WITH m AS (SELECT DISTINCT message_id, doc_id, content FROM {chat_message} WHERE turn_role = 'assistant' AND content IS NOT NULL), c AS (SELECT DISTINCT message_id, doc_id, unnest(regexp_extract_all(content, '"(p[0-9]+\.b[0-9]+)"', 1)) AS block FROM m),
        l AS (SELECT doc_id, block_id AS block, count(DISTINCT (page, line_no)) AS n FROM {layout_line} GROUP BY ALL) SELECT c.message_id, c.block, l.n FROM c LEFT JOIN l ON l.doc_id = c.doc_id AND l.block = c.block""",
        r"""WITH m AS (SELECT DISTINCT message_id, doc_id, content FROM {chat_message} WHERE turn_role = 'assistant' AND content IS NOT NULL), c AS (SELECT DISTINCT message_id, doc_id, explode(regexp_extract_all(content, r'"(p[0-9]+\.b[0-9]+)"', 1)) AS block FROM m),
        l AS (SELECT doc_id, block_id AS block, count(DISTINCT page, line_no) AS n FROM {layout_line} GROUP BY ALL) SELECT c.message_id, c.block, l.n FROM c LEFT JOIN l ON l.doc_id = c.doc_id AND l.block = c.block"""),
    "join_types_by_containment": _both("""WITH f AS (SELECT DISTINCT fixture_id, lower(document_type) AS found FROM {expected_fixture} WHERE document_type IS NOT NULL), g AS (SELECT DISTINCT fixture_id, lower(unnest(acceptable_types)) AS named FROM {expected_fixture})
        SELECT f.fixture_id, f.found, g.named, contains(f.found, g.named) OR contains(g.named, f.found) AS fits FROM f JOIN g ON f.fixture_id = g.fixture_id""",
        """WITH f AS (SELECT DISTINCT fixture_id, lower(document_type) AS found FROM {expected_fixture} WHERE document_type IS NOT NULL), g AS (SELECT DISTINCT fixture_id, lower(p) AS named FROM {expected_fixture} LATERAL VIEW explode(acceptable_types) AS p)
        SELECT f.fixture_id, f.found, g.named, contains(f.found, g.named) OR contains(g.named, f.found) AS fits FROM f JOIN g ON f.fixture_id = g.fixture_id"""),
    "join_party_in_content": _both("""WITH r AS (SELECT DISTINCT lower(to_value) AS party FROM {house_rules} WHERE kind = 'party' AND to_value IS NOT NULL), f AS (SELECT DISTINCT fixture_id, lower(unnest(parties)) AS party FROM {expected_fixture})
        SELECT f.fixture_id, f.party FROM f WHERE EXISTS (SELECT 1 FROM r WHERE r.party = f.party)""",
        """WITH r AS (SELECT DISTINCT lower(to_value) AS party FROM {house_rules} WHERE kind = 'party' AND to_value IS NOT NULL), f AS (SELECT DISTINCT fixture_id, lower(p) AS party FROM {expected_fixture} LATERAL VIEW explode(parties) AS p)
        SELECT f.fixture_id, f.party FROM f WHERE EXISTS (SELECT 1 FROM r WHERE r.party = f.party)"""),
    "join_positions_in_spans": _both(r"""WITH p AS (SELECT doc_id, unnest(pages) AS p FROM (SELECT DISTINCT ON (doc_id) doc_id, pages FROM {worker_document})), s AS (SELECT doc_id, p.page_number AS page, p.text AS text, unnest(p.volatile_spans) AS s FROM p)
        SELECT doc_id, page, s.start_at AS start_at, s.end_at AS end_at, regexp_matches(substring(text, s.start_at + 1, s.end_at - s.start_at), '(^|[^0-9])([0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]|[0-9][0-9]?[./][0-9][0-9]?[./]([0-9][0-9])?[0-9][0-9])([^0-9]|$)') AS holds_date FROM s WHERE text IS NOT NULL""",
        """WITH d AS (SELECT doc_id, any_value(pages) AS pages FROM {worker_document} GROUP BY doc_id), p AS (SELECT doc_id, p FROM d LATERAL VIEW explode(pages) AS p), s AS (SELECT doc_id, p.page_number AS page, p.text AS text, s FROM p LATERAL VIEW explode(p.volatile_spans) AS s)
        SELECT doc_id, page, s.start_at AS start_at, s.end_at AS end_at, substring(text, s.start_at + 1, s.end_at - s.start_at) RLIKE '(^|[^0-9])([0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]|[0-9][0-9]?[./][0-9][0-9]?[./]([0-9][0-9])?[0-9][0-9])([^0-9]|$)' AS holds_date FROM s WHERE text IS NOT NULL"""),
    "join_claims_with_items": _both("SELECT r.id, r.kind, t.document_type FROM (SELECT DISTINCT id, kind, to_value FROM {house_rules}) r LEFT JOIN (SELECT DISTINCT document_type FROM {expected_fixture}) t ON t.document_type = r.to_value"),
    # aggregations
    "agg_corpus_summary": _both("SELECT readiness, count(*) AS n, sum(CASE WHEN dated THEN 1 ELSE 0 END) AS dated, sum(CASE WHEN typed THEN 1 ELSE 0 END) AS typed, avg(n_parties) AS mean_parties FROM " + _SCORES_DUCK + " GROUP BY readiness",
        "SELECT readiness, count(*) AS n, sum(CASE WHEN dated THEN 1 ELSE 0 END) AS dated, sum(CASE WHEN typed THEN 1 ELSE 0 END) AS typed, avg(CASE WHEN n_parties >= 0 THEN n_parties END) AS mean_parties FROM " + _SCORES + " GROUP BY readiness"),
    "agg_grouped_summary": _both("SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(readiness) = 0 THEN 'readiness' ELSE 'route' END AS dimension, coalesce(kind, readiness, route) AS member, count(*) AS n, sum(CASE WHEN dated THEN 1 ELSE 0 END) AS dated FROM " + _SCORES_DUCK + " GROUP BY GROUPING SETS ((kind), (readiness), (route))",
        "SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(readiness) = 0 THEN 'readiness' ELSE 'route' END AS dimension, coalesce(kind, readiness, route) AS member, count(*) AS n, sum(CASE WHEN dated THEN 1 ELSE 0 END) AS dated FROM " + _SCORES + " GROUP BY GROUPING SETS ((kind), (readiness), (route))"),
    "agg_page_buckets": _both(f"SELECT {_BUCKET} AS bucket, count(*) AS n, sum(n) AS pages FROM {_PAPERS_DUCK} GROUP BY 1", f"SELECT {_BUCKET} AS bucket, count(*) AS n, sum(n) AS pages FROM {_PAPERS} GROUP BY 1"),
    "agg_distribution": _both("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, max(value) AS most, round(avg(value), 3) AS mean FROM {events} GROUP BY event_type"),
    "agg_upper_median": _both("SELECT user_id, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM {events} WHERE value IS NOT NULL GROUP BY user_id"),
    "agg_pooled_rates": _both("SELECT machine_id, sum(replacement) AS found, sum(chars) AS total, CASE WHEN sum(chars) > 0 THEN sum(replacement) * 1.0 / sum(chars) END AS rate FROM {page_signal} GROUP BY machine_id",
        "SELECT machine_id, sum(replacement) AS found, sum(chars) AS total, CASE WHEN sum(chars) > 0 THEN CAST(sum(replacement) AS DOUBLE) / sum(chars) END AS rate FROM {page_signal} GROUP BY machine_id"),
    "agg_route_confusion": _both("""WITH p AS (SELECT DISTINCT doc_id, page, route, CASE WHEN garbage > 15 THEN 'bad' ELSE 'fair' END AS seen FROM {page_signal})
        SELECT seen, count(CASE WHEN route = 'ocr' THEN 1 END) AS ocr, count(CASE WHEN route <> 'ocr' THEN 1 END) AS other FROM p GROUP BY seen"""),
    "agg_memory_peaks": _both("SELECT source, max(n_chars) AS peak, quantile_disc(n_chars, 0.95) AS p95 FROM {documents} GROUP BY source"),
    "agg_having_repeated": _both("SELECT doc_id, count(*) AS n FROM {worker_document} GROUP BY doc_id HAVING count(*) > 1"),
    "agg_failure_run": _both("""WITH r AS (SELECT event_id, user_id, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM {events})
        SELECT user_id, run, count(*) AS length FROM r WHERE event_type <> 'purchase' GROUP BY user_id, run HAVING count(*) >= 3"""),
    # the oracle's distance counts bytes, so it gets letters with marks as single bytes
    "agg_edit_distance": _both(f"SELECT DISTINCT id, levenshtein(translate(lower(from_value), '{_MARKED}', {_BYTES}), translate(lower(to_value), '{_MARKED}', {_BYTES})) AS distance, length(to_value) AS length FROM {{house_rules}} WHERE from_value IS NOT NULL AND to_value IS NOT NULL",
        "SELECT DISTINCT id, levenshtein(lower(from_value), lower(to_value)) AS distance, length(to_value) AS length FROM {house_rules} WHERE from_value IS NOT NULL AND to_value IS NOT NULL"),
    # windows and ranking
    "window_newest_per_item": _both("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM {events}) WHERE k = 1"),
    "window_latest_of_kind": _both("SELECT user_id, max(event_id) AS newest, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS complete, max(CASE WHEN event_type <> 'purchase' THEN event_id END) AS unsettled FROM {events} GROUP BY user_id"),
    "window_newest_of_two_sources": _both("SELECT doc_id, max(seen) AS newest FROM (SELECT doc_id, received_at AS seen FROM {worker_document} UNION ALL SELECT doc_id, received_at FROM {chat_message}) GROUP BY doc_id"),
    "window_history_top": _both("SELECT event_id, ts, user_id FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 500"),
    "window_signature_reach": _both("SELECT event_id, user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS reached FROM {events}"),
    "window_stable_since": _both("SELECT event_id, user_id, value = lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS unchanged FROM {events}"),
    "window_collision_numbers": _both("""WITH d AS (SELECT DISTINCT doc_id, file_name FROM {worker_document}), n AS (SELECT doc_id, file_name, row_number() OVER (PARTITION BY lower(file_name) ORDER BY doc_id) AS k FROM d)
        SELECT doc_id, CASE WHEN k = 1 THEN file_name ELSE regexp_replace(file_name, '(\\.[^.]*)?$', ' (' || CAST(k AS VARCHAR) || ')\\1') END AS name FROM n WHERE file_name IS NOT NULL""".replace("\\\\", "\\"),
        r"""WITH d AS (SELECT DISTINCT doc_id, file_name FROM {worker_document}), n AS (SELECT doc_id, file_name, row_number() OVER (PARTITION BY lower(file_name) ORDER BY doc_id) AS k FROM d)
        SELECT doc_id, CASE WHEN k = 1 THEN file_name ELSE concat(regexp_replace(file_name, r'\.[^.]*$', ''), ' (', CAST(k AS STRING), ')', regexp_extract(file_name, r'(\.[^.]*)$', 1)) END AS name FROM n WHERE file_name IS NOT NULL"""),
    "window_filed_index": _both("SELECT sha256, source_path, contract_id FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY loaded_at DESC, contract_id DESC) AS k FROM {sample_contract}) WHERE k = 1"),
    "window_top_by_group": _both("SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM {documents}) WHERE k <= 3"),
    "window_origin_marker": _both("SELECT doc_id, min(read_at) AS first_read FROM {layout_line} GROUP BY doc_id"),
    # set operations and upserts
    "set_enqueue_new": _both("SELECT DISTINCT sha256, lower(source_path) AS path FROM {sample_contract} s WHERE NOT EXISTS (SELECT 1 FROM {expected_fixture} f WHERE lower(f.file_name) = lower(s.source_path))"),
    "set_only_before": _both("SELECT user_id, date_trunc('day', ts) AS at_day FROM {events} WHERE event_type = 'view' EXCEPT SELECT user_id, date_trunc('day', ts) FROM {events} WHERE event_type = 'purchase'"),
    "set_in_both": _both("SELECT user_id FROM {events} WHERE event_type = 'view' INTERSECT SELECT user_id FROM {events} WHERE event_type = 'purchase'"),
    "set_merge_recordings": _both("""WITH new AS (SELECT message_id, content FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY received_at DESC) AS k FROM {chat_message}) WHERE k = 1 AND turn = 2),
        old AS (SELECT DISTINCT message_id, content FROM {chat_message}) SELECT message_id, content, true AS replaced FROM new UNION ALL SELECT message_id, content, false FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.message_id = o.message_id)"""),
    "set_context_union": _both("""WITH s AS (SELECT doc_id, line_no, text, 1 AS bits FROM {layout_line} WHERE text LIKE '%agree%' UNION ALL SELECT doc_id, line_no, text, 2 FROM {layout_line} WHERE text LIKE '%202%' UNION ALL SELECT doc_id, line_no, text, 4 FROM {layout_line} WHERE text LIKE '%Ltd%')
        SELECT doc_id, text, min(line_no) AS line_no, bit_or(bits) AS bits FROM s GROUP BY doc_id, text"""),
    "set_clear_terminal": _both("SELECT DISTINCT e.event_id FROM {events} e WHERE e.event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM {events} m WHERE m.user_id = e.user_id AND m.event_type = 'signup' AND m.event_id > e.event_id)"),
    "set_retention": _both("SELECT doc_id, page, line_no FROM {layout_line} WHERE read_at >= TIMESTAMP '2026-01-01 00:00:00'"),
    # dates whose order the document settles
    "date_numeric_order": _both("SELECT folder, date_order FROM " + _ORDER.replace("AS STRING", "AS VARCHAR"), "SELECT folder, date_order FROM " + _ORDER.replace("'^([0-9]", "r'^([0-9]")),
    "date_numeric_reading": _both("SELECT d.contract_id, CASE WHEN CAST(d.a AS INT) > 12 THEN 'day_first' WHEN CAST(d.b AS INT) > 12 THEN 'month_first' ELSE o.date_order END AS reading FROM " + _DATES.replace("AS STRING", "AS VARCHAR") + " d LEFT JOIN " + _ORDER.replace("AS STRING", "AS VARCHAR") + " o ON o.folder = d.folder WHERE d.a <> ''",
        "SELECT d.contract_id, CASE WHEN CAST(d.a AS INT) > 12 THEN 'day_first' WHEN CAST(d.b AS INT) > 12 THEN 'month_first' ELSE o.date_order END AS reading FROM " + _DATES.replace("'^([0-9]", "r'^([0-9]") + " d LEFT JOIN " + _ORDER.replace("'^([0-9]", "r'^([0-9]") + " o ON o.folder = d.folder WHERE d.a <> ''"),
    # routes of pages by their signals; the first two pages and the last are key pages
    "page_routes": _both("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, page, max(chars) AS chars, max(image_coverage) AS image_coverage, max(replacement) AS replacement, max(invisible) AS invisible,
            max(garbage) AS garbage, max(column_count) AS column_count, max(aligned_rows) AS aligned_rows, max(key_value_grid) AS key_value_grid, max(overlap) AS overlap, max(image_region) AS image_region FROM {page_signal} GROUP BY doc_id, page)),
        q AS (SELECT doc_id, page, garbage, k <= 2 OR k = n AS key_page, (chars < 20 AND image_coverage >= 650) OR (chars < 200 AND image_coverage >= 900) OR replacement > 30 AS needs_ocr, invisible >= 500 AND image_coverage >= 900 AS prior_ocr,
            CASE WHEN image_region >= 150 AND chars >= 20 THEN 'ocr_regions' WHEN column_count >= 2 OR aligned_rows >= 3 OR key_value_grid >= 2 OR overlap >= 100 THEN 'layout' ELSE 'fast' END AS as_text FROM p)
        SELECT doc_id, page, key_page, CASE WHEN needs_ocr THEN 'ocr' WHEN prior_ocr AND (garbage >= 40 OR as_text = 'ocr_regions' OR (as_text = 'layout' AND key_page)) THEN 'ocr' ELSE as_text END AS route FROM q"""),
    # keys that tell repeated blocks: the start and the end of a text with figures masked
    "duplicate_keys": _both("SELECT doc_id, left(lower(regexp_replace(trim(text), '[0-9]+', '#', 'g')), 80) AS head, CASE WHEN length(regexp_replace(trim(text), '[0-9]+', '#', 'g')) >= 240 THEN right(lower(regexp_replace(trim(text), '[0-9]+', '#', 'g')), 80) END AS tail FROM {documents} WHERE text IS NOT NULL",
        "SELECT doc_id, left(lower(regexp_replace(trim(text), '[0-9]+', '#')), 80) AS head, CASE WHEN length(regexp_replace(trim(text), '[0-9]+', '#')) >= 240 THEN right(lower(regexp_replace(trim(text), '[0-9]+', '#')), 80) END AS tail FROM {documents} WHERE text IS NOT NULL"),
    # the last word before a date, but for fillers, labels a deadline
    "deadline_labels": _both(r"""SELECT doc_id, line_no, regexp_matches(lower(line), '(^|[^a-z0-9])(due|expires|expiration|expiry|renewal|deadline)([^a-z0-9]+(date|on|or|before|by|of))*[^a-z0-9]*[0-9]') AS deadline
        FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM {documents} WHERE text IS NOT NULL)""",
        r"""SELECT doc_id, line_no, lower(line) RLIKE r'(^|[^a-z0-9])(due|expires|expiration|expiry|renewal|deadline)([^a-z0-9]+(date|on|or|before|by|of))*[^a-z0-9]*[0-9]' AS deadline
        FROM {documents} LATERAL VIEW posexplode(split(text, '
')) AS line_no, line WHERE text IS NOT NULL"""),
    # figures of documents and pages
    "agg_route_class": _both("""SELECT doc_id, CASE max(CASE route WHEN 'ocr' THEN 4 WHEN 'ocr_regions' THEN 3 WHEN 'layout' THEN 2 WHEN 'fast' THEN 1 ELSE 0 END)
        WHEN 4 THEN 'ocr' WHEN 3 THEN 'ocr_regions' WHEN 2 THEN 'layout' WHEN 1 THEN 'fast' ELSE 'unrouted' END AS route FROM {page_signal} GROUP BY doc_id"""),
    "agg_mean_confidence": _both("SELECT doc_id, CAST(floor((2 * sum(confidence) + count(confidence)) / (2.0 * count(confidence))) AS INT) AS confidence FROM (SELECT DISTINCT doc_id, page, line_no, confidence FROM {layout_line}) WHERE confidence IS NOT NULL GROUP BY doc_id"),
    "agg_upper_percentiles": _both("""WITH r AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY source) AS n FROM {documents} WHERE n_chars IS NOT NULL)
        SELECT source, max(n) AS n, min(n_chars) AS least, max(CASE WHEN k = floor(n / 2.0) + 1 THEN n_chars END) AS median, max(n_chars) AS most, CAST(floor(avg(n_chars)) AS BIGINT) AS mean FROM r GROUP BY source"""),
    "agg_all_distributions": _both("""WITH l AS (SELECT 'chars' AS metric, chars AS value FROM {page_signal} UNION ALL SELECT 'segments', segments FROM {page_signal} UNION ALL SELECT 'image_coverage', image_coverage FROM {page_signal} UNION ALL SELECT 'garbage', garbage FROM {page_signal})
        SELECT metric, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, max(value) AS most, round(avg(value), 3) AS mean FROM l GROUP BY metric"""),
    "agg_rate_delta": _both("""WITH d AS (SELECT user_id, date_trunc('day', ts) AS at_day, max(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) = 1 AND min(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) = 1 AS clean FROM {events} GROUP BY user_id, date_trunc('day', ts)),
        j AS (SELECT a.at_day, a.clean AS was, b.clean AS now_clean FROM d a JOIN d b ON a.user_id = b.user_id AND b.at_day = a.at_day + INTERVAL 1 DAY)
        SELECT at_day, count(*) AS n, sum(CASE WHEN was THEN 1 ELSE 0 END) AS before_clean, sum(CASE WHEN now_clean THEN 1 ELSE 0 END) AS after_clean, sum(CASE WHEN NOT was AND now_clean THEN 1 ELSE 0 END) AS fixed, sum(CASE WHEN was AND NOT now_clean THEN 1 ELSE 0 END) AS broken FROM j GROUP BY at_day"""),
    "agg_retrieval_buckets": _both("SELECT CASE WHEN n <= 3 THEN '1-3' WHEN n <= 9 THEN '4-9' WHEN n <= 24 THEN '10-24' ELSE '25+' END AS bucket, count(*) AS n FROM " + _PAPERS_DUCK + " GROUP BY 1", "SELECT CASE WHEN n <= 3 THEN '1-3' WHEN n <= 9 THEN '4-9' WHEN n <= 24 THEN '10-24' ELSE '25+' END AS bucket, count(*) AS n FROM " + _PAPERS + " GROUP BY 1"),
    "agg_warning_counts": _both("SELECT w.code AS code, w.field_affecting AS field_affecting, count(*) AS n FROM (SELECT unnest(warnings) AS w FROM (SELECT DISTINCT ON (doc_id) doc_id, warnings FROM {worker_document})) GROUP BY ALL",
        "SELECT w.code AS code, w.field_affecting AS field_affecting, count(*) AS n FROM (SELECT any_value(warnings) AS warnings FROM {worker_document} GROUP BY doc_id) LATERAL VIEW explode(warnings) AS w GROUP BY w.code, w.field_affecting"),
    "window_sheet": _both("""SELECT o_custkey, o_orderkey, total - 10 AS not_shown FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS total FROM {orders}) WHERE k <= 10"""),
    "window_next_short": _both("SELECT doc_id, page, line_no, CASE WHEN length(following) <= 40 THEN following END AS neighbour FROM (SELECT doc_id, page, line_no, lead(text) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS following FROM (SELECT DISTINCT doc_id, page, line_no, text FROM {layout_line}))"),
    "join_longest_root": _both("""WITH c AS (SELECT DISTINCT contract_id, source_path FROM {sample_contract}), r AS (SELECT DISTINCT split_part(source_path, '/', 1) AS root FROM c UNION SELECT DISTINCT split_part(source_path, '/', 1) || '/' || split_part(source_path, '/', 2) FROM c)
        SELECT c.contract_id, max(r.root) AS root FROM c JOIN r ON r.root = split_part(c.source_path, '/', 1) OR r.root = split_part(c.source_path, '/', 1) || '/' || split_part(c.source_path, '/', 2) GROUP BY c.contract_id""",
        # the roots a path can have are its own prefixes: an equi-join instead of a scan of all roots per path
        """WITH c AS (SELECT DISTINCT contract_id, source_path FROM {sample_contract}), r AS (SELECT DISTINCT substring_index(source_path, '/', 1) AS root FROM c UNION SELECT DISTINCT substring_index(source_path, '/', 2) FROM c),
        p AS (SELECT contract_id, explode(array(substring_index(source_path, '/', 1), substring_index(source_path, '/', 2))) AS prefix FROM c) SELECT p.contract_id, max(r.root) AS root FROM p JOIN r ON r.root = p.prefix GROUP BY p.contract_id"""),
    "join_marked_but_settled": _both("""WITH e AS (SELECT user_id, date_trunc('day', ts) AS at_day, event_type FROM {events}) SELECT DISTINCT a.user_id, a.at_day FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.at_day = a.at_day AND b.event_type = 'purchase')
        AND NOT EXISTS (SELECT 1 FROM e c WHERE c.user_id = a.user_id AND c.at_day = a.at_day AND c.event_type = 'signup')"""),
    "join_awaiting_mark": _both("""WITH n AS (SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM {events} WHERE event_type IN ('purchase', 'signup')) WHERE k = 1)
        SELECT u.user_id, coalesce(n.event_type, 'none') AS mark FROM (SELECT DISTINCT user_id FROM {events}) u LEFT JOIN n ON n.user_id = u.user_id WHERE coalesce(n.event_type, 'none') <> 'purchase'"""),
}


def agg_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the values of each kind of event."""
    found = distributions(table(spark, sf_dir, "events"), "event_type", "value")
    return found.select(F.col("dimension").alias("event_type"), "n", "p50", "p90", "p95", F.col("max").alias("most"), "mean")


def agg_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the values of each user."""
    return ranks.ranked(table(spark, sf_dir, "events"), ["user_id"], "value", {"median": ranks.upper_median}).select("user_id", "median")


def agg_memory_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest size and 95th percentile of each source."""
    found = ranks.ranked(table(spark, sf_dir, "documents"), ["source"], "n_chars", {"p95": ranks.nearest(0.95)})
    return found.select("source", F.col("most").alias("peak"), "p95")


def agg_upper_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, upper median, most and floored mean of the sizes of each source."""
    found = ranks.ranked(table(spark, sf_dir, "documents"), ["source"], "n_chars", {"median": ranks.upper_median})
    return found.select("source", "n", "least", "median", "most", F.floor("mean").cast("bigint").alias("mean"))


def agg_all_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of several figures of pages at once."""
    metrics = "chars", "segments", "image_coverage", "garbage"
    long = table(spark, sf_dir, "page_signal").select(F.expr(f"stack({len(metrics)}, {', '.join(f'{m!r}, {m}' for m in metrics)}) AS (metric, value)"))
    found = ranks.ranked(long, ["metric"], "value", {"p50": ranks.nearest(0.5), "p90": ranks.nearest(0.9)})
    return found.select("metric", "n", "p50", "p90", "most", F.round("mean", 3).alias("mean"))


QUERIES = {n: p[0] for n, p in PAIRS.items()} | {
    "agg_distribution": agg_distribution, "agg_upper_median": agg_upper_median, "agg_memory_peaks": agg_memory_peaks, "agg_upper_percentiles": agg_upper_percentiles,
    "agg_all_distributions": agg_all_distributions,
}
ORACLE_SQL = {n: p[1] for n, p in PAIRS.items()}
