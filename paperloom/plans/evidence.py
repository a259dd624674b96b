"""The evidence index of all documents: sections, units, terms and retrieval by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import evidence_index as E, segmentation as S
from paperloom.plans.documents import _BLOCKS
from paperloom.plans.scalars import _SEPARATOR, TERMS_SQL, documents

#: Words that lead to the evidence of a field; a deployment passes its own.
LEXICON = {"date": "date dated effective signed due", "parties": "between landlord tenant buyer supplier lender borrower", "type": "agreement invoice minutes report letter schedule"}


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks_of(S.lines_of(documents(spark, sf_dir)))


def section_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with the heading it falls under and the path of headings above it."""
    return E.linked(_blocks(spark, sf_dir)).select("doc_id", "block_no", "level", "parent", F.array_join("path", " > ").alias("path"))


def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of all documents."""
    return E.units(_blocks(spark, sf_dir))


def evidence_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted terms of all units."""
    return E.weighted_terms(E.units(_blocks(spark, sf_dir)))


def unit_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many units of its document a term stands."""
    return evidence_terms(spark, sf_dir).groupBy("doc_id", "term").agg(F.count("*").alias("units"))


def field_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each document by their BM25 for the words of each field."""
    words = spark.createDataFrame([(f, t) for f, text in LEXICON.items() for t in text.split()], "field string, w string")
    from paperloom.functions import text as T

    lexicon = words.select("field", F.explode(T.terms_of(F.col("w"))).alias("term"))
    return E.bm25_units(evidence_terms(spark, sf_dir), lexicon)


_LEVEL = "CASE WHEN kind = 'markdown_heading' THEN length(regexp_extract(text, '^\\s*(#+)', 1)) WHEN kind = 'heading' THEN 7 END"
_LASTS = ", ".join(f"max(CASE WHEN level = {n} THEN block_no END) OVER w AS l{n}" for n in range(1, 8))
_ABOVE = ", ".join(f"CASE WHEN level IS NULL OR level > {n} THEN coalesce(l{n}, 0) ELSE 0 END AS a{n}" for n in range(1, 8))
_OPEN = ", ".join(f"CASE WHEN a{n} > greatest(0, {', '.join(['0'] + [f'a{m}' for m in range(1, n)])}) THEN a{n} END" for n in range(1, 8))
_LINKED = f"""
    v AS (SELECT *, {_LEVEL} AS level, regexp_replace(text, '^[#\\s]+|[:\\s]+$', '', 'g') AS bare FROM b),
    la AS (SELECT *, {_LASTS} FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ab AS (SELECT *, {_ABOVE} FROM la),
    ch AS (SELECT *, list_filter([{_OPEN}], lambda x: x IS NOT NULL) AS chain FROM ab),
    nx AS (SELECT doc_id, block_no, unnest(chain) AS up, unnest(range(len(chain))) AS k FROM ch),
    pa AS (SELECT nx.doc_id, nx.block_no, string_agg(h.bare, ' > ' ORDER BY k) AS path, last(h.bare ORDER BY k) AS heading FROM nx JOIN v h ON h.doc_id = nx.doc_id AND h.block_no = nx.up GROUP BY ALL),
    lk AS (SELECT ch.doc_id, ch.block_no, kind, text, level, list_max(chain) AS parent, coalesce(path, '') AS path, coalesce(heading, '') AS heading FROM ch LEFT JOIN pa ON pa.doc_id = ch.doc_id AND pa.block_no = ch.block_no)"""


def _separator(x: str) -> str:
    return _SEPARATOR.replace("line", x)


_SINGLE = "kind IN ('list_item', 'key_value', 'table')"
_UNITS = f"""
    li AS (SELECT doc_id, block_no, kind, heading, kind = 'table' AND len(string_split(text, chr(10))) > 1 AND {_separator("string_split(text, chr(10))[2]")} AS headed, text,
        CASE WHEN {_SINGLE} THEN string_split(text, chr(10)) ELSE [replace(text, chr(10), ' ')] END AS parts FROM lk),
    ex AS (SELECT *, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM li),
    un AS (SELECT doc_id, 'b' || block_no || CASE kind WHEN 'table' THEN '.r' || k WHEN 'key_value' THEN '.f' || k WHEN 'list_item' THEN '.i' || k ELSE '' END AS unit_id, kind, part AS text, heading,
        CASE WHEN headed THEN string_split(text, chr(10))[1] ELSE '' END AS header FROM ex WHERE kind <> 'table' OR (NOT {_separator("part")} AND NOT (headed AND k = 0)))"""
_TERMS = f"""
    te AS (SELECT doc_id, unit_id, unnest({TERMS_SQL.format('text')}) AS term, 2 AS w FROM un UNION ALL SELECT doc_id, unit_id, unnest({TERMS_SQL.format('heading')}), 1 FROM un
        UNION ALL SELECT doc_id, unit_id, unnest({TERMS_SQL.format('header')}), 1 FROM un),
    wt AS (SELECT doc_id, unit_id, term, sum(w)::BIGINT AS weight FROM te GROUP BY ALL)"""
_STEPS = "".join(
    f""", s{b} AS MATERIALIZED (SELECT * EXCLUDE (ratio, lg), CASE WHEN sq >= {2 << 30} THEN sq >> 1 ELSE sq END AS ratio, CASE WHEN sq >= {2 << 30} THEN lg + {1 << b} ELSE lg END AS lg
        FROM (SELECT * EXCLUDE (sq), (ratio * ratio) >> 30 AS sq FROM s{b + 1}))""".replace("* EXCLUDE (sq), (ratio", "*, (ratio" if b == 9 else "* EXCLUDE (sq), (ratio")
    for b in range(9, -1, -1)
)
_LEX = " UNION ALL ".join(f"SELECT '{f}' AS field, '{t}' AS w" for f, text in LEXICON.items() for t in text.split())
_BM25 = f"""
    lx AS (SELECT DISTINCT field, unnest({TERMS_SQL.format('w')}) AS term FROM ({_LEX})),
    un2 AS (SELECT doc_id, count(DISTINCT unit_id) AS units, sum(weight)::BIGINT AS total FROM wt GROUP BY doc_id), ln AS (SELECT doc_id, unit_id, sum(weight)::BIGINT AS length FROM wt GROUP BY ALL),
    fr AS (SELECT doc_id, term, count(*) AS df FROM wt GROUP BY ALL),
    s10 AS MATERIALIZED (SELECT field, wt.doc_id, wt.unit_id, weight AS f, total, length, units, 2 * units + 2 AS n, 2 * df + 1 AS d, length(bin((2 * units + 2) // (2 * df + 1))) - 1 AS whole,
        ((2 * units + 2) << 30) // ((2 * df + 1) << (length(bin((2 * units + 2) // (2 * df + 1))) - 1)) AS ratio, (length(bin((2 * units + 2) // (2 * df + 1))) - 1) * 1024 AS lg
        FROM wt JOIN lx ON lx.term = wt.term JOIN un2 ON un2.doc_id = wt.doc_id JOIN ln ON ln.doc_id = wt.doc_id AND ln.unit_id = wt.unit_id JOIN fr ON fr.doc_id = wt.doc_id AND fr.term = wt.term){_STEPS},
    sc AS (SELECT field, doc_id, unit_id, sum((CASE WHEN n <= d THEN 0 ELSE lg END) * ((11000 * f * total) // greatest(1, 5 * f * total + 3 * total + 9 * length * units)))::BIGINT AS raw FROM s0 GROUP BY ALL)
    SELECT field, doc_id, unit_id, raw * 100 // max(raw) OVER (PARTITION BY field, doc_id) AS score FROM sc WHERE raw > 0"""

QUERIES = {"section_links": section_links, "evidence_units": evidence_units, "evidence_terms": evidence_terms, "unit_frequencies": unit_frequencies, "field_bm25": field_bm25}
ORACLE_SQL = {
    "section_links": f"WITH {_BLOCKS}, {_LINKED} SELECT doc_id, block_no, level, parent, path FROM lk",
    "evidence_units": f"WITH {_BLOCKS}, {_LINKED}, {_UNITS} SELECT * FROM un",
    "evidence_terms": f"WITH {_BLOCKS}, {_LINKED}, {_UNITS}, {_TERMS} SELECT * FROM wt",
    "unit_frequencies": f"WITH {_BLOCKS}, {_LINKED}, {_UNITS}, {_TERMS} SELECT doc_id, term, count(*) AS units FROM wt GROUP BY ALL",
    "field_bm25": f"WITH {_BLOCKS}, {_LINKED}, {_UNITS}, {_TERMS}, {_BM25}",
}
