"""Scalar functions over whole tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.session import spread, table

_WS = r"[ \t\r\n\x0B\f]+"
_STRIP = r"regexp_replace({0}, '^[ \t\r\n\x0B\f]+|[ \t\r\n\x0B\f]+$', '', 'g')"
_DOCS = "documents WHERE text IS NOT NULL"
_LINES = r"(SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text."""
    return spread(table(spark, sf_dir, "documents")).where("text IS NOT NULL")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no (from 0), line of every document."""
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts once each."""
    return table(spark, sf_dir, "sample_contract").dropDuplicates(["contract_id"])


def _sql_strip(x: str) -> str:
    return _STRIP.format(x)


_S = _sql_strip("line")
_LETTERS = "length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))"
_CAPS = "length(regexp_replace({0}, '[^\\p{{Lu}}]', '', 'g'))"
_HEADING = (
    f"({_S} <> '' AND length({_S}) <= 90 AND NOT ends_with({_S}, ':') AND NOT (ends_with({_S}, '.') AND len(regexp_split_to_array({_S}, '[ \t]+')) > 6)"
    f" AND {_LETTERS.format(_S)} >= 3 AND {_CAPS.format(_S)} * 10 >= {_LETTERS.format(_S)} * 8)"
)
_ITEM = f"((regexp_matches({_S}, '^([•◦▪‣●○■□–]|[-*+] )') AND length({_S}) > 2) OR (regexp_matches({_S}, '^\\(*([0-9]{{1,2}}|[a-z]|[ivx]+)\\) ') AND strpos({_S}, ' ') BETWEEN 2 AND 7))"
_SEPARATOR = f"regexp_matches({_S}, '^\\|?( *:*-{{3,}}:* *\\|)+( *:*-{{3,}}:* *)?$')"
_KEY = _sql_strip(f"string_split({_S}, ': ')[1]")
_VALUE = _sql_strip(f"substring({_S}, strpos({_S}, ': ') + 2)")
_K = _sql_strip(f"regexp_replace({_KEY}, ':+$', '')")
_WORDS = f"regexp_split_to_array({_K}, '[ \t]+')"
_LOW = f"len(list_filter({_WORDS}, lambda w: regexp_matches(w, '^\\p{{Ll}}') AND w NOT IN ({', '.join(repr(w) for w in T.LABEL_WORDS)})))"
_LABEL = (
    f"({_K} <> '' AND length({_K}) <= 40 AND len({_WORDS}) <= 6 AND regexp_matches({_K}, '^\\p{{Lu}}') AND NOT regexp_matches({_K}, '[\"“”;,:]') AND {_LOW} <= 2"
    f" AND NOT (len({_WORDS}) > 3 AND {_LOW} > 1))"
)
_IS_KV = f"(strpos({_S}, ': ') > 0 AND {_VALUE} <> '' AND {_LABEL})"
_KIND = (
    f"CASE WHEN {_S} = '' THEN 'blank' WHEN regexp_matches({_S}, '^#{{1,6}} +[^ ]') THEN 'markdown_heading' WHEN starts_with({_S}, '|') AND {_SEPARATOR} THEN 'table_separator'"
    f" WHEN starts_with({_S}, '|') THEN 'table_row' WHEN {_ITEM} THEN 'list_item' WHEN {_IS_KV} THEN 'key_value' WHEN {_HEADING} THEN 'heading' ELSE 'text' END"
)
_COLLAPSED = f"trim(regexp_replace({{0}}, '{_WS}', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_STEM = (
    "CASE WHEN length({0}) > 4 AND ends_with({0}, 'ies') THEN regexp_replace({0}, 'ies$', 'y')"
    " WHEN length({0}) >= 4 AND ends_with({0}, 's') AND NOT ends_with({0}, 'ss') AND NOT ends_with({0}, 'us') AND NOT ends_with({0}, 'is') THEN regexp_replace({0}, 's$', '') ELSE {0} END"
)
TERMS_SQL = (
    r"list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^\p{{N}}+$') AND w NOT IN (" + _STOP + ")), lambda w: " + _STEM.format("w") + ")"
)
_DATE = "agreement_date"
_C = "(SELECT DISTINCT contract_id, agreement_date, document_name, source_path, file_size, sha256, parties FROM sample_contract)"
_FX = "(SELECT DISTINCT fixture_id, file_name, document_type FROM expected_fixture)"


def _fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "expected_fixture").dropDuplicates(["fixture_id"])


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "house_rules").dropDuplicates(["id"])


_R = "(SELECT DISTINCT id, from_value FROM house_rules)"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "page_signal").dropDuplicates(["doc_id", "page"])


_PS = "(SELECT DISTINCT ON (doc_id, page) * FROM page_signal)"


def _col(name: str) -> Column:
    return F.col(name)


#: Query: (source, keys, value column, its column, the source in SQL, its SQL).
TABLE: dict[str, tuple[Callable, list[str], Callable[[], Column], str, str]] = {
    "collapse_whitespace": (documents, ["doc_id"], lambda: T.collapse_whitespace(_col("text")), _DOCS, _COLLAPSED.format("text")),
    "digit_masked": (documents, ["doc_id"], lambda: T.digit_masked(_col("text")), _DOCS, "lower(regexp_replace(text, '[0-9]+', '#', 'g'))"),
    "estimated_tokens": (
        documents, ["doc_id"], lambda: T.estimated_tokens(_col("text")), _DOCS,
        r"length(regexp_replace(text, '[^\p{N}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g')) + ((length(text) - length(regexp_replace(text, '[^\p{N}\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]', '', 'g'))) * 2 + 6) // 7",
    ),
    "contains_identifier": (
        lines, ["doc_id", "line_no"], lambda: T.contains_identifier(_col("line")), _LINES,
        rf"len(list_filter(regexp_split_to_array(line, '{_WS}'), lambda w: length(w) <= 24 AND length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) >= 2 AND length(regexp_replace(w, '[^0-9]', '', 'g')) >= 2)) > 0",
    ),
    "contains_money": (lines, ["doc_id", "line_no"], lambda: T.contains_money(_col("line")), _LINES, "regexp_matches(line, '[$£][^0-9]{0,2}[0-9]') OR contains(line, 'USD ') OR contains(line, 'EUR ')"),
    "carries_an_amount": (lines, ["doc_id", "line_no"], lambda: T.carries_an_amount(_col("line")), _LINES, r"regexp_matches(line, '[$£€] ?[0-9]|(^|[^0-9.,])[0-9][0-9,]*\.[0-9]{2}($|[^0-9.])')"),
    "money_amounts": (
        lines, ["doc_id", "line_no"], lambda: F.array_join(T.money_amounts(_col("line")), "; "), _LINES,
        r"array_to_string(list_transform(list_sort(list_distinct(regexp_extract_all(line, '(?:[$£€]|\b(?:USD|EUR|GBP|CAD)) *[0-9]+(?:[.,][0-9]+)*'))), lambda x: x), '; ')",
    ),
    "numeric_dates": (lines, ["doc_id", "line_no"], lambda: F.array_join(T.numeric_dates(_col("line")), "; "), _LINES, r"array_to_string(regexp_extract_all(line, '\b([0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4})\b', 1), '; ')"),
    "terms_of": (documents, ["doc_id"], lambda: F.array_join(T.terms_of(_col("text")), " "), _DOCS, f"array_to_string({TERMS_SQL.format('text')}, ' ')"),
    "line_kind": (lines, ["doc_id", "line_no"], lambda: T.line_kind(_col("line")), _LINES, _KIND),
    "is_heading_line": (lines, ["doc_id", "line_no"], lambda: T.is_heading_line(_col("line")), _LINES, _HEADING),
    "is_list_item": (lines, ["doc_id", "line_no"], lambda: T.is_list_item(_col("line")), _LINES, _ITEM),
    "is_table_separator": (lines, ["doc_id", "line_no"], lambda: T.is_table_separator(_col("line")), _LINES, _SEPARATOR),
    "field_label": (lines, ["doc_id", "line_no"], lambda: T.key_of(_col("line")), _LINES, f"CASE WHEN {_IS_KV} THEN {_KEY} END"),
    "field_value": (lines, ["doc_id", "line_no"], lambda: T.value_of(_col("line")), _LINES, f"CASE WHEN {_IS_KV} THEN {_VALUE} END"),
    "table_cells": (
        lambda s, d: lines(s, d).where("line LIKE '|%'"), ["doc_id", "line_no"], lambda: F.array_join(T.table_cells(_col("line")), "¦"), f"{_LINES} WHERE line LIKE '|%'",
        "array_to_string(list_transform(string_split(regexp_replace(replace(" + _S + ", '\\|', chr(1)), '^\\||\\|$', '', 'g'), '|'), lambda x: replace(" + _sql_strip("x") + ", chr(1), '|')), '¦')",
    ),
    "normalize_heading": (
        lambda s, d: lines(s, d).where(T.is_heading_line(F.col("line"))), ["doc_id", "line_no"], lambda: F.regexp_replace("line", r"^[# \t\r\n]+|[: \t\r\n]+$", ""), f"{_LINES} WHERE {_HEADING}",
        r"regexp_replace(line, '^[# \t\r\n]+|[: \t\r\n]+$', '', 'g')",
    ),
    "sanitize_cell": (lines, ["doc_id", "line_no"], lambda: T.sanitize_cell(_col("line")), _LINES, r"CASE WHEN length(replace(regexp_replace(line, '[\r\n]+', ' ', 'g'), '|', '\|')) > 1000 THEN substring(replace(regexp_replace(line, '[\r\n]+', ' ', 'g'), '|', '\|'), 1, 1000) || '…' ELSE replace(regexp_replace(line, '[\r\n]+', ' ', 'g'), '|', '\|') END"),
    "tsv_cell": (
        lines, ["doc_id", "line_no"], lambda: T.tsv_cell(_col("line")), "(SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^[=+\\-@\\t\\r]') THEN '''' || line ELSE line END AS g FROM " + _LINES + ")",
        "CASE WHEN regexp_matches(g, '[\\t\\r\\n\"]') THEN '\"' || replace(g, '\"', '\"\"') || '\"' ELSE g END",
    ),
    "html_cell": (lines, ["doc_id", "line_no"], lambda: T.html_cell(_col("line")), _LINES, "replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"),
    "content_hash": (documents, ["doc_id"], lambda: F.sha2("text", 256), _DOCS, "sha256(text)"),
    "head_and_tail_window": (documents, ["doc_id"], lambda: T.head_and_tail(_col("text"), 14000, 8000), _DOCS, "CASE WHEN length(text) > 22000 THEN substring(text, 1, 14000) || right(text, 8000) ELSE text END"),
    "is_valid_iso_date": (
        contracts, ["contract_id"], lambda: F.coalesce(F.col(_DATE).rlike("^[12][0-9]{3}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(F.col(_DATE), "yyyy-MM-dd").isNotNull(), F.lit(False)), _C,
        f"coalesce(regexp_matches({_DATE}, '^[12][0-9]{{3}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_cast({_DATE} AS DATE) IS NOT NULL, false)",
    ),
    "is_placeholder": (
        _rules, ["id"], lambda: F.coalesce(T.is_placeholder(_col("from_value")), F.lit(True)), _R,
        "coalesce(NOT regexp_matches(from_value, '[\\p{L}\\p{N}]') OR regexp_replace(lower(" + _COLLAPSED.format("from_value") + "), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') IN (" + ", ".join(f"'{p}'" for p in T.PLACEHOLDERS) + "), true)",
    ),
    "house_rule_key": (_rules, ["id"], lambda: T.name_key(_col("from_value")), _R, "lower(trim(regexp_replace(regexp_replace(from_value, '[^\\p{L}\\p{N} ]', '', 'g'), ' +', ' ', 'g')))"),
    "without_legal_form": (
        _rules, ["id"], lambda: T.without_legal_form(_col("from_value")), _R,
        "regexp_replace(" + _sql_strip("from_value") + r", '(?i)([ ,]+(llc|inc|corp|co|ltd|plc|gmbh|b\.v|s\.a|l\.p|bv|sa|lp|company|limited|corporation|incorporated)\.?)+$', '')",
    ),
    "format_router": (
        _fixtures, ["fixture_id"], lambda: T.reader(_col("file_name")), _FX,
        "CASE " + " ".join(f"WHEN lower(regexp_extract(file_name, '\\.([^./\\\\]+)$', 1)) IN ({', '.join(repr(x) for x in g)}) THEN '{n}'" for n, g in T.READERS.items()) + " ELSE 'unsupported' END",
    ),
    "supported_extension": (
        _fixtures, ["fixture_id"], lambda: T.extension(_col("file_name")).isin([x for g in T.READERS.values() for x in g]), _FX,
        "lower(regexp_extract(file_name, '\\.([^./\\\\]+)$', 1)) IN (" + ", ".join(repr(x) for g in T.READERS.values() for x in g) + ")",
    ),
    "copy_name": (_fixtures, ["fixture_id"], lambda: F.concat(F.lit("COPY - "), F.col("file_name")), _FX, "'COPY - ' || file_name"),
    "needs_review_name": (
        _fixtures, ["fixture_id"], lambda: F.when(F.col("file_name").startswith("NEEDS REVIEW - "), F.regexp_replace("file_name", "^NEEDS REVIEW - ", "")).otherwise(F.concat(F.lit("NEEDS REVIEW - "), F.col("file_name"))), _FX,
        "CASE WHEN starts_with(file_name, 'NEEDS REVIEW - ') THEN substring(file_name, 16) ELSE 'NEEDS REVIEW - ' || file_name END",
    ),
    "windows_name_key": (_fixtures, ["fixture_id"], lambda: F.lower(F.regexp_replace("file_name", "[. ]+$", "")), _FX, "lower(regexp_replace(file_name, '[. ]+$', ''))"),
    "record_key": (contracts, ["contract_id"], lambda: T.record_key(_col("source_path")), _C, "substring(sha256(lower(replace(source_path, '\\', '/'))), 1, 32)"),
    "document_key": (contracts, ["contract_id"], lambda: F.sha2(F.concat_ws("|", F.lower("source_path"), F.col("file_size").cast("string"), "sha256"), 256), _C, "sha256(concat_ws('|', lower(source_path), file_size, sha256))"),
    "tune_holdout_split": (contracts, ["contract_id"], (lambda: F.conv(F.substring(F.sha2("contract_id", 256), 1, 2), 16, 10).cast("int") % 2), _C, "('0x' || substring(sha256(contract_id), 1, 2))::INT % 2"),
    "is_prior_ocr": (_signals, ["doc_id", "page"], lambda: (F.col("invisible") >= 500) & (F.col("image_coverage") >= 900), _PS, "invisible >= 500 AND image_coverage >= 900"),
    "page_needs_ocr": (
        _signals, ["doc_id", "page"], lambda: ((F.col("chars") < 20) & (F.col("image_coverage") >= 650)) | ((F.col("chars") < 200) & (F.col("image_coverage") >= 900)) | (F.col("replacement") > 30), _PS,
        "(chars < 20 AND image_coverage >= 650) OR (chars < 200 AND image_coverage >= 900) OR replacement > 30",
    ),
    "barely_readable": (_signals, ["doc_id", "page"], lambda: (F.col("image_coverage") > 0) & (F.col("chars") < 200), _PS, "image_coverage > 0 AND chars < 200"),
}
#: Results that keep the order of the text in Spark are compared in sorted order.
_SORTED = {"money_amounts": lambda: F.array_join(F.array_sort(T.money_amounts(F.col("line"))), "; ")}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, keys, value, _, _ = TABLE[name]
    return lambda spark, sf_dir: source(spark, sf_dir).select(*keys, _SORTED.get(name, value)().alias("value"))


QUERIES = {f"fn_{n}": _query(n) for n in TABLE}
ORACLE_SQL = {f"fn_{n}": f"SELECT {', '.join(t[1])}, {t[4]} AS value FROM {t[3]}" for n, t in TABLE.items()}
