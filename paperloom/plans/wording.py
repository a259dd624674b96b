"""Wording of texts over whole tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import wording as W
from paperloom.plans.scalars import _LINES, documents, lines
from paperloom.session import table

_N = r"[^\p{L}\p{N}]"
_RULES = "(SELECT DISTINCT id, from_value, to_value FROM house_rules WHERE from_value IS NOT NULL AND to_value IS NOT NULL)"
_FILES = "(SELECT DISTINCT fixture_id, file_name FROM expected_fixture WHERE file_name IS NOT NULL)"
_DOCS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_LABEL = "trim(regexp_extract(line, '^([^:]*):', 1))"
_AFTER = "regexp_extract(line, '(?s)^[^:]*:(.*)$', 1)"
_IS_LABEL = f"({_LABEL} <> '' AND len(regexp_split_to_array({_LABEL}, '\\s+')) <= 4 AND NOT regexp_matches({_LABEL}, '[0-9]') AND regexp_matches({_AFTER}, '[\\p{{L}}\\p{{N}}]'))"
_LOOSE = "trim(replace(' ' || regexp_replace(regexp_replace(lower({0}), '[.,''\"’“”]', '', 'g'), '\\s+', ' ', 'g') || ' ', ' & ', ' and '))"
_WHOLE = (
    "({1} <> '' AND regexp_matches({0}, '(?s)' || CASE WHEN regexp_matches({1}, '^[\\p{{L}}\\p{{N}}]') THEN '(?:^|[^\\p{{L}}\\p{{N}}])' ELSE '' END || regexp_escape({1})"
    " || CASE WHEN regexp_matches({1}, '[\\p{{L}}\\p{{N}}]$') THEN '(?:$|[^\\p{{L}}\\p{{N}}])' ELSE '' END))"
)
_SIGNED = ["signature", "signed", "by:", "name:", "title:", "witness"]


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "house_rules").where("from_value IS NOT NULL AND to_value IS NOT NULL").select("id", "from_value", "to_value").distinct()


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "expected_fixture").where("file_name IS NOT NULL").select("fixture_id", "file_name").distinct()


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CORE = f"regexp_replace(lower(w), '^{_N}+|{_N}+$', '', 'g')"
_TITLE = (
    "CASE WHEN regexp_matches(regexp_replace(line, '[^\\p{L}]', '', 'g'), '[^\\p{Lu}]') THEN line ELSE array_to_string(list_transform(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> ''),"
    f" lambda w, k: CASE WHEN {_CORE} IN ({_quoted(W.INITIALISMS)}) THEN upper(w) WHEN k > 1 AND {_CORE} IN ({_quoted(W.SMALL_WORDS)}) THEN lower(w) ELSE upper(substring(lower(w), 1, 1)) || substring(lower(w), 2) END), ' ') END"
)
_MONTH = (
    "CASE " + " ".join(f"WHEN starts_with(ltrim(lower(line)), '{m}') THEN {k}" for k, m in enumerate(W.MONTHS, 1)) + " "
    + " ".join(f"WHEN regexp_matches(ltrim(lower(line)), '^{m[:3]}(?:[^a-z]|$)') THEN {k}" for k, m in enumerate(W.MONTHS, 1)) + " END"
)

#: Query: (source, keys, its columns, the source in SQL, the same in SQL).
TABLE: dict[str, tuple[Callable, list[str], dict[str, Callable], str, dict[str, str]]] = {
    "contains_whole": (
        _rules, ["id"], {"value": lambda: W.contains_whole(F.lower("to_value"), F.lower(F.regexp_extract("from_value", "^[^ ]*", 0)))}, _RULES,
        {"value": _WHOLE.format("lower(to_value)", "lower(regexp_extract(from_value, '^[^ ]*', 0))")},
    ),
    "contains_loosely": (
        _rules, ["id"], {"value": lambda: W.contains_whole(W.loosely(F.col("to_value")), W.loosely(F.col("from_value")))}, _RULES,
        {"value": _WHOLE.format(_LOOSE.format("to_value"), _LOOSE.format("from_value"))},
    ),
    "count_cues": (lines, ["doc_id", "line_no"], {"value": lambda: W.count_cues(F.col("line"), _SIGNED)}, _LINES, {"value": " + ".join(f"(CASE WHEN contains(lower(line), '{c}') THEN 1 ELSE 0 END)" for c in _SIGNED)}),
    "leading_month": (lines, ["doc_id", "line_no"], {"value": lambda: W.leading_month(F.col("line"))}, _LINES, {"value": _MONTH}),
    "strip_enumerators": (lines, ["doc_id", "line_no"], {"value": lambda: W.strip_enumerators(F.col("line"))}, _LINES, {"value": f"regexp_replace(line, '{W.ENUMERATORS}', '')"}),
    "label_and_value": (
        lines, ["doc_id", "line_no"], {"label": lambda: W.label_of(F.col("line")), "value": lambda: W.value_of(F.col("line"))}, _LINES,
        {"label": f"CASE WHEN {_IS_LABEL} THEN {_LABEL} END", "value": f"CASE WHEN {_IS_LABEL} THEN trim({_AFTER}) END"},
    ),
    "subject_value": (
        lines, ["doc_id", "line_no"], {"value": lambda: W.subject_value(F.col("line"))}, _LINES,
        {"value": f"CASE WHEN NOT {_IS_LABEL} THEN trim(line) WHEN lower(regexp_replace({_LABEL}, '^{_N}+|{_N}+$', '', 'g')) IN ({_quoted(W.SUBJECT_LABELS)}) THEN trim({_AFTER}) END"},
    ),
    "without_invisible": (documents, ["doc_id"], {"value": lambda: W.without_invisible(F.col("text"))}, _DOCS, {"value": f"regexp_replace(text, '{W.INVISIBLE}', '', 'g')"}),
    "form_codes": (
        lambda s, d: lines(s, d).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("k", "token")).where("token <> ''"), ["doc_id", "line_no", "k"], {"value": lambda: W.is_form_code(F.col("token"))},
        f"(SELECT doc_id, line_no, unnest(range(len(string_split(line, ' ')))) AS k, unnest(string_split(line, ' ')) AS token FROM {_LINES}) WHERE token <> ''",
        {"value": "regexp_matches(token, '[0-9]') AND regexp_matches(token, '\\p{L}') AND length(regexp_replace(token, '[^\\-.:]', '', 'g')) < 2"},
    ),
    "sanitize_extension": (
        _files, ["fixture_id"], {"value": lambda: W.sanitize_extension(F.regexp_extract("file_name", r"\.([^.]*)$", 1))}, _FILES,
        {"value": "substring(lower(regexp_replace(regexp_extract(file_name, '\\.([^.]*)$', 1), '[^A-Za-z0-9]', '', 'g')), 1, 16)"},
    ),
    "strip_duplicate_extension": (
        _files, ["fixture_id"], {"value": lambda: W.strip_duplicate_extension(F.concat("file_name", F.lit("."), F.upper(F.regexp_extract("file_name", r"\.([^.]*)$", 1))), F.regexp_extract("file_name", r"\.([^.]*)$", 1))}, _FILES,
        {"value": "CASE WHEN regexp_extract(file_name, '\\.([^.]*)$', 1) = '' THEN file_name || '.' ELSE regexp_replace(file_name || '.' || upper(regexp_extract(file_name, '\\.([^.]*)$', 1)), '(?i)(?:\\.' || regexp_escape(regexp_extract(file_name, '\\.([^.]*)$', 1)) || ')+$', '') END"},
    ),
    "leading_date": (
        lines, ["doc_id", "line_no"], {"value": lambda: W.leading_date(F.col("line"))}, f"(SELECT *, regexp_extract(line, '^([12][0-9]{{3}}-[0-9]{{2}}-[0-9]{{2}})(?:{_N}|$)', 1) AS d FROM {_LINES})",
        {"value": "CASE WHEN try_cast(nullif(d, '') AS DATE) IS NOT NULL THEN d END"},
    ),
    "year_is_plausible": (
        lambda s, d: table(s, d, "sample_contract").select("contract_id", "agreement_date").distinct().where("agreement_date IS NOT NULL"), ["contract_id", "agreement_date"], {"value": lambda: W.year_is_plausible(F.col("agreement_date"), 2026)},
        "(SELECT DISTINCT contract_id, agreement_date, try_cast(nullif(regexp_extract(agreement_date, '^([0-9]{4})', 1), '') AS INT) AS y FROM sample_contract WHERE agreement_date IS NOT NULL)", {"value": "y IS NULL OR y BETWEEN 1900 AND 2036"},
    ),
    "last_word_at": (
        lines, ["doc_id", "line_no"], {"value": lambda: W.last_word_at(F.lower("line"), "date")}, _LINES,
        {"value": f"CASE WHEN regexp_matches(lower(line), '(?s)^(.*{_N}|)date(?:{_N}|$)') THEN length(regexp_extract(lower(line), '(?s)^(.*{_N}|)date(?:{_N}|$)', 1)) END"},
    ),
    "title_case": (lines, ["doc_id", "line_no"], {"value": lambda: W.title_case(F.col("line"))}, _LINES, {"value": _TITLE}),
    "phrase_positions": (
        lines, ["doc_id", "line_no"], {"value": lambda: F.array_join(W.phrase_positions(F.split(F.lower("line"), "[^a-z0-9]+"), ["purchase", "orders"]).cast("array<string>"), ",")}, f"(SELECT doc_id, line_no, regexp_split_to_array(lower(line), '[^a-z0-9]+') AS w FROM {_LINES})",
        {"value": "array_to_string(list_filter(range(len(w) - 1), lambda k: w[k + 1] IN ('purchase', 'purchases') AND w[k + 2] IN ('order', 'orders', 'orderss')), ',')"},
    ),
}

_SPLIT = f"""(SELECT doc_id, line_no, unnest(regexp_extract_all(low, '{W.DATE}')) AS date, unnest(regexp_split_to_array(low, '{W.DATE}')) AS before
    FROM (SELECT doc_id, line_no, lower(regexp_replace(line, '\\s+', ' ', 'g')) AS low FROM {_LINES}))"""
_ROLE = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(wording, '{c}')''' for c in cues)} THEN '{role}'" for role, cues in W.ROLE_CUES.items()) + " END"
_ANOTHER = f"regexp_matches(wording, '(?:{'|'.join(W.OTHER_DATES)})\\s*date(?:[^d]|d[^a]|da[^t]|dat[^e])*$')"
_ISSUE = (
    f"NOT {_ANOTHER} AND (regexp_matches(wording, '{W._whole(W.ISSUE_LABELS)}') OR regexp_matches(wording, '(?:^|{_N})(?:{'|'.join(W.OWN_FIELDS)})\\s*[:|]\\s*$')"
    f" OR ((regexp_matches(wording, '{W._whole(W.GENERIC_LABELS)}') OR regexp_matches(wording, '(?:^|{_N})date\\s*$')) AND NOT regexp_matches(wording, '\\p{{L}}\\s*{_N}date(?:{_N}[^d]*)?$')))"
)


def date_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of all lines with the wording before them, the role it gives them, and whether it labels the document's own date."""
    found = lines(spark, sf_dir).where(F.col("line").rlike("[0-9]")).select("doc_id", "line_no", F.explode(W.date_windows(F.col("line"))).alias("d"))
    w = F.col("d.wording")
    return found.select("doc_id", "line_no", "d.date", w.alias("wording"), W.date_role(w).alias("role"), W.labels_the_issue_date(w).alias("own"), W.labels_another_date(w).alias("another"))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    source, keys, columns, _, _ = TABLE[name]
    return lambda spark, sf_dir: source(spark, sf_dir).select(*keys, *[c().alias(n) for n, c in columns.items()])


QUERIES = {f"fn_{n}": _query(n) for n in TABLE} | {"date_roles": date_roles}
ORACLE_SQL = {f"fn_{n}": f"SELECT {', '.join(t[1])}, {', '.join(f'{sql} AS {c}' for c, sql in t[4].items())} FROM {t[3]}" for n, t in TABLE.items()} | {
    "date_roles": f"SELECT doc_id, line_no, date, wording, {_ROLE} AS role, {_ISSUE} AS own, {_ANOTHER} AS another FROM (SELECT doc_id, line_no, date, regexp_replace(right(before, {W.WINDOW}), '^.*\\. ', '') AS wording FROM {_SPLIT} WHERE date IS NOT NULL)",
}
