"""Entities of lines, fields of recorded replies, and whether documents support them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import dates as D
from paperloom.functions import text as T, wording as W
from paperloom.plans.scalars import _LINES, _S, TERMS_SQL, documents, lines
from paperloom.plans.wording import _LOOSE, _WHOLE
from paperloom.session import table

#: Words that end the name of an organisation (fixed values, compared without case and points).
ENDINGS = "LLC|Inc|Incorporated|Corp|Corporation|Co|Company|Ltd|Limited|PLC|GmbH|Bank|Trust|Fund|Foundation|University|Group|Partners|Association|Cooperative"
ORGANIZATION = rf"((?:\p{{Lu}}[\p{{L}}'’.-]*,? (?:(?:&|and|of) )?){{1,7}}(?:{ENDINGS})\b)"
PERSON = r"(?:\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof)\.?|\bDear|/s/) (\p{Lu}[\p{L}'’-]*(?: \p{Lu}\.?)?(?: \p{Lu}[\p{L}'’-]+)+)"
RUN = r"(\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’-]*)+)"
DEFINED = r'"([^"]{1,80})" (?:means|shall mean|has the meaning)'
_ISO_SQL = (
    "CASE WHEN regexp_matches(t, '^[0-9]{{4}}') THEN replace(t, '/', '-') ELSE regexp_extract(t, '([0-9]{{4}})$', 1) || '-' || lpad(((strpos('janfebmaraprmayjunjulaugsepoctnovdec',"
    " regexp_extract(t, '(?:^|[0-9a-z] |-)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)', 1)) + 2) // 3)::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(t, '(?:^|[a-z.] )([0-9]{{1,2}})(?:[^0-9]|$)', 1), 2, '0') END"
).replace("{{", "{").replace("}}", "}")
STATED_SQL = (
    "list_filter(list_transform(regexp_extract_all(lower(regexp_replace({0}, '[ \\t\\r\\n]+', ' ', 'g')), '" + D.WRITTEN.replace("{", "{{").replace("}", "}}") + "', 1), lambda t: " + _ISO_SQL.replace("{", "{{").replace("}", "}}")
    + "), lambda d: try_cast(d AS DATE) IS NOT NULL AND regexp_matches(d, '^[12]'))"
)


def _joined(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), "; ")


def _sql_joined(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), '; ')"


def _line_query(value: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: lines(spark, sf_dir).select("doc_id", "line_no", value().alias("value"))


_LINE_QUERIES: dict[str, tuple[Callable[[], Column], str]] = {
    "ent_stated_dates": (lambda: _joined(D.stated_dates(F.col("line"))), _sql_joined(STATED_SQL.format("line"))),
    "ent_organizations": (lambda: _joined(F.regexp_extract_all("line", F.lit(ORGANIZATION), 1)), _sql_joined(f"regexp_extract_all(line, '{ORGANIZATION.replace(chr(39), chr(39) * 2)}', 1)")),
    "ent_people": (lambda: _joined(F.regexp_extract_all("line", F.lit(PERSON), 1)), _sql_joined(f"regexp_extract_all(line, '{PERSON.replace(chr(39), chr(39) * 2)}', 1)")),
    "ent_proper_name_runs": (lambda: F.size(F.regexp_extract_all("line", F.lit(RUN), 1)), f"len(regexp_extract_all(line, '{RUN.replace(chr(39), chr(39) * 2)}', 1))::INT"),
    "ent_defined_terms": (lambda: _joined(F.slice(F.regexp_extract_all("line", F.lit(DEFINED), 1), 1, 8)), _sql_joined(f"regexp_extract_all(line, '{DEFINED}', 1)[1:8]")),
    "ent_identifiers": (
        lambda: _joined(F.filter(F.split("line", r"[ \t\r,;:()]+"), lambda w: (F.length(w) <= 24) & w.rlike(r"^\p{Lu}[\p{Lu}\p{N}/-]*[0-9][\p{Lu}\p{N}/-]*$") & (F.length(F.regexp_replace(w, "[^0-9]", "")) >= 2))),
        _sql_joined(r"list_filter(regexp_split_to_array(line, '[ \t\r,;:()]+'), lambda w: length(w) <= 24 AND regexp_matches(w, '^\p{Lu}[\p{Lu}\p{N}/-]*[0-9][\p{Lu}\p{N}/-]*$') AND length(regexp_replace(w, '[^0-9]', '', 'g')) >= 2)"),
    ),
}


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "chat_message").where("turn_role = 'assistant' AND content IS NOT NULL").dropDuplicates(["message_id"])
    one = lambda f: F.nullif(F.regexp_extract("content", rf'"{f}":"([^"]*)"', 1), F.lit(""))
    return chats.select("message_id", "doc_id", one("document_type").alias("document_type"), one("document_date").alias("document_date"), one("subject").alias("subject"), F.regexp_extract_all("content", F.lit(r'"name":"([^"]*)"'), 1).alias("parties"))


def reply_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the recorded replies, read leniently."""
    return _replies(spark, sf_dir).select("message_id", "document_type", "document_date", "subject", F.array_join("parties", "; ").alias("parties"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "worker_document").dropDuplicates(["doc_id"])
    return papers.select("doc_id", T.collapse_whitespace(F.lower(F.array_join("pages.text", " "))).alias("t"))


def party_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each party of a reply stand in its document, as whole words and whatever its punctuation?"""
    asked = _replies(spark, sf_dir).select("message_id", "doc_id", F.explode(F.array_distinct("parties")).alias("party"))
    return asked.join(_texts(spark, sf_dir), "doc_id").select("message_id", "party", W.contains_whole(W.loosely(F.col("t")), W.loosely(F.col("party"))).alias("supported"))


def spellings(iso: Column) -> Column:
    """Ways to write an ISO date in figures and words, lower case."""
    d = F.try_to_date(iso, "yyyy-MM-dd")
    forms = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "M/d/yyyy", "dd/MM/yyyy", "d/M/yyyy", "dd.MM.yyyy", "d.M.yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMM. d, yyyy", "d MMMM yyyy", "d MMM yyyy"]
    return F.array_distinct(F.array(*[F.lower(F.date_format(d, f)) for f in forms]))


_FORMS = "%Y-%m-%d|%Y/%m/%d|%m/%d/%Y|%-m/%-d/%Y|%d/%m/%Y|%-d/%-m/%Y|%d.%m.%Y|%-d.%-m.%Y|%B %-d, %Y|%b %-d, %Y|%b. %-d, %Y|%-d %B %Y|%-d %b %Y".split("|")
_SPELLED = "list_distinct([" + ", ".join(f"lower(strftime(try_cast(document_date AS DATE), '{f}'))" for f in _FORMS) + "])"


def date_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling of the dates of the fixtures."""
    f = table(spark, sf_dir, "expected_fixture").where("document_date IS NOT NULL").dropDuplicates(["fixture_id"])
    return f.where(F.try_to_date("document_date", "yyyy-MM-dd").isNotNull()).select("fixture_id", F.explode(spellings(F.col("document_date"))).alias("spelling"))


def date_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the date of a reply stand in its document in any spelling?"""
    asked = _replies(spark, sf_dir).where(F.try_to_date("document_date", "yyyy-MM-dd").isNotNull())
    return asked.join(_texts(spark, sf_dir), "doc_id").select("message_id", "document_date", F.exists(spellings(F.col("document_date")), lambda s: F.col("t").contains(s)).alias("supported"))


def type_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do three fifths of the words of a reply's type stand in its document?"""
    asked = _replies(spark, sf_dir).where("document_type IS NOT NULL").withColumn("w", F.array_distinct(T.terms_of(F.col("document_type"))))
    both = asked.where(F.size("w") > 0).join(_texts(spark, sf_dir), "doc_id")
    return both.select("message_id", "document_type", (F.size(F.array_intersect("w", T.terms_of(F.col("t")))) * 10 >= F.size("w") * 6).alias("supported"))


def stated_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates that a document states, and on how many lines."""
    return lines(spark, sf_dir).select("doc_id", F.explode(D.stated_dates(F.col("line"))).alias("iso")).groupBy("doc_id", "iso").agg(F.count("*").alias("n"))


def date_lines_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 14 different lines of a document that state a date, at most 150 characters each."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    dated = lines(spark, sf_dir).where(F.size(D.stated_dates(F.col("line"))) > 0).groupBy("doc_id", T.strip(F.col("line")).alias("line")).agg(F.min("line_no").alias("line_no"))
    return dated.withColumn("k", F.row_number().over(w)).where("k <= 14").select("doc_id", "line_no", F.substring("line", 1, 150).alias("line"))


_R = """r AS (SELECT message_id, doc_id, nullif(regexp_extract(content, '"document_type":"([^"]*)"', 1), '') AS document_type, nullif(regexp_extract(content, '"document_date":"([^"]*)"', 1), '') AS document_date,
    nullif(regexp_extract(content, '"subject":"([^"]*)"', 1), '') AS subject, regexp_extract_all(content, '"name":"([^"]*)"', 1) AS parties
    FROM (SELECT DISTINCT message_id, doc_id, content FROM chat_message WHERE turn_role = 'assistant' AND content IS NOT NULL))"""
_T = "t AS (SELECT doc_id, trim(regexp_replace(lower(array_to_string(list_transform(pages, lambda p: p.text), ' ')), '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g')) AS t FROM (SELECT DISTINCT ON (doc_id) doc_id, pages FROM worker_document))"

QUERIES = {n: _line_query(v) for n, (v, _) in _LINE_QUERIES.items()} | {
    "reply_fields": reply_fields, "party_support": party_support, "date_spellings": date_spellings, "date_support": date_support, "type_support": type_support, "stated_by_document": stated_by_document, "date_lines_top": date_lines_top,
}
ORACLE_SQL = {n: f"SELECT doc_id, line_no, {sql} AS value FROM {_LINES}" for n, (_, sql) in _LINE_QUERIES.items()} | {
    "reply_fields": f"WITH {_R} SELECT message_id, document_type, document_date, subject, array_to_string(parties, '; ') AS parties FROM r",
    "party_support": f"WITH {_R}, {_T}, a AS (SELECT message_id, doc_id, unnest(list_distinct(parties)) AS party FROM r) SELECT message_id, party, {_WHOLE.format(_LOOSE.format('t'), _LOOSE.format('party'))} AS supported FROM a JOIN t USING (doc_id)",
    "date_spellings": f"SELECT fixture_id, unnest({_SPELLED}) AS spelling FROM (SELECT DISTINCT fixture_id, document_date FROM expected_fixture) WHERE try_cast(document_date AS DATE) IS NOT NULL",
    "date_support": f"WITH {_R}, {_T} SELECT message_id, document_date, len(list_filter({_SPELLED}, lambda s: contains(t, s))) > 0 AS supported FROM r JOIN t USING (doc_id) WHERE try_cast(document_date AS DATE) IS NOT NULL",
    "type_support": f"WITH {_R}, {_T}, a AS (SELECT message_id, doc_id, document_type, list_distinct({TERMS_SQL.format('document_type')}) AS w FROM r WHERE document_type IS NOT NULL) SELECT message_id, document_type, len(list_intersect(w, {TERMS_SQL.format('t')})) * 10 >= len(w) * 6 AS supported FROM a JOIN t USING (doc_id) WHERE len(w) > 0",
    "stated_by_document": f"WITH s AS (SELECT doc_id, unnest(list_distinct({STATED_SQL.format('line')})) AS iso FROM {_LINES}) SELECT doc_id, iso, count(*) AS n FROM s GROUP BY ALL",
    "date_lines_top": f"SELECT doc_id, line_no, substring(line, 1, 150) AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM (SELECT doc_id, {_S} AS line, min(line_no) AS line_no FROM {_LINES} WHERE len({STATED_SQL.format('line')}) > 0 GROUP BY ALL)) WHERE k <= 14",
}
