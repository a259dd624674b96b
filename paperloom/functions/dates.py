"""Dates as they are written, read by expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Months in full and in their usual short forms (fixed values).
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
ORDINAL = r"(?:st|nd|rd|th)?"
WRITTEN = (
    rf"\b([0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}|{MONTH}\.? [0-9]{{1,2}}{ORDINAL},? [0-9]{{4}}|[0-9]{{1,2}}{ORDINAL} {MONTH}\.?,? [0-9]{{4}}|[0-9]{{1,2}}-{MONTH}-[0-9]{{4}})\b"
)
_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"


def iso_of(token: Column) -> Column:
    """ISO form of one written date (lower case), null if there is no such day."""
    year_first = token.rlike("^[0-9]{4}")
    word = F.regexp_extract(token, r"(?:^|[0-9a-z] |-)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1)
    at = F.element_at(F.create_map(*[F.lit(x) for k in range(12) for x in (_STARTS[3 * k : 3 * k + 3], f"{k + 1:02d}")]), word)
    day = F.regexp_extract(token, r"(?:^|[a-z.] )([0-9]{1,2})(?:[^0-9]|$)", 1)
    written = F.concat_ws("-", F.regexp_extract(token, "([0-9]{4})$", 1), at, F.lpad(day, 2, "0"))
    iso = F.when(year_first, F.replace(token, F.lit("/"), F.lit("-"))).otherwise(written)
    return F.when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull() & iso.rlike("^[12]"), iso)


def stated_dates(c: Column) -> Column:
    """ISO dates stated on a line with a written month or year first, distinct, in order. Figures alone are left to the document's order."""
    tokens = F.regexp_extract_all(F.lower(F.regexp_replace(c, r"[ \t\r\n]+", " ")), F.lit(WRITTEN), 1)
    return F.array_distinct(F.filter(F.transform(tokens, iso_of), lambda d: d.isNotNull()))
