"""What the wording of a text says: whole words, labels, roles of dates, titles and names of files. All columns stay in the JVM."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wordings before a date that tell its role, the first that fits (fixed values).
ROLE_CUES = {
    "invoice": ["invoice date", "date of invoice", "invoice dated", "invoiced on", "bill date", "billing date", "statement date"],
    "notice": [
        "date of this notice", "notice date", "date of notice", "notice of termination dated", "notice of termination as of", "notice dated", "notice is given",
        "notice given", "notice is hereby given", "date of this letter", "letter date",
    ],
    "termination": ["terminat", "will end", "ends on", "separation date"],
    "amendment": ["amendment date", "amended as of", "amendment is dated", "amendment is effective", "amendment effective", "amendment is made", "amendment made as of"],
    "filing": ["filed on", "filing date", "date filed", "date of filing", "recorded on", "recording date"],
    "issuance": [
        "issued on", "issue date", "date of issue", "date issued", "issuance date", "journal date", "report date", "date of report", "order date", "po date", "ship date",
        "shipped on", "date shipped", "delivery date", "delivered on", "receipt date", "prepared on", "presented on", "published on", "publication date", "meeting date",
        "meeting held on", "held on", "date of meeting", "minutes of",
    ],
    "effective": [
        "effective", "commencement", "commencing", "commence", "start date", "starts on", "begins on", "beginning on", "in force", "entered into as of", "made as of",
        "made and entered into", "dated as of", "term begins",
    ],
    "execution": ["signed on", "signed this", "signed as of", "executed on", "executed this", "executed as of", "date signed", "signature date", "duly executed", "witness whereof"],
}
#: Labels that say a date is another event's, or the document's own (fixed values).
OTHER_DATES = ["due", "expiration", "expiry", "expires", "renewal", "end", "return", "deadline", "payable"]
ISSUE_LABELS = ["invoice date", "date of issue", "issue date", "statement date", "dated"]
OWN_FIELDS = ["released", "notice date"]
GENERIC_LABELS = ["date:", "dated", "date of this"]
#: Labels of a subject; small words and initialisms of titles (fixed values).
SUBJECT_LABELS = [
    "project", "purpose", "confidential purpose", "subject", "re", "regarding", "matter", "premises", "property", "position", "job title", "title", "role", "services",
    "scope", "description", "goods", "work", "equipment",
]
SMALL_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
INITIALISMS = ["nda", "sow", "po", "wo", "msa", "loi", "mou", "rfp", "rfq", "sla", "ip", "hr", "it", "llc", "inc", "ltd", "plc", "gmbh", "lp", "llp", "usa", "uk", "eu"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Characters that take no place in print (fixed values).
INVISIBLE = r"[\x{AD}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}\x{2066}-\x{2069}\x{FEFF}]"
#: A date in figures or with its month in words, in small letters.
DATE = (
    r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/.][0-9]{1,2}[/.](?:[0-9]{4}|[0-9]{2})|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? [0-9]{1,2}, [0-9]{4}"
    r"|[0-9]{1,2} (?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? [0-9]{4})"
)
WINDOW = 96
_W = r"[\p{L}\p{N}]"


def escaped(c: Column) -> Column:
    """A text as a pattern that matches it and nothing else."""
    return F.regexp_replace(c, r"([\\^$.|?*+()\[\]{}\-#&~])", r"\\$1")


def contains_whole(text: Column, wanted: Column) -> Column:
    """Does a text hold another one with no letter or digit running into those at its ends?"""
    left = F.when(wanted.rlike("^" + _W), f"(?:^|[^{_W[1:-1]}])").otherwise("")
    right = F.when(wanted.rlike(_W + "$"), f"(?:$|[^{_W[1:-1]}])").otherwise("")
    return (wanted != "") & F.regexp_like(text, F.concat(F.lit("(?s)"), left, escaped(wanted), right))


def loosely(c: Column) -> Column:
    """Small letters without the punctuation that names are written with or without; a lone & reads ``and``."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(c), "[.,'\"’“”]", ""), r"\s+", " ")
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), flat, F.lit(" ")), " & ", " and "))


def count_cues(c: Column, cues: list[str]) -> Column:
    """How many of the cues a text holds, whatever their case."""
    low = F.lower(c)
    return sum((F.when(low.contains(x), 1).otherwise(0) for x in cues), F.lit(0))


def leading_month(c: Column) -> Column:
    """The month that a text begins with, in full or in short; null without one."""
    low = F.ltrim(F.lower(c))
    out = F.lit(None).cast("int")
    for k, m in reversed(list(enumerate(MONTHS, 1))):
        out = F.when(low.rlike(f"^{m[:3]}(?:[^a-z]|$)"), k).otherwise(out)
    for k, m in reversed(list(enumerate(MONTHS, 1))):
        out = F.when(low.startswith(m), k).otherwise(out)
    return out


_MARK = r"[().:\-]*"
_TOKENS = {
    "word": r"(?i:section|article|clause|part|§|item|paragraph)\.*",
    "label": rf"(?:{_MARK}[0-9](?:[0-9.]{{0,10}}[0-9])?{_MARK}|{_MARK}(?:[ivxIVX]{{1,5}}|[A-Za-z]){_MARK}[.):])",
    "after": rf"{_MARK}(?:[ivxIVX]{{1,5}}|[A-Za-z]){_MARK}",
}
#: Up to three clause labels; a letter or Roman figure without a mark is one only after a word such as "Section".
ENUMERATORS = r"^\s*(?:" + "|".join(
    "".join(rf"{_TOKENS[t]}(?:\s+|$)" for t in run)
    for n in (3, 2, 1) for run in product(("word", "label", "after"), repeat=n)
    if all(t != "after" or k and run[k - 1] == "word" for k, t in enumerate(run))
) + ")?"


def strip_enumerators(c: Column) -> Column:
    """A text without the clause labels that it begins with."""
    return F.regexp_replace(c, ENUMERATORS, "")


def label_of(c: Column) -> Column:
    """The short label before a colon, or null."""
    label = F.trim(F.regexp_extract(c, r"(?s)^([^:]*):", 1))
    value = F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1)
    return F.when((label != "") & (F.size(F.split(label, r"\s+")) <= 4) & ~label.rlike("[0-9]") & value.rlike(_W), label)


def value_of(c: Column) -> Column:
    """The value after a short label, or null."""
    return F.when(label_of(c).isNotNull(), F.trim(F.regexp_extract(c, r"(?s)^[^:]*:(.*)$", 1)))


def subject_value(c: Column) -> Column:
    """A subject without its label; null where the label names something else."""
    label = F.lower(F.regexp_replace(label_of(c), rf"^[^{_W[1:-1]}]+|[^{_W[1:-1]}]+$", ""))
    return F.when(label.isNull(), F.trim(c)).when(label.isin(SUBJECT_LABELS), value_of(c))


def without_invisible(c: Column) -> Column:
    """A text without characters that take no place."""
    return F.regexp_replace(c, INVISIBLE, "")


def is_form_code(c: Column) -> Column:
    """Is a token the code of a standard form: letters and digits with one mark at most?"""
    return c.rlike("[0-9]") & c.rlike(r"\p{L}") & (F.length(F.regexp_replace(c, r"[^\-.:]", "")) < 2)


def sanitize_extension(c: Column) -> Column:
    """The letters and digits of an extension, small, sixteen at most."""
    return F.substring(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")), 1, 16)


def strip_duplicate_extension(name: Column, extension: Column) -> Column:
    """A name without its extension, however often it is repeated."""
    return F.when(extension == "", name).otherwise(F.regexp_replace(name, F.concat(F.lit(r"(?i)(?:\."), escaped(extension), F.lit(")+$")), F.lit("")))


def leading_date(c: Column) -> Column:
    """The ISO date that a name begins with, if it ends there and exists."""
    d = F.regexp_extract(c, rf"^([12][0-9]{{3}}-[0-9]{{2}}-[0-9]{{2}})(?:[^{_W[1:-1]}]|$)", 1)
    return F.when(F.try_to_date(d, "yyyy-MM-dd").isNotNull(), d)


def year_is_plausible(c: Column, current_year: int) -> Column:
    """Is the year of an ISO date one that a document could carry?"""
    year = F.regexp_extract(c, "^([0-9]{4})", 1).try_cast("int")
    return year.isNull() | year.between(1900, current_year + 10)


def last_word_at(c: Column, word: str) -> Column:
    """Where a word stands whole for the last time, from 0; null where it doesn't."""
    before = rf"(?s)^(.*[^{_W[1:-1]}]|){word}(?:[^{_W[1:-1]}]|$)"
    return F.when(c.rlike(before), F.length(F.regexp_extract(c, before, 1)))


def title_case(c: Column) -> Column:
    """Title case of a heading all in capitals; others stay as they are."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")

    def one(w: Column, k: Column) -> Column:
        low = F.lower(w)
        core = F.regexp_replace(low, rf"^[^{_W[1:-1]}]+|[^{_W[1:-1]}]+$", "")
        return F.when(core.isin(INITIALISMS), F.upper(w)).when((k > 0) & core.isin(SMALL_WORDS), low).otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 20)))

    return F.when(F.regexp_replace(c, r"[^\p{L}]", "").rlike(r"[^\p{Lu}]"), c).otherwise(F.array_join(F.transform(words, one), " "))


def same_word(word: Column, wanted: Column) -> Column:
    """Are two words one, the s of a plural aside?"""
    return (word == wanted) | ((F.length(wanted) > 3) & ((word == F.concat(wanted, F.lit("s"))) | (wanted == F.concat(word, F.lit("s")))))


def phrase_positions(words: Column, phrase: list[str]) -> Column:
    """Places, from 0, where the words of a phrase stand together in an array of words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - len(phrase), F.lit(0)))
    hits = F.filter(starts, lambda k: F.lit(True) if not phrase else _all([same_word(F.get(words, k + n), F.lit(p)) for n, p in enumerate(phrase)]))
    return F.when(F.size(words) >= max(1, len(phrase)), hits).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def date_windows(line: Column) -> Column:
    """date, wording of each date of a line in small letters: the wording stands before it, back to the date or sentence before, 96 characters at most."""
    low = F.lower(F.regexp_replace(line, r"\s+", " "))
    before = F.split(low, DATE)
    return F.transform(
        F.regexp_extract_all(low, F.lit(f"({DATE})"), 1),
        lambda d, k: F.struct(d.alias("date"), F.regexp_replace(F.right(F.get(before, k), F.lit(WINDOW)), r"^.*\. ", "").alias("wording")),
    )


def date_role(wording: Column) -> Column:
    """The role that the wording before a date gives it, or null."""
    out = F.lit(None).cast("string")
    for role, cues in reversed(ROLE_CUES.items()):
        out = F.when(_holds(wording, cues), role).otherwise(out)
    return out


def _holds(c: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for x in cues:
        out = out | c.contains(x)
    return out


def labels_another_date(wording: Column) -> Column:
    """Does the last ``date`` of a wording belong to another event, such as a due date?"""
    return wording.rlike(rf"(?:{'|'.join(OTHER_DATES)})\s*date(?:[^d]|d[^a]|da[^t]|dat[^e])*$")


def _whole(labels: list[str]) -> str:
    return "|".join(rf"(?:^|[^{_W[1:-1]}]){x}" + (rf"(?:[^{_W[1:-1]}]|$)" if x[-1].isalpha() else "") for x in labels)


def labels_the_issue_date(wording: Column) -> Column:
    """Does the wording before a date say that it is the document's own?"""
    named = wording.rlike(_whole(ISSUE_LABELS)) | wording.rlike(rf"(?:^|[^{_W[1:-1]}])(?:{'|'.join(OWN_FIELDS)})\s*[:|]\s*$")
    generic = wording.rlike(_whole(GENERIC_LABELS)) | wording.rlike(rf"(?:^|[^{_W[1:-1]}])date\s*$")
    qualified = wording.rlike(rf"\p{{L}}\s*[^{_W[1:-1]}]date(?:[^{_W[1:-1]}][^d]*)?$")
    return ~labels_another_date(wording) & (named | (generic & ~qualified))
