"""Text functions as Spark columns: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no subject (fixed values).
STOPWORDS = (
    "the and of to in an for by on or as at be is are was were this that with from its it any all such shall will may which each other under upon herein hereof"
    " thereof has have not than into their there these those been being if so but per"
).split()
#: Small words that a label may hold (fixed values).
LABEL_WORDS = "of and or to the for no. no by in on at per".split()
#: Values that state nothing (fixed values).
PLACEHOLDERS = ["null", "none", "n/a", "na", "nil", "unknown", "not stated", "not given", "not applicable", "tbd"]
#: Readers by extension (fixed values).
READERS = {
    "pdf": ["pdf"], "office": ["docx", "docm", "doc", "rtf", "odt", "pptx", "pptm", "ppsx", "ppt", "odp"], "open_workbook": ["ods"], "workbook": ["xlsx", "xlsm"],
    "legacy_workbook": ["xls"], "delimited": ["csv"], "eml": ["eml"], "msg": ["msg"], "text": ["txt", "md", "markdown"], "image": ["png", "jpg", "jpeg", "tif", "tiff"],
}


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"[ \t\r\n\x0B\f]+", " "))


def digit_masked(c: Column) -> Column:
    """Lower case with each run of figures as ``#``."""
    return F.lower(F.regexp_replace(c, "[0-9]+", "#"))


def estimated_tokens(c: Column) -> Column:
    """Figures and wide-script characters count one token each, others two in seven, rounded up."""
    single = F.length(F.regexp_replace(c, r"[^\p{N}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]", ""))
    other = F.length(c) - single
    return (single + F.floor((other * 2 + 6) / 7)).cast("bigint")


def contains_identifier(c: Column) -> Column:
    """Is there a token of at most 24 characters with two letters and two figures?"""
    return F.exists(
        F.split(c, r"[ \t\r\n\x0B\f]+"),
        lambda w: (F.length(w) <= 24) & (F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2) & (F.length(F.regexp_replace(w, "[^0-9]", "")) >= 2),
    )


def contains_money(c: Column) -> Column:
    """A currency sign with a figure close by, or a currency code."""
    return c.rlike(r"[$£][^0-9]{0,2}[0-9]") | c.contains("USD ") | c.contains("EUR ")


def carries_an_amount(c: Column) -> Column:
    """A currency sign and a figure, or a figure with exactly two decimals."""
    return c.rlike(r"[$£€] ?[0-9]|(^|[^0-9.,])[0-9][0-9,]*\.[0-9]{2}($|[^0-9.])")


def money_amounts(c: Column) -> Column:
    """Amounts with sign or code, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"((?:[$£€]|\b(?:USD|EUR|GBP|CAD)) *[0-9]+(?:[.,][0-9]+)*)"), 1))


def numeric_dates(c: Column) -> Column:
    """Tokens such as 3/14/2025, 14.03.2025 and 2025-03-14."""
    return F.regexp_extract_all(c, F.lit(r"\b([0-9]{1,4}[/.-][0-9]{1,2}[/.-][0-9]{2,4})\b"), 1)


def stem(c: Column) -> Column:
    """A word without ``'s``, ``ies`` as ``y``, and without a plural ``s``."""
    w = F.regexp_replace(c, "'s$", "")
    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .when((n >= 4) & w.endswith("s") & ~w.endswith("ss") & ~w.endswith("us") & ~w.endswith("is"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def terms_of(c: Column) -> Column:
    """Stems of the words that are no figures and no stopwords, in order, with repeats."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\p{N}+$") & ~w.isin(STOPWORDS))
    return F.transform(kept, stem)


def strip(c: Column) -> Column:
    """No white space outside."""
    return F.regexp_replace(c, r"^[ \t\r\n\x0B\f]+|[ \t\r\n\x0B\f]+$", "")


def _capitals(c: Column) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return (letters >= 3) & (F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) * 10 >= letters * 8)


def is_heading_line(c: Column, stripped: bool = False) -> Column:
    """At most 90 characters, four fifths of the letters capital, no colon at the end, no long sentence."""
    s = c if stripped else strip(c)
    words = F.size(F.split(s, r"[ \t]+"))
    return (s != "") & (F.length(s) <= 90) & ~s.endswith(":") & ~(s.endswith(".") & (words > 6)) & _capitals(s)


def is_list_item(c: Column, stripped: bool = False) -> Column:
    """A bullet, or a marker such as (a), 3) or (iv)."""
    s = c if stripped else strip(c)
    return (s.rlike(r"^([•◦▪‣●○■□–]|[-*+] )") & (F.length(s) > 2)) | s.rlike(r"^(?=[^ ]{1,6} )\(*([0-9]{1,2}|[a-z]|[ivx]+)\) ")


def is_table_separator(c: Column, stripped: bool = False) -> Column:
    """A row of dashes between bars."""
    return (c if stripped else strip(c)).rlike(r"^\|?( *:*-{3,}:* *\|)+( *:*-{3,}:* *)?$")


def is_label(c: Column) -> Column:
    """Short text with a capital first that names a field."""
    k = strip(F.regexp_replace(strip(c), ":+$", ""))
    words = F.split(k, r"[ \t]+")
    low = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Ll}") & ~w.isin(LABEL_WORDS)))
    return (
        (k != "") & (F.length(k) <= 40) & (F.size(words) <= 6) & k.rlike(r"^\p{Lu}") & ~k.rlike('["“”;,:]') & (low <= 2) & ~((F.size(words) > 3) & (low > 1))
    )


def key_of(c: Column, stripped: bool = False) -> Column:
    """The label of a ``Label: value`` line, or null."""
    s = c if stripped else strip(c)
    at = F.locate(": ", s)
    key, value = strip(F.substring_index(s, ": ", 1)), strip(F.substring(s, at + 2, F.length(s)))
    return F.when((at > 0) & (value != "") & is_label(key), key)


def value_of(c: Column, stripped: bool = False) -> Column:
    """The value of a ``Label: value`` line, or null."""
    s = c if stripped else strip(c)
    at = F.locate(": ", s)
    return F.when(key_of(s, True).isNotNull(), strip(F.substring(s, at + 2, F.length(s))))


def line_kind(c: Column, stripped: bool = False) -> Column:
    """Kind of a line, by the first test that fits."""
    s = c if stripped else strip(c)
    return (
        F.when(s == "", "blank").when(s.rlike(r"^#{1,6} +[^ ]"), "markdown_heading")
        .when(s.startswith("|") & is_table_separator(s, True), "table_separator").when(s.startswith("|"), "table_row")
        .when(is_list_item(s, True), "list_item").when(key_of(s, True).isNotNull(), "key_value").when(is_heading_line(s, True), "heading").otherwise("text")
    )


def table_cells(c: Column) -> Column:
    """Cells between unescaped bars, trimmed; empty cells stay."""
    inner = F.regexp_replace(strip(c), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda x: F.replace(strip(x), F.lit("\\|"), F.lit("|")))


def is_placeholder(c: Column) -> Column:
    """Does a value state nothing?"""
    core = F.regexp_replace(F.lower(collapse_whitespace(c)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return ~c.rlike(r"[\p{L}\p{N}]") | core.isin(PLACEHOLDERS)


def extension(c: Column) -> Column:
    """Lower-case extension of a file name, empty if none."""
    return F.lower(F.regexp_extract(c, r"\.([^./\\]+)$", 1))


def reader(c: Column) -> Column:
    """The reader for a file name, ``unsupported`` if none."""
    e, out = extension(c), None
    for name, group in READERS.items():
        out = F.when(e.isin(group), name) if out is None else out.when(e.isin(group), name)
    return out.otherwise("unsupported")


def tsv_cell(c: Column) -> Column:
    """A cell that spreadsheets read as text: guarded against formulas, quoted where needed."""
    guarded = F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)
    return F.when(guarded.rlike('[\t\r\n"]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def html_cell(c: Column) -> Column:
    """Text with the characters of markup escaped."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sanitize_cell(c: Column) -> Column:
    """One line, bars escaped, at most 1,000 characters and an ellipsis."""
    flat = F.replace(F.regexp_replace(c, r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) > 1000, F.concat(F.substring(flat, 1, 1000), F.lit("…"))).otherwise(flat)


def record_key(path: Column) -> Column:
    """First 32 hexadecimal digits of the digest of a path in lower case with forward slashes."""
    return F.substring(F.sha2(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), 256), 1, 32)


def name_key(c: Column) -> Column:
    """Letters, figures and single spaces in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N} ]", ""), " +", " ")))


def without_legal_form(c: Column) -> Column:
    """A name without the legal forms at its end."""
    return F.regexp_replace(strip(c), r"(?i)([ ,]+(llc|inc|corp|co|ltd|plc|gmbh|b\.v|s\.a|l\.p|bv|sa|lp|company|limited|corporation|incorporated)\.?)+$", "")


def head_and_tail(c: Column, head: int, tail: int) -> Column:
    """Both ends of a text longer than the two together."""
    return F.when(F.length(c) > head + tail, F.concat(F.substring(c, 1, head), F.right(c, F.lit(tail)))).otherwise(c)


def page_bucket(n: Column) -> Column:
    """Size class of a document by its pages."""
    return (
        F.when(n <= 1, "1").when(n <= 4, "2-4").when(n <= 9, "5-9").when(n <= 24, "10-24").when(n <= 49, "25-49").when(n <= 99, "50-99").otherwise("100+")
    )
