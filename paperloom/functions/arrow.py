"""Text functions that the JVM can't express, as vectorised pandas functions."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

INVISIBLE = dict.fromkeys([0xAD, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF])
QUOTES = str.maketrans("‘’‚‛“”„‟‐‑‒–—―−", "''''\"\"\"\"-------")


def normalize_text(value: str) -> str:
    """Compatibility form without invisibles, case folded, one kind of quotes and dashes, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", value.translate(INVISIBLE)).casefold().translate(QUOTES).split())


def normalize_name(value: str) -> str:
    """As ``normalize_text`` without points, commas and quotes; a lone ``&`` reads ``and``."""
    return " ".join("and" if w == "&" else w for w in re.sub(r"[.,'\"]", "", normalize_text(value)).split())


_ENDS = re.compile(r".*?(?:\n|[.!?;](?=\s|$))|.+$", re.S)


def sentence_chunks(value: str, most: int) -> list[str]:
    """Verbatim chunks of whole sentences up to ``most`` characters; joined they give the text back.

    The last chunk may be up to twice as long; a longer one is cut hard.
    """
    if len(value) <= most:
        return [value]
    chunks: list[str] = []
    current = ""
    for m in _ENDS.finditer(value):
        sentence, ends = m.group(), m.end() < len(value) or value[-1] in ".!?;\n"
        if ends and current and len(current) + len(sentence) > most:
            chunks.append(current)
            current = ""
        current += sentence
    while len(current) > 2 * most:
        chunks.append(current[:most])
        current = current[most:]
    if current.strip():
        chunks.append(current)
    return chunks or [value]


class _Page(HTMLParser):
    """Text of a page: title first, cells between bars, blocks on lines of their own."""

    BREAKS = set("br p div li h1 h2 h3 h4 h5 h6 blockquote hr ul ol dl dt dd tr thead tbody tfoot table pre".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: list[str] = []
        self.within = {"script": 0, "style": 0, "head": 0, "title": 0, "pre": 0}
        self.cells = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.within:
            self.within[tag] += 1
        if tag == "body":
            self.within["head"] = 0
        if tag in self.BREAKS:
            self.out.append("\n")
            self.cells = 0
        if tag in ("td", "th"):
            if self.cells:
                self.out.append(" | ")
            self.cells += 1

    def handle_endtag(self, tag: str) -> None:
        if self.within.get(tag):
            self.within[tag] -= 1
        if tag in self.BREAKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if self.within["title"]:
            self.title.append(data)
        elif not (self.within["script"] or self.within["style"] or self.within["head"]):
            self.out.append(data if self.within["pre"] else re.sub(r"\s+", " ", data))


def html_text(value: str) -> str:
    """Readable text of a page of HTML; blank lines collapse to one."""
    page = _Page()
    page.feed(value)
    page.close()
    lines = ["".join(page.title).strip(), *(x.strip() for x in "".join(page.out).split("\n"))]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def word_distance(a: str, b: str) -> int:
    """Edit distance over words."""
    x, y = a.split(), b.split()
    row = list(range(len(y) + 1))
    for i, w in enumerate(x, 1):
        new = [i]
        for j, v in enumerate(y, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def log2_in_1024ths(numerator: int, denominator: int) -> int:
    """floor(1024 log2(n / d)), 0 where that is negative, from integers alone."""
    if denominator <= 0 or numerator <= denominator:
        return 0
    whole = (numerator // denominator).bit_length() - 1
    ratio, out = (numerator << 30) // (denominator << whole), whole << 10
    for bit in range(9, -1, -1):
        ratio = ratio * ratio >> 30
        if ratio >= 2 << 30:
            ratio >>= 1
            out |= 1 << bit
    return out


def _per_text(f, kind):
    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run


normalize = _per_text(normalize_text, StringType())
normalize_loosely = _per_text(normalize_name, StringType())
html_to_text = _per_text(html_text, StringType())


def split_sentences(most: int):
    """Column function of ``sentence_chunks``."""
    return _per_text(lambda v: sentence_chunks(v, most), ArrayType(StringType()))


@F.pandas_udf(IntegerType())
def levenshtein_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance over words of two columns."""
    return pd.Series([None if x is None or y is None else word_distance(x, y) for x, y in zip(a, b)], dtype="Int32")
