"""Text of scanned pages: noise found, and repaired into paragraphs.

Method. Running headers and footers are edge lines that return on at least three
pages of a document once digits are masked and confusable glyphs folded to one
skeleton; page numbers are edge lines that only number the page. Words are
counted over the whole corpus and grouped by their skeletons: every glyph is
spelt out in the strokes it may be taken for, so a word and all its misreadings,
whatever their number, share one. A word is misread if a word of its group can
turn into it and neighbours and frequency support that one. Words cut at line
ends are joined where the joined word is known or the mark is a soft one, and
kept apart where the compound is. Windows over the judged lines number the
paragraphs.

Scale. Documents go to chunks by a hash. Each chunk asks for the skeletons of its
words and for its pairs of neighbours, by one word and the other's skeleton; the
counts of the whole corpus are joined to what was asked and sent back, one row a
chunk and form, so no word is hot. A form that was seen ``LEAST`` times is known,
in a corpus of any size; nothing is broadcast or sent to the driver. A chunk's
lines and counts must fit in a task; ``chunks`` sets how many there are.

Defined results: null and blank lines carry no noise; a line or run delivered
twice counts once; missing boxes leave lines in the order of their numbers;
documents of fewer than three pages have no running lines; empty tables give no
rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import chunk_of, chunks_for
from .name_links import distance

#: Sightings that make a word or a pair of neighbours known.
LEAST = 3
#: Confusions of glyphs, as printed and as read (fixed values). Those read as signs or digits show themselves.
SIGNS = {"0": "o", "5": "s", "6": "b", "8": "b", "9": "g", "@": "a", "(": "c", "ï": "i", "|": "l"}
READ_AS = {"c": "e", "f": "t", "ri": "n", "cl": "d", "ii": "u", "rn": "m", "b": "h", "vv": "w", "v": "y", "g": "q"}
#: What each glyph is spelt out as, so that a word and its misreadings are spelt alike.
STROKES = str.maketrans({"e": "c", "(": "c", "t": "f", "n": "ri", "d": "ci", "u": "ii", "m": "rri", "h": "b", "6": "b", "8": "b", "w": "vv", "y": "v", "q": "g", "9": "g", "0": "o", "5": "s", "@": "a", "ï": "i", "l": "i", "1": "i", "|": "i", "-": "", "’": "", "'": ""})
LOST = "�"
MARKS = "-‐­¬"
#: A misread form stands at most once for so many times of its original.
RATIO = 8

LETTERS = re.compile(r"[^\W\d_]")
PLAIN = re.compile(r"[a-z]+(?:[-’'][a-z]+)*$")
CODE = re.compile(r"[/=\\]|\w\.\w|://|^www\.")
EDGE_LINES = 3
#: Pages on which a running line returns, whatever the length of the document.
RETURNS = 3
HEADING = r"^(?:\d{1,3}(?:\.\d{1,3})*\.?\s+)?[^a-z.;,!?]{4,}$|^\d{1,3}\.\s+(?:[A-Z][\w’'-]*\s?){1,6}$"


def skeleton(text: str) -> str:
    """Letters of a line with digits masked and confusable glyphs folded."""
    s = re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])", "#", text.lower())
    for seen in ("rn", "ri", "ii", "vv", "cl"):
        s = s.replace(seen, READ_AS[seen])
    s = s.translate(str.maketrans("0156889@(ï|lqhcfv", "oisbbbgaciiigbety"))
    return re.sub(rf"[^\w#{LOST}]", "", s)


_ROMAN = re.compile(r"^(?:x{0,3}(?:ix|iv|v?i{0,3}))$")
_PAGE = re.compile(r"^(?P<word>[p][a@�][g9�][e�c]|[p�]age|pg|p|s|seite|sheet|folio)?(?P<a>\d{1,4}|#)(?P<of>(?:[o0�][f�]|/|von)(?P<b>\d{1,4}))?$")


def page_value(text: str) -> tuple[int | None, bool] | None:
    """(number, whether it is marked as a page number) if a line only numbers a page."""
    raw = text.strip().lower()
    if re.search(r"\d[.,]\d|\d\.$|\d[/-]\d+[/-]\d|[€$£%]", raw):
        return None
    flat = re.sub(r"[\s.|()\[\]{}~*<>·•:_–—-]", "", raw)
    if flat and _ROMAN.match(flat):
        values = {"i": 1, "v": 5, "x": 10}
        total = 0
        for c, d in zip(flat, flat[1:] + " "):
            total += -values[c] if d != " " and values[d] > values[c] else values[c]
        return total, flat != raw
    m = _PAGE.match(flat)
    if not m or re.search(r"\d\s+\d|\d-\d", raw) and not m.group("of"):
        return None
    return int(m.group("a")), bool(m.group("word") or m.group("of")) or not raw[0].isdigit()


def letter_bags(shapes: list[str]) -> np.ndarray:
    """How often each letter, in 64 classes, stands in each shape."""
    points = np.frombuffer("".join(shapes).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % 64
    of = np.repeat(np.arange(len(shapes)), [len(s) for s in shapes])
    return np.bincount(of * 64 + points, minlength=64 * len(shapes)).reshape(-1, 64)


def edge_noise(pages: dict[int, list[str]]) -> dict[tuple[int, int], str]:
    """(page, line index) to ``running`` or ``page_number`` for a document's lines by page."""
    edges: dict[int, tuple[list[int], list[int]]] = {}
    for p, lines in pages.items():
        n = len(lines)
        edges[p] = list(range(min(EDGE_LINES, n))), list(range(n - 1, max(-1, n - 1 - EDGE_LINES), -1))
    shapes: dict[str, set[tuple[int, int]]] = defaultdict(set)
    numbers: dict[tuple[int, int], tuple[int, bool]] = {}
    for p, sides in edges.items():
        for end, side in enumerate(sides):
            for k in side:
                if (v := page_value(pages[p][k])) is not None:
                    numbers[p, k] = v
                elif len(s := skeleton(pages[p][k])) >= 3:
                    shapes[s].add((p, end))
    often = max(RETURNS, len(pages) // 10)

    def returns(at: set[tuple[int, int]]) -> bool:
        """Does a shape return at one end of the page, or often enough at either?"""
        return max(Counter(end for _, end in at).values()) >= RETURNS or len({p for p, _ in at}) >= often

    # shapes that differ by a misread character or two are one
    if len(pages) >= RETURNS:
        ordered = sorted(shapes, key=lambda s: (-len({p for p, _ in shapes[s]}), s))
        by_length: dict[int, list[int]] = defaultdict(list)
        groups: dict[str, str] = {}
        bags = letter_bags(ordered)
        for k, s in enumerate(ordered):
            near = None
            if len(s) >= 6:
                slack = 1 + s.count(LOST) + len(s) // 16
                heads = np.array([h for d in range(-slack, slack + 1) for h in by_length.get(len(s) + d, ())], np.int64)
                # an edit changes two counts of letters at most, one up and one down
                over = bags[heads] - bags[k]
                heads = heads[np.maximum(np.maximum(over, 0).sum(axis=1), np.maximum(-over, 0).sum(axis=1)) <= slack]
                near = next((ordered[h] for h in heads.tolist() if distance(s, ordered[h], slack) <= slack), None)
            groups[s] = near or s
            if near is None:
                by_length[len(s)].append(k)
        places_of: dict[str, set[tuple[int, int]]] = defaultdict(set)
        for s, h in groups.items():
            places_of[h] |= shapes[s]
        strong = {s for s, h in groups.items() if returns(places_of[h])}
    else:
        strong = set()
    offsets = Counter(v - p for (p, _), (v, _) in numbers.items())
    offset, votes = offsets.most_common(1)[0] if offsets else (0, 0)
    out: dict[tuple[int, int], str] = {}
    for p, sides in edges.items():
        for side in sides:
            for k in side:
                if (p, k) in out:
                    break
                text = pages[p][k]
                value = numbers.get((p, k))
                if value is not None:
                    fits = value[0] - p == offset and votes >= 2
                    if fits or value[1] or (len(pages) == 1 and value[0] < 1000):
                        out[p, k] = "page_number"
                        continue
                elif skeleton(text) in strong and not (text[:1].islower() and text.rstrip()[-1:] in ".,;"):
                    out[p, k] = "running"
                    continue
                break
    return out


def strokes(word: str) -> str:
    """The skeleton of a word in small letters, the same for all its misreadings."""
    return word.translate(STROKES)


def read_from(word: str, original: str) -> bool:
    """Can confusions of glyphs, however many, turn an original into a word?"""
    glyphs = [("i", "l") if c == "1" else (SIGNS.get(c, c),) for c in word]
    reached = {(0, 0)}
    for i in range(len(word)):
        for k in [k for at, k in reached if at == i]:
            printed = original[k : k + 1]
            if any(a == printed or READ_AS.get(a) == printed for a in glyphs[i]):
                reached.add((i + 1, k + 1))
            if i + 1 < len(word) and any(READ_AS.get(a + b) == printed for a in glyphs[i] for b in glyphs[i + 1]):
                reached.add((i + 2, k + 1))
    return (len(word), len(original)) in reached


def lost_forms(word: str) -> list[str]:
    """A word with lost glyphs as it stands, and with its signs read back."""
    return list(dict.fromkeys((word, "".join(SIGNS.get(c, c) for c in word))))


def lost_key(form: str) -> str | None:
    """What a word must show to be the original of a form with lost glyphs: its length and two letters that are left, with their places."""
    left = [k for k, c in enumerate(form) if c != LOST]
    return _left_key(form, left[0], left[-1]) if left else None


def _left_key(form: str, i: int, j: int) -> str:
    return f"{len(form)} {i}{form[i]} {j}{form[j]}"


def number_of(key: str) -> int:
    """A key as a number of 32 bits; keys that share one bring more than was asked, which does no harm."""
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) - (1 << 31)


class Glyphs:
    """Judges words by the frequent words and neighbours of a corpus.

    ``words`` and ``pairs`` need to hold only what may be looked up for the lines that are judged.
    """

    def __init__(self, words: dict[str, int], pairs: dict[str, int], least: int):
        self.words, self.pairs, self.least = words, pairs, least
        self.by_length: dict[int, list[str]] = defaultdict(list)
        self.by_strokes: dict[str, list[str]] = defaultdict(list)
        for w in words:
            self.by_length[len(w)].append(w)
            self.by_strokes[strokes(w)].append(w)
        self.judged = lru_cache(maxsize=200_000)(self._judge)
        self.options = lru_cache(maxsize=200_000)(self._options)

    def _options(self, word: str) -> frozenset[str]:
        """Known words whose misreading gives a word."""
        return frozenset(w for w in self.by_strokes.get(strokes(word), ()) if w != word and read_from(word, w))

    def doubtful(self, word: str) -> bool:
        """Must neighbours say which word this is?"""
        options = self.options(word)
        return len(options) > 1 or bool(options) and word in self.words

    def sides(self, word: str, before: str, after: str) -> tuple[int, int]:
        """How often a word follows the one before, and is followed by the one after."""
        return self.pairs.get(f"{before} {word}", 0), self.pairs.get(f"{word} {after}", 0)

    def best(self, word: str, before: str, after: str) -> tuple[str, int]:
        """The original that neighbours and frequency support best, and its count."""
        found: list[str] = []
        if LOST in word:
            for form in lost_forms(word):
                pattern = re.compile("".join("." if c == LOST else re.escape(c) for c in form))
                found = found or [w for w in self.by_length[len(word)] if pattern.fullmatch(w)]
        else:
            found = list(self.options(word))
        if not found:
            return "", 0
        w = max(found, key=lambda w: (self.pairs.get(f"{before} {w}", 0) + self.pairs.get(f"{w} {after}", 0), self.words[w], w))
        return w, self.words[w]

    def known(self, word: str) -> int:
        return self.words.get(word, 0)

    def judge(self, token: str, before: str = "", after: str = "") -> tuple[bool, str]:
        """(is a character misread, the token as printed) of a word between its neighbours."""
        word = token.strip(".,;:!?").lower()
        if PLAIN.match(word) and len(token) > 4 and not self.doubtful(word):
            before = after = ""  # whatever the neighbours, so that the cache holds the word once
        return self.judged(token, before, after)

    def _judge(self, token: str, before: str, after: str) -> tuple[bool, str]:
        word = token.rstrip(".,;:!?\"'”’]}*").lstrip("\"'“‘[{*•")
        if word.endswith(")"):
            word = word.rstrip(").,;")
            word = word.lstrip("(")
        if not LETTERS.search(word):
            return False, token
        low = word.lower()
        if LOST in word:
            return True, self._as(token, word, self.best(low, before, after)[0])
        if CODE.search(word):
            return False, token
        signs = [c for c in low if c in SIGNS or c == "1"]
        if signs:
            return self._signs(token, word, low, before, after)
        if not PLAIN.match(low) or word.isupper() or len(low) < 2:
            return False, token
        own = self.known(low)
        head = low[:1] if word[0].isupper() else ""
        options = [w for w in self.options(low) if w.startswith(head) and self.words[w] >= 2 * self.least]
        if not options:
            return False, token
        found = max(options, key=lambda w: (sum(self.sides(w, before, after)), self.words[w], w))
        n = self.words[found]
        if own and len(low) > 3:
            # a known word: it stays where its neighbours know it better, and goes where both know only the original
            left, right = self.sides(found, before, after)
            with_own = sum(self.sides(low, before, after))
            if with_own > left + right or n < RATIO * own and not (left and right and left + right > RATIO * with_own):
                return False, token
        elif n < RATIO * own:
            return False, token
        if len(low) <= 3 and (own or before or after):
            # short words look alike: their neighbours must know the original, and not this one
            with_found = self.pairs.get(f"{before} {found}", 0) + self.pairs.get(f"{found} {after}", 0)
            with_own = self.pairs.get(f"{before} {low}", 0) + self.pairs.get(f"{low} {after}", 0)
            if with_found <= RATIO * with_own:
                return False, token
        return True, self._as(token, word, found)

    def _signs(self, token: str, word: str, low: str, before: str, after: str) -> tuple[bool, str]:
        letters = sum(c.isalpha() for c in low)
        digits = sum(c.isdigit() for c in low)
        others = sum(c in "@(ï|" for c in low)
        found = self.best(low, before, after)[0]
        if others and not digits:
            if low[0] == "(" and others == 1:
                rest = low[1:]
                if not found:
                    return False, token
                if self.known(rest):  # an opening bracket, unless the neighbours know the word with its c
                    with_found = self.pairs.get(f"{before} {found}", 0) + self.pairs.get(f"{found} {after}", 0)
                    with_rest = self.pairs.get(f"{before} {rest}", 0) + self.pairs.get(f"{rest} {after}", 0)
                    if with_found <= RATIO * with_rest:
                        return False, token
            elif low.strip("|") != low and not found:
                return False, token
            return letters >= 1, self._as(token, word, found)
        if re.search(r"\d\d\d|\d$(?<=\d\d)|^\d+(?:st|nd|rd|th)$|\d-|-\d|#", low):
            return bool(found) and letters >= 3, self._as(token, word, found) if found and letters >= 3 else token
        upper = word.upper() == word
        if upper and not (found and letters >= 3 and digits * 2 <= letters):
            return False, token
        if found or (letters >= 3 and digits <= 2 and sum(c.islower() for c in word) >= 3 and not re.search(r"[234 7]", low)):
            return True, self._as(token, word, found)
        return False, token

    @staticmethod
    def _as(token: str, word: str, original: str) -> str:
        """A token with its word restored, in the word's case; unknown originals leave the signs read back."""
        if not original:
            original = "".join(SIGNS.get(c, "i" if c == "1" else c) for c in word)
        elif word.upper() == word and sum(c.isalpha() for c in word) > 1:
            original = original.upper()
        elif word[0].isupper():
            original = original[0].upper() + original[1:]
        return token.replace(word, original, 1)

    def joins(self, first: str, second: str) -> tuple[str, str]:
        """How ``first`` (with its mark) goes on in ``second``: (``hyphen``, ``compound`` or nothing, the joined word)."""
        mark, stem = first[-1], first[:-1]
        head = re.match(r"[^\W_]*[^\W\d_@(|ï]?[\w@(|ï�’'-]*", second)
        tail = head.group() if head else ""
        own = re.search(r"[\w@(|ï�’'-]+$", stem)
        if not own or not tail or not LETTERS.search(own.group()[-1:] + own.group()) or own.group()[-1].isdigit() and own.group()[-1] not in "015689" or not (LETTERS.search(tail[0]) or tail[0] in "015689@(|" + LOST) or tail.isdigit():
            return "", ""
        whole, compound = (own.group() + tail).lower(), f"{own.group()}-{tail}".lower()
        if mark in "­¬":
            return "hyphen", own.group() + tail
        fits = self.known(whole) or (self.best(whole, "", "")[1] if len(whole) > 4 else 0)
        kept = self.known(compound) or (self.best(compound, "", "")[1] if len(compound) > 5 else 0)
        if fits or kept:
            return ("hyphen", own.group() + tail) if fits >= kept else ("compound", f"{own.group()}-{tail}")
        if tail[0].isupper() or own.group().isupper() and len(own.group()) > 1 and not tail.isupper():
            return ("compound", f"{own.group()}-{tail}") if not (own.group().isupper() and tail.isupper()) else ("hyphen", own.group() + tail)
        if self.known(own.group().lower()) and self.known(tail.lower()):
            return "compound", f"{own.group()}-{tail}"
        return "hyphen", own.group() + tail


def _line_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and neighbours of lines, combined within a task."""
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["key", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            tokens = text.split()
            # the first word may be the rest of a cut one, and a marked last word its start
            tokens = tokens[1:-1] if tokens and tokens[-1][-1] in MARKS else tokens[1:]
            last = ""
            for t in tokens:
                w = t.strip(".,;:!?\"'“”‘’()[]" if ")" in t else ".,;:!?\"'“”‘’[]").lower()
                if not PLAIN.match(w):
                    last = ""
                    continue
                seen[w] += 1
                if last:
                    seen[f"{last} {w}"] += 1
                last = w if w == t.lower() else ""
        if len(seen) > 300_000:
            yield out()
            seen.clear()
    yield out()


class Asked:
    """What the judgement of a document's lines may look up, as keys of :func:`_supplied`."""

    def __init__(self) -> None:
        self.keys: set[str] = set()

    def word(self, low: str) -> None:
        self.keys.add("s" + strokes(low))
        if LOST in low:
            self.keys.update("w" + k for form in lost_forms(low) if (k := lost_key(form)))

    def token(self, token: str, before: str, after: str) -> None:
        """A token between its neighbours, in all forms that :meth:`Glyphs.judge` tries."""
        plain = token.strip(".,;:!?").lower()
        word = token.rstrip(".,;:!?\"'”’]}*").lstrip("\"'“‘[{*•").lower()
        forms = {plain, word}
        if word.endswith(")"):
            forms.add(word.rstrip(").,;").lstrip("("))
        forms |= {f[1:] for f in forms if f[:1] == "("}
        for low in forms:
            if not LETTERS.search(low):
                continue
            self.word(low)
            if before:
                self.keys.add(f"p{before} {strokes(low)}")
            if after:
                self.keys.add(f"q{strokes(low)} {after}")
            if LOST in low:
                self.keys.update(x for form in lost_forms(low) if (k := lost_key(form)) for x in (f"l{before} {k}", f"r{k} {after}"))

    def join(self, first: str, second: str, before: str, after: str) -> None:
        """A word cut at a line's end with what may be its rest."""
        own, tail = re.search(r"[\w@(|ï�’'-]+$", first[:-1]), _tail_of(second)
        if not own or not tail:
            return
        for low in (own.group().lower(), tail.lower(), f"{own.group()}-{tail}".lower()):
            self.word(low)
        self.token(own.group() + tail, before, after)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, key: what each chunk asks for, once a chunk."""
    asked: dict[int, Asked] = {}
    chunk_of_document: dict[tuple, int] = {}
    documents: dict[tuple, list[dict]] = defaultdict(list)
    for batch in batches:
        for row in batch.to_pylist():
            at = row["origin"], row["doc_id"]
            chunk_of_document[at] = row["chunk"]
            documents[at].append(row)
    for at in list(documents):
        keys = asked.setdefault(chunk_of_document[at], Asked())
        lines = [line["text"].split() for line in printed_lines(documents.pop(at))]
        for n, tokens in enumerate(lines):
            for k, t in enumerate(tokens):
                before = tokens[k - 1].lower() if k else ""
                after = tokens[k + 1].strip(".,;:").lower() if k + 1 < len(tokens) else ""
                keys.token(t, before, after)
            # the rest stands in the next line of the body, beyond the edges of two pages at most
            if tokens and tokens[-1][-1] in MARKS and len(tokens[-1]) > 1:
                for rest in lines[n + 1 : n + 2 + 2 * EDGE_LINES]:
                    keys.join(tokens[-1], rest[0], tokens[-2].lower() if len(tokens) > 1 else "", rest[1].strip(".,;:").lower() if len(rest) > 1 else "")
    for c, a in asked.items():
        keys = pa.array({number_of(k) for k in a.keys}, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), keys], names=["chunk", "key"])


def _supplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, form, n: the known words and pairs of neighbours under all keys that may ask for them."""
    for batch in batches:
        keys, forms, counts = [], [], []
        for form, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            first, space, second = form.partition(" ")
            if space:
                own = [f"p{first} {strokes(second)}", f"q{strokes(first)} {second}"]
                own += [f"l{first} {_left_key(second, i, len(second) - 1 - j)}" for i, j in _ONE_LOST if i + j < len(second)]
                own += [f"r{_left_key(first, i, len(first) - 1 - j)} {second}" for i, j in _ONE_LOST if i + j < len(first)]
            else:
                own = ["s" + strokes(form)]
                own += ["w" + _left_key(form, i, j) for i, j in _left_over(len(form))]
            keys += map(number_of, own)
            forms += [form] * len(own)
            counts += [n] * len(own)
        for at in range(0, max(1, len(keys)), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000], pa.int32()), pa.array(forms[at : at + 100_000], pa.string()), pa.array(counts[at : at + 100_000], pa.int64())], names=["key", "form", "n"])


#: Glyphs lost at the start and at the end of a word whose neighbours are looked up.
_ONE_LOST = ((0, 0), (1, 0), (0, 1))


def _left_over(n: int) -> list[tuple[int, int]]:
    """First and last places that lost glyphs may leave in a word of ``n`` letters: up to two lost at either end, or one place alone."""
    return [(i, j) for i in range(min(3, n)) for j in range(max(i, n - 3), n)]


def corpus_counts(lines: DataFrame) -> DataFrame:
    """key, n: the words and pairs of neighbours of all lines (column ``text``) that were seen ``LEAST`` times."""
    facts = lines.select("text").where(F.length(F.trim("text")) > 0).mapInArrow(_line_facts, "key string, n bigint")
    return facts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def scanned_lines(layout_line: DataFrame, text_run: DataFrame) -> DataFrame:
    """origin, doc_id, page, seq, x, y, block, text: one row per line or run, once each."""
    lines = layout_line.select(
        F.lit("layout_line").alias("origin"), "doc_id", "page", F.col("line_no").alias("seq"), F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"), F.col("block_id").alias("block"), "text"
    )
    runs = text_run.select(
        F.lit("text_run").alias("origin"), "doc_id", "page", F.col("run_no").alias("seq"), F.col("bbox")[0].alias("x"), F.col("bbox")[1].alias("y"), F.lit(None).cast("string").alias("block"), "text"
    )
    return lines.unionByName(runs)


_JUDGED = (
    "origin string, doc_id string, page int, line int, seqs array<int>, running boolean, page_number boolean, hyphen boolean, misread array<int>,"
    " block string, repaired string"
)


def judged_lines(layout_line: DataFrame, text_run: DataFrame, chunks: int | None = None) -> DataFrame:
    """One row per printed line: its runs, kinds of noise, and its text with misread words restored.

    A word cut at the line's end stands whole in its first line.
    """
    source = scanned_lines(layout_line, text_run).where("doc_id IS NOT NULL AND page IS NOT NULL AND seq IS NOT NULL")
    n = chunks_for(source, chunks)
    lines = source.select(chunk_of(n, "origin", "doc_id").alias("chunk"), "origin", "doc_id", "page", "seq", "x", "y", "block", "text").repartition(n, "chunk")
    requests = lines.mapInArrow(_requests, "chunk int, key int")
    supplied = corpus_counts(lines).mapInArrow(_supplied, "key int, form string, n bigint")
    answers = requests.join(supplied, "key").select("chunk", F.col("form").alias("key"), "n").distinct()
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.string(), pa.string()]
    names = ["origin", "doc_id", "page", "line", "seqs", "running", "page_number", "hyphen", "misread", "block", "repaired"]

    def judge(lines: pa.Table, counts: pa.Table) -> pa.Table:
        words: dict[str, int] = {}
        pairs: dict[str, int] = {}
        for key, n in zip(counts.column("key").to_pylist(), counts.column("n").to_pylist()):
            (pairs if " " in key else words)[key] = n
        glyphs = Glyphs(words, pairs, LEAST)
        at, rows, out, parts = None, [], [], []

        def part() -> pa.Table:
            return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)

        for batch in lines.sort_by([("origin", "ascending"), ("doc_id", "ascending")]).to_batches(max_chunksize=5000):
            for row in batch.to_pylist():
                if (row["origin"], row["doc_id"]) != at:
                    if rows:
                        out += [(*at, *r) for r in judge_document(rows, glyphs)]
                    at, rows = (row["origin"], row["doc_id"]), []
                rows.append(row)
            if len(out) > 5000:
                parts.append(part())
                out = []
        if rows:
            out += [(*at, *r) for r in judge_document(rows, glyphs)]
        return pa.concat_tables([*parts, part()])

    return lines.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(judge, _JUDGED)


def printed_lines(rows: list[dict]) -> list[dict]:
    """The printed lines of a document in reading order: page, place on the page, runs and text."""
    by_page: dict[int, dict[int, dict]] = defaultdict(dict)
    for r in rows:
        kept = by_page[r["page"]].get(r["seq"])
        if kept is None or (r["text"] or "") > (kept["text"] or ""):
            by_page[r["page"]][r["seq"]] = r
    lines: list[dict] = []
    for p in sorted(by_page):
        runs = [r for r in by_page[p].values() if (r["text"] or "").strip()]
        runs.sort(key=lambda r: (r["y"] if r["y"] is not None else r["seq"], r["x"] or 0, r["seq"]))
        own: list[dict] = []
        for r in runs:
            if own and r["y"] is not None and own[-1]["y"] == r["y"]:
                own[-1]["runs"].append(r)
            else:
                own.append({"y": r["y"], "runs": [r], "page": p, "place": (p, len(own))})
        for line in own:
            line["text"] = " ".join(r["text"].strip() for r in line["runs"])
        lines += own
    return lines


def judge_document(rows: list[dict], glyphs: Glyphs) -> list[tuple]:
    """Judged lines of one document, in reading order."""
    lines = printed_lines(rows)
    places = [line["place"] for line in lines]
    pages: dict[int, list[str]] = defaultdict(list)
    for line in lines:
        pages[line["page"]].append(line["text"])
    noise = edge_noise(pages)
    body = [n for n, place in enumerate(places) if place not in noise]
    following = dict(zip(body, body[1:]))
    out = []
    taken: set[int] = set()
    rest_bad: set[int] = set()
    for n, (line, place) in enumerate(zip(lines, places)):
        seqs = [r["seq"] for r in line["runs"]]
        block = line["runs"][0]["block"]
        kind = noise.get(place)
        if kind:
            out.append((place[0], place[1], seqs, kind == "running", kind == "page_number", False, [], block, None))
            continue
        tokens = [(t, r["seq"]) for r in line["runs"] for t in r["text"].split()]
        wrong: set[int] = set()
        made: list[str] = []
        how, whole = "", ""
        last = tokens[-1][0]
        if last[-1] in MARKS and n in following and len(last) > 1:
            how, whole = glyphs.joins(last, lines[following[n]]["text"].split()[0])
        for k, (t, seq) in enumerate(tokens):
            before = tokens[k - 1][0].lower() if k else ""
            after = tokens[k + 1][0].strip(".,;:").lower() if k + 1 < len(tokens) else ""
            if k == len(tokens) - 1 and how:
                stem = t[:-1]
                rest_of = lines[following[n]]["text"].split()
                bad, fixed = glyphs.judge(whole, before, rest_of[1].strip(".,;:").lower() if len(rest_of) > 1 and rest_of[0] == _tail_of(rest_of[0]) else "")
                here, rest = _shares(stem, whole, bad, fixed)
                if here:
                    wrong.add(seq)
                if rest:
                    rest_bad.add(following[n])
                taken.add(following[n])
                # punctuation of the rest stays with the joined word
                first = lines[following[n]]["text"].split()[0]
                made.append(_lead(stem) + (fixed if bad else whole) + first[len(_tail_of(first)) :])
                continue
            if k == 0 and n in taken:
                if n in rest_bad:
                    wrong.add(seq)
                continue
            if t[-1] in MARKS and k == len(tokens) - 1:
                made.append(t)
                if LOST in t and LETTERS.search(t):
                    wrong.add(seq)
                continue
            bad, fixed = glyphs.judge(t, before, after)
            if bad:
                wrong.add(seq)
            made.append(fixed)
        out.append((place[0], place[1], seqs, False, False, how == "hyphen", sorted(wrong), block, " ".join(made)))
    return out


def _tail_of(token: str) -> str:
    m = re.match(r"[\w@(|ï�’'-]*", token)
    return m.group() if m else ""


def _lead(stem: str) -> str:
    """What stands before the word in its first part, such as an opening bracket."""
    m = re.search(r"[\w@(|ï�’'-]+$", stem)
    return stem[: m.start()] if m else ""


def _shares(stem: str, whole: str, bad: bool, fixed: str) -> tuple[bool, bool]:
    """Which parts of a joined word hold the misread character: (the first, the rest)."""
    if not bad:
        return False, False
    m = re.search(r"[\w@(|ï�’'-]+$", stem)
    cut = len(m.group()) if m else 0
    odd = [k for k, c in enumerate(whole) if c in "@(ï|" + LOST or (c in "0156898" and whole[:k].isalpha() | whole[k + 1 :].isalpha())]
    if odd:
        return any(k < cut for k in odd), any(k >= cut for k in odd)
    a, b = whole.lower(), fixed.lower()
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    return lo < cut, len(a) - hi > cut


def noise_found(layout_line: DataFrame, text_run: DataFrame) -> DataFrame:
    """origin, doc_id, page, seq, noise: one row per noisy line or run and kind."""
    lines = judged_lines(layout_line, text_run)
    kinds = F.concat(
        F.when(F.col("running"), F.transform("seqs", lambda s: F.struct(s.alias("seq"), F.lit("running").alias("noise")))).otherwise(F.array()),
        F.when(F.col("page_number"), F.transform("seqs", lambda s: F.struct(s.alias("seq"), F.lit("page_number").alias("noise")))).otherwise(F.array()),
        F.when(F.col("hyphen"), F.array(F.struct(F.element_at("seqs", -1).alias("seq"), F.lit("hyphen").alias("noise")))).otherwise(F.array()),
        F.transform("misread", lambda s: F.struct(s.alias("seq"), F.lit("misread").alias("noise"))),
    )
    return lines.select("origin", "doc_id", "page", F.explode(kinds).alias("k")).select("origin", "doc_id", "page", "k.seq", "k.noise")


def paragraphs(layout_line: DataFrame, text_run: DataFrame) -> DataFrame:
    """origin, doc_id, para_no, first_page, text: the continuous paragraphs of each document.

    A paragraph ends at a heading, or where a new block begins after a line that ends a sentence.
    """
    body = judged_lines(layout_line, text_run).where("NOT running AND NOT page_number AND repaired <> ''")
    order = Window.partitionBy("origin", "doc_id").orderBy("page", "line")
    heading = F.col("repaired").rlike(HEADING)
    ends = F.col("before").rlike(r"[.!?:]['\"”’)]*$")
    marked = body.withColumns({"heading": heading, "before": F.lag("repaired").over(order), "was_heading": F.lag(heading).over(order), "old_block": F.lag("block").over(order)})
    begins = (
        F.col("before").isNull() | F.col("heading") | F.col("was_heading") | F.col("repaired").rlike(r"^(?:\([a-z0-9]{1,3}\)|\d{1,3}\.\d{1,3})\s")
        | (ends & F.coalesce(F.col("block") != F.col("old_block"), F.lit(False)))
    )
    numbered = marked.withColumn("para_no", F.sum(F.when(begins, 1).otherwise(0)).over(order).cast("int"))
    gathered = numbered.groupBy("origin", "doc_id", "para_no").agg(F.min("page").alias("first_page"), F.array_sort(F.collect_list(F.struct("page", "line", "repaired"))).alias("lines"))
    return gathered.select("origin", "doc_id", "para_no", "first_page", F.array_join(F.transform("lines", lambda x: x["repaired"]), " ").alias("text"))
