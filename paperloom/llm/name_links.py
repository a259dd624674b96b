"""Spellings of the same person or organisation, linked.

Method: trie join. Each spelling is read into its parts: legal form, trade,
region, numeral and the letters of the name itself, or a person's given and
family names. Names with equal trade, region and numeral are sharded by length
and by thirds of their letters (halves of short names), so that two names within
the bound always share a shard: two edits leave a third intact, at most one place
away, and a swap across the border of two thirds has a shard of its own. Each
shard is a trie that holds every name in every order of its words, and each name
walks the trie with a Levenshtein automaton (adjacent swaps count once) that
follows only branches within the bound. Names of more than four words have too
many orders for a trie: they are sharded by their counts of letters, which no
order changes, and their words are laid along the other name one by one. One edit links; two do if they lie in different parts of the
name, since names that differ in one syllable are different names. People are
linked by family name so, and by given name, nickname or initial; an initial is
linked only if a single person fits. Components of the links are the parties.

Defined results: null and blank spellings have no rows; repeated spellings count
once; a spelling without letters is linked to none; an empty table gives no
rows. Spellings of one party all come out in pairs, so rows grow with the square
of the spellings of a party, not of its mentions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import checkpointed

from .names_lexicon import CALLED, GIVEN, LEGAL, NUMERALS, REGIONS, TITLES, TRADES, TRADES_SHORT

WORD = re.compile(r"[^\W_]+")
INNER_DOT = re.compile(r"(?<=\w)\.(?=\w\b)")
#: Two edits link names of so many letters, one edit those of LEAST.
LONG, LEAST = 9, 5
#: Words of a name whose orders all stand in a trie.
ORDERED = 4
#: Two edits change the counts of four letters at most, so one of five classes of letters stays as it is.
CLASSES = 5


def folded(text: str) -> str:
    """Lower case without accents and without dots between single letters."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return INNER_DOT.sub("", plain.lower())


@lru_cache(maxsize=20000)
def trade_of(word: str) -> str | None:
    """The trade a word names, in full, short, or with one slip."""
    if word in TRADES:
        return word
    if word in TRADES_SHORT:
        return TRADES_SHORT[word]
    if len(word) >= 7:
        near = [t for t in TRADES if abs(len(t) - len(word)) <= 1 and distance(word, t, 1) <= 1]
        if len(near) == 1:
            return near[0]
    return None


def read_name(spelling: str) -> tuple[str, str, str, list[str], list[str]] | None:
    """(block, key, given name, letters in every word order, words of a name with too many orders) of a spelling; the block of people is ``p``."""
    flat = folded(spelling)
    words = WORD.findall(flat)
    if words and words[0] == "the" and len(words) > 1:
        words = words[1:]
    legal = False
    if words[-3:] == ["limited", "liability", "company"]:
        words, legal = words[:-3], True
    while len(words) > 1 and words[-1] in LEGAL:
        words, legal = words[:-1], True
    trades, regions, numerals, core = [], [], [], []
    for k, w in enumerate(words):
        if w in ("and", "und", "et") and 0 < k < len(words) - 1:
            continue
        if (len(words) > 2 or (k and (legal or w in TRADES or (len(words[0]) >= 9 and words[0] not in GIVEN)))) and (t := trade_of(w)):
            trades.append(t)
        elif k and w in REGIONS:
            regions.append(w)
        elif k and w in NUMERALS:
            numerals.append(NUMERALS[w])
        else:
            core.append(w)
    if legal or trades or regions or numerals:
        letters = "".join(core)
        if not letters:
            return None
        block = "c|" + "|".join("+".join(sorted(x)) for x in (trades, regions, numerals))
        if len(core) > ORDERED:
            return block, letters, "", [letters], sorted(core)
        return block, letters, "", list(dict.fromkeys("".join(o) for o in permutations(core))), []
    people = [w for w in words if w not in TITLES or len(w) == 1]
    if not people:
        return None
    if len(people) == 1:
        return "p", people[0], "", [people[0]], []
    head, comma, tail = flat.partition(",")
    if comma and tail.strip():
        family = [w for w in WORD.findall(head) if w not in TITLES]
        first = [w for w in WORD.findall(tail) if w not in TITLES or len(w) == 1]
    elif people[-1] in GIVEN and people[0] not in GIVEN and len(people[0]) > 1:
        family, first = people[:1], people[-1:]
    else:
        first, family = people[:1], [w for w in people[1:] if len(w) > 1]
    letters = "".join(family)
    if not letters or not first:
        return None
    return "p", letters, first[0], [letters], []


def distance(a: str, b: str, most: int) -> int:
    """Edits with adjacent swaps between two strings, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


class Trie:
    """Strings by their letters, with the owners of each."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, text: str, owner) -> None:
        node = self.root
        for c in text:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(owner)

    def within(self, text: str, most: int) -> Iterator[tuple[object, int]]:
        """(owner, distance) of all strings within ``most`` edits of a text.

        The automaton's state at a depth is the band of distances to the prefixes of
        the text that are at most ``most`` letters shorter or longer; a branch is left
        when nothing in two bands is within the bound.
        """
        n, far, width = len(text), most + 1, 2 * most + 1
        first = [j if 0 <= (j := t - most) <= n else far for t in range(width)]
        stack = [(self.root, 0, "", [far] * width, first)]
        while stack:
            node, depth, last, before, row = stack.pop()
            for c, child in node.items():
                if not c:
                    t = n - depth + most
                    if 0 <= t < width and row[t] <= most:
                        for owner in child:
                            yield owner, row[t]
                    continue
                new, low, i = [], far, depth + 1
                for t in range(width):
                    j = i - most + t
                    if j < 0 or j > n:
                        v = far
                    elif j == 0:
                        v = i
                    else:
                        y = text[j - 1]
                        v = row[t] + (c != y)
                        if t + 1 < width and row[t + 1] + 1 < v:
                            v = row[t + 1] + 1
                        if t and new[t - 1] + 1 < v:
                            v = new[t - 1] + 1
                        if j > 1 and last == y and c == text[j - 2] and before[t] + 1 < v:
                            v = before[t] + 1
                    new.append(v)
                    low = min(low, v)
                if low <= most or min(row) < most:
                    stack.append((child, i, c, row, new))


def same_letters(a: str, b: str, edits: int) -> bool:
    """Are two names within ``edits`` edits one name with slips?"""
    if edits == 0:
        return True
    if edits == 1:
        return min(len(a), len(b)) >= LEAST
    if min(len(a), len(b)) < LONG:
        return False
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    return max(len(a), len(b)) - lo - hi >= 5


def orders_within(words: list[str], text: str, most: int) -> Iterator[tuple[str, int]]:
    """(letters, distance) of the orders of words that are within ``most`` edits of a text.

    Words are laid one by one; an order is left as a branch of a trie is.
    """
    far = [most + 1] * (len(text) + 1)
    stack = [("", sorted(words), far, list(range(len(text) + 1)))]
    while stack:
        done, rest, before, row = stack.pop()
        if not rest:
            if row[-1] <= most:
                yield done, row[-1]
            continue
        for k, word in enumerate(rest):
            if k and rest[k - 1] == word:
                continue
            made, last, now = done, before, row
            for c in word:
                new = [now[0] + 1]
                for j, y in enumerate(text, 1):
                    v = min(now[j - 1] + (c != y), now[j] + 1, new[-1] + 1)
                    if j > 1 and made[-1:] == y and c == text[j - 2]:
                        v = min(v, last[j - 2] + 1)
                    new.append(v)
                made, last, now = made + c, now, new
                if min(now) > most and min(last) >= most:
                    break
            else:
                stack.append((made, rest[:k] + rest[k + 1 :], last, now))


def held_shards(text: str) -> set[str]:
    """Shards whose trie holds a text: its parts, and those that a swap across their border makes."""
    n, out = len(text), set()
    if n < LEAST:
        return {f"1|{text}"}
    if n >= LONG:
        a = (n + 1) // 3
        b = n - a
        out |= {f"3|{n}|f|{text[:a]}", f"3|{n}|f|{text[: a - 1]}{text[a]}", f"3|{n}|m|{text[a:b]}", f"3|{n}|l|{text[b:]}", f"3|{n}|l|{text[b - 1]}{text[b + 1 :]}"}
    if n <= LONG:
        a = n // 2
        out |= {f"2|{n}|f|{text[:a]}", f"2|{n}|f|{text[: a - 1]}{text[a]}", f"2|{n}|l|{text[a:]}"}
    return out


def walked_shards(text: str) -> set[str]:
    """Shards that a text walks: they hold every text that ``same_letters`` may link to it.

    The first part stands at the start and the last at the end, or else one edit
    lies on either side of the middle, which is then at most one place away.
    """
    m, out = len(text), set()
    if m < LEAST:
        return {f"1|{text}"}
    for n in range(max(LEAST, m - 1), m + 2) if m <= LONG else ():
        if min(n, m) < LONG:
            a = n // 2
            out |= {f"2|{n}|f|{text[:a]}", f"2|{n}|l|{text[m - n + a :]}"}
    for n in range(max(LONG, m - 2), m + 3) if m >= LONG else ():
        a = (n + 1) // 3
        b = n - a
        out |= {f"3|{n}|f|{text[:a]}", f"3|{n}|l|{text[m - a :]}"}
        out |= {f"3|{n}|m|{text[a + d : b + d]}" for d in (-1, 0, 1) if abs(m - n - d) <= 1}
    return out


def letter_shards(text: str, length: int) -> set[str]:
    """Shards by the letters of each class, in alphabetic order; of a text and those of ``length`` letters within two edits, one at least is shared."""
    letters = sorted(text)
    return {f"w|{length}|{k}|{''.join(c for c in letters if ord(c) % CLASSES == k)}" for k in range(CLASSES)}


def given_fits(a: str, b: str) -> str:
    """``same``, ``initial`` or nothing, for two given names."""
    if a == b:
        return "same"
    if not a or not b:
        return ""
    if len(a) == 1 or len(b) == 1:
        return "initial" if len(a) != len(b) and (a[0] == b[0] or any(n[0] == min(a, b, key=len) for n in CALLED.get(max(a, b, key=len), ()))) else ""
    if CALLED.get(a, {a}) & CALLED.get(b, {b}):
        return "same"
    short, full = sorted((a, b), key=len)
    if short not in GIVEN and len(short) >= 3 and short[:3] == full[:3] and short[-1] in "iy" or short[-2:] == "ie" and short[:3] == full[:3]:
        return "same"  # a pet form that no list has
    if (a not in GIVEN or b not in GIVEN) and min(len(a), len(b)) >= 4:
        for x in {a, *CALLED.get(a, ())}:
            for y in {b, *CALLED.get(b, ())}:
                if distance(x, y, 1) <= 1:
                    return "same"
    return ""


@lru_cache(maxsize=50_000)
def given_keys(given: str) -> frozenset[str]:
    """Keys of a given name; names that :func:`given_fits` share one: a full form, an initial, the start of a pet form, or a form less one letter."""
    called = CALLED.get(given, {given})
    if len(given) < 2:
        return frozenset({f"i{given}", f"={given}"})
    keys = {f"={given}", *(f"={n}" for n in called), f"i{given[0]}", *(f"i{n[0]}" for n in called), f"p{given[:3]}"}
    for n in {given, *called}:
        keys.add(f"d{n}")
        keys.update(f"d{n[:k]}{n[k + 1 :]}" for k in range(len(n)))
    return frozenset(keys)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for s in batch.column(0).to_pylist():
            if read := read_name(s):
                block, key, given, orders, words = read
                rows.append((s, f"{block}\x1f{key}\x1f{given}", block, key, given, orders, words))
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.string()] * 5 + [pa.list_(pa.string())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["name", "node", "block", "key", "given", "orders", "words"])


_SHARDED = "shard string, node string, key string, given string, letters string, walks boolean, held boolean, words array<string>"


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shards that hold or are walked by each entry; ``by_words`` entries go to those of names with too many orders."""
    names = [f.split()[0] for f in _SHARDED.split(", ")]
    kinds = [pa.string()] * 5 + [pa.bool_()] * 2 + [pa.list_(pa.string())]
    for batch in batches:
        rows = []
        for node, key, given, letters, own, block, words, by_words in zip(*(c.to_pylist() for c in batch.columns)):
            n = len(letters)
            if by_words:
                held = letter_shards(letters, n) if words else set()
                walked = {s for m in range(n - 2, n + 3) for s in letter_shards(letters, m)} if own else set()
            else:
                held, walked = held_shards(letters), walked_shards(letters) if own else set()
            rows += [(f"{block}|{s}", node, key, given, letters, s in walked, s in held, words if by_words else []) for s in held | walked]
        for at in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 20_000]), kinds)], names=names)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within shards; the rows of a shard follow each other."""
    shard, rows, out = None, [], []

    def close() -> None:
        if len({r[0] for r in rows}) < 2 or not any(r[4] for r in rows):
            return
        # each spelling of a family walks once, and meets only the given names that share a key with its own
        trie, wordy = Trie(), []
        held: dict[str, dict[str, list[tuple[str, str]]]] = {}
        walking: dict[str, list[tuple[str, str, str]]] = {}
        for node, key, given, letters, walks, holds, words in rows:
            if words and holds:
                wordy.append((node, given, words))
            elif holds:
                if letters not in held:
                    held[letters] = {}
                    trie.add(letters, letters)
                for k in given_keys(given) if key else ("",):
                    held[letters].setdefault(k, []).append((node, given))
            if walks:
                walking.setdefault(letters, []).append((node, key, given))
        for letters, walkers in walking.items():
            most = 2 if len(letters) >= LONG else 1
            near = [(text, edits) for text, edits in trie.within(letters, most) if same_letters(letters, text, edits)] if trie.root else []
            for node, key, given in walkers:
                met: set[tuple[str, str]] = set()
                for text, _ in near:
                    for k in given_keys(given) if key else ("",):
                        met.update(held[text].get(k, ()))
                for other, other_given in met:
                    fit = given_fits(given, other_given) if key else "same"
                    if other != node and fit:
                        out.append((min(node, other), max(node, other), fit))
            for other, other_given, words in wordy:
                if any(same_letters(letters, text, edits) for text, edits in orders_within(words, letters, most)):
                    for node, key, given in walkers:
                        fit = given_fits(given, other_given) if key else "same"
                        if other != node and fit:
                            out.append((min(node, other), max(node, other), fit))

    for batch in batches:
        for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if s != shard:
                close()
                shard, rows = s, []
            rows.append(row)
        if len(out) > 50_000:
            yield _link_batch(out)
            out = []
    close()
    if out:
        yield _link_batch(out)


def _link_batch(out: list) -> pa.RecordBatch:
    unique = list(dict.fromkeys(out))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*unique)], names=["a", "b", "fit"])


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of each component of the links (a, b).

    Each round takes the least root among a node's neighbours and then the root of
    that root, so that long chains shrink by halves.
    """
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    roots = both.groupBy("node").agg(F.least("node", F.min("other")).alias("root"))
    roots = checkpointed(roots)
    while True:  # the longest chain shrinks by half each round, so it ends
        heard = both.join(roots.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("heard"))
        nearer = roots.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        of_root = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        new = checkpointed(nearer.join(of_root, "root", "left").select("node", "old", F.least("root", F.coalesce("higher", "root")).alias("root")))
        changed = new.where("root <> old").limit(1).count()
        roots = new.select("node", "root")
        if not changed:
            return roots


def parties(spellings: DataFrame) -> DataFrame:
    """name, party of each distinct spelling in the column ``name``; the party is a key that its spellings share."""
    names = spellings.select(F.regexp_replace("name", r"^\s+|\s+$", "").alias("name")).where(F.length("name") > 0).distinct()
    read = checkpointed(names.mapInArrow(_parsed, "name string, node string, block string, key string, given string, orders array<string>, words array<string>"))
    nodes = read.select("node").distinct()
    # spellings with and without blanks share a node, but only some know the words to reorder
    entries = read.select(
        "node", F.when(F.col("block") == "p", "key").otherwise("").alias("key"), "given", F.explode("orders").alias("letters"), F.col("key").alias("own"), "block", "words"
    ).select("node", "key", "given", "letters", (F.col("letters") == F.col("own")).alias("own"), "block", "words").distinct()
    # shards of names with too many orders: walked by the names of their block and length only
    n = F.length("letters")
    reach = entries.where(F.size("words") > 0).select("block", F.explode(F.sequence(n - 2, n + 2)).alias("n")).distinct()
    by_words = entries.where("own").withColumn("n", n).join(reach, ["block", "n"], "left_semi").select(*entries.columns)
    sharded = entries.withColumn("by_words", F.lit(False)).unionByName(by_words.withColumn("by_words", F.lit(True))).mapInArrow(_sharded, _SHARDED)
    links = checkpointed(sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(_links, "a string, b string, fit string").distinct())
    sure = components(links.where("fit = 'same'"))
    party = nodes.select("node").join(sure, "node", "left").select("node", F.coalesce("root", "node").alias("party"))
    # an initial joins the one party that it fits
    short = links.where("fit = 'initial'").select("a", "b").union(links.where("fit = 'initial'").select("b", "a")).toDF("node", "other")
    is_short = F.length(F.element_at(F.split("node", "\x1f"), 3)) == 1
    fits = (
        short.where(is_short).join(party.withColumnRenamed("node", "other").withColumnRenamed("party", "goal"), "other").join(party, "node")
        .groupBy("party").agg(F.min("goal").alias("goal"), F.max("goal").alias("last")).where("goal = last").select("party", "goal")
    )
    final = party.join(fits, "party", "left").select("node", F.coalesce("goal", "party").alias("party"))
    return read.select("name", "node").join(final, "node").select("name", "party")


def linked_pairs(spellings: DataFrame) -> DataFrame:
    """name_a, name_b with name_a < name_b by bytes: all pairs of spellings of one party."""
    found = checkpointed(parties(spellings))
    a, b = found.toDF("name_a", "party"), found.toDF("name_b", "party")
    return a.join(b, "party").where("name_a < name_b").select("name_a", "name_b")
