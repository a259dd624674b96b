"""Evaluation texts that stand, wholly or in part, inside corpus documents.

Method: pigeonhole edit matching on words. A run of ``min_words`` words of a
test item with at most ``max_errors`` word edits must keep one of the item's
consecutive pieces of ``(min_words + 1) // (max_errors + 2)`` words intact,
because such a run holds at least ``max_errors + 1`` whole pieces at whatever
word it begins. An automaton finds all exact piece hits in a document in one
pass; each hit is verified with Myers' bit-parallel distance, and with no error
allowed the exact run around the hit is measured as well.

Words are runs of letters and digits, compared in lower case. Defined results:
null, empty and wordless texts have no rows; an item of fewer than
``min_words`` words has none; repeated documents give their row once per
document id; an empty item or corpus table gives no rows. Items are the stated
query set: they go to the workers in blocks of at most ``block_words`` words,
whatever their number, so that no automaton grows with the corpus.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_WORD = re.compile(r"[\W_]+")
#: Words of items in one automaton, about 100 bytes each.
BLOCK_WORDS = 200_000


def words_of(text: str | None) -> str:
    """The words of a text, lower case, one space between and around them."""
    return f" {NOT_WORD.sub(' ', text.lower()).strip()} " if text else "  "


def myers_within(pattern: list[str], text: list[str], budget: int) -> tuple[int, int]:
    """(least distance of the whole pattern to any stretch of the text, its end), by bit vectors over words.

    Stops early where the distance is 0. The pattern must not be empty; ``budget`` only bounds what is of interest.
    """
    m = len(pattern)
    peq: dict[str, int] = defaultdict(int)
    for k, w in enumerate(pattern):
        peq[w] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
            if best == 0:
                break
    return best, end


class LeakFinder:
    """Automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, max_errors: int):
        import ahocorasick

        self.min_words, self.max_errors = min_words, max_errors
        self.size = (min_words + 1) // (max_errors + 2)
        if self.size < 1:
            raise ValueError("the error budget leaves no piece of a whole word")
        self.items = {i: words_of(t).split() for i, t in items}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.items.items():
            if len(w) >= min_words:
                for at in range(0, len(w) - self.size + 1, self.size):
                    pieces[f" {' '.join(w[at : at + self.size])} "].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str | None) -> dict[int, tuple[int, int]]:
        """Item to (longest matched words, least errors) of the runs found in a text."""
        if self.empty or not text:
            return {}
        flat = words_of(text)
        hits = list(self.automaton.iter(flat))
        if not hits:
            return {}
        words = flat.split()
        word_at = {0: 0}
        count = 0
        for k, c in enumerate(flat[:-1]):
            if c == " ":
                word_at[k] = count
                count += 1
        out: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int, int]] = set()
        for end, (length, places) in hits:
            at = word_at[end - length + 1]
            for item, begin in places:
                line = (item, at - begin, begin if self.max_errors else -1)
                if line in seen:
                    continue
                own = self.items[item]
                errors = self._least_errors(own, begin, words, at)
                if errors is None:
                    continue
                seen.add(line)
                run = self._run(own, begin, words, at)
                if run >= self.min_words or self.max_errors:
                    found = (max(run, self.min_words), errors)
                    if item not in out or (-found[1], found[0]) > (-out[item][1], out[item][0]):
                        out[item] = found
        return out

    def _least_errors(self, own: list[str], begin: int, words: list[str], at: int) -> int | None:
        """Myers' distance of the best window of the item around a piece hit, if within the budget."""
        k, least, best = self.max_errors, self.min_words, None
        lo = max(0, begin + self.size - least)
        near = set(words[max(0, at - least - k) : at + least + k])
        # a window within the budget shares all its words but k with the stretch, which rules most hits out
        shared = [0]
        for w in own[lo : begin + least]:
            shared.append(shared[-1] + (w in near))
        for first in range(lo, min(begin, len(own) - least) + 1):
            if shared[first - lo + least] - shared[first - lo] < least - k:
                continue
            ahead = begin - first
            stretch = words[max(0, at - ahead - k) : at + least - ahead + k]
            if len(stretch) < least - k:
                continue
            distance, _ = myers_within(own[first : first + least], stretch, k)
            if distance <= k and (best is None or distance < best):
                best = distance
                if best == 0:
                    break
        return best

    def _run(self, own: list[str], begin: int, words: list[str], at: int) -> int:
        """Length of the run of equal words around a piece hit."""
        lo, hi = 0, self.size
        while begin - lo > 0 and at - lo > 0 and own[begin - lo - 1] == words[at - lo - 1]:
            lo += 1
        while begin + hi < len(own) and at + hi < len(words) and own[begin + hi] == words[at + hi]:
            hi += 1
        return lo + hi


def leaked_items(
    corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    min_words: int = 12, max_errors: int = 0, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc, item, matched words and errors: one row per document and item with a run within the error budget."""
    blocks = _blocks(items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")), block_words)
    source = corpus.select(F.col(doc_id), F.col(doc_text))
    kind, item_kind = dict(source.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"`{doc_id}` {kind}, `{item_id}` {item_kind}, matched_words int, errors int"
    if not blocks:
        return corpus.sparkSession.createDataFrame([], schema)
    passes = [source.mapInArrow(_finder_of(b, min_words, max_errors, doc_id, item_id, source, items.schema[item_id].dataType), schema) for b in blocks]
    return reduce(DataFrame.unionByName, passes).dropDuplicates([doc_id, item_id])


def _blocks(items: DataFrame, block_words: int) -> list[list[tuple[int, str]]]:
    blocks: list[list[tuple[int, str]]] = []
    size = block_words
    for i, t in items.where("i is not null and t is not null").dropDuplicates(["i"]).toLocalIterator():
        n = len(t) // 4 + 1
        if size + n > block_words:
            blocks.append([])
            size = 0
        blocks[-1].append((i, t))
        size += n
    return blocks


def _finder_of(block, min_words, max_errors, doc_id, item_id, source, item_type):
    from pyspark.sql.pandas.types import to_arrow_type

    doc_arrow, item_arrow = to_arrow_type(source.schema[doc_id].dataType), to_arrow_type(item_type)
    spark = source.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = LeakFinder(sent.value, min_words, max_errors)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, item, *how) for i, t in zip(ids, texts) for item, how in finder.find(t).items()]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (doc_arrow, item_arrow, pa.int32(), pa.int32()))], names=[doc_id, item_id, "matched_words", "errors"])

    return run
