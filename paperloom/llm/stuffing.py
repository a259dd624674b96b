"""Pages of stuffed keywords, link lists and tags.

Method: mean pointwise mutual information of neighbouring words, from counts of
the whole corpus. For neighbours a, b of a block (a paragraph; short ones are
joined) it is log P(b | a) / P(b): how much likelier b is after a, by the counts
of all other documents, than b is in the block at all. Words of a language lead
to one another, so prose, schedules and name lists score high in whatever order
of topics they come. Words thrown together score as their block shuffled: about
zero or less. Two tests stand on it:

* salad: the mean is far below zero, or it is low within the segments of a block
  (between commas, bars, bullets and line ends), too, and most words or many
  neighbours return in the block;
* repeated collocations: half of the neighbours repeat an earlier pair and the
  mean is no higher than that of the shuffled block. Repeated sentences of prose
  are spared since their words lead to one another.

Links and tags are words of two classes in these counts; a word beside one counts
as the same collocation whatever the word. Numbers take no part. A pair whose
second word is seen less than ``RARE`` times elsewhere is no evidence and counts
zero, and counts are shrunk to the shuffled block by ``PRIOR`` sightings.
A document is found if such blocks hold more than half of its characters.

Scale. Texts are read once into word ids. Documents go to chunks by a hash; each
chunk sends the counts of its distinct words and pairs, they are summed by pair
(at most one row a chunk, so no pair is hot), and each chunk gets the sums of
its own pairs back. Nothing is broadcast or sent to the driver, and all counts
are exact for word ids of 30 bits. ``chunks`` sets how many chunks there are; a
chunk's ids and counts must fit in a task.

Defined results: null, empty, blank and wordless texts are never found; repeated
documents are each judged alike; an empty table gives no rows; only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import chunk_of, chunks_for

#: Ids of the classes that stand for all numbers, links and tags, and for any word beside a link or tag.
NUMBER, LINK, TAG, ANY = 0, 1, 2, 3
#: In a document's ids: the end of a segment; ``BLOCK`` less its characters begins a block.
CUT, BLOCK = -1, -2
#: In place of the second word of a pair: the count of the first by itself.
ALONE = (1 << 32) - 1
CACHE_TOKENS, SLICE = 400_000, 1 << 22
RARE, PRIOR = 30, 5.0
#: Paragraphs shorter than this are judged together; blocks of fewer words aren't judged.
SHORT, LEAST_WORDS = 60, 4
#: Mean information of salad by itself; at most that of a shuffled block, as a whole and within segments.
SALAD, SHUFFLED, IN_SEGMENTS = -1.0, 0.15, 0.3
#: Shares of neighbours and of words that repeat earlier ones of the block.
MANY, MOST_PAIRS, MOST_WORDS = 0.15, 0.5, 0.5

URL = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]|,;]+|[a-z0-9-]+(?:\.[a-z0-9-]+)+/[^\s\"'<>)\]|,;]*", re.I)
PART = re.compile(r"\x01|#[^\W_][\w-]*|[^\W\d_]+(?:_[^\W_]+[\w-]*)+|[^\W\d_]+|\d[\d.,/:-]*")
BLANK_LINES = re.compile(r"\r?\n[^\S\n]*\r?\n\s*|\r[^\S\r\n]*\r\s*")
LINE_ENDS = re.compile(r"[\r\n]+")
HAS_LETTER, HAS_FIGURE = re.compile(r"[^\W\d_]"), re.compile(r"\d")
ENDS_SEGMENT = re.compile(r"[.!?,;|•/]$")


def _word_id(word: str) -> int:
    return 4 + zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % (1 << 30)


def _part_id(w: str) -> int:
    if w == "\x01":
        return LINK
    if w[0] == "#" or "_" in w:
        return TAG
    return NUMBER if w[0].isdigit() else _word_id(w)


class Words:
    """Word ids of texts; white-space tokens seen before are looked up."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {"\x02": array("i", [CUT]).tobytes()}

    def _token(self, token: str) -> bytes:
        plain = token.strip(".,;:()|\"'!?-/•")
        if plain.isalpha():  # most tokens are one word
            ids = [_word_id(plain)]
        elif "#" not in token and not HAS_LETTER.search(token):
            ids = [NUMBER] if HAS_FIGURE.search(token) else []
        elif "/" not in token and "." not in token:
            ids = [_part_id(w) for w in PART.findall(token)]
        else:
            ids = [_part_id(w) for w in PART.findall(URL.sub(" \x01 ", token))]
        if ENDS_SEGMENT.search(token) and ids[-1:] != [LINK]:
            ids.append(CUT)
        return array("i", ids).tobytes()

    def of(self, text: str) -> bytes:
        """Ids of the words of a text, in order, with the ends of its segments."""
        tokens, known = LINE_ENDS.sub(" \x02 ", text).split(), self.known
        try:
            return b"".join(map(known.__getitem__, tokens))
        except KeyError:
            if len(known) > CACHE_TOKENS:
                self.__init__()
                known = self.known
            for t in set(tokens).difference(known):
                known[t] = self._token(t)
            return b"".join(map(known.__getitem__, tokens))

    def document(self, text: str) -> bytes:
        """Ids of a text with the sizes of its blocks."""
        out: list[bytes] = []
        for block in blocks(text):
            out += (array("i", [BLOCK - len(block)]).tobytes(), self.of(block))
        return b"".join(out)


def blocks(text: str) -> Iterator[str]:
    """Paragraphs, runs of short ones as one."""
    short: list[str] = []
    for p in BLANK_LINES.split(text):
        if len(p) < SHORT:
            short.append(p)
            continue
        if short:
            yield "\n".join(short)
            short = []
        yield p
    if short:
        yield "\n".join(short)


@lru_cache(maxsize=1)
def worker_words() -> Words:
    """The words a worker process has seen, kept from one task to the next."""
    return Words()


class Read:
    """The words, neighbours and blocks of documents, as arrays over all of them."""

    def __init__(self, documents: list[bytes]):
        ids = np.frombuffer(b"".join(documents), np.int32)
        lengths = np.fromiter((len(d) // 4 for d in documents), np.int64, len(documents))
        starts = ids <= BLOCK
        at = np.flatnonzero(ids >= 0)
        self.sizes = (BLOCK - ids[starts]).astype(np.int64)
        self.block_document = np.repeat(np.arange(len(documents)), lengths)[starts]
        self.words = ids[at].astype(np.int64)
        self.block = (np.cumsum(starts) - 1)[at]
        self.document = self.block_document[self.block] if len(at) else at
        plain = self.words != NUMBER
        self.first = np.flatnonzero((self.block[:-1] == self.block[1:]) & plain[:-1] & plain[1:]) if len(at) > 1 else at[:0]
        self.within = np.diff(at)[self.first] == 1 if len(at) > 1 else np.zeros(0, bool)
        self.pairs = (self.words[self.first] << 32) | self.words[self.first + 1] if len(self.first) else self.first

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words and pairs with their numbers."""
        words, n_words = np.unique(self.words[self.words != NUMBER], return_counts=True)
        pairs, n_pairs = np.unique(self.pairs, return_counts=True)
        return np.concatenate([(words << 32) | ALONE, pairs]), np.concatenate([n_words, n_pairs])

    def stuffed(self, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Which blocks are stuffed, by the corpus counts (sorted by key) of all words and pairs that stand here."""
        n_blocks = len(self.sizes)
        length = np.bincount(self.block, minlength=n_blocks)
        if not len(self.first):
            return np.zeros(n_blocks, bool)
        alone = np.searchsorted(keys, (self.words << 32) | ALONE)
        alone[self.words == NUMBER] = 0
        of_words = totals[alone] - _same(self.document, alone)
        in_block = _same(self.block, alone)
        a, b = self.first, self.first + 1
        pair = np.searchsorted(keys, self.pairs)
        together = totals[pair] - _same(self.document[a], pair)
        block = self.block[a]
        information = np.log((together * length[block] / in_block[b] + PRIOR) / (of_words[a] + PRIOR))
        information[of_words[b] < RARE] = 0.0
        n = np.maximum(1, np.bincount(block, minlength=n_blocks))
        mean = np.bincount(block, information, n_blocks) / n
        in_segments = np.bincount(block, information * self.within, n_blocks) / n
        left, right = self.words[a], self.words[b]
        mark_left, mark_right = (left == LINK) | (left == TAG), (right == LINK) | (right == TAG)
        left, right = np.where(mark_right & ~mark_left, ANY, left), np.where(mark_left & ~mark_right, ANY, right)
        repeats = (np.bincount(block, minlength=n_blocks) - _distinct(block, (left << 32) | right, n_blocks)) / np.maximum(1, length - 1)
        plain = self.words != NUMBER
        returning = (np.bincount(self.block[plain], minlength=n_blocks) - _distinct(self.block[plain], self.words[plain], n_blocks)) / np.maximum(1, length)
        salad = (mean < SALAD) | ((mean < SHUFFLED) & (in_segments < IN_SEGMENTS) & ((repeats >= MANY) | (returning >= MOST_WORDS)))
        return (length >= LEAST_WORDS) & (salad | ((mean < SHUFFLED) & (repeats >= MOST_PAIRS)))

    def shares(self, keys: np.ndarray, totals: np.ndarray, documents: int) -> np.ndarray:
        """Share of each document's characters that stands in stuffed blocks."""
        bad = np.bincount(self.block_document, self.sizes * self.stuffed(keys, totals), documents)
        return bad / np.maximum(1, np.bincount(self.block_document, self.sizes, documents))


def slices(documents: list[bytes]) -> Iterator[list[bytes]]:
    """Documents in runs of about ``SLICE`` bytes of ids, so that the arrays over them stay small."""
    part, size = [], 0
    for d in documents:
        part.append(d)
        size += len(d)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _same(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each place, how often its key stands in its group."""
    _, at, n = np.unique((group.astype(np.int64) << 32) | key, return_inverse=True, return_counts=True)
    return n[at]


def _distinct(group: np.ndarray, key: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct keys of each group."""
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    g, k = group[order], key[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return np.bincount(g[new], minlength=groups)


def word_ids(corpus: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """id, chunk INT, ids BINARY: each document with words, shuffled to its chunk."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = corpus.where(F.length(text_col) > 0).select(id_col, text_col, chunk_of(chunks, id_col, text_col).alias("__chunk"))
    kind, id_arrow = dict(source.dtypes)[id_col], to_arrow_type(source.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words()
        for batch in batches:
            ids = [words.document(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_arrow), batch.column(2), pa.array(ids, pa.binary())], names=["id", "chunk", "ids"])

    return source.mapInArrow(run, f"id {kind}, chunk int, ids binary").repartition(chunks, "chunk")


def chunk_counts(ids: DataFrame) -> DataFrame:
    """chunk INT, key BIGINT, n BIGINT: the words and pairs of each chunk with their numbers in all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, list[bytes]] = {}  # whole chunks, so that each sends a key once
        for batch in batches:
            for c, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                chunks.setdefault(c, []).append(text)
        for c in list(chunks):
            keys, n = Read(chunks.pop(c)).counts()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))], names=["chunk", "key", "n"])

    summed = ids.mapInArrow(run, "chunk int, key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks"))
    return summed.select(F.explode("chunks").alias("chunk"), "key", "n")


def stuffed_documents(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.5, chunks: int | None = None) -> DataFrame:
    """id and stuffed_share of each document with more than ``least_share`` of its characters in stuffed blocks."""
    from pyspark.sql.pandas.types import to_arrow_type

    ids = word_ids(corpus, id_col, text_col, chunks_for(corpus, chunks))
    kind, id_arrow = dict(ids.dtypes)["id"], to_arrow_type(ids.schema["id"].dataType)

    def judge(documents: pa.Table, counts: pa.Table) -> pa.Table:
        keys, totals = counts.column("key").to_numpy(), counts.column("n").to_numpy()
        order = np.argsort(keys)
        keys, totals = keys[order], totals[order]
        texts = documents.column("ids").to_pylist()
        parts = [Read(part).shares(keys, totals, len(part)) for part in slices(texts)] if len(keys) else [np.zeros(len(texts))]
        shares = np.concatenate(parts)
        found = documents.column("id").combine_chunks().filter(pa.array(shares > least_share))
        return pa.table([found.cast(id_arrow), pa.array(shares[shares > least_share])], names=["id", "stuffed_share"])

    found = ids.groupBy("chunk").cogroup(chunk_counts(ids).groupBy("chunk")).applyInArrow(judge, f"id {kind}, stuffed_share double")
    return found.withColumnRenamed("id", id_col)
