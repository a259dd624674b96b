"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: speculate and verify. Every distinct pre-token is proposed as its
greedy longest-match tokens; a vectorised check then tests whether each
adjacent pair of proposed tokens is one that merging could leave side by side.
A token sequence is the BPE encoding exactly if all its adjacent pairs are
compatible, so only words with a failing pair are merged step by step.

Defined results: a null text and an empty text both give an empty list; text
that looks like a special token is encoded as ordinary text; one row comes out
per row that goes in, repeated rows included; other columns are not read, so
clashing names cannot occur.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a worker keeps; beyond that the store is emptied and refilled.
CACHE_WORDS = 400_000

_SPACE = r"\t-\r \x85\xa0  -     　"
#: The pre-token pattern of the vocabulary, with white space spelled out as Unicode defines it.
PRETOKEN = regex.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+",
    regex.V0,
)
#: A space with white space on both sides (or another space): its text is cut at lone spaces only.
CROWDED = re.compile(r"\s \s| {2}|^ | $")
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(shifted)}


class SpeculativeBpe:
    """Encoder of words for one vocabulary file (JSON with ``model.vocab`` and ``model.merges``)."""

    def __init__(self, vocab_path: str):
        with open(vocab_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        alphabet = byte_alphabet()
        ids = model["vocab"]
        as_bytes = {t: bytes(alphabet[c] for c in t) for t in ids if all(c in alphabet for c in t)}
        self.ids = {b: ids[t] for t, b in as_bytes.items()}
        self.longest = max(map(len, self.ids))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(ids.values()) + 1
        self.left, self.right = np.arange(size), np.arange(size)
        self.rank: dict[tuple[int, int], int] = {}
        self.rank_of_id = np.full(size, -1, np.int64)
        keys = []
        for rank, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.left[z], self.right[z], self.rank_of_id[z] = x, y, rank
            self.rank[x, y] = rank
            keys.append((x << 32) | y)
        self.merged = [ids[a + b] for a, b in merges]
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], order.astype(np.int64)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, at, ids, longest = [], 0, self.ids, self.longest
        while at < len(word):
            for end in range(min(len(word), at + longest), at, -1):
                if (found := ids.get(word[at:end])) is not None:
                    out.append(found)
                    at = end
                    break
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would merging leave exactly this boundary in place?

        Both tokens are undone merge by merge from the latest one. If two parts that
        meet at the boundary form a merge earlier than the ones undone so far,
        merging would have crossed the boundary.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        ok, alive = np.ones(len(a), bool), np.arange(len(a))
        # a merge that crosses from the left part wins ties against later positions, hence the two limits
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(alive):
            x, y = a[alive], b[alive]
            key = (x << 32) | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossing = np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)
            bad = crossing < limit[alive]
            ok[alive[bad]] = False
            rx, ry = self.rank_of_id[x], self.rank_of_id[y]
            done = (rx < 0) & (ry < 0)
            go = ~bad & ~done
            undo_first = go & (rx > ry)
            undo_second = go & ~undo_first
            i, j = alive[undo_first], alive[undo_second]
            limit[i], a[i] = rx[undo_first], self.right[x[undo_first]]
            limit[j], b[j] = ry[undo_second] + 1, self.left[y[undo_second]]
            alive = alive[go]
        return ok

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding, by the earliest merge each time."""
        parts = [self.ids[bytes([b])] for b in word]
        if len(parts) > 64:
            return self._merge_long(parts)
        rank = self.rank
        while len(parts) > 1:
            best, at = min((rank.get(p, 1 << 40), k) for k, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [self.merged[best]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """As ``merge`` with a heap over a linked list, for words of thousands of bytes."""
        import heapq

        n = len(parts)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(n - 1) if (r := self.rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, x, y = heapq.heappop(heap)
            if not live[k] or parts[k] != x or (m := after[k]) >= n or parts[m] != y:
                continue
            parts[k], live[m], after[k] = self.merged[r], False, after[m]
            if after[k] < n:
                before[after[k]] = k
            for i, j in ((before[k], k), (k, after[k])):
                if i >= 0 and j < n and (s := self.rank.get((parts[i], parts[j]))) is not None:
                    heapq.heappush(heap, (s, i, parts[i], parts[j]))
        return [p for p, alive in zip(parts, live) if alive]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that the store lacks: all proposed, all pairs checked at once, failures merged."""
        todo = list(words)
        if not todo:
            return
        if len(self.words) + len(todo) > CACHE_WORDS:
            self.words.clear()
        raw = [w.encode("utf-8", "surrogatepass") for w in todo]
        proposed = [self.propose(w) for w in raw]
        flat = np.fromiter(chain.from_iterable(proposed), np.int64)
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        owner = np.repeat(np.arange(len(todo)), lengths)
        inside = owner[1:] == owner[:-1]
        fails = np.unique(owner[:-1][inside][~self.compatible(flat[:-1][inside], flat[1:][inside])]) if len(flat) > 1 else []
        for k in fails:
            proposed[k] = self.merge(raw[k])
        self.words.update(zip(todo, (array("i", p).tobytes() for p in proposed)))

    def learn_pieces(self, pieces: set[str]) -> None:
        """Encodes pieces as they stand after a space: the space belongs to the piece."""
        if len(self.pieces) + len(pieces) > CACHE_WORDS:
            self.pieces.clear()
        todo = list(pieces)
        split = [PRETOKEN.findall(f" {p}") for p in todo]
        words = set().union(*split)
        self.learn(words.difference(self.words) if len(self.words) + len(words) <= CACHE_WORDS else words)
        get = self.words.__getitem__
        self.pieces.update((p, b"".join(map(get, ws))) for p, ws in zip(todo, split))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts.

        A single space between two characters that are not white space always
        begins a pre-token, so a text may be cut there and its pieces looked up.
        """
        split = [(t.split(" ") if not CROWDED.search(t) else LONE_SPACE.split(t)) if t else None for t in texts]
        heads = [PRETOKEN.findall(p[0]) if p else [] for p in split]
        tails = [p[1:] if p else [] for p in split]
        needed = set().union(*tails)
        new = needed.difference(self.pieces)
        self.learn_pieces(new if len(self.pieces) + len(new) <= CACHE_WORDS else needed)
        words = set().union(*heads)
        self.learn(words.difference(self.words) if len(self.words) + len(words) <= CACHE_WORDS else words)
        word, piece = self.words.__getitem__, self.pieces.__getitem__
        ids = [b"".join(map(word, h)) + b"".join(map(piece, t)) for h, t in zip(heads, tails)]
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(texts)) // 4, out=offsets[1:])
        return offsets, np.frombuffer(b"".join(ids), np.int32)


@lru_cache(maxsize=4)
def encoder(vocab_path: str) -> SpeculativeBpe:
    """One encoder a worker process."""
    return SpeculativeBpe(vocab_path)


def default_vocab() -> str:
    """Path of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocab_path: str | None = None, out_col: str = "ids") -> DataFrame:
    """``id_col`` and the token ids of ``text_col``, one row a row, without a shuffle."""
    path = str(vocab_path or default_vocab())
    source = df.select(F.col(id_col), F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            offsets, ids = bpe.encode_batch(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, out_col])

    kind = dict(source.dtypes)[id_col]
    return source.mapInArrow(run, f"`{id_col}` {kind}, `{out_col}` array<int>")
