"""Oversized items cut into ordered pieces at natural boundaries.

Method: every position after a run of white space gets a boundary strength
(page end 5, paragraph 4, line 3, sentence 2, word 1); a sparse table answers
range-maximum queries over the strengths. Each piece ends at the strongest
boundary of its permissible window, the rightmost of equals, and the next piece
begins ``overlap`` characters earlier. The window is the second half of the
limit, widened to everything past the overlap where it holds no boundary; where
there is none at all, the piece is cut at the limit.

Defined results: positions count Unicode code points of the parts joined with
nothing between them; null parts count as empty; items within the limit, null,
empty and part-less items give no rows; each row in gives its pieces once, so
rows delivered twice are the caller's to drop; an empty table gives no rows.
Joining the pieces without their overlaps gives the text back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE, PARAGRAPH, LINE, SENTENCE, WORD, HARD = 5, 4, 3, 2, 1, 0
NAMES = ["hard", "word", "sentence", "line", "paragraph", "page"]
#: Code points that count as white space, and those that end a sentence before it (fixed values).
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)
ENDS = np.array([ord(c) for c in ".!?;:…"], np.uint32)
WIDE_ENDS = np.array([ord(c) for c in "。！？；"], np.uint32)
CLOSERS = np.array([ord(c) for c in "\"')]”’»"], np.uint32)


def boundaries(text: str, page_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, strengths) of all places where the text may be cut, in order."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    # a membership table over the range in use is faster than sorting the text
    space = (cp <= 32) & ((cp == 32) | ((cp >= 9) & (cp <= 13)) | ((cp >= 28) & (cp <= 31)))
    high = cp > 127
    if high.any():
        space[high] = np.isin(cp[high], SPACES)
    starts = np.flatnonzero(space & ~np.concatenate(([False], space[:-1])))
    stops = np.flatnonzero(space & ~np.concatenate((space[1:], [False]))) + 1
    feeds = np.concatenate(([0], np.cumsum((cp == 10) | ((cp == 13) & (np.concatenate((cp[1:], [0])) != 10)) | (cp == 0x2028) | (cp == 0x2029))))
    breaks = feeds[stops] - feeds[starts]
    before = np.maximum(starts - 1, 0)
    last = np.where(np.isin(cp[before], CLOSERS), cp[np.maximum(starts - 2, 0)], cp[before])
    strength = np.where(breaks >= 2, PARAGRAPH, np.where(breaks == 1, LINE, np.where(np.isin(last, ENDS), SENTENCE, WORD)))
    wide = np.flatnonzero(np.isin(cp, WIDE_ENDS)) + 1 if high.any() else np.array([], np.int64)
    pages = np.array([p for p in page_ends if 0 < p < n], np.int64)
    at = np.concatenate((stops, wide, pages))
    rank = np.concatenate((strength, np.full(len(wide), SENTENCE), np.full(len(pages), PAGE)))
    keep = (at > 0) & (at < n)
    at, rank = at[keep], rank[keep]
    order = np.lexsort((rank, at))
    at, rank = at[order], rank[order]
    final = np.concatenate((at[1:] != at[:-1], [True])) if len(at) else np.array([], bool)
    return at[final], rank[final]


class StrongestCut:
    """Sparse table: the rightmost strongest boundary of any range in constant time."""

    def __init__(self, at: np.ndarray, rank: np.ndarray):
        self.at, self.rank = at, rank
        level = (rank.astype(np.int64) << 32) | np.arange(len(at))
        self.levels = [level]
        width = 1
        while 2 * width <= len(at):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def best(self, low: int, high: int) -> tuple[int, int] | None:
        """(position, strength) of the best cut with low <= position <= high."""
        i, j = np.searchsorted(self.at, low, "left"), np.searchsorted(self.at, high, "right")
        if i >= j:
            return None
        k = int(j - i).bit_length() - 1
        found = max(self.levels[k][i], self.levels[k][j - (1 << k)]) & 0xFFFFFFFF
        return int(self.at[found]), int(self.rank[found])


def pieces(parts: list[str | None], limit: int, overlap: int) -> list[tuple[int, int, str, str]]:
    """(start, end, boundary, text) of each piece of an item over the limit."""
    texts = [p or "" for p in parts]
    text = "".join(texts)
    if len(text) <= limit:
        return []
    table = StrongestCut(*boundaries(text, np.cumsum([len(t) for t in texts]).tolist()))
    out, start = [], 0
    while len(text) - start > limit:
        found = table.best(start + max(limit // 2, overlap + 1), start + limit) or table.best(start + overlap + 1, start + limit)
        end, rank = found or (start + limit, HARD)
        out.append((start, end, NAMES[rank], text[start:end]))
        start = end - overlap
    out.append((start, len(text), "end", text[start:]))
    return out


def split_oversized(df: DataFrame, key: Column, parts: Column, limit: int, overlap: int = 200) -> DataFrame:
    """item_key, piece_no (from 1), start_pos, end_pos, boundary, piece of every item over ``limit`` characters.

    ``parts`` is an array of strings, such as the pages of a document in order, or an array of one text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    over = df.select(key.cast("string").alias("item_key"), parts.alias("parts")).where(
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(F.length(p), F.lit(0)).cast("bigint")) > limit
    )
    schema = "item_key string, piece_no int, start_pos int, end_pos int, boundary string, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = [
                    (k, no, *piece)
                    for k, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for no, piece in enumerate(pieces(texts, limit, overlap), 1)
                ]
                columns = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["item_key", "piece_no", "start_pos", "end_pos", "boundary", "piece"])

    return over.mapInArrow(run, schema)


def pages_in_order(pages: str = "pages") -> Column:
    """Texts of a document's pages by page number; pages of one number keep their order."""
    return F.expr(
        f"transform(array_sort(transform(arrays_zip({pages}.page_number, {pages}.text), (p, i) -> struct(p.page_number AS n, i AS i, p.text AS t))), x -> x.t)"
    )
