"""Fingerprints of texts and joins of near duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import checkpointed

SHINGLE, LEAST = 5, 200
#: Fingerprints that share a key of bits at random, at most about so many; and those of a key that one part of a join holds.
CROWD, PART = 64, 10_000
_OFFSET, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def normalized(text: str) -> str:
    """Lower-case letters and figures with single spaces between words."""
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text).split())


def simhash(text: str | None) -> int | None:
    """64-bit fingerprint of the five-character shingles of a text, none for short ones."""
    flat = normalized(text or "")
    cp = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) < LEAST:
        return None
    octets = cp.view(np.uint8).reshape(-1, 4).astype(np.uint64)
    n = len(cp) - SHINGLE + 1
    with np.errstate(over="ignore"):
        h = np.full(n, _OFFSET, np.uint64)
        for k in range(SHINGLE):
            for b in range(4):
                h = (h ^ octets[k : k + n, b]) * _PRIME
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = int.from_bytes(np.packbits(2 * bits > n, bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``fingerprint`` (a signed 64-bit number) of every row; null where the text is too short."""
    from pyspark.sql.pandas.types import to_arrow_type

    source = df.select(id_col, text_col)
    kind = to_arrow_type(source.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kind), pa.array([simhash(t) for t in batch.column(1).to_pylist()], pa.int64())], names=[id_col, "fingerprint"])

    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, fingerprint bigint")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def bands_for(n: int, most: int) -> tuple[int, int]:
    """(blocks, how many of them make a key) so that a key is shared by about ``CROWD`` of ``n`` fingerprints at random.

    ``most`` bits spoil as many blocks at most, so some key of the blocks that are left is equal for all pairs within ``most`` bits.
    """
    take = 1
    while n >> (take * 64 // (most + take)) > CROWD and take < 5:
        take += 1
    return most + take, take


def band_keys(c: Column, blocks: int, take: int) -> Column:
    """The keys of a fingerprint: each choice of ``take`` of its blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen) for chosen in combinations(range(blocks), take)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(k).alias("band"), c.bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(signed)])


def fingerprint_classes(prints: DataFrame, id_col: str) -> DataFrame:
    """fingerprint, representative (the least id) and members of each distinct fingerprint."""
    return prints.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min(id_col).alias("representative"), F.count("*").alias("members"))


def near_classes(prints: DataFrame, id_col: str, most: int = 6) -> DataFrame:
    """fingerprint_a < fingerprint_b, distance: all pairs of different fingerprints within ``most`` bits.

    Equal fingerprints are one class and meet once, however many documents carry
    them; :func:`near_members` gives the documents of a class. The classes of a key
    that many share are met in parts: each is sent to every part, and asks in its own.
    """
    classes = checkpointed(fingerprint_classes(prints, id_col))
    blocks, take = bands_for(classes.count(), most)
    banded = classes.select("fingerprint", F.explode(band_keys(F.col("fingerprint"), blocks, take)).alias("k")).select("fingerprint", "k.band", "k.value")
    crowds = banded.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1").select("band", "value", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    met = banded.join(crowds, ["band", "value"])
    a = met.select("band", "value", F.col("fingerprint").alias("fingerprint_a"), F.pmod(F.xxhash64("fingerprint"), "parts").cast("int").alias("part"))
    b = met.select("band", "value", F.col("fingerprint").alias("fingerprint_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    distance = hamming(F.col("fingerprint_a"), F.col("fingerprint_b"))
    pairs = a.join(b, ["band", "value", "part"]).where(F.col("fingerprint_a") < F.col("fingerprint_b")).withColumn("distance", distance).where(F.col("distance") <= most)
    return pairs.select("fingerprint_a", "fingerprint_b", "distance").distinct()


def near_members(prints: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    """``id_col``, representative, members, links: the class of each row with a fingerprint, and how many other classes are near it."""
    ends = pairs.select(F.explode(F.array("fingerprint_a", "fingerprint_b")).alias("fingerprint"))
    links = ends.groupBy("fingerprint").agg(F.count("*").alias("links"))
    classes = fingerprint_classes(prints, id_col).join(links, "fingerprint", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return prints.join(classes, "fingerprint").select(id_col, "representative", "members", "links")
