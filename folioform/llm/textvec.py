"""Vectorised views of batches of texts: code points, words and polynomial (Rabin-Karp) hashes, computed by numpy."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioform.session import broadcast_if_small

#: Characters handled at once; a longer text is handled alone.
CHUNK_CHARS = 1_000_000
_BASE = 0x5851F42D4C957F2D
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """True at the code points of letters and digits."""
    return np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    both = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        both.append(np.cumprod(p))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = 1 << max(20, (n - 1).bit_length())
    a, b = _powers(up)
    return a[:n], b[:n]


def chunks(texts: list[str], least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, code points) of groups of texts of at least ``least`` characters; each text is followed by one line feed."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < max(1, least):
            continue
        if group and size + len(t) > CHUNK_CHARS:
            yield _chunk(texts, group)
            group, size = [], 0
        group.append(i)
        size += len(t) + 1
    if group:
        yield _chunk(texts, group)


def _chunk(texts: list[str], group: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined = "\n".join([*(texts[i] for i in group), ""])
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum([0, *(len(texts[i]) + 1 for i in group)])
    return np.array(group), starts, cps


def prefix_hash(cps: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of mixed code points times BASE^j for j < i."""
    up, _ = powers(len(cps) + 1)
    p = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(mix(cps.astype(np.uint64) + _GOLD) * up[:-1], out=p[1:])
    return p


def run_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [start, end), equal for equal runs wherever they stand."""
    _, down = powers(len(p))
    return mix((p[end] - p[start]) * down[start])


def word_hashes(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of each word, 64-bit hash of each word) per chunk; words are maximal runs of letters or digits in lower case."""
    for rows, starts, cps in chunks([None if t is None else t.lower() for t in texts]):
        inside = alnum_table()[cps]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        begin, end = edge[::2], edge[1::2]  # a chunk ends in a line feed, so every word ends
        yield rows[np.searchsorted(starts, begin, "right") - 1], run_hash(prefix_hash(cps), begin, end)


def apart(rows: DataFrame) -> DataFrame:
    """``rows`` with classes (``cls``, a 64-bit hash) told apart by a second 64-bit hash ``chk`` of the same content: where one
    class has several of these, they become the classes. Expected of some hundred classes in 10^11, so the extra table is small."""
    mixed = rows.groupBy("cls").agg(F.min("chk").alias("_lo"), F.max("chk").alias("_hi")).where("_lo <> _hi").select("cls", F.lit(True).alias("_mixed"))
    if mixed.isEmpty():
        return rows.drop("chk")
    return rows.join(broadcast_if_small(mixed), "cls", "left").withColumn("cls", F.when(F.col("_mixed"), F.col("chk")).otherwise(F.col("cls"))).drop("_mixed", "chk")
