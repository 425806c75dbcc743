"""The BLAKE3 digest, after its public specification; a Pandas UDF for tables of blobs."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Fixed values of the specification.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
_MASK = 0xFFFFFFFF
_COLUMNS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(cv: tuple, block: bytes, counter: int, length: int, flags: int) -> tuple:
    m = struct.unpack("<16I", block)
    s = [*cv, *IV[:4], counter & _MASK, counter >> 32, length, flags]
    for r in range(7):
        for k, (a, b, c, d) in enumerate(_COLUMNS):
            for x, (rd, rb) in ((m[2 * k], (16, 12)), (m[2 * k + 1], (8, 7))):
                s[a] = (s[a] + s[b] + x) & _MASK
                v = s[d] ^ s[a]
                s[d] = (v >> rd | v << (32 - rd)) & _MASK
                s[c] = (s[c] + s[d]) & _MASK
                v = s[b] ^ s[c]
                s[b] = (v >> rb | v << (32 - rb)) & _MASK
        if r < 6:
            m = tuple(m[p] for p in PERMUTATION)
    return tuple(s[i] ^ s[i + 8] for i in range(8))


def _chunk(data: bytes, counter: int, root: int) -> tuple:
    cv, blocks = IV, [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
    for i, b in enumerate(blocks):
        last = i == len(blocks) - 1
        cv = _compress(cv, b.ljust(64, b"\x00"), counter, len(b), CHUNK_START * (i == 0) | (CHUNK_END | root) * last)
    return cv


def _subtree(data: bytes, counter: int, root: int) -> tuple:
    if len(data) <= 1024:
        return _chunk(data, counter, root)
    left = 1 << ((len(data) - 1) // 1024).bit_length() - 1  # the greatest power of two of whole chunks that leaves something
    cut = left * 1024
    pair = _subtree(data[:cut], counter, 0) + _subtree(data[cut:], counter + left, 0)
    return _compress(IV, struct.pack("<16I", *pair), 0, 64, PARENT | root)


def blake3_hex(data: bytes) -> str:
    return struct.pack("<8I", *_subtree(bytes(data), 0, ROOT)).hex()


@pandas_udf(StringType())
def blake3(content: pd.Series) -> pd.Series:
    """Hex digests of binary values; null for null."""
    return content.map(lambda b: None if b is None else blake3_hex(b))
