"""Evaluation texts leaking into training text: spaced-seed hashing.

A seed is a mask over SPAN consecutive words; positions where it is 0 are ignored, so a window still hits when words there
were substituted. Every window of every evaluation passage and of every document is hashed under every mask, and the two
sets of hashes are joined. A filter of the test hashes, of bounded size, goes to the map tasks first, so that of the corpus
only windows that may have a partner are joined, each with the stretch of words around it. Matches are verified word by
word along their diagonal, tolerating substitutions. An exact run of SPAN words hits under any mask, so no exact leak is
lost. A passage of fewer than SPAN words is hashed as a whole, over its own length, and found where it stands complete.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioform.llm.textvec import mix, word_hashes
from folioform.session import broadcast_if_small, materialize

SPAN = 13
#: Fixed masks of SPAN positions, nine of which count.
MASKS = ("1110110100111", "1011001111101", "1101011011011")
#: The filter has 2^FILTER_BITS bits at most (16 MB), however many test hashes there are; beyond that more windows pass it and are joined.
FILTER_BITS = 27
#: Words of all passages together that are broadcast for verification (64 MB); beyond that passages are joined by a shuffle.
BROADCAST_WORDS = 8_000_000
#: A tolerant overlap keeps at least this share of equal words; a seed's nine words of thirteen reach it.
TOLERATED = 0.65
LEAKS = "item_id bigint, doc_id bigint, exact_words int, overlap_words int, equal_words int, passage_words int"
_STEP = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(SPAN)], np.uint64)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """One hash per window of SPAN words under ``mask``."""
    n = len(words) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            h += words[k : k + n] * _STEP[k]
    return mix(h)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of ``n`` (at most SPAN) words, all of which count."""
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h += words[k : k + len(h)] * _STEP[k]
    return mix(h)


def overlap(equal: np.ndarray) -> tuple[int, int, int]:
    """(longest run of equal words, words and equal words of the best substitution-tolerant overlap) along one diagonal.

    The overlap is the stretch of greatest score, equal words scoring 1 - TOLERATED and others -TOLERATED, so its share of
    equal words stays above TOLERATED.
    """
    edge = np.flatnonzero(np.diff(np.concatenate(([0], equal.astype(np.int8), [0]))))
    run = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
    score = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - TOLERATED, -TOLERATED))))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    start = int(np.flatnonzero(score[: end + 1] == low[end])[-1])
    return run, end - start, int(equal[start:end].sum())


def windows(words: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, int]]:
    """(hashes, window length) under every mask, and under every length of ``lengths`` as a whole; no two kinds share a hash."""
    for k, m in enumerate(MASKS):
        yield mix(seed_hashes(words, m) + np.uint64(SPAN + k)), SPAN
    for n in lengths:
        if n <= len(words):
            yield mix(run_hashes(words, n) + np.uint64(n)), n


def passage_words(items: DataFrame, item_id: str, passage: str) -> DataFrame:
    """(item_id, p_no, words): the word hashes of every passage; ``p_no`` keeps passages under one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[int, list] = {}
            for rows, hashes in word_hashes(b.column(2).to_pylist()):
                for r in np.unique(rows).tolist():
                    out.setdefault(r, []).append(hashes[rows == r].view(np.int64))
            ids, no = b.column(0).to_pylist(), b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in out], pa.int64()), pa.array([no[r] for r in out], pa.int64()), pa.array([np.concatenate(x) for x in out.values()], pa.list_(pa.int64()))], ["item_id", "p_no", "words"])

    kept = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.xxhash64(F.col(passage).cast("string")).alias("p_no"), F.col(passage).cast("string").alias("p")).where("p IS NOT NULL").distinct()
    return kept.mapInArrow(run, "item_id bigint, p_no bigint, words array<bigint>")


def passage_hashes(passages: DataFrame, short: bool) -> DataFrame:
    """(h, item_id, p_no, off, n): the window hashes of the passages; of those under SPAN words one, if ``short``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, no, w in zip(b.item_id, b.p_no, b.words):
                w = np.asarray(w, np.int64).view(np.uint64)
                if len(w) >= SPAN or short:
                    out += [pd.DataFrame({"h": h.view(np.int64), "item_id": i, "p_no": no, "off": np.arange(len(h)), "n": n}) for h, n in windows(w, [len(w)] if len(w) < SPAN else [])]
            if out:
                yield pd.concat(out)

    return passages.mapInPandas(run, "h bigint, item_id bigint, p_no bigint, off int, n int")


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions of a hash."""
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def hash_filter(hashes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A filter of ``n`` hashes (h): 64-bit words, at most 2^FILTER_BITS bits, combined per word before they come to the driver."""
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(1024 * (n + 1)))))
    at = F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1))))
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v"))
    got = words.toArrow()  # at most 2^FILTER_BITS / 64 rows
    out = np.zeros((1 << bits) // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return out, bits


def corpus_segments(docs: DataFrame, doc_id: str, text: str, keep: np.ndarray, bits: int, lengths: list[int], reach: int) -> DataFrame:
    """(doc_id, seg, words, hits array<struct<h, pos>>): of every document the stretches around windows that pass the filter,
    ``reach`` words to either side; positions count from the document's first word."""
    shared = docs.sparkSession.sparkContext.broadcast(keep)

    def passes(h: np.ndarray) -> np.ndarray:
        f, (a, b) = shared.value, probes(h, bits)
        at = np.flatnonzero(f[a >> np.uint64(6)] >> (a & np.uint64(63)) & np.uint64(1))
        b = b[at]
        return at[(f[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, words in word_hashes(batch.column(1).to_pylist()):
                at, hs = [], []
                for h, n in windows(words, lengths):
                    p = passes(h)
                    p = p[row[p] == row[p + n - 1]]
                    at.append(p)
                    hs.append(h[p])
                at, hs = np.concatenate(at), np.concatenate(hs)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hs = at[order], hs[order]
                first = np.searchsorted(row, row[at], "left")
                last = np.searchsorted(row, row[at], "right")
                new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (at[1:] - at[:-1] > 2 * reach + SPAN))))
                end = np.append(new[1:], len(at))
                lo = np.maximum(at[new] - reach, first[new])
                hi = np.minimum(at[end - 1] + SPAN + reach, last[new])
                size = hi - lo
                flat = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                w = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(words[flat].view(np.int64)))
                hit = pa.StructArray.from_arrays([pa.array(hs.view(np.int64)), pa.array((at - first).astype(np.int32))], ["h", "pos"])
                hits = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)), pa.int32()), hit)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[at[new]]]), pa.array((lo - first[new]).astype(np.int32)), w, hits], ["doc_id", "seg", "words", "hits"])

    corpus = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("t")).where("doc_id IS NOT NULL AND t IS NOT NULL")
    return corpus.mapInArrow(run, "doc_id bigint, seg int, words array<bigint>, hits array<struct<h:bigint,pos:int>>")


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, short: bool = True) -> DataFrame:
    """All (item, document) pairs with a verified overlap of SPAN words or more, or (``short``) of a whole shorter passage: schema LEAKS, one row a pair with its best overlap.

    Null and empty passages or texts and rows without an id give nothing; a passage repeated under two ids is reported
    under both; rows repeated in the corpus are reported once per id. Empty tables give an empty result. The corpus is read
    once, however many items there are, and only the stretches around possible hits leave the map tasks.
    """
    passages = materialize(passage_words(items, item_id, passage), "leak-passages")
    tests = materialize(passage_hashes(passages, short), "leak-hashes")
    size = passages.agg(F.max(F.size("words")), F.sum(F.size("words").cast("bigint"))).first()
    reach, total = int(size[0] or 0), int(size[1] or 0)
    lengths = sorted(r.n for r in tests.where(F.col("n") < SPAN).select("n").distinct().collect())  # at most SPAN - 1 rows
    keep, bits = hash_filter(tests, tests.count())
    segments = materialize(corpus_segments(docs, doc_id, text, keep, bits, lengths, reach), "leak-segments")
    hits = segments.select("doc_id", "seg", F.explode("hits").alias("x")).select("doc_id", "seg", "x.h", "x.pos")
    met = hits.join(broadcast_if_small(tests), "h").select("doc_id", "seg", "item_id", "p_no", (F.col("pos") - F.col("off")).alias("diagonal"), "n").distinct()
    side = passages.withColumnRenamed("words", "p_words")
    both = met.join(F.broadcast(side) if total <= BROADCAST_WORDS else side, ["item_id", "p_no"]).join(segments.select("doc_id", "seg", "words"), ["doc_id", "seg"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, seg, i, at, n, p, w in zip(b.doc_id, b.seg, b.item_id, b.diagonal, b.n, b.p_words, b.words):
                at -= seg  # where the passage would begin in the segment
                lo, hi = max(at, 0), min(at + len(p), len(w))
                equal = np.asarray(w[lo:hi]) == np.asarray(p[lo - at : hi - at])
                if n < SPAN:
                    if equal.all() and len(equal) == n:
                        out.append((i, d, n, n, n, n))
                    continue
                exact, span, same = overlap(equal)
                if span >= SPAN:  # else the words between the seed's positions differ too much
                    out.append((i, d, exact, span, same, len(p)))
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "exact_words", "overlap_words", "equal_words", "passage_words"])

    found = both.select("doc_id", "seg", "item_id", "diagonal", "n", "p_words", "words").mapInPandas(verify, LEAKS)
    best = F.max(F.struct("equal_words", (-F.col("overlap_words")).alias("less"), "passage_words"))
    per = found.groupBy("item_id", "doc_id").agg(F.max("exact_words").alias("exact_words"), best.alias("b"))
    return per.select("item_id", "doc_id", "exact_words", (-F.col("b.less")).alias("overlap_words"), "b.equal_words", "b.passage_words")


def exact_leaks(leaks: DataFrame, words: int = SPAN) -> DataFrame:
    """(item_id, doc_id) where at least ``words`` (SPAN or more) consecutive words of the passage occur."""
    return leaks.where(F.col("exact_words") >= max(words, SPAN)).select("item_id", "doc_id")
