"""Long exact spans shared between records: Rabin-Karp hashes of every fixed-length window, counted in Spark.

The spans asked for are measured in characters, so a token here is one character.

Every window of WINDOW characters is hashed. Of any GUARANTEE - WINDOW + 1 consecutive windows at least the one of least
hash is kept (winnowing), so two records that share GUARANTEE characters keep at least one window in common, and about one
window in seventy is shuffled. A run of GUARANTEE characters around a kept window reaches MORE further on its left or on
its right, so kept windows are counted under two hashes, widened to either side; shorter boilerplate never meets. Around
windows counted in more than one text, every window of GUARANTEE characters is hashed and counted; the repeated ones merge
into maximal removal intervals, without pairing records. Pairs are wanted by another operator: records that share a kept
window are compared along the diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioform.llm.textvec import apart, chunks, mix, prefix_hash, run_hash
from folioform.session import broadcast_if_small, materialize

GUARANTEE, WINDOW = 400, 256
#: Low bits that hold a position within a piece of a chunk; the hash has the others.
_POS = np.uint64((1 << 24) - 1)
SPANS = "cls_a bigint, cls_b bigint, start_a int, start_b int, n_chars int"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of ``w`` values, in linear time."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(texts: list[str | None], guarantee: int = GUARANTEE, window: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position in its text, key) of the kept windows, each under up to two keys."""
    w, more = guarantee - window + 1, -(-(guarantee - window) // 2)
    for rows, starts, cps in chunks(texts, guarantee):
        p = prefix_hash(cps)
        begin = np.arange(len(cps) - window + 1)
        h = run_hash(p, begin, begin + window)
        if len(h) < w:
            continue
        of = np.repeat(np.arange(len(rows)), np.diff(starts))
        step, at = int(_POS) + 1 - (w - 1), []
        for base in range(0, len(h) - w + 1, step):  # pieces whose positions fit beside the hash; any w windows are in one of them
            part = h[base : base + step + w - 1]
            low = sliding_min((part & ~_POS) | np.arange(len(part), dtype=np.uint64), w)
            first = base + np.arange(len(low))
            inside = first + w - 1 + window <= starts[of[first] + 1] - 1  # the last window ends within the text of the first
            at.append(base + (low[inside] & _POS).astype(np.int64))
        at = np.unique(np.concatenate(at))
        a, b = starts[of[at]], starts[of[at] + 1] - 1
        for side, ok in ((0, at - more >= a), (1, at + window + more <= b)):
            q = at[ok]
            lo, hi = (q - more, q + window) if side == 0 else (q, q + window + more)
            yield rows[of[q]], (q - starts[of[q]]).astype(np.int32), mix(run_hash(p, lo, hi) + np.uint64(side + 1)).view(np.int64)


def equal_runs(a: str, b: str, diagonal: int, least: int) -> list[tuple[int, int, int]]:
    """Maximal (start_a, start_b, length) with a[start_a:] equal to b[start_b:], start_a - start_b = diagonal, of at least ``least`` characters."""
    lo, hi = max(0, diagonal), min(len(a), len(b) + diagonal)
    if hi - lo < least:
        return []
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a[lo:hi], b[lo - diagonal : hi - diagonal]))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (x == y).astype(np.int8), [0]))))
    return [(int(s) + lo, int(s) + lo - diagonal, int(e - s)) for s, e in zip(edge[::2], edge[1::2]) if e - s >= least]


def text_classes(df: DataFrame, row_id: str, text: str, least: int = GUARANTEE) -> DataFrame:
    """(uid, cls, t): records of at least ``least`` characters; ``cls`` is a hash of the whole text, equal for copies, and told apart for other texts."""
    t = F.col(text).cast("string")
    return apart(df.select(F.col(row_id).cast("bigint").alias("uid"), F.xxhash64(t).alias("cls"), F.xxhash64(F.lit("second"), t).alias("chk"), t.alias("t")).where(F.length("t") >= least))


def kept_windows(records: DataFrame, guarantee: int = GUARANTEE, window: int = WINDOW) -> DataFrame:
    """(key, cls, pos) of all kept windows of text_classes() records, hashed once and written to the shared folder.

    A task hashes a text it has seen before only once, so a text repeated in a third of all rows adds one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            cls, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for i, c in enumerate(cls.tolist()):
                if c in seen:
                    texts[i] = None
                seen.add(c)
            for row, pos, key in anchors(texts, guarantee, window):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cls[row]), pa.array(pos)], ["key", "cls", "pos"])

    return materialize(records.select("cls", "t").mapInArrow(run, "key bigint, cls bigint, pos int"), "span-windows")


def shared_windows(kept: DataFrame) -> DataFrame:
    """(key, lo, hi, n, pos_lo, pos_hi) of the kept windows counted in more than one class."""
    counted = kept.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n"), F.min_by("pos", "cls").alias("pos_lo"), F.max_by("pos", "cls").alias("pos_hi"))
    return materialize(counted.where("lo <> hi"), "span-counts")


def shared_spans(records: DataFrame, guarantee: int = GUARANTEE, window: int = WINDOW) -> DataFrame:
    """Maximal spans of at least ``guarantee`` characters shared by two different texts (schema SPANS, cls_a < cls_b).

    ``records`` are of text_classes. Copies of one text meet as one class.
    """
    kept = kept_windows(records, guarantee, window)
    counted = shared_windows(kept)
    two = counted.where("n = 2").select(F.col("lo").alias("cls_a"), F.col("hi").alias("cls_b"), (F.col("pos_lo") - F.col("pos_hi")).alias("diagonal"))
    hot = kept.join(counted.where("n > 2").select("key"), "key", "left_semi")
    a, b = (hot.select("key", F.col("cls").alias(f"cls_{x}"), F.col("pos").alias(f"pos_{x}")) for x in "ab")
    many = a.join(b, "key").where("cls_a < cls_b").select("cls_a", "cls_b", (F.col("pos_a") - F.col("pos_b")).alias("diagonal"))
    meet = two.unionByName(many).distinct()
    texts = records.select("cls", "t").dropDuplicates(["cls"])
    wanted = meet.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    texts = texts.join(wanted, "cls", "left_semi")
    both = meet.join(texts.select(F.col("cls").alias("cls_a"), F.col("t").alias("ta")), "cls_a").join(texts.select(F.col("cls").alias("cls_b"), F.col("t").alias("tb")), "cls_b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = [(a, b, *r) for a, b, d, ta, tb in zip(x.cls_a, x.cls_b, x.diagonal, x.ta, x.tb) for r in equal_runs(ta, tb, d, guarantee)]
            yield pd.DataFrame(out, columns=["cls_a", "cls_b", "start_a", "start_b", "n_chars"])

    return both.select("cls_a", "cls_b", "diagonal", "ta", "tb").mapInPandas(compare, SPANS)


def shared_pairs(df: DataFrame, row_id: str, text: str, guarantee: int = GUARANTEE, window: int = WINDOW) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: records whose texts share a verbatim run of at least ``guarantee`` characters.

    Null and shorter texts share nothing; copies share all. Repeated rows count once; empty tables give no rows.
    """
    records = text_classes(df, row_id, text, guarantee)
    members = records.select("uid", "cls").distinct()
    pairs = shared_spans(records, guarantee, window).select("cls_a", "cls_b").distinct()
    several = members.groupBy("cls").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi")
    links = pairs.unionByName(several.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")))
    a, b = (members.select(F.col("uid").alias(f"u{x}"), F.col("cls").alias(f"cls_{x}")) for x in "ab")
    met = links.join(a, "cls_a").join(b, "cls_b").where("cls_a <> cls_b OR ua < ub")
    return met.select(F.least("ua", "ub").alias("doc_a"), F.greatest("ua", "ub").alias("doc_b"))


#: Positions of kept windows that are broadcast together (some 40 MB); beyond that texts and positions are joined by a shuffle.
BROADCAST_POSITIONS = 5_000_000


def repeated_windows(records: DataFrame, members: DataFrame, guarantee: int = GUARANTEE, window: int = WINDOW) -> DataFrame:
    """(cls, pos): every window of ``guarantee`` characters that another text has too.

    Such a window contains a kept window counted in both texts, so only the windows around those are hashed, of one
    record a class, and counted.
    """
    kept = kept_windows(records, guarantee, window)
    keys = broadcast_if_small(shared_windows(kept).select("key"))
    met = kept.join(keys, "key", "left_semi").select("cls", "pos").distinct()
    one = members.groupBy("cls").agg(F.min("uid").alias("uid"))
    places = met.groupBy("cls").agg(F.collect_list("pos").alias("at")).join(one, "cls")  # a class's kept windows: at most one a character of its text
    places = materialize(places, "span-places")
    n = places.agg(F.sum(F.size("at") + 2)).first()[0] or 0
    where = records.join(F.broadcast(places) if n <= BROADCAST_POSITIONS else places, ["cls", "uid"]).select("cls", "t", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, t, at in zip(*(x.to_pylist() for x in batch.columns)):
                _, _, cps = next(chunks([t]))
                p = prefix_hash(cps)
                todo = np.zeros(len(t) - guarantee + 2, np.int32)  # +1 where a run of wanted starts begins, -1 after its end
                ends = np.minimum(np.array(at), len(t) - guarantee)
                np.add.at(todo, np.maximum(np.array(at) - (guarantee - window), 0), 1)
                np.add.at(todo, ends + 1, -1)
                start = np.flatnonzero(np.cumsum(todo)[:-1] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(run_hash(p, start, start + guarantee).view(np.int64)), pa.array(np.full(len(start), c)), pa.array(start.astype(np.int32))], ["h", "cls", "pos"])

    found = materialize(where.mapInArrow(run, "h bigint, cls bigint, pos int"), "span-all-windows")
    several = found.groupBy("h").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("h")
    return found.join(several, "h", "left_semi").select("cls", "pos")


def removal_intervals(df: DataFrame, row_id: str, text: str, guarantee: int = GUARANTEE, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_spans, shared_chars, n_chars, shared_share) of every record that shares something: its repeated windows
    merged into maximal intervals (touching ones are one).

    A record with a copy is shared as a whole. Null and shorter texts share nothing; what a text repeats within itself only
    is not shared. Repeated rows count once; empty tables give no rows.
    """
    records = text_classes(df, row_id, text, guarantee)
    members = materialize(records.select("uid", "cls", F.length("t").alias("n_chars")).distinct(), "span-members")
    w = Window.partitionBy("cls").orderBy("pos")  # windows of one text
    opened = repeated_windows(records, members, guarantee, window).withColumn("new", F.when(F.col("pos") - F.lag("pos").over(w) <= guarantee, 0).otherwise(1))
    merged = opened.withColumn("k", F.sum("new").over(w)).groupBy("cls", "k").agg((F.max("pos") - F.min("pos") + guarantee).alias("n"))
    merged = merged.groupBy("cls").agg(F.count("*").alias("n_spans"), F.sum("n").alias("shared_chars"))
    copies = members.groupBy("cls").agg((F.min("uid") != F.max("uid")).alias("copied"))
    out = members.join(copies, "cls").join(merged, "cls", "left").where("copied OR n_spans IS NOT NULL")
    shared = F.when(F.col("copied"), F.col("n_chars").cast("bigint")).otherwise(F.col("shared_chars"))
    return out.select(F.col("uid").alias("doc_id"), F.when(F.col("copied"), 1).otherwise(F.col("n_spans")).cast("bigint").alias("n_spans"), shared.alias("shared_chars"), F.col("n_chars").cast("bigint").alias("n_chars"), F.round(shared / F.col("n_chars"), 6).alias("shared_share"))
