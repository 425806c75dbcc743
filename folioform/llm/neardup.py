"""Near-duplicate records with small edits: ProbMinHash signatures, banding, exact verification.

Words (or word shingles) are weighted by rarity; a ProbMinHash signature lets every element arrive by a Poisson process of
its weight whose points fall on random registers, and stops as soon as no later point can win one. Two records agree in a
register with the probability (weighted) Jaccard of their sets. Registers are banded; records that share a band, and whose
sketches allow them to be similar, are verified on their sets. Exact copies form one class first, so a text repeated in a
third of all rows is signed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioform.llm.printform import print_words
from folioform.llm.textvec import apart
from folioform.session import materialize

#: Registers of a signature are BANDS x ROWS. A pair of weighted similarity s shares a band with 1 - (1 - s^ROWS)^BANDS:
#: 0.9998 at 0.75, which 95 % of the pairs of 0.7 or more by plain words exceed, and 0.993 at 0.68.
BANDS, ROWS = 32, 5
#: A word found in at least 1 / RARE of the records weighs less than a rare one; there are at most RARE x words per record such words.
RARE = 30
#: Classes of one band that a task pairs by itself.
LARGEST_BAND = 10_000
#: Bytes of entries a task gets if bands are even, and entries it holds before it passes on its large bands.
PART_BYTES, HELD = 16_000_000, 4_000_000
#: The size code of sketches that stands for this many elements or more.
MANY = 63
_GOLD, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weight_of(n: int, total: int) -> float:
    """Rarity weight of an element found in ``n`` of ``total`` records, constant below a share of 1 / RARE."""
    return min(math.log(total / n), math.log(RARE)) ** 1.5 + 0.02


class Signer:
    """ProbMinHash of batches of sets. ``common``: {element: weight}; every other element weighs ``rare``."""

    CHUNK = 48

    def __init__(self, common: dict[int, float], rare: float, bands: int = BANDS, rows: int = ROWS, seed: int = 1) -> None:
        self.m, self.bands, self.rows, self.rare, self.seed = bands * rows, bands, rows, rare, np.uint64(seed)
        order = np.array(sorted(common), np.uint32)
        self.keys, self.weights = order, np.array([common[int(k)] for k in order], np.float32)

    def weigh(self, elements: np.ndarray) -> np.ndarray:
        w = np.full(len(elements), self.rare, np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, elements), len(self.keys) - 1)
            hit = self.keys[at] == elements
            w[hit] = self.weights[at[hit]]
        return w

    def points(self, elements: np.ndarray, k0: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Times and registers of the next CHUNK points of each element; ``before``: the time of its last point."""
        k = np.arange(k0, k0 + self.CHUNK, dtype=np.uint64)
        x = _mix(_mix(elements.astype(np.uint64) + self.seed * _GOLD)[:, None] + (k * _GOLD)[None, :])
        reg = ((x & np.uint64(0xFFFFFFFF)) * np.uint64(self.m)) >> np.uint64(32)
        gap = -np.log(((x >> np.uint64(40)).astype(np.float64) + 1) / (1 << 24)) / self.weigh(elements)[:, None]
        return (before[:, None] + np.cumsum(gap, axis=1)).astype(np.float32), reg.astype(np.int64)

    def sign(self, elements: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """(n_rows, m) winners of flattened sets: ``elements`` (uint32) and the row of each."""
        reg = np.full(n_rows * self.m, np.uint64(0xFFFFFFFFFFFFFFFF))
        uniq, inv = np.unique(elements, return_inverse=True)
        last = np.zeros(len(uniq))
        live, k0, limit = np.arange(len(elements)), 0, np.full(n_rows, np.inf, np.float32)
        while len(live):
            times, regs = self.points(uniq, k0, last)
            last = times[:, -1].astype(np.float64)
            for k in range(self.CHUNK):
                t = times[inv[live], k]
                if k % 3 == 0 and (k or k0):
                    top = (reg.reshape(n_rows, self.m).max(axis=1) >> np.uint64(32)).astype(np.uint32)
                    limit = np.where(top == 0xFFFFFFFF, np.float32(np.inf), top.view(np.float32))
                keep = t <= limit[row[live]]
                live, t = live[keep], t[keep]
                if not len(live):
                    break
                at = row[live] * self.m + regs[inv[live], k]
                np.minimum.at(reg, at, (t.view(np.uint32).astype(np.uint64) << np.uint64(32)) | elements[live].astype(np.uint64))
            k0 += self.CHUNK
        return (reg & np.uint64(0xFFFFFFFF)).reshape(n_rows, self.m)

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        """(n_rows, bands) 64-bit keys, the band's number mixed in."""
        s = signature.reshape(len(signature), self.bands, self.rows)
        h = np.zeros(s.shape[:2], np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64)[None, :] * _GOLD
        for i in range(self.rows):
            h = _mix(h * np.uint64(0x2545F4914F6CDD1D) + s[:, :, i] + np.uint64(1))
        return h.view(np.int64)


def word_sets(df: DataFrame, row_id: str, text: str, min_words: int, shingle: int = 1) -> DataFrame:
    """(uid, cls, chk, words): the sorted distinct 32-bit hashes of a record's words (or shingles of ``shingle`` words) as they look
    in print, and two 64-bit hashes of the set of their 64-bit hashes. Null texts and texts of fewer than ``min_words`` words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            uids, classes, checks, offsets, values = [], [], [], [0], []
            for uid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = print_words(t) if t else []
                if len(words) < max(min_words, shingle):
                    continue
                if shingle > 1:
                    words = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
                found = set()
                for w in set(words):
                    h = known.get(w)
                    if h is None:
                        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                        if len(known) < 500_000:
                            known[w] = h
                    found.add(h)
                whole = np.array(sorted(found), np.uint64)
                a = np.unique((whole & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32)
                uids.append(uid)
                digest = xxhash.xxh3_128_intdigest(whole.tobytes())
                classes.append((digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                checks.append((digest >> 64) - (1 << 63))
                values.append(a)
                offsets.append(offsets[-1] + len(a))
            flat = np.concatenate(values) if values else np.zeros(0, np.int32)
            words_col = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), pa.array(classes, pa.int64()), pa.array(checks, pa.int64()), words_col], ["uid", "cls", "chk", "words"])

    return df.select(F.col(row_id).cast("bigint").alias("uid"), F.col(text).cast("string").alias("t")).mapInArrow(run, "uid bigint, cls bigint, chk bigint, words array<int>")


def common_weights(sets: DataFrame) -> tuple[dict[int, float], float]:
    """Weights of the common elements. Counted over all records; only elements in at least 1 / RARE of them come to the driver."""
    total = sets.count()
    if not total:
        return {}, 1.0
    counts = sets.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") * RARE >= total)
    return {r.w & 0xFFFFFFFF: weight_of(r.n, total) for r in counts.collect()}, math.log(RARE) ** 1.5 + 0.02


class Layout(NamedTuple):
    """How an entry fits into two 64-bit words: 40 bits of its band's key and 24 of the sketch; the rest of the sketch and the class's number.

    A sketch is a code of the set's size (6 bits; MANY: that many elements or more) and a map of up to 58 bits, in which every
    element flips one. Two maps differ in at most as many bits as the sets in elements, so close() never rejects a similar pair.
    """

    id_bits: int
    threshold: Fraction

    @property
    def map_bits(self) -> int:
        return min(64, 88 - self.id_bits) - 6

    def sketches(self, elements: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """Sketches of flattened sets: ``elements`` (uint32, distinct in a set) and the row of each."""
        at = ((_mix(elements.astype(np.uint64) + _GOLD) >> np.uint64(32)) * np.uint64(self.map_bits)) >> np.uint64(32)
        bits = np.zeros(n_rows, np.uint64)
        np.bitwise_xor.at(bits, row, np.uint64(1) << at)
        return (bits << np.uint64(6)) | np.minimum(np.bincount(row, minlength=n_rows), MANY).astype(np.uint64)

    def pack(self, key: np.ndarray, number: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = (key & ~_LOW) | (sketch & _LOW)
        return a, number if self.id_bits == 64 else ((sketch >> np.uint64(24)) << np.uint64(self.id_bits)) | number

    def unpack(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, number, sketch)"""
        if self.id_bits == 64:
            return a & ~_LOW, b, a & _LOW
        return a & ~_LOW, b & np.uint64((1 << self.id_bits) - 1), ((b >> np.uint64(self.id_bits)) << np.uint64(24)) | (a & _LOW)

    def most(self) -> np.ndarray:
        """[code, code]: how many elements sets of these sizes may differ in, -1 where the sizes alone differ by more."""
        n = np.arange(MANY + 1)
        both, by_size = n[:, None] + n[None, :], np.abs(n[:, None] - n[None, :])
        most = (self.threshold.denominator - self.threshold.numerator) * both // (self.threshold.denominator + self.threshold.numerator)
        most[by_size > most] = -1
        most[MANY, :] = most[:, MANY] = 64
        return most.astype(np.int8)

    def close(self, a: str, b: str) -> Column:
        """The rule of most() over columns of sketches."""
        code = [F.col(x).bitwiseAND(F.lit(MANY)) for x in (a, b)]
        differ = F.bit_count(F.shiftrightunsigned(F.col(a).bitwiseXOR(F.col(b)), 6))
        t = self.threshold
        return (code[0] == MANY) | (code[1] == MANY) | (F.greatest(differ.cast("bigint"), F.abs(code[0] - code[1])) * (t.denominator + t.numerator) <= (code[0] + code[1]) * (t.denominator - t.numerator))


def _parted(a: np.ndarray, b: np.ndarray, key: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, data): the entries of each part, the first words before the second ones. A band is in one part."""
    part = ((_mix(key) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    part, a, b = part[order], a[order], b[order]
    edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ends = np.append(edges[1:], len(part))
    blobs = [a[i:j].tobytes() + b[i:j].tobytes() for i, j in zip(edges, ends)]
    return pa.RecordBatch.from_arrays([pa.array(part[edges].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "data"])


def band_entries(classes: DataFrame, common: dict[int, float], rare: float, layout: Layout, parts: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(part, data): one entry per class and band, packed; ``classes``: id (a number of at most ``layout.id_bits``), words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, held, n = Signer(common, rare, bands, rows), [], 0
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                lists = b.column(1)
                lens = np.diff(lists.offsets.to_numpy())
                number = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                elements = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
                row = np.repeat(np.arange(len(lens)), lens)
                keys = signer.band_keys(signer.sign(elements, row, len(lens))).view(np.uint64).ravel()
                held.append(layout.pack(keys, np.repeat(number, bands), np.repeat(layout.sketches(elements, row, len(lens)), bands)))
                n += len(keys)
                if n >= 500_000:
                    a, b = (np.concatenate(x) for x in zip(*held))
                    yield _parted(a, b, a & ~_LOW, parts)
                    held, n = [], 0
        if held:
            a, b = (np.concatenate(x) for x in zip(*held))
            yield _parted(a, b, a & ~_LOW, parts)

    return classes.select("id", "words").mapInArrow(run, "part int, data binary")


def candidate_pairs(entries: DataFrame, largest: int = LARGEST_BAND, layout: Layout | None = None, parts: int = 8, hold: int = HELD) -> DataFrame:
    """Distinct (cls_a, cls_b), cls_a < cls_b, of classes that share a band and whose sketches, if there is a layout, allow them to be similar.

    ``entries``: (band, cls), or packed ones, with their layout. They are shuffled once; a task pairs the bands of one part
    and writes only pairs that pass, as chance pairs grow with the square of the input. A band of more than ``largest``
    classes is passed on as it is and joined with itself in a second step that Spark splits.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (x.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if len(a):
                yield _parted(a, b, a, parts)

    most = layout.most() if layout else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray, band: np.ndarray | None) -> pa.RecordBatch:
            bands = pa.nulls(len(a), pa.int64()) if band is None else pa.array(band.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), bands], ["cls_a", "cls_b", "band"])

        held, found, size, limit, heavy = [], [], 0, hold, np.zeros(0, np.uint64)

        def sort() -> Iterator[pa.RecordBatch]:
            """Put what is held in the order of bands; large bands are passed on, with sketches, and so is what comes of them later."""
            nonlocal held, heavy, size
            a, b = (np.concatenate(x) for x in zip(*held))
            key, c, sketch = layout.unpack(a, b) if layout else (a, b, np.full(len(a), MANY, np.uint64))
            order = np.argsort(key)
            key, c, sketch = key[order], c[order], sketch[order]
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            sizes = np.diff(np.append(edges, len(key)))
            large = (sizes > largest) | np.isin(key[edges], heavy)
            heavy = np.union1d(heavy, key[edges[large]])
            big = np.repeat(large, sizes)
            passed = np.flatnonzero(big)
            for i in range(0, len(passed), 100_000):
                at = passed[i : i + 100_000]
                yield out(c[at], sketch[at], key[at])
            key, c, sketch = key[~big], c[~big], sketch[~big]
            held, size = [layout.pack(key, c, sketch) if layout else (key, c)], len(key)
            found[:] = key, c, sketch

        def pairs(key: np.ndarray, c: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs of whole bands: shifted copies of the sorted arrays meet while their bands are equal."""
            code, bits = (sketch & np.uint64(MANY)).astype(np.int64), sketch >> np.uint64(6)
            live, met, n = np.arange(len(key)), [], 0
            for d in range(1, len(key)):
                live = live[live < len(key) - d]
                live = live[key[live + d] == key[live]]
                if not len(live):
                    break
                for i in range(0, len(live), 200_000):
                    x = live[i : i + 200_000]
                    y = x + d
                    if layout:
                        near = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int8) <= most[code[x], code[y]]
                        x, y = x[near], y[near]
                    a, b = c[x].view(np.int64), c[y].view(np.int64)
                    met.append((np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]))
                    n += len(x)
                    if n > 100_000:
                        yield out(*(np.concatenate(z) for z in zip(*met)), None)
                        met, n = [], 0
            if met:
                yield out(*(np.concatenate(z) for z in zip(*met)), None)

        for batch in batches:
            for blob in batch.column(0):
                both = np.frombuffer(blob.as_buffer(), np.uint64).reshape(2, -1)
                held.append((both[0], both[1]))
                size += both.shape[1]
            if size > limit:
                yield from sort()
                limit = max(hold, 2 * size)
        if held:
            yield from sort()
            yield from pairs(*found)

    if "band" in entries.columns:
        entries = entries.select("band", "cls").mapInArrow(pack, "part int, data binary")
    placed = entries.repartitionById(parts, F.col("part")).select("data")
    found = materialize(placed.mapInArrow(run, "cls_a bigint, cls_b bigint, band bigint"), "neardup-candidates")
    heavy = found.where("band IS NOT NULL")
    a, b = (heavy.select("band", F.col("cls_a").alias(f"cls_{x}"), F.col("cls_b").alias(f"sketch_{x}")) for x in "ab")
    joined = a.join(b, "band").where(F.col("cls_a") < F.col("cls_b"))
    if layout:
        joined = joined.where(layout.close("sketch_a", "sketch_b"))
    return found.where("band IS NULL").select("cls_a", "cls_b").unionByName(joined.select("cls_a", "cls_b")).distinct()


def similar_classes(classes: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs (cls_a, cls_b), cls_a < cls_b, of classes whose sets reach ``threshold``, compared as the fraction it is written as. ``candidates`` are pairs of ids."""
    wa, wb = (classes.select(F.col("id").alias(f"cls_{x}"), F.col("cls").alias(f"c{x}"), F.col("words").alias(f"w{x}")) for x in "ab")
    both = candidates.join(wa, "cls_a").join(wb, "cls_b")
    common = F.size(F.array_intersect("wa", "wb"))
    t = Fraction(str(threshold))
    similar = both.where(common.cast("bigint") * t.denominator >= (F.size("wa") + F.size("wb") - common).cast("bigint") * t.numerator)
    return similar.select(F.least("ca", "cb").alias("cls_a"), F.greatest("ca", "cb").alias("cls_b"))


def numbered_classes(sets: DataFrame) -> tuple[DataFrame, int]:
    """((cls, id, words) of each class, bits of the largest id). An id is the least position ``at`` of the class's records, its partition
    and row put together without the bits that neither needs; so it stays the same however often it is computed."""
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    most = sets.agg(F.max(part), F.max(row)).first()
    part_bits, row_bits = ((n or 0).bit_length() for n in most)
    number = F.shiftleft(part, row_bits).bitwiseOR(row)
    return sets.groupBy("cls").agg(F.min(number).alias("id"), F.first("words").alias("words")), part_bits + row_bits


def near_duplicates(df: DataFrame, row_id: str, text: str, threshold: float = 0.8, min_words: int = 5, shingle: int = 5, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (uid, cls) of every record with enough words, and verified pairs of classes.

    Nulls, empty and short texts have no class. Ties do not occur: the threshold is compared exactly. Repeated rows (one
    id twice) are one member. An empty table gives two empty results. Other columns are ignored, whatever their names.
    """
    sets = materialize(word_sets(df, row_id, text, min_words, shingle).withColumn("at", F.monotonically_increasing_id()), "neardup-sets")
    sets = apart(sets)
    common, rare = common_weights(sets)
    classes, id_bits = numbered_classes(sets)
    classes = materialize(classes, "neardup-classes")
    layout = Layout(max(24, id_bits), Fraction(str(threshold)))
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(classes.count() * bands * 16 / PART_BYTES))
    entries = band_entries(classes, common, rare, layout, parts, bands, rows)
    pairs = similar_classes(classes, candidate_pairs(entries, layout=layout, parts=parts), threshold)
    return sets.select("uid", "cls").distinct(), pairs


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs of records (uid_a < uid_b) of similar classes and within a class."""
    several = members.groupBy("cls").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi")).where("lo <> hi")
    links = pairs.unionByName(several.select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")))
    a, b = (members.select(F.col("uid").alias(f"u{x}"), F.col("cls").alias(f"cls_{x}")) for x in "ab")
    met = links.join(a, "cls_a").join(b, "cls_b").where("cls_a <> cls_b OR ua < ub")
    return met.select(F.least("ua", "ub").alias("uid_a"), F.greatest("ua", "ub").alias("uid_b"))


def connected_groups(members: DataFrame, pairs: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(uid, group_id, n_links): the group of every record by alternating large-star and small-star rounds over class pairs.

    Each round's edges are written to the shared folder, so lineage stays short and a lost executor costs one round.
    n_links counts the record's links to other classes. group_id is the least class of the group.
    """
    pairs = materialize(pairs, "neardup-pairs")
    edges = pairs.select(F.col("cls_b").alias("u"), F.col("cls_a").alias("v"))
    before = None
    for _ in range(max_rounds):
        edges = materialize(_star(_star(edges, True), False), "neardup-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    links = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    roots = edges.select(F.col("u").alias("cls"), F.col("v").alias("root"))
    return members.join(roots, "cls", "left").join(links, "cls", "left").select("uid", F.coalesce("root", "cls").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; edges (u, v) with u > v. Large: every node's larger neighbours move to its least; small: its smaller ones and itself do."""
    if large:
        nb = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        nb = edges
    least = nb.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    both = nb.join(least, "u")
    out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def pandas_pairs(rows: pd.DataFrame, threshold: float, min_words: int) -> set[tuple[int, int]]:
    """Brute force for tests: all pairs of ``rows`` (uid, text)."""
    sets = {}
    for uid, t in zip(rows["uid"], rows["text"]):
        words = print_words(t) if t else []
        if len(words) >= min_words:
            sets[uid] = set(words)
    ids = sorted(sets)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if Fraction(len(sets[a] & sets[b]), len(sets[a] | sets[b])) >= Fraction(str(threshold))}
