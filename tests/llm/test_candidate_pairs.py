"""Candidate pairs of near duplicates: what is written of the chance pairs, and that no similar pair is ruled out."""

import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest

from folioform.llm import neardup

T = Fraction(7, 10)


def test_chance_pairs_are_not_written(spark, monkeypatch):
    """Texts of few words in all meet in many bands by chance; such pairs grow with the square of the rows and must not reach the disk."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words, 20)) for _ in range(1200)]
    texts += [" ".join([*t.split()[:-1], f"edit{i}"]) for i, t in enumerate(texts[:40])]
    written, write = {}, neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    members, pairs = neardup.near_duplicates(spark.createDataFrame([*enumerate(texts)], "id long, text string"), "id", "text", 0.7, 12, 1)
    got = {(r.uid_a, r.uid_b) for r in neardup.expand_pairs(members, pairs).collect()}
    assert got == neardup.pandas_pairs(pd.DataFrame({"uid": range(len(texts)), "text": texts}), 0.7, 12) and len(got) >= 40
    assert written["neardup-candidates"].count() < 60 * len(got)


@pytest.mark.parametrize("id_bits", [24, 30, 47, 64])
def test_sketches_rule_out_no_similar_pair(spark, id_bits):
    rng = np.random.default_rng(id_bits)
    layout = neardup.Layout(id_bits, T)
    sets = []
    for _ in range(1500):
        a = rng.choice(500, rng.integers(1, 90), replace=False).astype(np.uint32)
        b = np.unique(np.concatenate((a[rng.random(len(a)) < rng.choice([0.8, 0.9, 1.0])], rng.choice(500, rng.integers(0, 12)).astype(np.uint32) + np.uint32(1000))))
        sets += [a, b if len(b) else a]
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    sketch = layout.sketches(np.concatenate(sets), row, len(sets))
    key, number = rng.integers(0, 2**64, len(sets), dtype=np.uint64), np.arange(len(sets), dtype=np.uint64)
    back = layout.unpack(*layout.pack(key, number, sketch))
    assert (back[0] == key >> np.uint64(24) << np.uint64(24)).all() and (back[1] == number).all() and (back[2] == sketch).all()
    code, bits = (sketch & np.uint64(63)).astype(int), sketch >> np.uint64(6)
    near = np.bitwise_count(bits[::2] ^ bits[1::2]).astype(np.int8) <= layout.most()[code[::2], code[1::2]]
    jaccard = [Fraction(len(np.intersect1d(a, b)), len(np.union1d(a, b))) for a, b in zip(sets[::2], sets[1::2])]
    assert all(n for n, j in zip(near, jaccard) if j >= T) and sum(j >= T for j in jaccard) > 300 and not near.all()
    s = sketch.view(np.int64).tolist()
    same = spark.createDataFrame([*zip(range(len(s)), s[::2], s[1::2])], "i long, a long, b long").select("i", layout.close("a", "b").alias("n")).orderBy("i").collect()
    assert [r.n for r in same] == near.tolist()


@pytest.mark.parametrize("largest", [4, 10_000])
@pytest.mark.parametrize("hold", [30, 4_000_000])
def test_bands_of_any_size_with_sketches(spark, largest, hold):
    """Whether a band is paired in its task, passed on at once or after others have been, the same pairs come out."""
    rng = random.Random(7)
    base = [rng.sample(range(400), 20) for _ in range(40)]
    sets = [*base, *([*x[:18], 900 + i, 950 + i] for i, x in enumerate(base))]
    classes = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, words array<int>").repartition(7)
    layout = neardup.Layout(24, T)
    # every word weighs next to nothing but one, so that many sets share all their bands
    entries = neardup.band_entries(classes, {x: 1e-6 for x in range(20, 1000)}, 1.0, layout, 3, 4, 2)
    got = {tuple(r) for r in neardup.candidate_pairs(entries, largest, layout, 3, hold).collect()}
    want = {tuple(r) for r in neardup.candidate_pairs(entries, 10_000, layout, 3).collect()}
    near = {(i, i + 40) for i in range(40)}
    assert got == want and len(got & near) > 30 and len(got) < 40 * 79 / 2
