"""Texts longer than the positions that fit beside a hash."""

import random

import numpy as np

from folioform.llm import spans


def test_text_longer_than_the_position_bits(monkeypatch):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    whole = make(12_000)
    one = {int(k) for _, _, key in spans.anchors([whole]) for k in key}
    monkeypatch.setattr(spans, "_POS", np.uint64((1 << 10) - 1))
    keys = lambda t: {int(k) for _, _, key in spans.anchors([t]) for k in key}
    at = [0, 500, 1023 - 200, 5000, 11_600]
    assert one and all(keys(whole) & keys(make(3000) + whole[a : a + 400] + make(3000)) for a in at)
