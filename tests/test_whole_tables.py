"""Queries over whole tables: every kind of row, checked against plain Python."""

from collections import Counter

import pytest

from folioform import queries_corpus, queries_formats
from folioform.schema import BOOKS
from folioform.sources import registry
from folioform.sources.model import Verse

TEXTS = ["<b>not</b> & markup &amp; so", "a\xa0b & c d", "\xa0edge ", "{\\rtf1 said he}", "back\\slash \\par x", "{and} {ref:d}", "“é” Ελλ кир עבר", "c1 \x85 line sep", "𐤀 astral"]


@pytest.mark.parametrize("fmt", queries_formats.NUMBERED + ["sqlite"])
def test_texts_survive(fmt):
    f = registry.BY_NAME[fmt]
    verses = [Verse("Gen", 1, i, t) for i, t in enumerate(TEXTS)] + [Verse("Gen", 1, 1, "same place")]
    got = Counter((v.doc, v.chapter, v.verse, v.text) for v in f.read("x", f.write(verses)))
    assert got == Counter((v.doc, v.chapter, v.verse, v.text) for v in verses)


def test_zefania_control_character_costs_no_file():
    f = registry.BY_NAME["zefania"]
    assert [v.text for v in f.read("x", f.write([Verse("Gen", 1, 1, "a\x01b"), Verse("Gen", 1, 2, "c")]))] == ["a�b", "c"]


@pytest.mark.parametrize("fmt", queries_formats.NAMED + queries_formats.NUMBERED)
def test_every_verse_takes_part(spark, tmp_path, fmt):
    spark.createDataFrame([("mod-a", b, 1, i, f"t {i}") for i, b in enumerate([" Gen ", "", None, "Gen"], 1)], "module_id string, book string, chapter int, verse int, text string").write.parquet(f"{tmp_path}/verses.parquet")
    spark.createDataFrame([("mod-a", 1, c, i, f"<{i}> & é") for i, c in enumerate([1, None, 0, 2])], "module_id string, book int, chapter int, verse int, scripture string").write.parquet(f"{tmp_path}/esword_bible.parquet")
    got = Counter(tuple(r) for r in queries_formats.QUERIES[f"format_{fmt}"](spark, str(tmp_path)).collect())
    if fmt in queries_formats.NAMED:
        assert got == Counter([("mod-a", "Gen", 1, 1, "t 1"), ("mod-a", "mod-a", 1, 2, "t 2"), ("mod-a", "mod-a", 1, 3, "t 3"), ("mod-a", "Gen", 1, 4, "t 4")])
    else:
        assert got == Counter([("mod-a", "Gen", 1, None, "<0> & é"), ("mod-a", "Gen", None, 1, "<1> & é"), ("mod-a", "Gen", None, 2, "<2> & é"), ("mod-a", "Gen", 2, 3, "<3> & é")])


ESWORD = [(1, "m", 1, 1, 1), (2, "m", 1, 3, 4), (3, "m", 40, 7, 1), (4, "m", 40, 9, 3), (5, "n", 40, 8, 1), (6, "m", 66, None, 1), (7, "m", 5, 2, 0), (8, "m", 40, 7, 1), (9, "m", None, 7, 1)]
VERSES = [("u1", "m", "Gen", 1, "one two"), ("u2", "n", "Gen", 1, "two"), ("u3", "m", "Gen", 4, "four é, x"), ("u4", "m", "Rev", 22, "two"), ("u5", "m", "Rev", 22, None)]
ITEMS = [(1, 1, 7, q, f, s) for q, f, s in [(10.0, "A", "F")]] + [(2, 1, 7, 12.0, "N", "O"), (3, 1, 7, 15.0, "R", "F"), (4, 1, 8, 12.0, "N", "O"), (5, 1, 7, 20.0, "R", "F")]
BLOBS = [(1, 1), (2, 1024), (3, 1536), (4, 1024**2), (5, 5 * 1024**3), (6, None)]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    for name, rows, schema in [
        ("esword_bible", ESWORD, "row_id bigint, module_id string, book int, chapter int, verse int"),
        ("verses", VERSES, "verse_uid string, module_id string, book string, chapter int, text string"),
        ("lineitem", ITEMS, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, l_returnflag string, l_linestatus string"),
        ("blobs", BLOBS, "blob_id bigint, size_bytes bigint"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return lambda q: sorted(tuple(r) for r in queries_corpus.QUERIES[q](spark, d).collect())


def test_all_books_and_chapters(whole):
    assert Counter(whole("book_number_lookup")) == Counter((r, BOOKS[b - 1] if b else None) for r, _, b, _, _ in ESWORD)
    got = Counter(v[0] for v in ESWORD for c in ESWORD if v[2] and v[3] and c[3] and c[4] == 1 and v[1:3] == c[1:3] and c[3] <= v[3] <= c[3] + 2)
    assert whole("chapter_overlap") == sorted(got.items())
    assert whole("canon_missing_verses") == [("m", 1, 3, 3), ("m", 40, 9, 2)]


def test_all_words(whole):
    assert {(u, x) for u, _, x, _ in whole("token_positions") if x[0].isalnum()} == {(v[0], w.strip(",")) for v in VERSES for w in (v[4] or "").split()}
    assert ("u3", 2, "é", 5) in whole("token_positions") and ("u3", 3, ",", 7) in whole("token_positions")
    assert whole("unique_words_per_side") == [("Gen", "four", "m"), ("Gen", "one", "m"), ("Rev", "two", "m")]


def test_all_spans_and_sizes(whole):
    want = [(x[2], x[0] * 10 + 1, y[0] * 10 + 1) for x in ITEMS for y in ITEMS if x[2] == y[2] and x[0] < y[0] and x[3] < y[3] + 5 and y[3] < x[3] + 5]
    assert whole("span_overlap") == want and len(want) == 2
    assert dict(whole("human_sizes")) == {1: "1 B", 2: "1.0 KB", 3: "1.5 KB", 4: "1.0 MB", 5: "5.0 GB", 6: None}


def test_token_bucket_of_a_whole_table(spark, tmp_path):
    import datetime as dt
    import random

    from folioform.streaming.windows import allow

    rng = random.Random(4)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(40_000)), i % 3) for i in range(120)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.key: (r.n_events, r.n_allowed) for r in queries_corpus.QUERIES["stream_token_bucket"](spark, str(tmp_path)).collect()}
    for u in range(3):
        times = sorted(t.replace(tzinfo=dt.timezone.utc).timestamp() for _, t, x in rows if x == u)
        assert got[str(u)] == (40, sum(allow(times, 3.0, 1 / 3600, 3.0, None)[0]))
