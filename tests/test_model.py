"""Markup, XML, caches, catalogues, references and self-checks on small tables."""

import pytest
from pyspark.sql import functions as F

from folioform.functions import refs, text, xmltools
from folioform.operators import align, canon, catalogue, search, standoff, validate
from folioform.plans import cache


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_xml():
    assert xmltools.xml_error("<a><b/></a>") is None and xmltools.xml_error(None) is None
    assert xmltools.xml_error("<a><b></a>").startswith("1:") and xmltools.xml_error("") and xmltools.xml_error("x")
    assert xmltools.pretty('<a x="1&amp;2"><b>t &lt; <i>u</i></b><c/></a>') == '<a x="1&amp;2">\n  <b>t &lt; <i>u</i></b>\n  <c/>\n</a>'
    assert xmltools.pretty("<a") is None and xmltools.pretty(None) is None


def test_xml_columns(spark):
    df = spark.createDataFrame([("<a><b>1</b><b>2</b></a>",), ("<a>",), (None,)], "x string")
    assert [r[0] for r in df.select(xmltools.well_formed(F.col("x"))).collect()] == [True, False, None]
    assert [r.v for r in df.select(xmltools.xpath_all(F.col("x"), "/a/b/text()").alias("v")).collect()] == [["1", "2"], None, None]
    assert [r.v for r in df.select(xmltools.xpath_first(F.col("x"), "/a/b").alias("v")).collect()] == ["1", None, None]
    assert [r.v for r in df.select(xmltools.pretty_printed(F.col("x")).alias("v")).collect()] == ["<a>\n  <b>1</b>\n  <b>2</b>\n</a>", None, None]
    assert df.where("x = '<a>'").select(xmltools.error_of(F.col("x")).alias("v")).first().v.startswith("1:3")


def test_cache(spark):
    c = cache.TableCache(1)
    a = c.get("a", lambda: spark.range(1))
    assert c.get("a", lambda: spark.range(9)) is a and c.get("b", lambda: spark.range(2)).count() == 2
    s = c.stats(spark).first()
    assert (s["size"], s.hits, s.misses, s.evictions) == (1, 1, 2, 1)
    c.drop("b")
    c.clear()
    assert cache.TableCache().stats(spark).first().hit_rate == 0.0


def test_catalogue(spark):
    cat = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "module string, version string")
    have = catalogue.install(cat, spark.createDataFrame([("a", "0")], cat.schema), ["b", "zzz"])
    assert {(r.module, r.installed) for r in catalogue.available(cat, have).collect()} == {("a", "other version"), ("b", "yes"), ("c", "no")}
    assert {r.module for r in catalogue.uninstall(have, ["a"]).collect()} == {"b"}
    files = spark.createDataFrame([("a", 0), ("x", 5)], "module string, length int")
    assert {(r.module, r.status) for r in catalogue.verify(have, files).collect()} == {("a", "empty"), ("b", "missing")}
    assert search.catalogue_counts(cat, "B", ["module"], version="1").first().asDict() == {"n_shown": 1, "n_all": 3}
    assert {r.module for r in cat.where(search.like(F.col("module"), "A%")).collect()} == {"a"}
    assert one(spark, search.like(F.lit("Éa"), "é%")) is False


def test_ranges(spark):
    read = lambda t: one(spark, refs.parse_range(F.lit(t)))
    got = lambda t: tuple(read(t))[:5] if read(t) else None
    assert got("1 Cor 13:4-7") == ("1Cor", 13, 4, None, 7) and got("II Kings 3 – 5") == ("2Kgs", 3, None, 5, None)
    assert got("gen 1:2-3:4") == ("Gen", 1, 2, 3, 4) and got("Song of Songs") == ("Song", None, None, None, None) and got("Keth 4") == ("Keth", 4, None, None, None)
    assert read("Gen 5-3") is None and read("Gen 1:9-3") is None and read("12 13") is None and read("") is None
    a = refs.book_aliases()
    assert a["firstsam"] == "1Sam" and "j" not in a and "ju" not in a and a["jude"] == "Jude" and a["philippians"] == "Phil"


def test_psalms_and_mappings(spark):
    grid = spark.range(1, 151).select(F.col("id").cast("int").alias("c")).withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(8))))
    there = canon.greek_psalm(F.col("c"), F.col("v"))
    g = grid.select("c", "v", there["chapter"].alias("gc"), there["verse"].alias("gv"))
    back = canon.hebrew_psalm(F.col("gc"), F.col("gv"))
    assert g.where((back["chapter"] != F.col("c")) | (back["verse"] != F.col("v"))).count() == 0
    m = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "k string, t array<string>")
    assert sorted((r.k, r.target) for r in canon.split_refs(spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s")], "k string, me string"), m, ["k"], "t", "me").collect()) == [("a", "x"), ("a", "y"), ("b", "s"), ("c", "s")]
    c = spark.createDataFrame([("KJV", 1), ("LXX", 2)], "system string, n int")
    assert canon.resolve_canon(c, "lxx")[1] == "LXX" and canon.resolve_canon(c, "vulg", fallback="KJV")[1] == "KJV" and canon.resolve_canon(c, "Q", {"q": "LXX"})[1] == "LXX"
    with pytest.raises(ValueError):
        canon.resolve_canon(c, "none")
    idx = spark.createDataFrame([(i, "p") for i in range(0, 400, 7)], "idx long, part string")
    starts = spark.createDataFrame([("p", 1, 1, 5, 100), ("p", 1, 2, 106, 250)], "part string, book_idx int, chapter int, start long, n_verses long")
    got = {(r.idx, r.chapter, r.verse) for r in canon.index_to_ref(idx, starts, ["part"]).collect()}
    assert got == {(i, 1 if i < 106 else 2, i - (4 if i < 106 else 105)) for i in range(0, 400, 7) if 5 <= i < 105 or 106 <= i < 356}


def test_markup(spark):
    notes = one(spark, text.placed_notes(F.lit("é<note>a</note> x <reference osisRef='G.1'>r</reference><note n='2'>b</note>")))
    assert [(n.kind, n.text, n["at"]) for n in notes] == [("FOOTNOTE", "a", 2), ("FOOTNOTE", "b", 57), ("CROSS_REF", "G.1", 19)]
    assert one(spark, text.versification_message(F.lit("<chapter sID='a' osisID='Gen.3'/>"))) == "versification: chapter Gen.3 begins here in source"
    assert one(spark, text.versification_message(F.lit("<chapter eID='a'/>"))) == "versification: structural marker only" and one(spark, text.versification_message(F.lit("x"))) == ""
    hold = lambda t: one(spark, text.is_placeholder(F.lit(t)))
    assert hold("Genesis 1:1") and hold(" 1 John 3:4: ") and hold("Song of Songs 1:1") and hold("abc") and not hold("at 5 4:30") and not hold("In 3 days 4:5")
    shown = one(spark, align.truncated_diff(align.line_diff(F.lit("a\nb\nc"), F.lit("a\nx\ny\nz")), 2))
    assert [(r.line, r.old, r.new) for r in shown.shown] == [(2, "b", "x"), (3, "c", "y")] and shown.more == 1


def test_bag_similarity(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "b"]), (2, [], []), (3, ["x"], []), (4, ["a", "a"], ["a", "a"])], "id int, a array<string>, b array<string>")
    assert {r.id: r.similarity for r in align.bag_similarity(df, ["id"], F.col("a"), F.col("b")).collect()} == {1: 0.666667, 2: 0.0, 3: 0.0, 4: 1.0}


def test_rollup(spark):
    e = spark.createDataFrame([("b", 1, 2, "two"), ("b", 1, 1, "one"), ("b", 2, 1, " "), ("b", 3, 1, "three"), ("c", 1, 1, None)], "book string, chapter int, verse int, t string")
    chapters, books = standoff.rollup_entries(e, ["book"], "chapter", ["verse"], "t")
    assert {(r.book, r.chapter, r.text) for r in chapters.collect()} == {("b", 1, "one\ntwo"), ("b", 3, "three")}
    assert [tuple(r) for r in books.collect()] == [("b", 2, 3, "one\ntwo\nthree")]


def test_checks_by_type(spark):
    a = spark.createDataFrame([("x", bytearray(b"1"))], "name string, content binary")
    b = spark.createDataFrame([("x", bytearray(b"2"))], "name string, content binary")
    ir = spark.createDataFrame([("c", None), ("d", "L2")], "corpus_id string, loss_class string")
    lost = spark.createDataFrame([("d", "note"), ("d", "note"), ("d", "mark")], "corpus_id string, element_type string")
    run = lambda *checks: [r["status"] for r in validate.run_plan({"checks": list(checks)}, {"a": a, "b": b, "ir": ir, "lost": lost}, {})[1]]
    assert run({"type": "BYTE_EQUAL", "a": "a", "b": "a"}, {"type": "BYTE_EQUAL", "a": "a", "b": "b"}, {"type": "BYTE_EQUAL", "a": "a", "b": "gone"}) == ["pass", "fail", "fail: gone is not known"]
    assert run({"type": "IR_FIDELITY", "ir": "ir", "max_loss_class": "L2"}, {"type": "IR_FIDELITY", "ir": "ir", "max_loss_class": "L1"}) == ["pass", "fail"]
    assert run({"type": "IR_FIDELITY", "ir": "ir", "max_loss_class": "L2", "lost": "lost", "max_lost": 1, "allowed": ["note"]}, {"type": "IR_FIDELITY", "ir": "ir", "max_loss_class": "L2", "lost": "lost", "max_lost": 2}) == ["pass", "fail"]
    assert run({"type": "WHAT"}) == ["fail: WHAT is not known"]
