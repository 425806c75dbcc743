"""Column functions and corpus operators."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from folioform.functions import refs, text
from folioform.operators import align, canon, search, tokens, validate


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_markup(spark):
    assert one(spark, " <p>a <b>b</b></p> > c<unclosed", text.strip_markup) == "a b  c"
    assert one(spark, None, text.strip_markup) is None
    assert one(spark, '<w lemma="strong:H07225 x" morph="M">In</w><w lemma="strong:G1">b</w>', text.word_elements) == [Row(text="In", lemma="strong:H07225 x", morph="M", strongs=["H07225"]), Row(text="b", lemma="strong:G1", morph="", strongs=["G1"])]
    assert one(spark, 'a<note>n</note><reference osisRef="Gen.1">G</reference><reference>H</reference>', text.notes) == [Row(kind="FOOTNOTE", text="n"), Row(kind="CROSS_REF", text="Gen.1"), Row(kind="CROSS_REF", text="H")]
    assert [r.boundary for r in one(spark, '<chapter osisID="a"/><chapter sID="b"/><chapter eID="b"/>', text.chapter_markers)] == ["container", "start", "end"]
    assert one(spark, '<hi type="bold">x</hi> &amp; <note>n</note>', text.osis_to_markdown) == "**x** & [^n]"
    assert one(spark, "<b>x</b><scripRef>G 1</scripRef>", text.thml_to_markdown) == "**x**[G 1]"
    assert one(spark, "<FR>x<Fr><RF>n<Rf>", text.gbf_to_markdown) == "**x** [^n]"
    assert one(spark, "<orth>h</orth><pos>n</pos><def>a</def><def>b</def><ref>z</ref>", text.tei_to_markdown) == "**h** *n* 1. a 2. b See: z"


def test_tokens(spark):
    got = one(spark, "É'x, y", text.tokens)
    assert [(t.text, t.type, t.char_start, t.char_end) for t in got] == [("É'x", "word", 0, 4), (",", "punctuation", 4, 5), (" ", "whitespace", 5, 6), ("y", "word", 6, 7)]
    assert one(spark, "", text.tokens) == []
    long = "wörd, " * 5000
    rows = tokens.token_rows(spark.createDataFrame([(1, long), (2, None), (3, "")], "k int, x string"), ["k"], "x")
    assert rows.count() == 15000 and rows.agg(F.max("char_end")).first()[0] == len(long.encode())
    assert {(r.word, r.n) for r in tokens.word_counts(spark.createDataFrame([(1, "a A b")], "k int, x string"), ["k"], "x").collect()} == {("a", 2), ("b", 1)}
    assert one(spark, "Don't 3 stop", text.plain_words) == ["Don't", "3", "stop"]


def test_scalars(spark):
    assert one(spark, " A  b\n", text.squeeze) is not None
    assert one(spark, "Hello, World", text.normalise) == "hello world"
    assert one(spark, "50% & {x}~\\", text.escape_latex) == r"50\% \& \{x\}\textasciitilde{}\textbackslash{}"
    assert one(spark, "<a & 'b'>", text.escape_html) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, "My File!.v2", text.safe_id) == "my-file-v2"
    assert one(spark, "x.pack.tar.xz", lambda c: text.trim_archive_suffix(c, "pack")) == "x" and one(spark, "x.pack.zip", text.trim_archive_suffix) == "x.pack"
    assert one(spark, "2048", text.human_size) == "2.0 KB"
    assert one(spark, "GNU General Public License", text.spdx) == "GPL-3.0-or-later"
    assert one(spark, "zCom4", text.module_type) == "COMMENTARY"
    assert one(spark, "v1.10.2-rc1", lambda c: text.version_key(c)) == [1, 10, 2]
    assert one(spark, "1.10.2", lambda c: text.version_matches(c, "^1.9")) and not one(spark, "2.0", lambda c: text.version_matches(c, "^1.9"))
    assert one(spark, "The (the) end", lambda c: text.highlight(c, "(the)")) == "The <mark>(the)</mark> end"
    assert [(r.ref, r.text) for r in one(spark, "Genesis 1:1: In the beginning. Genesis 1:2: And  more (KJV)", text.rendered_verses)] == [("Genesis 1:1", "In the beginning."), ("Genesis 1:2", "And more")]
    assert [one(spark, x, text.empty_kind) for x in (None, "<p>x</p>", '<chapter n="1"/>', "<b/>", '<div type="book"/>')] == ["loss", "parse_error", "chapter", "markup_only", "book"]
    assert one(spark, "H0042", lambda c: text.strongs_key(c, F.lit("grc"))) == "H42" and one(spark, "00042", lambda c: text.strongs_key(c, F.lit("heb"))) == "H42"


def test_refs(spark):
    r = one(spark, "1Sam.3.4a-5", refs.parse_osis)
    assert (r.book, r.chapter, r.verse, r.sub_verse, r.verse_end, r.osis_id) == ("1Sam", 3, 4, "a", 5, "1Sam.3.4a-5")
    assert one(spark, "sam 3", refs.parse_osis) is None
    h = one(spark, "1 Samuel 3:4-5:6", lambda c: refs.parse_human(c, {"1samuel": "1Sam"}))
    assert (h.book, h.chapter, h.verse, h.chapter_end, h.verse_end) == ("1Sam", 3, 4, 5, 6)
    assert [x.osis_id for x in one(spark, "cf. Gen 1:1; see Exod 2:3-4; ???", refs.parse_list)] == ["Gen.1.1", "Exod.2.3-4"]
    lit = lambda b, c, v, e=0: F.struct(F.lit(b).alias("book"), F.lit(c).alias("chapter"), F.lit(v).alias("verse"), F.lit(0).alias("chapter_end"), F.lit(e).alias("verse_end"))
    q = lambda a, b: spark.range(1).select(refs.contains(a, b).alias("y")).first().y
    assert q(lit("G", 0, 0), lit("G", 3, 1)) and q(lit("G", 3, 0), lit("G", 3, 1)) and not q(lit("G", 3, 0), lit("G", 4, 1)) and q(lit("G", 3, 2, 5), lit("G", 3, 4)) and not q(lit("G", 3, 2, 5), lit("G", 3, 6)) and not q(lit("G", 0, 0), lit("H", 1, 1))


def test_canon(spark):
    c = spark.createDataFrame([("s", 1, 1, 3), ("s", 1, 2, 2), ("s", 2, 1, 1)], "part string, book_idx int, chapter int, n_verses int")
    idx = canon.verse_index(c, ["part"])
    assert [(r.book_idx, r.chapter, r.start) for r in idx.orderBy("book_idx", "chapter").collect()] == [(1, 1, 4), (1, 2, 8), (2, 1, 12)]
    back = canon.index_to_ref(spark.createDataFrame([("s", 4), ("s", 9), ("s", 12), ("s", 7)], "part string, idx int"), idx, ["part"])
    assert sorted((r.idx, r.book_idx, r.chapter, r.verse) for r in back.collect()) == [(4, 1, 1, 1), (9, 1, 2, 2), (12, 2, 1, 1)]
    a = spark.createDataFrame([("G", 1, 31), ("G", 2, 25)], "book string, chapter int, n_verses int")
    b = spark.createDataFrame([("G", 1, 31), ("G", 3, 24)], "book string, chapter int, n_verses int")
    assert sorted((r.chapter, r.n_a, r.n_b) for r in canon.canon_diff(a, b).collect()) == [(2, 25, None), (3, None, 24)]
    v = spark.createDataFrame([("G", 1, 1), ("G", 1, 2)], "book string, chapter int, verse int")
    m = spark.createDataFrame([("G", 1, 1, "G", 1, 2, "shift"), ("G", 1, 2, None, None, None, "missing")], "book string, chapter int, verse int, to_book string, to_chapter int, to_verse int, type string")
    mapped, loss = canon.apply_mapping(v, m)
    assert sorted((r.verse, r.mapped_verse) for r in mapped.collect()) == [(1, 2), (2, None)] and [r.loss for r in loss.collect()] == ["missing"]


def test_align(spark):
    d = spark.createDataFrame([("a\nb\nc", "a\nx")], "o string, n string").select(F.explode(align.line_diff(F.col("o"), F.col("n"))).alias("d")).select("d.*")
    assert [(r.line, r.kind) for r in d.collect()] == [(2, "changed"), (3, "removed")]
    p = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "b", "c"]), (2, [], [])], "id int, a array<string>, b array<string>")
    assert {r.id: r.similarity for r in align.bag_similarity(p, ["id"], F.col("a"), F.col("b")).collect()} == {1: 0.5, 2: 0.0}


def test_search(spark):
    t = spark.createDataFrame([(i, f"name {i % 7}") for i in range(25)], "k int, n string")
    p = search.page(t, ["n", "k"], 99, 11)
    assert p.count() == 3 and p.first().page_no == 3
    assert search.page(t.where("false"), ["n"], 1, 11).count() == 0
    toks = spark.createDataFrame([(1, [(["H1", "G2"],)])], "id int, t array<struct<strongs:array<string>>>")
    assert toks.where(search.strongs_matches(F.col("t"), "h1")).count() == 1 and toks.where(search.strongs_matches(F.col("t"), "H3")).count() == 0
    lex = spark.createDataFrame([("00012", "x"), ("H7", "y"), ("7", "z")], "lex_key string, text string")
    got = search.lookup_cascade(spark.createDataFrame([("H12",), ("h7",), ("H9",)], "k string"), lex, "k")
    assert sorted((r.asked, r.text) for r in got.collect()) == [("H12", "x"), ("h7", "y")]


def test_validate(spark):
    s = spark.createDataFrame([("x", "VERSE", "a", 5, 2), ("", "ODD", None, 1, 2)], "span_id string, type string, start_anchor string, start_byte int, end_byte int")
    got = sorted((r.span_id, r.path) for r in validate.violations(s, ["span_id"], validate.span_rules()).collect())
    assert got == [("", "id"), ("", "start_anchor"), ("", "type"), ("x", "end")]
    reps = spark.createDataFrame([("k", 1, "a", "b", "L1", ["x"]), ("k", 2, "b", "c", "L3", ["y"])], "k string, step int, source string, target string, loss_class string, lost array<string>")
    assert tuple(validate.combined_loss(reps, ["k"]).first()) == ("k", "a", "c", "L3", ["x", "y"])
    lost = spark.createDataFrame([("k", "markup"), ("k", "note")], "k string, element_type string")
    assert validate.within_budget(reps.select("k", "loss_class").limit(1), lost, "k", "L3", 1, ["note"]).first().passed
    assert not validate.within_budget(reps.select("k", "loss_class"), lost, "k", "L2", 0, []).orderBy("passed").first().passed
    h = validate.hash_check(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, d string"), spark.createDataFrame([("a", "1"), ("b", "9"), ("z", "0")], "k string, d string"), "k", "d")
    assert {r.k: r.status for r in h.collect()} == {"a": "pass", "b": "fail", "c": "new", "z": "missing"}
    t = spark.createDataFrame([(1,), (1,)], "x int")
    ok, report = validate.run_plan({"steps": [{"type": "copy", "output": "o"}], "checks": [{"type": "IR_STRUCTURE_EQUAL", "a": "i", "b": "o"}]}, {"i": t}, {"copy": lambda tabs, s: tabs["i"]})
    assert ok and len(report) == 2
    ok, report = validate.run_plan({"steps": [{"type": "boom", "output": "o"}]}, {}, {"boom": lambda tabs, s: 1 / 0})
    assert not ok and report[-1]["status"].startswith("fail")
    assert not validate.same_rows(t, t.limit(1))
