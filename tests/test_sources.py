"""Every format: round trips, detection, damaged input."""

import pytest

from folioform.operators.validate import same_rows
from folioform.plans import convert
from folioform.sources import binary, database, registry, textual
from folioform.sources.model import Verse

VERSES = [Verse("Gen", 1, 1, "First words."), Verse("Gen", 1, 2, "Second “verse” – done."), Verse("Gen", 2, 1, "Third & last"), Verse("Matt", 1, 1, "Other book")]
KEY = [(v.doc, v.chapter, v.verse, v.text) for v in VERSES]
#: Formats that do not keep places, or only those of the New Testament.
PARTIAL = {"rtf", "gobible", "flex", "morphgnt", "sblgnt", "accordance", "logos"}


def key(vs):
    return [(v.doc, v.chapter, v.verse, v.text) for v in vs]


@pytest.mark.parametrize("fmt", [f.name for f in registry.FORMATS if f.write and f.name not in PARTIAL])
def test_round_trip(fmt):
    f = registry.BY_NAME[fmt]
    data = f.write(VERSES)
    assert key(f.read("x", data)) == KEY
    assert registry.detect(f"x{f.suffixes[0]}", data) in (fmt, "usfm" if fmt == "sfm" else fmt)


def test_sinks_that_keep_less():
    f = registry.BY_NAME
    for fmt in ("morphgnt", "sblgnt"):
        assert key(f[fmt].read("x", f[fmt].write([*VERSES, Verse("Rev", 2, 3, "last words here")]))) == [KEY[3], ("Rev", 2, 3, "last words here")]
        assert registry.detect("x.txt", f[fmt].write([*VERSES, Verse("Rev", 2, 3, "last words here")])) == fmt
    assert [v.text for v in f["flex"].read("x", f["flex"].write(VERSES))] == [v.text for v in VERSES]
    assert [v.text for v in f["gobible"].read("x", f["gobible"].write(VERSES))] == [v.text for v in VERSES if len(v.text) > 10]
    for fmt, name in (("flex", "x.flextext"), ("gobible", "x.jar"), ("odf", "x.odt"), ("dbl", "x.zip")):
        assert registry.detect(name, f[fmt].write(VERSES)) == fmt
    odd = [Verse("Gen", 1, 1, "a < b & \x01 “c”")]
    assert [v.text for v in f["odf"].read("x", f["odf"].write(odd))] == ["a < b & � “c”"] == [v.text for v in f["flex"].read("x", f["flex"].write(odd))]


def test_accordance_tables():
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.executescript("CREATE TABLE AccContent (id INT, body TEXT); CREATE TABLE Other (t TEXT); CREATE TABLE AccVerses (id INT, body TEXT);")
    con.execute("INSERT INTO AccContent VALUES (1, 'content of the module')")
    con.execute("INSERT INTO Other VALUES ('not a text of the module')")
    con.execute("INSERT INTO AccVerses VALUES (1, 'verses of the module')")
    con.commit()
    data = con.serialize()
    assert registry.detect("x.atext", data) == "accordance"
    assert [v.text for v in registry.BY_NAME["accordance"].read("x", data)] == ["verses of the module", "content of the module"]


@pytest.mark.parametrize("fmt", [f.name for f in registry.FORMATS if f.read])
@pytest.mark.parametrize("data", [b"", b"\x00\xff\xfe", b"<a><b", b"{", "é\n".encode()])
def test_damaged_input(fmt, data):
    f = registry.BY_NAME[fmt]
    if f.detect("x", data) or not database.looks_sqlite(data) and fmt not in ("sqlite", "esword", "mysword", "mybible", "accordance", "logos"):
        assert list(f.read("x", data)) is not None


def test_word_tables():
    rows = "010101 N- ----NSF- In In in in\n010101 V- 3IAI-S-- was was was be\n010102 N- ----NSF- Next next next next\n".encode()
    assert key(textual.read_morphgnt("x", rows)) == [("Matt", 1, 1, "In was"), ("Matt", 1, 2, "Next")]
    assert key(textual.read_oshb("x", b"Gen.1.1 a b\nGen.1.1 c\nGen.1.2 d\n")) == [("Gen", 1, 1, "a b c"), ("Gen", 1, 2, "d")]


def test_usfm_markers():
    data = "\\id GEN\n\\h Genesis\n\\c 1\n\\p\n\\v 1-2 One \\wj two\\wj*\nthree\\f + \\ft note\\f*\n\\q more\n\\v 3\n".encode()
    (v,) = textual.read_usfm("x", data)
    assert (v.doc, v.verse, v.verse_end, v.text, v.title) == ("Gen", 1, 2, "One two three more", "Genesis")


def test_osis_milestones():
    data = b'<osis><div type="book" osisID="Gen"><chapter osisID="Gen.1"><p><verse sID="Gen.1.1" osisID="Gen.1.1"/>A <q>b</q><note>no</note><verse eID="Gen.1.1"/></p></chapter></div></osis>'
    assert key(textual.read_osis("x", data)) == [("Gen", 1, 1, "A b")]


def test_theword():
    canon = [("Gen", 1, 2), ("Gen", 2, 1)]
    assert key(textual.read_theword("x", textual.write_theword(VERSES, canon), canon)) == KEY[:3]


def test_binary_modules():
    canon = [("Gen", 1, 3), ("Gen", 2, 2), ("Matt", 1, 2)]
    assert key(binary.read_ztext(*binary.write_ztext(VERSES, canon, 10), canon)) == KEY
    items = {f"k{i:03}": f"text {i} é" for i in range(120)}
    assert dict(binary.read_zld(*binary.write_zld(items))) == items
    nodes = [(-1, "", ""), (0, "A", "ta"), (1, "A1", "é"), (0, "B", "tb")]
    assert [(p, n, t) for _, p, n, t in binary.read_genbook(*binary.write_genbook(nodes))] == nodes


def test_archives():
    files = {"a/b.txt": b"x" * 2000, "c": b""}
    for kind in ("zip", "xz", "gz", ""):
        data = binary.pack(files, kind)
        assert {p: c for p, _, d, c in binary.entries(data) if not d} == files and binary.pack(files, kind) == data
    assert not binary.safe_path("../x") and not binary.safe_path("/x") and binary.safe_path("a/b")


def test_conf():
    name, conf = binary.read_conf("[Mod]\nA=1\nFeature=X\nFeature=Y\nAbout=one \\\n two\n[Other]\nA=2\n")
    assert name == "Mod" and conf == {"A": ["1"], "Feature": ["X", "Y"], "About": ["one two"]} or conf["About"][0].split() == ["one", "two"]


def test_rtf():
    assert textual.strip_rtf(r"{\rtf1{\fonttbl{\f0 Arial;}}\b bold\b0  \'e9\u233? x\par y}") == "bold éé x\ny"


def test_rtf_styles():
    assert textual.rtf_to_html(r"{\rtf1 a {\b b & {\i c}} d\par e}") == "a <b>b &amp; </b><b><i>c</i></b> d<br/>e"
    assert textual.rtf_to_latex(r"{\rtf1 a_ {\b b}}") == r"a\_ \textbf{b}"


def test_blake3():
    from folioform.functions.blake3 import blake3_hex

    assert blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert len({blake3_hex(b"x" * n) for n in range(1000, 5000, 250)}) == 16


def test_binary_modules_in_spark(spark, tmp_path):
    canon = {"ot": [("Gen", 1, 2), ("Gen", 2, 1)], "nt": [("Matt", 1, 1)]}
    (tmp_path / "mod").mkdir()
    for t in ("ot", "nt"):
        for s, data in zip(("bzs", "bzv", "bzz"), binary.write_ztext(VERSES, canon[t])):
            (tmp_path / "mod" / f"{t}.{s}").write_bytes(data)
    got = registry.binary_modules(registry.files(spark, str(tmp_path)), canon).collect()
    assert [(r.doc_id, r.chapter, r.verse, r.text) for r in got] == KEY and {r.corpus_id for r in got} == {"mod"}


def test_registry_in_spark(spark, tmp_path):
    for f in registry.FORMATS:
        if f.write:
            (tmp_path / f"x_{f.name}{f.suffixes[0]}").write_bytes(f.write(VERSES))
    (tmp_path / "junk.bin").write_bytes(bytes(range(256)))
    (tmp_path / "mods.zip").write_bytes(binary.pack({"mods.d/a.conf": b"[A]\nFeature=StrongsNumbers\n", "../evil": b"x"}, "zip"))
    fs = registry.files(spark, str(tmp_path))
    cat = {r.name: r for r in registry.catalogue(fs).collect()}
    assert cat["junk.bin"].format is None and cat["junk.bin"].kind == "application/octet-stream" and cat["x_epub.epub"].kind == "application/zip"
    blocks = registry.read_blocks(fs)
    counts = {r["corpus_id"]: r["count"] for r in blocks.groupBy("corpus_id").count().collect()}
    assert set(counts.values()) == {1, 3, 4} and len(counts) == sum(bool(f.write) for f in registry.FORMATS)
    assert {c for c, n in counts.items() if n < 4} == {"x_morphgnt", "x_sblgnt", "x_gobible", "x_accordance", "x_logos"}
    osis = blocks.where("corpus_id = 'x_osis'").cache()
    assert all(convert.round_trip(osis, f) for f in ("json", "usx", "sqlite", "epub"))
    made = convert.convert(spark, str(tmp_path / "x_osis.osis"), "html", str(tmp_path / "out"))
    assert made.first().name == "x_osis.html" and (tmp_path / "out" / "x_osis.html").exists()
    mods = registry.modules(registry.archive_entries(fs))
    assert [(r.module, r.features) for r in mods.collect()] == [("A", ["StrongsNumbers"])]
    store = str(tmp_path / "store")
    first = registry.put_blobs(store, registry.as_blobs(fs))
    assert first == fs.count() and registry.put_blobs(store, registry.as_blobs(fs)) == 0
    arts = registry.as_blobs(fs).limit(1).select(registry.F.lit("a").alias("artifact_id"), "sha256")
    assert registry.verify_artifacts(arts, spark.read.parquet(store)).first().status == "ok"
    paths = registry.tree_paths(spark.createDataFrame([(0, -1, ""), (1, 0, "A"), (2, 1, "B")], "node int, parent int, name string"))
    assert {r.path for r in paths.collect()} == {"", "/A", "/A/B"}
    chain = spark.range(300).selectExpr("CAST(id AS INT) AS node", "CAST(id - 1 AS INT) AS parent", "CAST(id AS STRING) AS name").unionByName(spark.createDataFrame([(900, 901, "lost"), (950, 951, "round"), (951, 950, "round")], "node int, parent int, name string"))
    deep = {r.node: r.path for r in registry.tree_paths(chain).collect()}
    assert len(deep) == 300 and deep[299] == "".join(f"/{i}" for i in range(1, 300))
    kids = {r.node: r.children for r in registry.tree_children(chain).collect()}
    assert kids[0] == [1] and kids[299] == [] and kids[950] == [951]
    with pytest.raises(ValueError):
        registry.read_blocks(fs, "olivetree")
    assert same_rows(osis, osis)
