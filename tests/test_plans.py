"""Interchange JSON, data source, self-check plans, canons from files."""

import json

from pyspark.sql import functions as F

from folioform.operators import canon
from folioform.plans import selfcheck, sqltool
from folioform.sources import datasource, ir_json, textual
from folioform.sources.model import Verse

VERSES = [Verse("Gen", 1, 1, "First."), Verse("Gen", 1, 2, "Second."), Verse("Matt", 1, 1, "Other.")]


def test_ir_json(spark, tmp_path):
    doc = {"id": "c", "documents": [{"id": "Gen", "order": 1, "content_blocks": [{"id": "cb-1", "sequence": 1, "text": "x", "tokens": [{"id": "t", "index": 0}], "anchors": [{"id": "a", "char_offset": 2, "spans": [{"id": "s", "type": "VERSE", "ref": {"book": "Gen", "chapter": 3, "verse": 4}}]}]}, {"id": "Gen.5.6", "sequence": 2, "text": None}], "annotations": [{"id": "n", "span_id": "s", "value": {"a": 1}}]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    t = ir_json.tables(ir_json.read(spark, str(tmp_path / "c.json")))
    assert [(r.block_id, r.chapter, r.verse) for r in t["blocks"].orderBy("sequence").collect()] == [("cb-1", 3, 4), ("Gen.5.6", 5, 6)]
    assert t["spans"].first().start_byte == 2 and json.loads(t["annotations"].first().value) == {"a": 1} and t["tokens"].count() == 1
    nested = ir_json.nest(t["documents"], t["blocks"])
    ir_json.write(nested, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().documents[0].content_blocks[0].id == "cb-1"
    b = t["blocks"]
    assert ir_json.corpus_hash(b).first().digest == ir_json.corpus_hash(b.repartition(3).orderBy(F.desc("sequence"))).first().digest


def test_data_source(spark, tmp_path):
    (tmp_path / "a.usfm").write_bytes(textual.write_usfm(VERSES))
    (tmp_path / "b.json").write_bytes(textual.write_json(VERSES))
    (tmp_path / "c.bin").write_bytes(b"\x00\x01")
    datasource.register(spark)
    df = spark.read.format("folioform").option("path", str(tmp_path)).load()
    assert {(r.corpus_id, r.n) for r in df.groupBy("corpus_id").agg(F.count("*").alias("n")).collect()} == {("a", 3), ("b", 3)}
    assert spark.read.format("folioform").option("path", str(tmp_path / "a.usfm")).option("format", "usfm").load().where("verse = 2").first().text == "Second."


def test_selfcheck(spark, tmp_path):
    (tmp_path / "x.osis").write_bytes(textual.write_osis(VERSES))
    r = selfcheck.run(spark, selfcheck.ROUND_TRIP, str(tmp_path), "osis")
    assert r["status"] == "pass" and len(r["results"]) == 4 and r["hash"] == selfcheck.run(spark, selfcheck.ROUND_TRIP, str(tmp_path), "osis")["hash"]
    assert selfcheck.run(spark, selfcheck.IDENTITY, str(tmp_path), "osis")["status"] == "pass"
    assert selfcheck.run(spark, selfcheck.ROUND_TRIP, str(tmp_path), "pdb")["status"] == "fail"


def test_canon_files(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"id": "k", "ot_books": [{"name": "Genesis", "osis": "Gen", "chapters": [31, 25]}], "nt_books": [{"name": "Matthew", "osis": "Matt", "chapters": [25]}]}))
    c = canon.load_canon(spark, str(tmp_path / "k.json"))
    assert sorted((r.testament, r.book, r.chapter, r.n_verses) for r in c.collect()) == [("NT", "Matt", 1, 25), ("OT", "Gen", 1, 31), ("OT", "Gen", 2, 25)]
    assert canon.canon_totals(c).where("system IS NULL").first().n_verses == 81
    assert canon.expand_canon(c).count() == 81


def test_sqltool(spark, tmp_path):
    spark.range(2).createOrReplaceTempView("two")
    assert [r.json for r in sqltool.query_json(spark, "SELECT id FROM two ORDER BY id").collect()] == ['{"id":0}', '{"id":1}']
    sqltool.export_csv(spark.table("two"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    assert sqltool.row_counts({"two": spark.table("two")}).first().n == 2 and sqltool.describe(spark.table("two")) == [("id", "bigint")]
