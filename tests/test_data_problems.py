"""Differences, shredding and orphan references: edge cases and brute force."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioform.operators import compare, orphans, shred

T = lambda d, h=0: dt.datetime(2024, 1, d, h)
IR = "ir_row_id long, ir_key string, doc_id string, block_id string, seq int, text string, osis_id string, token_count int, extracted_at timestamp_ntz"
CMP = "compare_id long, plan_id string, ir_a_key string, ir_b_key string, output_key string, run_at timestamp_ntz"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_compare_edges(spark):
    ir = spark.createDataFrame(
        [
            (1, "a", "D", "1", 1, "x", None, 3, T(1)), (2, "b", "D", "1", 1, "y", None, 3, T(1)),
            (3, "a", "D", "2", None, "x", "o", 3, T(1)), (4, "b", "D", "2", None, "x", "o", 3, T(1)),
            (5, "a", "D", "3", 1, "old", None, 1, T(1)), (6, "a", "D", "3", 1, "new", None, 1, T(2)), (7, "b", "D", "3", 1, "new", None, None, T(1)),
            (8, "a", None, "4", 1, "n", None, 1, T(1)), (9, "b", None, "4", 1, "n", None, 1, T(1)),
            (10, "a", "D", "5", 1, "only a", None, 1, T(1)), (11, "b", "D", "6", 1, "only b", None, 1, T(1)),
            (12, "a", "D", "5", 1, "only a", None, 1, T(1)), (13, "z", "D", "1", 1, "unnamed", None, 1, T(1)),
        ],
        IR,
    )
    cmp = spark.createDataFrame([(1, "p", "a", "b", "o", T(1)), (1, "p", "a", "b", "o", T(1)), (2, "p", "a", None, "o", T(1)), (3, "p", "a", "gone", "o", T(1)), (4, "p", "b", "b", "o", T(1))], CMP)
    found = rows(compare.compare_extractions(cmp, ir))
    one = [r[1:] for r in found if r[0] == 1]
    assert one == [("D", "1", "text"), ("D", "3", "token_count"), ("D", "5", "missing_in_b"), ("D", "6", "missing_in_a")]
    assert {r[3] for r in found if r[0] == 3} == {"missing_in_b"} and sum(r[0] == 3 for r in found) == 5
    assert not [r for r in found if r[0] in (2, 4)]
    assert rows(compare.compare_extractions(cmp, ir.where("false"))) == []
    assert rows(compare.compare_extractions(cmp.where("false"), ir)) == []
    clash = ir.withColumn("diff", F.lit("?")).withColumn("in_a", F.lit(1)).withColumn("compare_id", F.lit(9))
    assert rows(compare.compare_extractions(cmp, clash)) == found


def test_diff_tables_random(spark):
    rng = random.Random(5)
    one = lambda: [(k, rng.choice([None, 1, 2]), rng.choice([None, "x", "y"])) for k in range(40) if rng.random() < 0.8]
    a, b = one(), one()
    got = rows(compare.diff_tables(*(spark.createDataFrame(x, "k long, u int, v string") for x in (a, b)), ["k"], ["u", "v"]))
    da, db = ({r[0]: r[1:] for r in x} for x in (a, b))
    want = [(k, "missing_in_b") for k in da if k not in db] + [(k, "missing_in_a") for k in db if k not in da] + [(k, n) for k in da if k in db for n, x, y in zip("uv", da[k], db[k]) if x != y]
    assert got == sorted(want, key=repr)


REF, TGT = "run_uid long, transcript_blob_sha256 string, started_at timestamp_ntz, finished_at timestamp_ntz", "sha256 string, created_at timestamp_ntz, deleted_at timestamp_ntz"


def test_orphans_edges(spark):
    refs = spark.createDataFrame(
        [(1, " AB ", T(5), None), (2, "sha256:AB\n", T(1), T(5)), (3, "SHA256:ab", T(1), None), (4, "nope", T(5), None), (5, None, T(5), None), (6, " ", T(5), None), (7, "cd", T(5), None), (8, "cd", T(7), None), (9, "cd", T(6), None), (10, "nope", None, None), (11, "ab", None, None), (4, "nope", T(5), None)],
        REF,
    )
    blobs = spark.createDataFrame([("ab", T(2), None), ("CD", T(3), T(5)), ("cd", T(6), T(7)), (None, T(1), None)], TGT)
    found = lambda r, b: orphans.orphan_references(orphans.judged_runs(r, b), "runs")
    got = {(r.src_id, r.ref_month, r.reason) for r in found(refs, blobs).collect()}
    assert got == {(3, "2024-01", "late"), (4, "2024-01", "missing"), (7, "2024-01", "deleted"), (8, "2024-01", "deleted"), (10, None, "missing")}
    assert found(refs, blobs).count() == 5
    assert found(refs.where("false"), blobs).count() == 0
    assert {r.reason for r in found(refs, blobs.where("false")).collect()} == {"missing"}
    per = {(r.ref_month, r.reason, r.n_orphans) for r in orphans.orphan_counts(orphans.judged_runs(refs, blobs), "runs").collect()}
    assert per == {("2024-01", "late", 1), ("2024-01", "missing", 2), (None, "missing", 1), ("2024-01", "deleted", 2)}


@pytest.mark.parametrize("seed,share", [(1, 0.01), (2, 0.2), (3, 1.0), (4, 0.2), (5, 0.2)])
def test_orphans_agree_with_brute_force(spark, seed, share):
    rng = random.Random(seed)
    at = lambda: dt.datetime(2024, 1 + rng.randrange(4), 1 + rng.randrange(6))
    refs = [(i, rng.choice(["hot"] * 5 + ["a", "b", "c", "d", "e"]), at(), None) for i in range(300)]
    tgts = [(rng.choice(["hot", "hot", "a", "b", "c", "e"]), at(), rng.choice([None, at(), at()])) for _ in range(9)]
    r, t = spark.createDataFrame(refs, REF), spark.createDataFrame(tgts, TGT)
    j = orphans.judged_runs(r, t, heavy_share=share)
    assert bool(j.heavy) == (share < 1)
    want = {}
    for i, k, x, _ in refs:
        life = [(b, d) for kk, b, d in tgts if kk == k]
        if not any(b <= x and (d is None or x < d) for b, d in life):
            want[i] = (f"{x:%Y-%m}", "missing" if not life else "late" if all(b > x for b, _ in life) else "deleted")
    assert {x.src_id: (x.ref_month, x.reason) for x in orphans.orphan_references(j, "runs").collect()} == want
    assert {(x.ref_month, x.reason): x.n_orphans for x in orphans.orphan_counts(j, "runs").collect()} == Counter(want.values())


def test_nested_nodes(spark):
    doc = {
        "canonical_ref": {"book": "B", "osis_id": "B.1"},
        "id": "d",
        "annotations": [{"id": "n1", "span_id": "s1"}, {"id": "n2", "span_id": "gone"}, {"id": "n3", "span_id": None}],
        "content_blocks": [{"id": "b1", "anchors": [{"spans": [{"id": "s1"}, {"id": "s1"}]}, {"spans": {"id": "s2"}}], "annotations": [{"id": "n4", "span_id": "s2"}]}, {"id": "b2", "anchors": None, "tokens": [{"id": "t"}]}],
    }
    lone = {"id": "e", "canonical_ref": "E.2", "content_blocks": {"id": "b9"}, "annotations": {"id": "n9"}}
    payloads = [json.dumps(doc), json.dumps(lone), None, "", "null", "[]", json.dumps(doc)[:-7], "{}", '{"id": "x", "content_blocks": []}', "[" * 100000]
    df = spark.createDataFrame(list(enumerate(payloads)), "raw_id long, payload string").withColumn("rec_id", F.lit("clash"))
    got = {tuple(r) for r in shred.nested_nodes(df).collect()}
    assert got == {
        (0, "content_block", "b1", "d", "B.1"), (0, "content_block", "b2", "d", "B.1"), (0, "span", "s1", "b1", "B.1"), (0, "span", "s2", "b1", "B.1"),
        (0, "annotation", "n1", "s1", "B.1"), (0, "annotation", "n2", "", "B.1"), (0, "annotation", "n3", "", "B.1"), (0, "annotation", "n4", "s2", "B.1"),
        (1, "content_block", "b9", "e", "E.2"), (1, "annotation", "n9", "", "E.2"),
    }
    tabs = shred.ir_tables(df)
    assert {(r.rec_id, r.doc_id, r.root_osis_id) for r in tabs["documents"].collect()} == {(0, "d", "B.1"), (1, "e", "E.2"), (7, None, None), (8, "x", None)}
    assert {(r.rec_id, r.block_no, r.block_id) for r in tabs["content_blocks"].collect()} == {(0, 0, "b1"), (0, 1, "b2"), (1, 0, "b9")}
    assert {(r.anchor_no, r.span_no, r.span_id) for r in tabs["spans"].collect()} == {(0, 0, "s1"), (0, 1, "s1"), (1, 0, "s2")}
    assert {(r.rec_id, r.block_no, r.note_no, r.annotation_id) for r in tabs["annotations"].collect()} == {(0, None, 0, "n1"), (0, None, 1, "n2"), (0, None, 2, "n3"), (0, 0, 0, "n4"), (1, None, 0, "n9")}
    assert {(r.rec_id, r.reason) for r in tabs["rejects"].collect()} == {(2, "null"), (3, "not json"), (4, "not an object"), (5, "not an object"), (6, "not json"), (9, "not an object")}
    assert shred.nested_nodes(df.where("false")).count() == 0


def flat(v, names=(), ords=()):
    """Brute force of shred.triples by json.loads: scalars with their path."""
    if isinstance(v, dict):
        return [t for k, x in v.items() for t in flat(x, (*names, k), (*ords, -1))]
    if isinstance(v, list):
        out = []
        for i, x in enumerate(v):
            at = (names, (*ords[:-1], i)) if ords[-1] < 0 else ((*names, ""), (*ords, i))
            out += flat(x, *at)
        return out
    return [] if v is None else [(names, ords, v if isinstance(v, str) else json.dumps(v))]


def test_triples_agree_with_a_tree_parser():
    rng = random.Random(3)

    def value(d):
        k = rng.randrange(8 if d else 5)
        if k < 5:
            return rng.choice([None, True, 3, -2.5, "x", 'q"\\\n', "é\u2028", ""])
        return [value(d - 1) for _ in range(rng.randrange(4))] if k == 5 else {rng.choice("ab.") + str(i): value(d - 1) for i in range(rng.randrange(4))}

    for _ in range(300):
        doc = {"r": value(5), "s": value(4)}
        for text in (json.dumps(doc), json.dumps(doc, indent=1, ensure_ascii=False)):
            assert [(n, o, v) for n, o, k, v in shred.triples(text) if k == "value"] == flat(doc)
    good = json.dumps({"a": [1, {"b": "x\n", "c": None}, [], True], "d": {"e": -1.5e3}})
    for _ in range(2000):
        s = list(good)
        for _ in range(rng.randrange(1, 3)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice(["", s[k] + rng.choice('{}[],:"1 a')])
        s = "".join(s)
        try:
            ok = isinstance(json.loads(s), dict)
        except ValueError:
            ok = False
        try:
            list(shred.triples(s))
        except shred.Unreadable:
            assert not ok
        else:
            assert ok


def test_shred_depth_dots_and_repeats(spark):
    deep = '{"a":' * 100_000 + "1" + "}" * 100_000
    payloads = [deep, '{"canonical_ref.osis_id": "no", "canonical_ref": {"osis_id": "yes"}, "id": 1, "id": "d", "content_blocks": [{"id": "x"}], "content_blocks": [{"id": "y"}]}', '{"m": [[1, 2], [3]], "o": {}}', '{"o": [{"k": {"v": 1}}, 5]}']
    df = spark.createDataFrame([*enumerate(payloads), (1, payloads[1]), (2, '{"z": 1}')], "raw_id long, payload string")
    nodes = {tuple(r) for r in shred.nested_nodes(df).collect()}
    assert nodes == {(1, "content_block", "x", "d", "yes"), (1, "content_block", "y", "d", "yes")}
    whole = shred.shred(df.where("raw_id = 0"), "raw_id", "payload").where("kind = 'json'").first()
    assert len(whole.names) == shred.MAX_DEPTH and len(whole.value) == len(deep) - 6 * shred.MAX_DEPTH
    tables = shred.flat_tables(df, "raw_id", "payload")
    assert set(tables) == {(), ("content_blocks",), ("m", ""), ("o",)}
    assert {(r.rec_id, *r["at"], r["value"]) for r in tables["m", ""].collect()} == {(2, 0, 0, "1"), (2, 0, 1, "2"), (2, 1, 0, "3")}
    # {} where others hold arrays is an item without members; a scalar there is no object
    assert {(r.rec_id, *r["at"], r.is_object, r["k.v"], r["value"]) for r in tables["o",].collect()} == {(2, 0, True, None, None), (3, 0, True, "1", None), (3, 1, False, None, "5")}
    assert {r["canonical_ref.osis_id"] for r in tables[()].where("rec_id = 1").collect()} == {"yes"} and {r["canonical_ref.osis_id_2"] for r in tables[()].where("rec_id = 1").collect()} == {"no"}
