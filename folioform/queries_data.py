"""Driver queries of the general data problems (differences, shredding, orphans) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioform.operators import compare, orphans, shred
from folioform.session import read_table as rd


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return compare.compare_extractions(rd(s, d, "compare_ir"), rd(s, d, "ir_blocks"))


def p2_diff_counts(s: SparkSession, d: str) -> DataFrame:
    return p2_found(s, d).groupBy("compare_id", "diff").agg(F.count("*").alias("n_blocks"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return shred.nested_nodes(rd(s, d, "ir_raw"))


def p3_content_blocks(s: SparkSession, d: str) -> DataFrame:
    return shred.ir_tables(rd(s, d, "ir_raw"))["content_blocks"]


def p3_spans(s: SparkSession, d: str) -> DataFrame:
    return shred.ir_tables(rd(s, d, "ir_raw"))["spans"]


def p3_annotations(s: SparkSession, d: str) -> DataFrame:
    return shred.ir_tables(rd(s, d, "ir_raw"))["annotations"]


def p3_documents(s: SparkSession, d: str) -> DataFrame:
    return shred.ir_tables(rd(s, d, "ir_raw"))["documents"]


def p3_rejects(s: SparkSession, d: str) -> DataFrame:
    """Payloads that are no JSON object, with the reason."""
    return shred.ir_tables(rd(s, d, "ir_raw"))["rejects"]


def _p4_judged(s: SparkSession, d: str) -> list[tuple[orphans.Judged, str]]:
    return [(orphans.judged_runs(rd(s, d, "runs"), rd(s, d, "blobs")), "runs"), (orphans.judged_verses(rd(s, d, "verses"), rd(s, d, "books")), "verses")]


def p4_found(s: SparkSession, d: str) -> DataFrame:
    runs, verses = (orphans.orphan_references(*j) for j in _p4_judged(s, d))
    return runs.unionByName(verses)


def p4_orphans_per_month(s: SparkSession, d: str) -> DataFrame:
    runs, verses = (orphans.orphan_counts(*j) for j in _p4_judged(s, d))
    return runs.unionByName(verses)


QUERIES = {f.__name__: f for f in (p2_found, p2_diff_counts, p3_found, p3_content_blocks, p3_spans, p3_annotations, p3_documents, p3_rejects, p4_found, p4_orphans_per_month)}

_P2 = """
WITH pairs AS (SELECT DISTINCT compare_id, ir_a_key, ir_b_key FROM compare_ir WHERE ir_a_key IS NOT NULL AND ir_b_key IS NOT NULL),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ir_key, doc_id, block_id ORDER BY extracted_at DESC NULLS LAST, ir_row_id DESC) AS rn FROM ir_blocks) WHERE rn = 1),
a AS (SELECT p.compare_id, c.* FROM pairs p JOIN cur c ON c.ir_key = p.ir_a_key),
b AS (SELECT p.compare_id, c.* FROM pairs p JOIN cur c ON c.ir_key = p.ir_b_key),
j AS (SELECT coalesce(a.compare_id, b.compare_id) AS compare_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.block_id, b.block_id) AS block_id,
  a.compare_id IS NOT NULL AS in_a, b.compare_id IS NOT NULL AS in_b, a.seq IS DISTINCT FROM b.seq AS d1, a.text IS DISTINCT FROM b.text AS d2,
  a.osis_id IS DISTINCT FROM b.osis_id AS d3, a.token_count IS DISTINCT FROM b.token_count AS d4
  FROM a FULL JOIN b ON a.compare_id = b.compare_id AND a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.block_id IS NOT DISTINCT FROM b.block_id),
found AS (SELECT compare_id, doc_id, block_id, 'missing_in_a' AS diff FROM j WHERE NOT in_a UNION SELECT compare_id, doc_id, block_id, 'missing_in_b' FROM j WHERE NOT in_b
  UNION SELECT compare_id, doc_id, block_id, 'seq' FROM j WHERE in_a AND in_b AND d1 UNION SELECT compare_id, doc_id, block_id, 'text' FROM j WHERE in_a AND in_b AND d2
  UNION SELECT compare_id, doc_id, block_id, 'osis_id' FROM j WHERE in_a AND in_b AND d3 UNION SELECT compare_id, doc_id, block_id, 'token_count' FROM j WHERE in_a AND in_b AND d4)
"""

_P4 = """
WITH refs AS (
  SELECT 'runs' AS src_table, run_uid AS src_id, coalesce(finished_at, started_at) AS t, regexp_replace(lower(trim(transcript_blob_sha256, e' \\t\\n\\r')), '^sha256:', '') AS k FROM runs
  UNION ALL SELECT 'verses', verse_uid, created_at, lower(trim(book, e' \\t\\n\\r')) FROM verses),
targets AS (
  SELECT 'runs' AS src_table, regexp_replace(lower(trim(sha256, e' \\t\\n\\r')), '^sha256:', '') AS k, created_at AS b, deleted_at AS d FROM blobs
  UNION ALL SELECT 'verses', lower(trim(id, e' \\t\\n\\r')), added_at, deleted_at FROM books),
j AS (SELECT r.src_table, r.src_id, r.t, count(g.k) AS n, count(*) FILTER (WHERE g.b <= r.t AND (g.d IS NULL OR r.t < g.d)) AS there, count(*) FILTER (WHERE g.b <= r.t) AS earlier
  FROM refs r LEFT JOIN targets g ON g.src_table = r.src_table AND g.k = r.k WHERE r.k <> '' GROUP BY ALL),
found AS (SELECT src_table, src_id, strftime(t, '%Y-%m') AS ref_month, CASE WHEN n = 0 THEN 'missing' WHEN earlier = 0 THEN 'late' ELSE 'deleted' END AS reason FROM j WHERE there = 0)
"""

#: Shapes vary in the payloads: blocks, spans and annotations may be lone objects, annotations may stand below blocks.
_P3 = """
WITH ok AS (SELECT raw_id, payload::JSON AS p FROM ir_raw WHERE json_valid(payload) AND json_type(payload::JSON) = 'OBJECT'),
root AS (SELECT raw_id, p, coalesce(p->>'$.id', '') AS doc_id, CASE json_type(p->'$.canonical_ref') WHEN 'VARCHAR' THEN coalesce(p->>'$.canonical_ref', '') WHEN 'OBJECT' THEN coalesce(p->>'$.canonical_ref.osis_id', '') ELSE '' END AS osis FROM ok),
bl AS (SELECT raw_id, doc_id, osis, unnest(CASE json_type(p->'$.content_blocks') WHEN 'ARRAY' THEN (p->'$.content_blocks')::JSON[] WHEN 'OBJECT' THEN [p->'$.content_blocks'] END) AS b FROM root),
an AS (SELECT raw_id, osis, coalesce(b->>'$.id', '') AS bid, unnest(CASE json_type(b->'$.anchors') WHEN 'ARRAY' THEN (b->'$.anchors')::JSON[] WHEN 'OBJECT' THEN [b->'$.anchors'] END) AS a FROM bl),
sp AS (SELECT raw_id, osis, bid, unnest(CASE json_type(a->'$.spans') WHEN 'ARRAY' THEN (a->'$.spans')::JSON[] WHEN 'OBJECT' THEN [a->'$.spans'] END) AS s FROM an),
nt AS (SELECT raw_id, osis, unnest(CASE json_type(p->'$.annotations') WHEN 'ARRAY' THEN (p->'$.annotations')::JSON[] WHEN 'OBJECT' THEN [p->'$.annotations'] END) AS n FROM root
  UNION ALL SELECT raw_id, osis, unnest(CASE json_type(b->'$.annotations') WHEN 'ARRAY' THEN (b->'$.annotations')::JSON[] WHEN 'OBJECT' THEN [b->'$.annotations'] END) FROM bl),
known AS (SELECT DISTINCT raw_id, coalesce(s->>'$.id', '') AS span_id FROM sp)
SELECT raw_id, 'content_block' AS node_kind, coalesce(b->>'$.id', '') AS node_id, doc_id AS parent_id, osis AS root_osis_id FROM bl
UNION SELECT raw_id, 'span', coalesce(s->>'$.id', ''), bid, osis FROM sp
UNION SELECT nt.raw_id, 'annotation', coalesce(n->>'$.id', ''), coalesce(k.span_id, ''), osis FROM nt LEFT JOIN known k ON k.raw_id = nt.raw_id AND k.span_id = coalesce(n->>'$.span_id', '')
"""

#: The flat tables, a lone object counting as an array of one. ITEMS: one row per item of a list, with its position.
_ARR = "CASE json_type({0}) WHEN 'ARRAY' THEN ({0})::JSON[] WHEN 'OBJECT' THEN [{0}] END"
_ITEMS = "SELECT {keep}, unnest(l) AS {v}, unnest(generate_series(0, len(l) - 1))::INT AS {n} FROM (SELECT *, {arr} AS l FROM {src}) WHERE len(l) > 0"
_P3_BLOCKS = f"""WITH ok AS (SELECT raw_id AS rec_id, payload::JSON AS p FROM ir_raw WHERE json_valid(payload) AND json_type(payload::JSON) = 'OBJECT'),
b AS ({_ITEMS.format(keep="rec_id", v="b", n="block_no", arr=_ARR.format("p->'$.content_blocks'"), src="ok")})
"""
_P3_SPANS = _P3_BLOCKS + f""", a AS ({_ITEMS.format(keep="rec_id, block_no", v="a", n="anchor_no", arr=_ARR.format("b->'$.anchors'"), src="b")}),
s AS ({_ITEMS.format(keep="rec_id, block_no, anchor_no", v="s", n="span_no", arr=_ARR.format("a->'$.spans'"), src="a")})
SELECT rec_id, block_no, anchor_no, span_no, s->>'$.id' AS span_id, s->>'$.type' AS type, s->>'$.start_anchor_id' AS start_anchor_id, s->>'$.ref.osis_id' AS osis_id FROM s"""
_P3_NOTES = _P3_BLOCKS + f""", n AS (SELECT rec_id, NULL::INT AS block_no, note_no, n FROM ({_ITEMS.format(keep="rec_id", v="n", n="note_no", arr=_ARR.format("p->'$.annotations'"), src="ok")})
UNION ALL SELECT rec_id, block_no, note_no, n FROM ({_ITEMS.format(keep="rec_id, block_no", v="n", n="note_no", arr=_ARR.format("b->'$.annotations'"), src="b")}))
SELECT rec_id, block_no, note_no, n->>'$.id' AS annotation_id, n->>'$.span_id' AS span_id, n->>'$.type' AS type, n->>'$.source' AS source FROM n"""
_P3_DOCS = _P3_BLOCKS + """SELECT rec_id, p->>'$.id' AS doc_id, CASE json_type(p->'$.canonical_ref') WHEN 'VARCHAR' THEN p->>'$.canonical_ref' WHEN 'OBJECT' THEN p->>'$.canonical_ref.osis_id' END AS root_osis_id, p->>'$.title' AS title, p->>'$.order' AS doc_order FROM ok"""
_P3_REJECTS = """SELECT raw_id AS rec_id, CASE WHEN payload IS NULL THEN 'null' WHEN NOT json_valid(payload) THEN 'not json' ELSE 'not an object' END AS reason FROM ir_raw
WHERE payload IS NULL OR NOT json_valid(payload) OR json_type(CASE WHEN json_valid(payload) THEN payload END::JSON) <> 'OBJECT'"""

ORACLE = {
    "p3_content_blocks": _P3_BLOCKS + "SELECT rec_id, block_no, b->>'$.id' AS block_id, b->>'$.sequence' AS sequence, b->>'$.text' AS text FROM b",
    "p3_spans": _P3_SPANS,
    "p3_annotations": _P3_NOTES,
    "p3_documents": _P3_DOCS,
    "p3_rejects": _P3_REJECTS,
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_diff_counts": _P2 + "SELECT compare_id, diff, count(*) AS n_blocks FROM found GROUP BY ALL",
    "p3_found": _P3,
    "p4_found": _P4 + "SELECT * FROM found",
    "p4_orphans_per_month": _P4 + "SELECT src_table, ref_month, reason, count(*) AS n_orphans FROM found GROUP BY ALL",
}
