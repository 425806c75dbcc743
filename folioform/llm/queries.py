"""Driver queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioform.llm import leaks, mojibake, neardup, packing, printform, residue, spans
from folioform.session import materialize
from folioform.session import read_table as rd


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(*neardup.near_duplicates(rd(s, d, "blocks"), "block_uid", "text", threshold=0.7, min_words=12, shingle=1))


def p1_groups(s: SparkSession, d: str) -> DataFrame:
    return neardup.connected_groups(*neardup.near_duplicates(rd(s, d, "blocks"), "block_uid", "text", threshold=0.7, min_words=12, shingle=1))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return printform.lookalike_pairs(rd(s, d, "blocks"), "block_uid", F.col("text"), "blocks").unionByName(printform.lookalike_pairs(rd(s, d, "esword_bible"), "row_id", F.col("scripture"), "esword_bible"))


def p5_print_forms(s: SparkSession, d: str) -> DataFrame:
    """Every esword_bible row with its print form."""
    return rd(s, d, "esword_bible").select("row_id", printform.print_form_udf("scripture").alias("print_form"))


def _p6_rows(s: SparkSession, d: str) -> DataFrame:
    return mojibake.source_rows(rd(s, d, "esword_bible"), "esword_bible", "row_id", "module_id", "scripture").unionByName(mojibake.source_rows(rd(s, d, "mybible_verses"), "mybible_verses", "verse_uid", "module_id", "text"))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_rows(_p6_rows(s, d)).select("src_table", "src_id")


def p6_restored(s: SparkSession, d: str) -> DataFrame:
    """The garbled rows with the chain believed and the text restored."""
    return mojibake.garbled_rows(_p6_rows(s, d)).select("src_table", "src_id", "chain", "restored")


def _p7_rows(s: SparkSession, d: str) -> DataFrame:
    return residue.text_rows(rd(s, d, "blocks"), "blocks", "block_uid", "text").unionByName(residue.text_rows(rd(s, d, "esword_bible"), "esword_bible", "row_id", "scripture"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return residue.residue_rows(_p7_rows(s, d)).select("src_table", "src_id")


def p7_clean(s: SparkSession, d: str) -> DataFrame:
    """The rows that stay once residue is excluded."""
    return residue.clean_rows(_p7_rows(s, d))


#: Shares of the kinds of module every window is filled to; kinds not named share the rest as they are.
P8_TARGETS = {"BIBLE": 0.4, "COMMENTARY": 0.25, "DICTIONARY": 0.15}


def p8_packed(s: SparkSession, d: str) -> DataFrame:
    return packing.pack(rd(s, d, "documents"), "doc_id", "text", "module_type", targets=P8_TARGETS)


def p8_fill(s: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(s, d))


def p8_mixture(s: SparkSession, d: str) -> DataFrame:
    return packing.mixture_report(p8_packed(s, d))


def p8_share_errors(s: SparkSession, d: str) -> DataFrame:
    """How far the windows are from the target shares."""
    return packing.share_errors(materialize(p8_packed(s, d), "packed"), P8_TARGETS)


def p8_conserved(s: SparkSession, d: str) -> DataFrame:
    """Per document, whether all of it came out, whole, and in containers that hold it."""
    return packing.conservation(materialize(p8_packed(s, d), "packed"), packing.sized_items(rd(s, d, "documents"), "doc_id", "text", "module_type"))


def p8_by_source(s: SparkSession, d: str) -> DataFrame:
    """Containers that keep the mixture of sources the corpus has."""
    return packing.pack(rd(s, d, "documents"), "doc_id", "text", "source")


def _p9_leaks(s: SparkSession, d: str, short: bool) -> DataFrame:
    return leaks.leaked_passages(rd(s, d, "documents"), "doc_id", "text", rd(s, d, "eval_items"), "item_id", "passage", short)


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return leaks.exact_leaks(_p9_leaks(s, d, short=False))


def p9_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Every verified overlap, substitutions tolerated."""
    return _p9_leaks(s, d, short=True)


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(rd(s, d, "documents"), "doc_id", "text")


def p10_shared(s: SparkSession, d: str) -> DataFrame:
    """Per document, how much of it is found elsewhere."""
    return spans.removal_intervals(rd(s, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p5_found, p5_print_forms, p6_found, p6_restored, p7_found, p7_clean, p8_packed, p8_fill, p8_mixture, p8_share_errors, p8_conserved, p8_by_source, p9_found, p9_overlaps, p10_found, p10_shared)}

_GRAMS = "SELECT DISTINCT {id}, array_to_string(w[i : i + 12], ' ') AS gram FROM (SELECT {id}, w, unnest(generate_series(1, len(w) - 12)) AS i FROM (SELECT {id}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE {text} IS NOT NULL) WHERE len(w) >= 13)"

ORACLE = {
    "p8_conserved": "SELECT doc_id, count(*) AS copies, true AS whole, true AS fits, true AS tokens_kept FROM documents GROUP BY doc_id",
    "p9_found": f"SELECT DISTINCT item_id, doc_id FROM ({_GRAMS.format(id='item_id', text='passage', table='eval_items')}) JOIN ({_GRAMS.format(id='doc_id', text='text', table='documents')}) USING (gram)",
    "p10_found": """WITH w AS (SELECT doc_id, md5_number(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 399)) AS i FROM documents WHERE length(text) >= 400)),
d AS (SELECT DISTINCT h, doc_id FROM w) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p10_shared": """WITH w AS (SELECT doc_id, i, md5_number(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 399)) AS i FROM documents WHERE length(text) >= 400)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN r USING (h)),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m), s AS (SELECT doc_id, max(i) - min(i) + 400 AS n FROM k GROUP BY doc_id, k)
SELECT doc_id, count(*) AS n_spans, sum(n)::BIGINT AS shared_chars, any_value(length(text)) AS n_chars, round(sum(n) / any_value(length(text)), 6) AS shared_share FROM s JOIN documents USING (doc_id) GROUP BY doc_id""",
}
