"""Driver queries of the interchange model: stand-off joins, numbering systems, references, markup, catalogues, stores, self-checks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioform.functions import refs, text, xmltools
from folioform.operators import align, canon, catalogue, search, shred, standoff, tokens, validate
from folioform.plans import cache, convert, selfcheck, sqltool
from folioform.queries_data import _P3_BLOCKS, _P3_SPANS
from folioform.session import materialize, shared_dir
from folioform.session import read_table as rd
from folioform.sources import ir_json, registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- stand-off annotations, extraction ------------------------------------------------------------------------------------

_LIST = "CASE json_type({0}) WHEN 'ARRAY' THEN ({0})::JSON[] WHEN 'OBJECT' THEN [{0}] END"
_CHAIN = _P3_SPANS.rpartition("SELECT rec_id, block_no, anchor_no")[0] + f""", n AS (SELECT rec_id, unnest({_LIST.format("p->'$.annotations'")}) AS n FROM ok UNION ALL SELECT rec_id, unnest({_LIST.format("b->'$.annotations'")}) FROM b),
notes AS (SELECT rec_id, n->>'$.id' AS annotation_id, n->>'$.type' AS type, n->>'$.span_id' AS span_id FROM n), sps AS (SELECT rec_id, s->>'$.id' AS span_id, s->>'$.start_anchor_id' AS anchor_id FROM s),
ans AS (SELECT rec_id, a->>'$.id' AS anchor_id, (a->>'$.char_offset')::INT AS char_offset, a->>'$.content_block_id' AS block_id FROM a), bls AS (SELECT rec_id, b->>'$.id' AS block_id FROM b)
"""


def _ir(s, d):
    return shred.ir_tables(rd(s, d, "ir_raw"))


@q(_CHAIN + "SELECT rec_id, annotation_id, type, span_id, anchor_id, char_offset, block_id FROM notes JOIN sps USING (rec_id, span_id) JOIN ans USING (rec_id, anchor_id) JOIN bls USING (rec_id, block_id)")
def standoff_join(s, d):
    t = _ir(s, d)
    return standoff.resolve(t["annotations"], t["spans"], t["anchors"], t["content_blocks"])


@q(_CHAIN + """, j AS (SELECT n.rec_id, n.annotation_id, max(CASE WHEN sps.rec_id IS NULL THEN 0 WHEN ans.rec_id IS NULL THEN 1 WHEN bls.rec_id IS NULL THEN 2 ELSE 3 END) AS r FROM notes n LEFT JOIN sps ON sps.rec_id = n.rec_id AND sps.span_id = n.span_id
LEFT JOIN ans ON ans.rec_id = n.rec_id AND ans.anchor_id = sps.anchor_id LEFT JOIN bls ON bls.rec_id = n.rec_id AND bls.block_id = ans.block_id GROUP BY ALL)
SELECT rec_id, annotation_id, ['span', 'anchor', 'block'][r + 1] AS missing FROM j WHERE r < 3""")
def standoff_broken(s, d):
    t = _ir(s, d)
    return standoff.broken(t["annotations"], t["spans"], t["anchors"], t["content_blocks"])


@q(_P3_BLOCKS + f""", k AS (SELECT rec_id, coalesce(len({_LIST.format("b->'$.tokens'")}), 0) AS t, coalesce(len({_LIST.format("b->'$.annotations'")}), 0) AS a FROM b)
SELECT ok.rec_id, (SELECT count(*) FROM k WHERE k.rec_id = ok.rec_id) AS n_blocks, (SELECT coalesce(sum(t), 0)::BIGINT FROM k WHERE k.rec_id = ok.rec_id) AS n_tokens, (SELECT coalesce(sum(a), 0)::BIGINT FROM k WHERE k.rec_id = ok.rec_id) + coalesce(len({_LIST.format("p->'$.annotations'")}), 0) AS n_annotations FROM ok""")
def extraction_stats(s, d):
    """Blocks, tokens and annotations per extracted document, each table counted before it moves."""
    t = _ir(s, d)
    out = t["documents"].select("rec_id")
    for name, n in (("content_blocks", "n_blocks"), ("tokens", "n_tokens"), ("annotations", "n_annotations")):
        out = out.join(t[name].groupBy("rec_id").agg(F.count("*").alias(n)), "rec_id", "left")
    return out.na.fill(0)


@q("""WITH v AS (SELECT * FROM verses WHERE length(trim(text)) > 0), c AS (SELECT module_id, book, chapter, count(*) AS n, string_agg(text, chr(10) ORDER BY verse NULLS FIRST, verse_uid) AS t FROM v GROUP BY ALL),
b AS (SELECT module_id, book, count(*) AS n_chapters, sum(n)::BIGINT AS n_entries, string_agg(t, chr(10) ORDER BY chapter NULLS FIRST) AS t FROM c GROUP BY ALL)
SELECT 'chapter' AS level, module_id, book, chapter, n AS n_entries, sha256(t) AS digest FROM c UNION ALL SELECT 'book', module_id, book, n_chapters::INT, n_entries, sha256(t) FROM b""")
def commentary_rollup(s, d):
    """Entries of verses rolled up to chapters and books (of a book ``chapter`` is their number)."""
    chapters, books = standoff.rollup_entries(rd(s, d, "verses"), ["module_id", "book"], "chapter", ["verse", "verse_uid"], "text")
    c = chapters.select(F.lit("chapter").alias("level"), "module_id", "book", "chapter", "n_entries", F.sha2("text", 256).alias("digest"))
    return c.unionByName(books.select(F.lit("book").alias("level"), "module_id", "book", F.col("n_chapters").cast("int").alias("chapter"), "n_entries", F.sha2("text", 256).alias("digest")))


# ---- numbering systems ----------------------------------------------------------------------------------------------------


@q("SELECT module_id, book, id, verse_uid FROM (SELECT *, row_number() OVER (PARTITION BY module_id, book ORDER BY chapter, verse, verse_uid) AS k FROM verses WHERE chapter IS NOT NULL AND verse IS NOT NULL) WHERE k = 1")
def merge_refs(s, d):
    v = rd(s, d, "verses").where("chapter IS NOT NULL AND verse IS NOT NULL").withColumn("o", F.struct("chapter", "verse", "verse_uid"))
    return canon.merge_refs(v, ["module_id", "book"], "o", ["id", "verse_uid"])


_AB, _BC = [("Keth", 1, "Keth", 2), ("Vosh", 2, "Vosh", 3)], [("Keth", 2, "Keth", 5), ("Melq", 1, "Melq", 9)]
_VAL = lambda rows: "(VALUES " + ", ".join(map(str, rows)) + ")"


@q(f"""WITH ab AS (SELECT * FROM {_VAL(_AB)} m(book, chapter, tb, tc)), bc AS (SELECT * FROM {_VAL(_BC)} m(book, chapter, tb, tc)), ac AS (SELECT ab.book, ab.chapter, coalesce(bc.tb, ab.tb) AS tb, coalesce(bc.tc, ab.tc) AS tc FROM ab LEFT JOIN bc ON bc.book = ab.tb AND bc.chapter = ab.tc),
x AS (SELECT 'direct' AS how, v.verse_uid, v.book, v.chapter, m.tb, m.tc FROM verses v LEFT JOIN ab m ON m.book = v.book AND m.chapter = v.chapter UNION ALL SELECT 'chained', v.verse_uid, v.book, v.chapter, m.tb, m.tc FROM verses v LEFT JOIN ac m ON m.book = v.book AND m.chapter = v.chapter
UNION ALL SELECT 'identity', verse_uid, book, chapter, NULL, NULL FROM verses) SELECT how, verse_uid, coalesce(tb, book) AS mapped_book, coalesce(tc, chapter) AS mapped_chapter FROM x""")
def ref_map_registry(s, d):
    """The verses in three other systems: by the table at hand, over a system between, and unchanged where neither leads there."""
    m = "book string, chapter int, tb string, tc int"
    tables = [("A", "B", s.createDataFrame(_AB, m)), ("B", "C", s.createDataFrame(_BC, m))]
    v, out = rd(s, d, "verses").select("verse_uid", "book", "chapter"), None
    for target in ("B", "C", "D"):
        mapped, how = canon.map_between(v, tables, "A", target, ["book", "chapter"], ["tb", "tc"])
        part = mapped.select(F.lit(how).alias("how"), "verse_uid", "mapped_book", "mapped_chapter")
        out = part if out is None else out.unionByName(part)
    return out


_LOSSY = [("Keth", 1, 1, "Keth", 1, 2, "merge"), ("Vosh", 2, 3, None, None, None, "missing"), ("Melq", 3, 4, "Melq", 3, 5, "shift")]


@q(f"""WITH m AS (SELECT * FROM {_VAL(_LOSSY).replace("None", "NULL")} m(book, chapter, verse, to_book, to_chapter, to_verse, type)) SELECT DISTINCT v.book, v.chapter, v.verse, m.type AS loss FROM verses v JOIN m ON m.book = v.book AND m.chapter = v.chapter AND m.verse = v.verse WHERE m.type IN ('missing', 'merge', 'split')""")
def mapping_losses(s, d):
    m = s.createDataFrame(_LOSSY, "book string, chapter int, verse int, to_book string, to_chapter int, to_verse int, type string")
    return canon.apply_mapping(rd(s, d, "verses").select("verse_uid", "book", "chapter", "verse"), m)[1]


_OSIS_CANON = "SELECT module_id AS system, CASE WHEN book > 39 THEN 'NT' ELSE 'OT' END AS testament, 'b' || book AS book, chapter, max(verse) AS n_verses FROM esword_bible WHERE chapter > 0 AND book IS NOT NULL GROUP BY ALL"


def _canon_files(s: SparkSession, d: str) -> DataFrame:
    """The numbering each module follows, stored as canon files and loaded from there; chapters without a row have no verses."""
    e = rd(s, d, "esword_bible").where("chapter > 0 AND book IS NOT NULL").groupBy("module_id", "book", "chapter").agg(F.max("verse").alias("n"))
    b = e.groupBy("module_id", "book").agg(F.max("chapter").alias("last"), F.map_from_entries(F.collect_list(F.struct("chapter", "n"))).alias("ns"))
    b = b.select("module_id", "book", F.struct(F.concat(F.lit("Book "), "book").alias("name"), F.concat(F.lit("b"), "book").alias("osis"), F.transform(F.sequence(F.lit(1), F.col("last")), lambda c: F.coalesce(F.try_element_at("ns", c), F.lit(0))).alias("chapters")).alias("b"))
    side = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("book", "b")))), lambda x: x["b"])
    at = f"{shared_dir(s)}/canon-{uuid.uuid4().hex}"
    b.groupBy("module_id").agg(side(F.col("book") <= 39).alias("ot_books"), side(F.col("book") > 39).alias("nt_books")).select(F.col("module_id").alias("id"), "ot_books", "nt_books").write.json(at)
    return canon.load_canon(s, at, lines=True)


@q(f"WITH c AS ({_OSIS_CANON}) SELECT system, testament, book, chapter, n_verses FROM c WHERE n_verses > 0")
def canon_loaded(s, d):
    return _canon_files(s, d).where("n_verses > 0").select("system", "testament", "book", "chapter", "n_verses")


@q(f"WITH c AS ({_OSIS_CANON}) SELECT system, testament, book, count(*) AS n_chapters, sum(n_verses)::BIGINT AS n_verses FROM c WHERE n_verses > 0 GROUP BY ROLLUP (system, testament, book)")
def canon_totals(s, d):
    """Verses per book, testament and system."""
    return canon.canon_totals(_canon_files(s, d).where("n_verses > 0"))


@q(f"""WITH c AS ({_OSIS_CANON}), n AS (SELECT *, rank() OVER (ORDER BY system) AS k FROM c WHERE n_verses > 0), a AS (SELECT * FROM n WHERE system = (SELECT min(system) FROM c)), b AS (SELECT * FROM n WHERE system = (SELECT max(system) FROM c))
SELECT coalesce(a.book, b.book) AS book, coalesce(a.chapter, b.chapter) AS chapter, a.n_verses AS n_a, b.n_verses AS n_b FROM a FULL JOIN b ON a.book = b.book AND a.chapter = b.chapter WHERE a.n_verses IS DISTINCT FROM b.n_verses""")
def canon_differences(s, d):
    """Chapters where the first and the last system by name differ; the last is found by an alias, whatever its case."""
    c = materialize(_canon_files(s, d).where("n_verses > 0"), "canon")
    first, last = c.agg(F.min("system"), F.max("system")).first()
    a, _ = canon.resolve_canon(c, str(first).upper())
    b, _ = canon.resolve_canon(c, "other", {"Other": last}, first)
    return canon.canon_diff(a.select("book", "chapter", "n_verses"), b.select("book", "chapter", "n_verses"))


# ---- references -----------------------------------------------------------------------------------------------------------

_PLACE = "SELECT row_id, book, chapter AS c, verse AS v FROM esword_bible WHERE chapter > 0 AND verse > 0 AND book BETWEEN 1 AND 66"
_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in refs.BOOK_NAMES) + "][book]"
_IDS_SQL = "[" + ", ".join(f"'{b}'" for b in refs.BOOKS) + "][book]"


@q(f"""WITH p AS ({_PLACE}) SELECT row_id, 'book' AS kind, {_IDS_SQL} AS book, NULL::INT AS chapter, NULL::INT AS verse, NULL::INT AS chapter_end, NULL::INT AS verse_end FROM p UNION ALL SELECT row_id, 'chapter', {_IDS_SQL}, c, NULL, NULL, NULL FROM p
UNION ALL SELECT row_id, 'chapters', {_IDS_SQL}, c, NULL, c + 2, NULL FROM p UNION ALL SELECT row_id, 'verse', {_IDS_SQL}, c, v, NULL, NULL FROM p UNION ALL SELECT row_id, 'verses', {_IDS_SQL}, c, v, NULL, v + 3 FROM p UNION ALL SELECT row_id, 'verses', {_IDS_SQL}, c, v, c + 1, 1 FROM p""")
def range_grammar(s, d):
    """Every verse's place written in all forms of the range grammar, with full names, file codes and ordinals, and read again."""
    p = rd(s, d, "esword_bible").where("chapter > 0 AND verse > 0 AND book BETWEEN 1 AND 66")
    name, code = F.array(*map(F.lit, refs.BOOK_NAMES))[F.col("book") - 1], F.array(*map(F.lit, refs.CODES))[F.col("book") - 1]
    roman = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^1 ", "I "), "^2 ", "II "), "^3 ", "III ")
    c, v = F.col("chapter").cast("string"), F.col("verse").cast("string")
    up = lambda x, n: (F.col(x) + n).cast("string")
    forms = F.array(name, F.concat(code, F.lit(" "), c), F.concat(roman, F.lit(" "), c, F.lit("-"), up("chapter", 2)), F.concat(F.lower(name), F.lit("  "), c, F.lit(":"), v), F.concat(name, F.lit(" "), c, F.lit("."), v, F.lit(" – "), up("verse", 3)), F.concat(F.upper(name), F.lit(". "), c, F.lit(":"), v, F.lit("-"), up("chapter", 1), F.lit(":1")))
    x = p.select("row_id", F.explode(forms).alias("t")).select("row_id", refs.parse_range(F.col("t")).alias("r"))
    return x.select("row_id", "r.kind", "r.book", "r.chapter", "r.verse", "r.chapter_end", "r.verse_end")


@q(f"WITH p AS ({_PLACE}) SELECT row_id, 0 AS pos, {_IDS_SQL} AS book, c AS chapter, v AS verse FROM p UNION ALL SELECT row_id, 1, 'Matt', 1, v FROM p")
def reference_lists(s, d):
    """Lists such as "cf. Genesis 1:2; see also Matt 1:2" with a part that is no reference."""
    p = rd(s, d, "esword_bible").where("chapter > 0 AND verse > 0 AND book BETWEEN 1 AND 66")
    name = F.array(*map(F.lit, refs.BOOK_NAMES))[F.col("book") - 1]
    at = F.concat(F.lit("cf. "), name, F.lit(" "), F.col("chapter"), F.lit(":"), F.col("verse"), F.lit("; 12 !; see also Matt 1:"), F.col("verse"))
    x = p.select("row_id", F.posexplode(refs.parse_list(at, refs.book_aliases())).alias("pos", "r"))
    return x.select("row_id", "pos", "r.book", "r.chapter", "r.verse")


@q("SELECT v.verse_uid, n.strongs AS key, n.key AS bare FROM (SELECT verse_uid, verse FROM verses WHERE verse > 0) v, LATERAL (SELECT 'H' || v.verse AS strongs, lpad(v.verse::VARCHAR, 5, '0') AS key) n")
def strongs_keys(s, d):
    """Lexicon keys of several spellings as Strong's numbers, and the padded form a lexicon stores."""
    v = rd(s, d, "verses").where("verse > 0").select("verse_uid", F.concat(F.lit(" h0"), "verse").alias("k"), F.lpad(F.col("verse").cast("string"), 5, "0").alias("bare"))
    return v.select("verse_uid", text.strongs_key("k", F.lit("grc")).alias("key"), "bare")


@q("SELECT DISTINCT verse::VARCHAR AS asked, lpad(verse::VARCHAR, 5, '0') AS lex_key, 'entry ' || verse AS entry FROM verses WHERE verse > 0 AND verse % 2 = 0 UNION ALL SELECT DISTINCT 'H' || verse, verse::VARCHAR, 'bare ' || verse FROM verses WHERE verse > 0 AND verse % 2 = 1")
def strongs_cascade(s, d):
    """Keys looked up as they are, then without their letter, then padded."""
    n = rd(s, d, "verses").where("verse > 0").select("verse").distinct()
    v = F.col("verse").cast("string")
    even = F.col("verse") % 2 == 0
    keys = n.select(F.when(even, v).otherwise(F.concat(F.lit("H"), v)).alias("k"))
    lexicon = n.select(F.when(even, F.lpad(v, 5, "0")).otherwise(v).alias("lex_key"), F.concat(F.when(even, "entry ").otherwise("bare "), v).alias("entry"))
    return search.lookup_cascade(keys, lexicon, "k").select("asked", "lex_key", "entry")


_W = "'<w lemma=\"strong:G' || verse || ' lemma:x\" morph=''N-NSF''>' || 'word' || '</w> and <w>plain</w>'"


@q(f"SELECT verse_uid, verse % 3 = 1 AS hit FROM verses WHERE verse > 0 AND contains({_W}, 'strong:G')")
def strongs_search(s, d):
    """Word elements with Strong's numbers taken apart and searched for three numbers, whatever the case."""
    w = F.concat(F.lit('<w lemma="strong:G'), F.col("verse") % 3, F.lit(" lemma:x\" morph='N-NSF'>word</w> and <w>plain</w>"))
    v = rd(s, d, "verses").where("verse > 0").select("verse_uid", text.word_elements(w).alias("words"))
    return v.select("verse_uid", search.strongs_matches(F.col("words"), "g1").alias("hit"))


@q("SELECT doc_id, title FROM documents WHERE contains(lower(title), 'ar')")
def key_contains(s, d):
    return search.key_contains(rd(s, d, "documents").select("doc_id", "title"), "title", "AR")


@q("SELECT count(*) FILTER (WHERE module_type = 'DICTIONARY' AND contains(lower(concat_ws(' ', title, source)), 'zld')) AS n_shown, count(*) AS n_all FROM documents")
def catalogue_counts(s, d):
    return search.catalogue_counts(rd(s, d, "documents"), "ZLD", ["title", "source"], module_type="DICTIONARY", lang="all")


@q("""WITH h AS (SELECT 'blocks' AS corpus, 0 AS c, block_uid AS id FROM blocks WHERE contains(lower(text), 'lantern') UNION ALL SELECT 'verses', 1, verse_uid FROM verses WHERE contains(lower(text), 'lantern') UNION ALL SELECT 'documents', 2, doc_id FROM documents WHERE contains(lower(text), 'lantern'))
SELECT corpus, id::VARCHAR AS id, (SELECT count(*) FROM h)::INT AS n_total FROM h ORDER BY c, h.id LIMIT 100""")
def search_limited(s, d):
    """The first hundred hits over three corpora, and the exact number of all."""
    sides = [("blocks", "block_uid"), ("verses", "verse_uid"), ("documents", "doc_id")]
    return search.limited_hits({t: rd(s, d, t).where(search.text_matches(F.col("text"), "lantern")).select(F.col(k).alias("id")) for t, k in sides}, 100)


# ---- markup ---------------------------------------------------------------------------------------------------------------

_MARKED = "coalesce(text, '') || ' <note type=\"x\">first ' || verse_uid || '</note>é<reference osisRef=\"Gen.1.1\">a</reference> <reference>b ' || verse_uid || '</reference>'"


@q(f"""WITH t AS (SELECT verse_uid, strlen(coalesce(text, '')) AS n, strlen(verse_uid::VARCHAR) AS k FROM verses)
SELECT verse_uid, 'FOOTNOTE' AS kind, 'first ' || verse_uid AS text, (n + 1)::INT AS at FROM t UNION ALL SELECT verse_uid, 'CROSS_REF', 'Gen.1.1', (n + 1 + 15 + 6 + k + 7 + 2)::INT FROM t
UNION ALL SELECT verse_uid, 'CROSS_REF', 'b ' || verse_uid, (n + 1 + 15 + 6 + k + 7 + 2 + 29 + 13 + 1)::INT FROM t""")
def placed_notes(s, d):
    """Notes and references behind every verse, with the byte each begins at."""
    at = F.concat(F.coalesce("text", F.lit("")), F.lit(' <note type="x">first '), "verse_uid", F.lit('</note>é<reference osisRef="Gen.1.1">a</reference> <reference>b '), "verse_uid", F.lit("</reference>"))
    return rd(s, d, "verses").select("verse_uid", F.explode(text.placed_notes(at)).alias("n")).select("verse_uid", "n.*")


@q("""SELECT doc_id, 'start' AS kind, 'versification: chapter ' || osis_ref || ' begins here in source' AS message FROM documents WHERE osis_ref IS NOT NULL UNION ALL SELECT doc_id, 'end', 'versification: chapter ' || osis_ref || ' ends here in source' FROM documents WHERE osis_ref IS NOT NULL
UNION ALL SELECT doc_id, 'container', 'versification: structural marker only' FROM documents WHERE osis_ref IS NOT NULL UNION ALL SELECT doc_id, 'text', '' FROM documents WHERE osis_ref IS NOT NULL""")
def versification_messages(s, d):
    x = rd(s, d, "documents").where("osis_ref IS NOT NULL")
    mark = lambda a, b: F.concat(F.lit(f'<chapter osisID="'), "osis_ref", F.lit(f'"{a}/>{b}'))  # noqa: E731, F541
    kinds = [("start", ' sID="c1"', " "), ("end", ' eID="c1"', ""), ("container", "", ""), ("text", ' sID="c1"', "In the beginning")]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), text.versification_message(mark(a, b)).alias("message")) for k, a, b in kinds])
    return x.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def _md_sql(rules: list[tuple[str, str]], x: str) -> str:
    """The rules of functions.text as nested SQL replacements."""
    for a, b in rules:
        a, b = a.replace("'", "''"), b.replace("$1", "\\1").replace("'", "''")
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), e' \\t\\n\\r\\f\\v')"


@q(f"SELECT doc_id, {_md_sql(text.OSIS_RULES, 'text')} AS osis, {_md_sql(text.THML_RULES, 'text')} AS thml, {_md_sql(text.GBF_RULES, 'text')} AS gbf FROM documents")
def markup_to_markdown(s, d):
    return rd(s, d, "documents").select("doc_id", text.osis_to_markdown("text").alias("osis"), text.thml_to_markdown("text").alias("thml"), text.gbf_to_markdown("text").alias("gbf"))


@q("SELECT doc_id, title AS headword, 'noun' AS pos, '**' || title || '** *noun* [from ' || lang || '] 1. first 2. second See: other' AS markdown FROM documents WHERE regexp_matches(title, '^\\w+$') AND regexp_matches(lang, '^\\w+$')")
def tei_entries(s, d):
    """Dictionary entries built of titles, taken apart and written as Markdown."""
    x = rd(s, d, "documents").where(F.col("title").rlike(r"^\w+\z") & F.col("lang").rlike(r"^\w+\z"))
    e = F.concat(F.lit("<entryFree><form><orth>"), "title", F.lit("</orth></form><pos>noun</pos><etym>from "), "lang", F.lit("</etym><def>first</def><def n='2'>second</def><ref>other</ref></entryFree>"))
    t = text.tei_entry(e)
    return x.select("doc_id", t["headword"].alias("headword"), t["pos"].alias("pos"), text.tei_to_markdown(e).alias("markdown"))


@q("""SELECT verse_uid, coalesce(id, '') AS id, coalesce(text, '') AS text, true AS ok, false AS cut_ok FROM verses""")
def xml_documents(s, d):
    """Verses wrapped as XML: both attributes and text found again by XPath; whole documents are well-formed, cut ones are not."""
    xml = F.concat(F.lit('<v id="'), text.escape_xml(F.coalesce("id", F.lit(""))), F.lit('"><t>'), text.escape_xml(F.coalesce("text", F.lit(""))), F.lit("</t></v>"))
    v = rd(s, d, "verses").withColumn("xml", xml)
    cut = F.substring("xml", F.lit(1), F.length("xml") - 4)
    return v.select("verse_uid", xmltools.xpath_first(F.col("xml"), "/v/@id").alias("id"), xmltools.xpath_first(F.col("xml"), "/v/t").alias("text"), xmltools.well_formed(F.col("xml")).alias("ok"), xmltools.well_formed(cut).alias("cut_ok"))


@q("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;'), '''', '&#39;') AS html, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS content,
replace(replace(replace(regexp_replace(replace(text, '\\', chr(1)), '([&%$#_{}])', '\\\\\\1', 'g'), '~', '\\textasciitilde{}'), '^', '\\textasciicircum{}'), chr(1), '\\textbackslash{}') AS latex FROM documents""")
def escapes(s, d):
    return rd(s, d, "documents").select("doc_id", text.escape_html("text").alias("html"), text.escape_xml_text("text").alias("content"), text.escape_latex("text").alias("latex"))


@q("SELECT source, regexp_matches(v, '^1\\.(2|[3-9])') AS newer, regexp_matches(v, '^1\\.2\\.') AS same_minor, v FROM (SELECT source, '1.' || (length(source) % 4) || '.' || doc_id AS v FROM documents)")
def version_filters(s, d):
    x = rd(s, d, "documents").select("source", F.concat(F.lit("v1."), F.length("source") % 4, F.lit("."), "doc_id", F.lit("-rc1")).alias("w"), F.concat(F.lit("1."), F.length("source") % 4, F.lit("."), "doc_id").alias("v"))
    return x.select("source", F.coalesce(text.version_matches("w", ">=1.2"), F.lit(False)).alias("newer"), F.coalesce(text.version_matches("w", "~1.2"), F.lit(False)).alias("same_minor"), "v").na.drop(subset=["source", "v"])


@q("SELECT doc_id, coalesce(source, '') AS a, coalesce(source, '') || '.osis' AS b FROM documents")
def archive_names(s, d):
    x = rd(s, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("n"))
    return x.select("doc_id", text.trim_archive_suffix(F.concat("n", F.lit(".osis.TAR.gz")), "osis").alias("a"), text.trim_archive_suffix(F.concat("n", F.lit(".osis.zip"))).alias("b"))


@q("SELECT verse_uid, 0 AS pos, 'Genesis ' || chapter || ':' || verse AS ref, 'first words here.' AS text FROM verses WHERE chapter > 0 AND verse > 0 UNION ALL SELECT verse_uid, 1, '1 Samuel ' || verse || ':' || chapter, 'more of them.' FROM verses WHERE chapter > 0 AND verse > 0")
def rendered_output(s, d):
    """Output of a rendering tool, with a placeholder and an attribution that are dropped."""
    v = rd(s, d, "verses").where("chapter > 0 AND verse > 0")
    out = F.concat(F.lit("Genesis "), "chapter", F.lit(":"), "verse", F.lit(": first  words\nhere. 1 Samuel "), "verse", F.lit(":"), "chapter", F.lit(": more of them. Exodus 1:1: - (Some Translation)"))
    return v.select("verse_uid", F.posexplode(text.rendered_verses(out)).alias("pos", "r")).select("verse_uid", "pos", "r.ref", "r.text")


@q("""WITH m AS (SELECT DISTINCT source AS module, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL UNION ALL SELECT 'KJV', 'en' UNION ALL SELECT 'SBLGNT', 'grc' UNION ALL SELECT 'LXX', 'grc')
SELECT module, lang, array_to_string(list_sort(list_distinct(list_filter([CASE lang WHEN 'en' THEN 'English' WHEN 'la' THEN 'Latin' WHEN 'grc' THEN 'Greek' WHEN 'he' THEN 'Hebrew' END, CASE WHEN lower(module) NOT IN ('sblgnt', 'oeb') THEN 'Old Testament' END, CASE WHEN lower(module) NOT IN ('osmhb', 'lxx') THEN 'New Testament' END,
CASE WHEN module = 'LXX' THEN 'Orthodox Canon' END, CASE WHEN module = 'LXX' THEN 'Septuagint' END, CASE WHEN module <> 'LXX' THEN 'Protestant Canon' END, CASE WHEN lower(module) = 'sblgnt' THEN 'Critical Text' END, 'Public Domain', CASE WHEN lower(module) IN ('kjv', 'lxx') THEN 'Historical Translation' END,
CASE WHEN lower(module) = 'sblgnt' THEN 'Modern Translation' END, CASE WHEN module = 'KJV' THEN 'Strong''s Numbers' END], lambda x: x IS NOT NULL))), ', ') AS tags FROM m""")
def bible_tags(s, d):
    m = rd(s, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.col("source").alias("module"), "lang").distinct()
    m = m.unionByName(s.createDataFrame([("KJV", "en"), ("SBLGNT", "grc"), ("LXX", "grc")], "module string, lang string"))
    about = F.when(F.col("module") == "KJV", "With Strong's numbers").otherwise("Text")
    return m.select("module", "lang", F.array_join(text.module_tags("module", "lang", F.when(F.col("module") == "LXX", "LXX").otherwise("KJV"), F.lit("Public Domain text"), about), ", ").alias("tags"))


# ---- catalogues, caches, differences --------------------------------------------------------------------------------------


@q("SELECT plugin_kind AS kind, count(DISTINCT plugin_id) AS n_plugins, array_to_string(list_sort(list(DISTINCT plugin_id) FILTER (WHERE plugin_id IS NOT NULL)), ', ') AS plugins FROM runs GROUP BY plugin_kind")
def plugins_by_kind(s, d):
    return catalogue.plugins_by_kind(rd(s, d, "runs"), "plugin_kind", "plugin_id")


@q("""WITH p AS (SELECT plugin_id, 'L' || max(CASE run_status WHEN 'success' THEN 0 WHEN 'running' THEN 1 WHEN 'failed' THEN 4 ELSE 2 END) AS loss_class FROM runs WHERE plugin_id IS NOT NULL AND engine_id IS NOT NULL GROUP BY plugin_id)
SELECT loss_class, count(*) AS n_plugins, array_to_string(list_sort(list(plugin_id)), ', ') AS plugins FROM p GROUP BY loss_class""")
def plugins_by_loss(s, d):
    """Run states read as loss classes."""
    st = F.col("run_status")
    r = rd(s, d, "runs").where("engine_id IS NOT NULL").withColumn("loss", F.when(st == "success", "L0").when(st == "running", "L1").when(st == "failed", "L4").otherwise("L2"))
    return catalogue.plugins_by_loss(r, "plugin_id", "loss")


@q("""WITH c AS (SELECT source AS module, min(doc_id)::VARCHAR AS version FROM documents WHERE source IS NOT NULL GROUP BY source), w AS (SELECT min(module) AS a, max(module) AS b FROM c)
SELECT c.module, c.version, CASE WHEN c.module = w.a THEN 'yes' ELSE 'no' END AS installed, CASE WHEN c.module = w.a THEN 'ok' END AS status, CASE WHEN c.module = w.a THEN (SELECT count(*) FROM documents d WHERE d.source = c.module) END AS n_files FROM c, w""")
def catalogue_life_cycle(s, d):
    """Two modules installed, one removed again, the rest verified against the documents there are."""
    docs = rd(s, d, "documents").where("source IS NOT NULL")
    c = docs.groupBy(F.col("source").alias("module")).agg(F.min("doc_id").cast("string").alias("version"))
    first, last = c.agg(F.min("module"), F.max("module")).first()
    have = catalogue.install(c, c.limit(0), [first, last, "no such module"])
    have = catalogue.uninstall(have, [last]) if first != last else have
    checked = catalogue.verify(have, docs.select(F.col("source").alias("module"), F.length("title").alias("length"))).select("module", "n_files", F.when(F.col("status") != "missing", "ok").alias("status"))
    return catalogue.available(c, have).join(checked, "module", "left").select("module", "version", "installed", "status", "n_files")


@q("SELECT 2 AS size, 2 AS capacity, 3 AS hits, 4 AS misses, 2 AS evictions, 0.428571::DOUBLE AS hit_rate")
def cache_statistics(s, d):
    c = cache.TableCache(2)
    for name in ("books", "runs", "books", "books", "blobs", "books", "runs"):
        c.get(name, lambda n=name: rd(s, d, n))
    out = c.stats(s)
    c.clear()
    return out


@q("""WITH p AS (SELECT a.ir_row_id AS id_a, b.ir_row_id AS id_b, string_split(replace(coalesce(a.text, ''), ' ', chr(10)), chr(10)) AS a, string_split(replace(coalesce(b.text, ''), ' ', chr(10)), chr(10)) AS b FROM compare_ir c JOIN ir_blocks a ON a.ir_key = c.ir_a_key JOIN ir_blocks b ON b.ir_key = c.ir_b_key AND b.doc_id = a.doc_id AND b.block_id = a.block_id GROUP BY ALL),
l AS (SELECT id_a, id_b, unnest(generate_series(1, greatest(len(a), len(b)))) AS line, a, b FROM p), x AS (SELECT id_a, id_b, line, coalesce(a[line], '') AS old, coalesce(b[line], '') AS new FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY id_a, id_b ORDER BY line) AS k, count(*) OVER (PARTITION BY id_a, id_b) AS n FROM x WHERE old <> new)
SELECT id_a, id_b, line::INT AS line, CASE WHEN old = '' THEN 'added' WHEN new = '' THEN 'removed' ELSE 'changed' END AS kind, old, new, greatest(n - 3, 0)::INT AS more FROM f WHERE k <= 3""")
def line_diff_truncated(s, d):
    """Differences of compared blocks, a word a line: the first three, and how many more there are."""
    from folioform.queries_corpus import _ir_pairs

    lines = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("\n"))
    p = _ir_pairs(s, d).select("id_a", "id_b", align.truncated_diff(align.line_diff(lines(F.col("ta")), lines(F.col("tb"))), 3).alias("t"))
    return p.select("id_a", "id_b", "t.more", F.explode("t.shown").alias("x")).select("id_a", "id_b", "x.line", "x.kind", "x.old", "x.new", "more")


@q("SELECT doc_id, sha256(string_agg(h, '' ORDER BY seq NULLS FIRST, block_id NULLS FIRST, h)) AS digest FROM (SELECT doc_id, seq, block_id, sha256('{' || concat_ws(',', '\"block_id\":' || to_json(block_id), '\"seq\":' || seq, '\"osis_id\":' || to_json(osis_id), '\"token_count\":' || token_count) || '}') AS h FROM ir_blocks) GROUP BY doc_id")
def canonical_hashes(s, d):
    """Hashes of documents over the canonical JSON of their blocks."""
    return ir_json.canonical_hash(rd(s, d, "ir_blocks"), ["doc_id"], ["block_id", "seq", "osis_id", "token_count"], ["seq", "block_id"])


@q("SELECT l_orderkey AS chain, arg_min(l_returnflag, k) AS source, arg_max(l_linestatus, k) AS target, 'L' || max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END) AS loss_class, count(*) AS n_lost FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem) GROUP BY l_orderkey")
def loss_of_chains(s, d):
    """Order lines read as the reports of conversion chains, each step losing one element."""
    from pyspark.sql import Window

    c = F.when(F.col("l_returnflag") == "A", "L0").when(F.col("l_returnflag") == "N", "L2").otherwise("L4")
    step = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    r = rd(s, d, "lineitem").select(F.col("l_orderkey").alias("chain"), step.alias("step"), F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target"), c.alias("loss_class"), F.array(F.col("l_partkey").cast("string")).alias("lost"))
    return validate.combined_loss(r, ["chain"]).select("chain", "source", "target", "loss_class", F.size("lost").cast("bigint").alias("n_lost"))


@q("""WITH r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 3 END AS lv FROM orders), n AS (SELECT l_orderkey AS id, count(*) AS k FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) SELECT r.id, r.lv <= 1 AND coalesce(n.k, 0) <= 3 AS passed FROM r LEFT JOIN n USING (id)""")
def loss_budgets(s, d):
    """Orders read as loss reports, their lines as lost elements, of which flag A is allowed."""
    c = F.when(F.col("o_orderstatus") == "F", "L1").when(F.col("o_orderstatus") == "O", "L0").otherwise("L3")
    lost = rd(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("element_type"))
    return validate.within_budget(rd(s, d, "orders").select(F.col("o_orderkey").alias("id"), c.alias("loss_class")), lost, "id", "L1", 3, ["A"])


# ---- stores, archives, self-checks ----------------------------------------------------------------------------------------


def _files(s: SparkSession, d: str, fmt: str = "json") -> DataFrame:
    """The verses as one file per module."""
    from folioform.queries_formats import all_named

    return materialize(registry.emit(all_named(s, d), fmt), "files")


@q("SELECT count(DISTINCT module_id)::INT AS stored, 0 AS again, count(DISTINCT module_id) AS ok, 1::BIGINT AS missing FROM verses WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def blob_store(s, d):
    """Files ingested twice: stored once, found again by their hashes, one artifact without a blob."""
    files = _files(s, d)
    store = f"{shared_dir(s)}/store-{uuid.uuid4().hex}"
    n, again = (registry.put_blobs(store, registry.as_blobs(files)) for _ in range(2))
    arts = files.select(F.col("name").alias("artifact_id"), "sha256").unionByName(s.createDataFrame([("lost", "0" * 64)], "artifact_id string, sha256 string"))
    status = registry.verify_artifacts(arts, s.read.schema(registry.BLOB).parquet(store))
    return status.agg(F.count(F.when(F.col("status") == "ok", 1)).alias("ok"), F.count(F.when(F.col("status") == "missing", 1)).alias("missing")).select(F.lit(n).alias("stored"), F.lit(again).alias("again"), "ok", "missing")


@q("SELECT module_id AS corpus, kind, true AS same FROM (SELECT DISTINCT module_id FROM verses WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''), (VALUES ('zip'), ('xz'), ('gz'), ('tar')) k(kind)")
def archives(s, d):
    """Every file packed in four kinds of archives and read from them again."""
    files = _files(s, d)
    packed = registry.pack_files(files, ["zip", "xz", "gz", "tar"])
    found = registry.archive_entries(packed.select(F.concat_ws("|", "name", "kind").alias("path"), "content")).where("NOT is_dir").select("archive", F.sha2("content", 256).alias("digest"))
    j = found.select(F.split("archive", r"\|")[0].alias("name"), F.split("archive", r"\|")[1].alias("kind"), "digest").join(files.select("name", "sha256"), "name")
    return j.select(F.regexp_replace("name", r"\.json$", "").alias("corpus"), "kind", (F.col("digest") == F.col("sha256")).alias("same"))


@q("SELECT source AS module, upper(substr(source, 1, 1)) AS letter, 2 AS n_features FROM (SELECT DISTINCT source FROM documents WHERE regexp_matches(source, '^[A-Za-z0-9-]+$'))")
def module_catalogue(s, d):
    """Configuration files of modules, packed, listed and read as a catalogue."""
    m = rd(s, d, "documents").select("source").distinct().where(F.col("source").rlike(r"^[A-Za-z0-9-]+\z"))
    conf = F.concat(F.lit("["), "source", F.lit("]\nDescription=about \\\n more\nLetter="), F.upper(F.substring("source", 1, 1)), F.lit("\nFeature=A\nFeature=B\n"))
    entries = m.select(F.concat(F.lit("mods.d/"), "source", F.lit(".conf")).alias("name"), F.encode(conf, "UTF-8").alias("content"))
    got = registry.modules(registry.archive_entries(registry.pack_files(entries, ["gz"]).select(F.col("name").alias("path"), "content")))
    return got.select("module", F.col("conf")["Letter"][0].alias("letter"), F.size("features").alias("n_features"))


@q("SELECT count(*) FILTER (WHERE kind <> 'application/octet-stream') AS n_known, any_value(kind) AS kind, any_value('json') AS format FROM (SELECT DISTINCT module_id, 'application/json' AS kind FROM verses WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '')")
def file_catalogue(s, d):
    """Formats and content types of stored files, found from their contents."""
    at = f"{shared_dir(s)}/files-{uuid.uuid4().hex}"
    registry.save(_files(s, d), at)
    return registry.catalogue(registry.files(s, at)).agg(F.count(F.when(F.col("kind") != "application/octet-stream", 1)).alias("n_known"), F.max("kind").alias("kind"), F.max("format").alias("format"))


_SELF = [("identity-bytes", "step", "EXPORT", "pass"), ("identity-bytes", "check", "BYTE_EQUAL", "pass"), ("behaviour-identity", "check", "TRANSCRIPT_EQUAL", "pass"), ("fidelity", "check", "IR_FIDELITY", "pass"), ("changed", "check", "TRANSCRIPT_EQUAL", "fail"), ("changed", "check", "BYTE_EQUAL", "fail"), ("changed", "check", "IR_FIDELITY", "fail"), ("changed", "check", "NO_SUCH_TYPE", "fail: NO_SUCH_TYPE is not known"), ("compare", "step", "COMPARE_IR", "pass"), ("compare", "check", "IR_STRUCTURE_EQUAL", "pass")]


@q("SELECT * FROM " + _VAL(_SELF) + " r(plan, kind, type, status)")
def self_checks(s, d):
    """The canned plans over stored files and logs, and one whose checks must fail."""
    files = _files(s, d)
    log = rd(s, d, "events").select(F.col("event_id").alias("seq"), "event_type", "user_id")
    ir = rd(s, d, "blocks").select("corpus_id", F.lit("L1").alias("loss_class"))
    v = rd(s, d, "verses").groupBy(F.col("module_id").alias("doc_id"), "chapter", "verse").agg(F.count("*").alias("n"))
    tables = {"files": files, "run_a": log, "run_b": log.repartition(3), "ir": ir, "log2": log.where("seq > 1"), "files2": files.withColumn("content", F.concat("content", F.encode(F.lit(" "), "UTF-8"))), "v": v, "none": v.limit(0).select("doc_id", "chapter", "verse", F.lit("x").alias("diff")).where("false")}
    changed = {"id": "changed", "checks": [{"type": "TRANSCRIPT_EQUAL", "a": "run_a", "b": "log2"}, {"type": "BYTE_EQUAL", "a": "files", "b": "files2"}, {"type": "IR_FIDELITY", "ir": "ir", "max_loss_class": "L0"}, {"type": "NO_SUCH_TYPE"}]}
    same = {"id": "compare", "steps": [{"type": "COMPARE_IR", "a": "v", "b": "v", "fields": ["n"], "output": "diff"}], "checks": [{"type": "IR_STRUCTURE_EQUAL", "a": "diff", "b": "none"}]}
    rows = [(p["id"], r["kind"], r["type"], r["status"]) for p in (selfcheck.IDENTITY, selfcheck.BEHAVIOUR, selfcheck.FIDELITY, changed, same) for r in validate.run_plan(p, tables, selfcheck._steps("json"))[1]]
    return s.createDataFrame(rows, "plan string, kind string, type string, status string")


@q("SELECT json_object('id', id, 'n', n)::VARCHAR AS json FROM (SELECT id, count(*) AS n FROM books GROUP BY id)")
def sql_profile(s, d):
    """A query over a named table as JSON rows."""
    name = f"books_{uuid.uuid4().hex}"
    rd(s, d, "books").createOrReplaceTempView(name)
    out = sqltool.query_json(s, f"SELECT id, count(*) AS n FROM {name} GROUP BY id")
    return out.select("json")


@q("WITH RECURSIVE t AS (SELECT c_custkey AS node, '' AS path FROM customer WHERE c_custkey = 1 UNION ALL SELECT c.c_custkey, t.path || '/' || c.c_name FROM customer c JOIN t ON c.c_custkey // 2 = t.node AND c.c_custkey > 1) SELECT node, path FROM t")
def tree_paths(s, d):
    """Customers as a binary tree by number, with the path of each from the first."""
    c = rd(s, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") == 1, -1).otherwise(F.floor(F.col("c_custkey") / 2)).alias("parent"), F.col("c_name").alias("name"))
    return registry.tree_paths(c)


@q("SELECT verse_uid, count(*) AS n_words, sum(n)::BIGINT AS n FROM (SELECT verse_uid, word, count(*) AS n FROM (SELECT verse_uid, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}'']+')) AS word FROM verses) GROUP BY ALL) GROUP BY verse_uid")
def word_counts(s, d):
    """The reader's words counted per verse."""
    return tokens.word_counts(rd(s, d, "verses"), ["verse_uid"], "text").groupBy("verse_uid").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))


@q("SELECT target, loss_class, lost, (SELECT count(DISTINCT module_id) FROM verses WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') AS n_files FROM (VALUES ('osis', 'L0', ''), ('rtf', 'L2', 'write rtf'), ('txt', 'L3', 'write txt')) t(target, loss_class, lost)")
def derived_exports(s, d):
    """Stored files converted to three formats, with the loss of reading and writing together."""
    base, out = f"{shared_dir(s)}/export-{uuid.uuid4().hex}", None
    registry.save(_files(s, d), f"{base}/in")
    for to in ("osis", "rtf", "txt"):
        r = convert.derived_export(s, f"{base}/in", to, f"{base}/{to}", "json")
        part = r.groupBy("target", "loss_class", F.array_join("lost", ", ").alias("lost")).agg(F.count("*").alias("n_files"))
        out = part if out is None else out.unionByName(part)
    return out
