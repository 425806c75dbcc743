"""Driver queries of the corpus operators, each with its SQL twin, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioform.functions import refs, text
from folioform.operators import align, canon, search, tokens, validate
from folioform.schema import BOOKS
from folioform.session import broadcast_if_small
from folioform.session import read_table as rd
from folioform.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- filters, search, lookups --------------------------------------------------------------------------------------------


@q("SELECT doc_id, source, lang FROM documents WHERE contains(lower(text), 'the road') ORDER BY doc_id LIMIT 100")
def search_substring_topn(s, d):
    return search.first_hits(rd(s, d, "documents").select("doc_id", "source", "lang", "text"), search.text_matches(F.col("text"), "The Road"), ["doc_id"], 100).drop("text")


@q("SELECT source, count(*) AS n_hits FROM documents WHERE contains(lower(text), 'über') GROUP BY source")
def search_total_by_source(s, d):
    return search.hit_counts(rd(s, d, "documents"), search.text_matches(F.col("text"), "über"), ["source"])


@q("SELECT 'documents' AS corpus, doc_id AS id FROM documents WHERE contains(lower(text), 'lantern') UNION ALL SELECT 'blocks', block_uid FROM blocks WHERE contains(lower(text), 'lantern') UNION ALL SELECT 'verses', verse_uid FROM verses WHERE contains(lower(text), 'lantern')")
def search_multi_corpus_union(s, d):
    sides = [("documents", "doc_id"), ("blocks", "block_uid"), ("verses", "verse_uid")]
    hits = [rd(s, d, t).where(search.text_matches(F.col("text"), "lantern")).select(F.lit(t).alias("corpus"), F.col(k).alias("id")) for t, k in sides]
    return hits[0].unionByName(hits[1]).unionByName(hits[2])


@q("SELECT count(*) AS n_hits FROM verses WHERE contains(lower(text), 'the days')")
def phrase_quote_normalize(s, d):
    return rd(s, d, "verses").where(search.text_matches(F.col("text"), '"the days"')).agg(F.count("*").alias("n_hits"))


@q("SELECT row_id, scripture FROM esword_bible WHERE book = 1 AND chapter = 1 AND verse = 1")
def point_lookup(s, d):
    return search.point(rd(s, d, "esword_bible"), book=1, chapter=1, verse=1).select("row_id", "scripture")


@q("SELECT module_id, verse, scripture, row_number() OVER (ORDER BY module_id, verse, row_id) AS pos FROM esword_bible WHERE book = 1 AND chapter = 2")
def chapter_scan(s, d):
    w = Window.orderBy("module_id", "verse", "row_id")  # one chapter
    return search.point(rd(s, d, "esword_bible"), book=1, chapter=2).select("module_id", "verse", "scripture", F.row_number().over(w).alias("pos"))


@q("SELECT book, count(*) AS n_verses, max(chapter) AS last_chapter FROM esword_bible WHERE book = 12 GROUP BY book")
def book_scan(s, d):
    return search.point(rd(s, d, "esword_bible"), book=12).groupBy("book").agg(F.count("*").alias("n_verses"), F.max("chapter").alias("last_chapter"))


@q("SELECT id, book_name FROM books WHERE lower(id) = 'vosh'")
def ci_lookup(s, d):
    return rd(s, d, "books").where(search.same_key(F.col("id"), "VOSH")).select("id", "book_name")


@q("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 's%'")
def ilike_prefix(s, d):
    return rd(s, d, "part").where(search.like(F.col("p_name"), "S%")).select("p_partkey", "p_name")


@q("SELECT DISTINCT corpus_id FROM blocks WHERE starts_with(corpus_id, 'OLD')")
def key_prefix(s, d):
    return rd(s, d, "blocks").where(F.col("corpus_id").startswith("OLD")).select("corpus_id").distinct()


@q("SELECT p_partkey FROM part WHERE p_brand = 'Brand#13'")
def facet_filter(s, d):
    return search.facet_filter(rd(s, d, "part"), p_brand="Brand#13", p_type="all").select("p_partkey")


@q("SELECT doc_id, title FROM documents WHERE module_type = 'COMMENTARY' AND contains(lower(concat_ws(' ', title, source, lang)), 'vosh')")
def catalogue_filter(s, d):
    return search.catalogue_filter(rd(s, d, "documents"), "Vosh", ["title", "source", "lang"], module_type="COMMENTARY", lang="all").select("doc_id", "title")


@q("SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def facet_languages(s, d):
    return search.facet_values(rd(s, d, "documents"), "lang")


@q("SELECT lang AS value FROM documents WHERE lang IS NOT NULL UNION SELECT lang FROM blocks WHERE lang IS NOT NULL")
def facet_union(s, d):
    a, b = (search.facet_values(rd(s, d, t), "lang").select("value") for t in ("documents", "blocks"))
    return a.union(b).distinct()


@q("SELECT DISTINCT module_type, upper(substr(title, 1, 1)) AS letter FROM documents WHERE length(title) > 0")
def letter_index(s, d):
    return search.letter_index(rd(s, d, "documents"), "title", ["module_type"])


@q("WITH n AS (SELECT ceil(count(*) / 11.0)::INT AS pages FROM part) SELECT p_partkey, p_name, least(3, pages) AS page_no, pages AS n_pages FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS rn FROM part), n WHERE rn BETWEEN (least(3, pages) - 1) * 11 + 1 AND least(3, pages) * 11")
def page_slice(s, d):
    return search.page(rd(s, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 3, 11)


@q("SELECT count(*) FILTER (WHERE strlen(trim(text, e' \\t\\n\\r')) < 5 OR regexp_matches(trim(text, e' \\t\\n\\r'), '^(?:[1-4]\\s+|I{1,3}V?\\s+)?[A-Za-z]+(?:\\s+(?:of\\s+)?[A-Za-z]+)*\\s+\\d+:\\d+:?$')) AS n_short, count(*) AS n FROM blocks WHERE text IS NOT NULL")
def placeholder_filter(s, d):
    return rd(s, d, "blocks").where("text IS NOT NULL").agg(F.count(F.when(text.is_placeholder("text"), 1)).alias("n_short"), F.count("*").alias("n"))


@q("SELECT lang, count(*) AS n FROM documents WHERE contains(text, '<') AND trim(regexp_replace(text, '<[^>]*>?', '', 'g'), e' \\t\\n\\r') <> '' GROUP BY lang")
def skip_markup_only(s, d):
    return rd(s, d, "documents").where(F.contains("text", F.lit("<"))).where(text.strip_markup("text") != "").groupBy("lang").agg(F.count("*").alias("n"))


@q("SELECT corpus_id, count(*) AS n FROM blocks WHERE (verse_ref).chapter = 3 AND (verse_ref).verse BETWEEN 2 AND 9 AND (verse_ref).book = 'Vosh' GROUP BY corpus_id")
def ref_containment(s, d):
    ref = lambda b, c, v, ve: F.struct(F.lit(b).alias("book"), F.lit(c).alias("chapter"), F.lit(v).alias("verse"), F.lit(0).alias("chapter_end"), F.lit(ve).alias("verse_end"))
    return rd(s, d, "blocks").where(refs.contains(ref("Vosh", 3, 2, 9), F.col("verse_ref"))).groupBy("corpus_id").agg(F.count("*").alias("n"))


@q("SELECT verse_uid FROM verses WHERE book = 'Keth' AND (chapter > 3 OR chapter = 3 AND verse >= 5) AND (chapter < 7 OR chapter = 7 AND verse <= 2)")
def ref_range(s, d):
    v = rd(s, d, "verses")
    end = lambda c, x: F.struct(F.lit("Keth").alias("book"), F.lit(c).alias("chapter"), F.lit(x).alias("verse"))
    return v.where(refs.in_range(F.col("book"), F.col("chapter"), F.col("verse"), end(3, 5), end(7, 2))).select("verse_uid")


@q("SELECT CASE WHEN book_order > 39 THEN 'NT' ELSE 'OT' END AS testament, count(*) AS n FROM books GROUP BY ALL")
def testament_split(s, d):
    return rd(s, d, "books").groupBy(F.when(F.col("book_order") > 39, "NT").otherwise("OT").alias("testament")).agg(F.count("*").alias("n"))


_BLOCK_RULES = """SELECT path, message, count(*) AS n FROM (
SELECT 'id' AS path, 'required' AS message FROM blocks WHERE block_id IS NULL OR block_id = '' UNION ALL
SELECT 'sequence', 'negative' FROM blocks WHERE seq < 0 UNION ALL
SELECT 'hash', 'does not match the text' FROM blocks WHERE text_hash <> '' AND text_hash <> sha256(text)) GROUP BY ALL"""


@q(_BLOCK_RULES)
def validate_blocks(s, d):
    b = rd(s, d, "blocks").withColumnRenamed("seq", "sequence").withColumnRenamed("text_hash", "hash")
    return validate.violations(b, [], validate.block_rules()).groupBy("path", "message").agg(F.count("*").alias("n"))


@q("SELECT verse_uid, path, message FROM (SELECT verse_uid, 'book' AS path, 'required' AS message FROM verses WHERE book IS NULL OR book = '' UNION ALL SELECT verse_uid, 'chapter', 'negative' FROM verses WHERE chapter < 0 UNION ALL SELECT verse_uid, 'verse', 'negative' FROM verses WHERE verse < 0)")
def validate_refs(s, d):
    return validate.violations(rd(s, d, "verses"), ["verse_uid"], validate.ref_rules())


@q("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text, e' \\t\\n\\r') = '' THEN 'loss' WHEN trim(replace(regexp_replace(text, '<[^>]*>?', '', 'g'), '>', ''), e' \\t\\n\\r') <> '' THEN 'parse_error'
WHEN contains(text, '<chapter') THEN 'chapter' WHEN regexp_matches(text, '<div[^>]*type="book"') THEN 'book' WHEN regexp_matches(text, '<div[^>]*type="(section|subSection|majorSection)"') THEN 'section'
WHEN regexp_matches(text, '<(milestone|lb|pb|verse)') THEN 'milestone' ELSE 'markup_only' END AS kind FROM (SELECT text FROM documents UNION ALL SELECT regexp_extract(text, '<[a-z]+ [^>]*>') FROM documents)) GROUP BY kind""")
def empty_text_class(s, d):
    """Kinds of whole texts and of the first tag with attributes of each."""
    t = rd(s, d, "documents").select("text")
    both = t.unionByName(t.select(F.regexp_extract("text", "<[a-z]+ [^>]*>", 0).alias("text")))
    return both.select(text.empty_kind("text").alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


# ---- joins ---------------------------------------------------------------------------------------------------------------


@q("SELECT v.verse_uid, b.book_name FROM verses v LEFT JOIN (SELECT id, min(book_name) AS book_name FROM books GROUP BY id) b ON v.book = b.id")
def catalogue_left(s, d):
    b = rd(s, d, "books").groupBy(F.col("id").alias("book")).agg(F.min("book_name").alias("book_name"))
    return rd(s, d, "verses").join(broadcast_if_small(b), "book", "left").select("verse_uid", "book_name")


@q("SELECT DISTINCT v.book FROM verses v WHERE v.book IS NOT NULL AND NOT EXISTS (SELECT 1 FROM books b WHERE b.id = v.book)")
def catalogue_anti(s, d):
    v = rd(s, d, "verses").where("book IS NOT NULL")
    return v.join(rd(s, d, "books").select(F.col("id").alias("book")), "book", "left_anti").select("book").distinct()


@q("SELECT b.blob_id FROM blobs b WHERE EXISTS (SELECT 1 FROM runs r WHERE r.transcript_blob_sha256 = b.sha256)")
def catalogue_semi(s, d):
    return rd(s, d, "blobs").join(rd(s, d, "runs").select(F.col("transcript_blob_sha256").alias("sha256")), "sha256", "left_semi").select("blob_id")


_MAP = [("Keth", 3, 1, "Keth", 2, 30), ("Keth", 3, 2, "Keth", 3, 1), ("Vosh", 1, 1, "Vosh", 1, 2), ("Vosh", 1, 1, "Vosh", 9, 9), ("Melq", 7, 4, "Melq", 7, 5)]
_MAP_SQL = "(VALUES " + ", ".join(str(x) for x in _MAP) + ") m(book, chapter, verse, tb, tc, tv)"


@q(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY book, chapter, verse ORDER BY tb, tc, tv) AS k FROM {_MAP_SQL})
SELECT v.verse_uid, v.book, v.chapter, v.verse, CASE WHEN m.k = 1 THEN tb ELSE v.book END AS mapped_book, CASE WHEN m.k = 1 THEN tc ELSE v.chapter END AS mapped_chapter, CASE WHEN m.k = 1 THEN tv ELSE v.verse END AS mapped_verse
FROM verses v LEFT JOIN m ON m.k = 1 AND m.book = v.book AND m.chapter = v.chapter AND m.verse = v.verse""")
def ref_map_first_match(s, d):
    m = s.createDataFrame(_MAP, "book string, chapter int, verse int, tb string, tc int, tv int")
    return canon.map_refs(rd(s, d, "verses").select("verse_uid", "book", "chapter", "verse"), m, ["book", "chapter", "verse"], ["tb", "tc", "tv"], ["tb", "tc", "tv"])


@q("""WITH ab AS (SELECT n_nationkey AS k, n_regionkey AS t FROM nation), bc AS (SELECT * FROM (VALUES (0, 10), (1, 11), (3, 13)) x(k, t))
SELECT ab.k, coalesce(bc.t, ab.t) AS t FROM ab LEFT JOIN bc ON bc.k = ab.t""")
def ref_map_chained(s, d):
    ab = rd(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("t"))
    return canon.chain_mappings(ab, s.createDataFrame([(0, 10), (1, 11), (3, 13)], "k int, t int"), ["k"], ["t"])


@q("""WITH r AS (SELECT * FROM (VALUES (1, 1, 0, 5, 5), (2, 0, 2, 7, 7), (3, 1, 2, 9, 9)) x(rule_no, chapter, verse, tc, tv)),
v AS (SELECT DISTINCT chapter, verse FROM esword_bible WHERE chapter IS NOT NULL AND verse IS NOT NULL)
SELECT chapter, verse, coalesce((SELECT arg_min(tc, rule_no) FROM r WHERE (r.chapter = 0 OR r.chapter = v.chapter) AND (r.verse = 0 OR r.verse = v.verse)), chapter) AS mapped_chapter,
coalesce((SELECT arg_min(tv, rule_no) FROM r WHERE (r.chapter = 0 OR r.chapter = v.chapter) AND (r.verse = 0 OR r.verse = v.verse)), verse) AS mapped_verse FROM v""")
def wildcard_rule_map(s, d):
    v = rd(s, d, "esword_bible").where("chapter IS NOT NULL AND verse IS NOT NULL").select("chapter", "verse").distinct()
    return canon.rule_map(v, [(1, 0, 5, 5), (0, 2, 7, 7), (1, 2, 9, 9)], ["chapter", "verse"], ["tc", "tv"])


_PSALM = """(CASE WHEN c <= 9 THEN c WHEN c = 10 THEN 9 WHEN c <= 113 THEN c - 1 WHEN c IN (114, 115) THEN 113 WHEN c = 116 AND v <= 9 THEN 114 WHEN c = 116 THEN 115 WHEN c <= 146 THEN c - 1 WHEN c = 147 AND v <= 11 THEN 146 ELSE c END)::INT AS to_chapter,
(CASE WHEN c = 10 THEN v + 21 WHEN c = 115 THEN v + 8 WHEN c = 116 AND v > 9 THEN v - 9 WHEN c = 147 AND v > 11 THEN v - 11 ELSE v END)::INT AS to_verse,
CASE WHEN c IN (10, 115) THEN 'merge' WHEN c IN (116, 147) THEN 'split' WHEN c <= 9 OR c >= 148 THEN 'direct' ELSE 'renumber' END AS kind"""


@q(f"SELECT row_id, {_PSALM} FROM (SELECT row_id, chapter AS c, verse AS v FROM esword_bible WHERE chapter IS NOT NULL)")
def psalm_renumber(s, d):
    """Every row's chapter and verse read as those of a psalm."""
    p = canon.greek_psalm(F.col("chapter"), F.col("verse"))
    return rd(s, d, "esword_bible").where("chapter IS NOT NULL").select("row_id", p["chapter"].alias("to_chapter"), p["verse"].alias("to_verse"), p["kind"].alias("kind"))


@q(f"""WITH f AS (SELECT c, v, {_PSALM} FROM (SELECT DISTINCT chapter AS c, verse AS v FROM esword_bible WHERE chapter BETWEEN 1 AND 150 AND verse > 0))
SELECT to_chapter AS chapter, to_verse AS verse, c AS back_chapter, v AS back_verse FROM f WHERE NOT (c = 9 AND v > 21 OR c IN (113, 114) AND v > 8 OR c = 116 AND FALSE OR to_chapter = 147 AND c = 147 AND v <= 11 OR to_chapter = 146 AND v > 11)""")
def psalm_inverse(s, d):
    """Greek numbers of every psalm verse, and the Hebrew ones they come from; verses beyond a psalm's length are left out."""
    g = rd(s, d, "esword_bible").where("chapter BETWEEN 1 AND 150 AND verse > 0").select("chapter", "verse").distinct()
    there = canon.greek_psalm(F.col("chapter"), F.col("verse"))
    t = g.select(F.col("chapter").alias("c"), F.col("verse").alias("v"), there["chapter"].alias("chapter"), there["verse"].alias("verse"))
    t = t.where(~((F.col("c") == 9) & (F.col("v") > 21) | F.col("c").isin(113, 114) & (F.col("v") > 8) | (F.col("chapter") == 146) & (F.col("v") > 11)))
    back = canon.hebrew_psalm(F.col("chapter"), F.col("verse"))
    return t.select("chapter", "verse", back["chapter"].alias("back_chapter"), back["verse"].alias("back_verse"))


@q("""WITH m AS (SELECT * FROM (VALUES ('Keth', 1, ['Keth.1.1', 'Keth.1.2']), ('Vosh', 2, ['Vosh.2.4']), ('Melq', 3, [])) x(book, chapter, targets))
SELECT v.verse_uid, unnest(CASE WHEN len(m.targets) > 0 THEN m.targets ELSE [v.id] END) AS target FROM verses v LEFT JOIN m ON m.book = v.book AND m.chapter = v.chapter""")
def split_map_explode(s, d):
    m = s.createDataFrame([("Keth", 1, ["Keth.1.1", "Keth.1.2"]), ("Vosh", 2, ["Vosh.2.4"]), ("Melq", 3, [])], "book string, chapter int, targets array<string>")
    return canon.split_refs(rd(s, d, "verses").select("verse_uid", "book", "chapter", "id"), m, ["book", "chapter"], "targets", "id").select("verse_uid", "target")


_CANON = "SELECT module_id, book AS book_idx, chapter, max(verse) AS n_verses FROM esword_bible WHERE chapter IS NOT NULL GROUP BY ALL"
_STARTS = f"""WITH c AS ({_CANON}), h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY module_id, book_idx ORDER BY chapter) = 1 THEN 1 ELSE 0 END AS head FROM c),
x AS (SELECT *, (2 + coalesce(sum(n_verses + 1 + head) OVER (PARTITION BY module_id ORDER BY book_idx, chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head + 1)::BIGINT AS start FROM h)"""


def _starts(s, d):
    c = rd(s, d, "esword_bible").where("chapter IS NOT NULL").groupBy("module_id", F.col("book").alias("book_idx"), "chapter").agg(F.max("verse").alias("n_verses"))
    return canon.verse_index(c, ["module_id"])


@q(_STARTS + "SELECT module_id, book_idx, chapter, n_verses, start FROM x")
def verse_index_cumsum(s, d):
    return _starts(s, d)


@q(_STARTS + "SELECT e.row_id, x.start + e.verse - 1 AS idx, x.book_idx, x.chapter, e.verse::BIGINT AS verse FROM esword_bible e JOIN x ON x.module_id = e.module_id AND x.book_idx = e.book AND x.chapter = e.chapter WHERE e.verse > 0")
def verse_index_inverse(s, d):
    st = _starts(s, d)
    e = rd(s, d, "esword_bible").where("verse > 0").select("row_id", "module_id", F.col("book").alias("book_idx"), "chapter", "verse")
    idx = e.join(st, ["module_id", "book_idx", "chapter"]).select("row_id", "module_id", (F.col("start") + F.col("verse") - 1).alias("idx"))
    return canon.index_to_ref(idx, st, ["module_id"]).select("row_id", "idx", "book_idx", "chapter", "verse")


@q("""WITH n AS (SELECT module_id, book, chapter, max(verse) AS n_verses FROM esword_bible WHERE book IS NOT NULL AND chapter IS NOT NULL GROUP BY ALL), g AS (SELECT module_id, book, chapter, unnest(generate_series(1, n_verses)) AS verse FROM n WHERE n_verses > 0)
SELECT g.module_id, g.book, g.chapter, count(*) AS n_missing FROM g LEFT JOIN esword_bible e ON e.book = g.book AND e.module_id = g.module_id AND e.chapter = g.chapter AND e.verse = g.verse WHERE e.row_id IS NULL GROUP BY ALL""")
def canon_missing_verses(s, d):
    keys = ["module_id", "book", "chapter"]
    e = rd(s, d, "esword_bible").where("book IS NOT NULL AND chapter IS NOT NULL")
    grid = canon.expand_canon(e.groupBy(*keys).agg(F.max("verse").alias("n_verses")))
    return grid.join(e.select(*keys, "verse"), [*keys, "verse"], "left_anti").groupBy(*keys).agg(F.count("*").alias("n_missing"))


@q("""WITH i AS (SELECT user_id AS k, event_id AS id, ts AS lo, ts + INTERVAL 1 DAY AS hi FROM events WHERE event_type = 'signup')
SELECT e.event_id, min(i.id) AS first_id FROM events e JOIN i ON e.user_id = i.k AND e.ts BETWEEN i.lo AND i.hi GROUP BY e.event_id""")
def interval_lookup(s, d):
    e = rd(s, d, "events").select("event_id", F.col("user_id").alias("k"), "ts", "event_type")
    i = e.where("event_type = 'signup'").select("k", F.col("event_id").alias("id"), F.col("ts").alias("lo"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("hi"))
    return align.interval_lookup(e, "event_id", i, "k", ["ts"], ["lo"], ["hi"], ["id"], lambda c: F.unix_date(c.cast("date"))).select("event_id", F.col("first.id").alias("first_id"))


@q("WITH s AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS id, min(l_quantity) AS a, min(l_quantity) + 5 AS b FROM lineitem GROUP BY ALL) SELECT x.k, x.id AS id_a, y.id AS id_b FROM s x JOIN s y ON x.k = y.k AND x.id < y.id AND x.a < y.b AND y.a < x.b")
def span_overlap(s, d):
    li = rd(s, d, "lineitem").groupBy(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.min("l_quantity").alias("a"), (F.min("l_quantity") + 5).alias("b"))
    return align.overlaps(li, "k", "id", "a", "b", lambda c: F.floor(c / 8))


_LANGS = ["de", "en", "fr"]


@q("SELECT doc_id AS book, seq AS verse, " + ", ".join(f"coalesce(min(CASE WHEN lang = '{x}' THEN text END), 'not available') AS {x}" for x in _LANGS) + " FROM blocks GROUP BY ALL")
def parallel_align(s, d):
    return align.parallel(rd(s, d, "blocks").select(F.col("doc_id").alias("book"), F.col("seq").alias("verse"), "lang", "text"), ["book", "verse"], "lang", "text", _LANGS)


@q("""WITH w AS (SELECT DISTINCT book, module_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM verses)
SELECT book, word, min(module_id) AS module_id FROM w WHERE length(word) > 2 GROUP BY book, word HAVING count(*) = 1""")
def unique_words_per_side(s, d):
    return align.unique_words(rd(s, d, "verses"), ["book"], "module_id", F.split(F.lower("text"), r"\s+"))


@q("SELECT verse_uid, regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi') AS marked FROM verses")
def highlight_term(s, d):
    return rd(s, d, "verses").select("verse_uid", text.highlight("text", "the").alias("marked"))


_IRPAIR = "SELECT a.ir_row_id AS id_a, b.ir_row_id AS id_b, a.text AS ta, b.text AS tb FROM compare_ir c JOIN ir_blocks a ON a.ir_key = c.ir_a_key JOIN ir_blocks b ON b.ir_key = c.ir_b_key AND b.doc_id = a.doc_id AND b.block_id = a.block_id GROUP BY ALL"


def _ir_pairs(s, d):
    c = broadcast_if_small(rd(s, d, "compare_ir").select("ir_a_key", "ir_b_key").distinct())
    b = rd(s, d, "ir_blocks")
    a1 = b.select(F.col("ir_key").alias("ir_a_key"), "doc_id", "block_id", F.col("ir_row_id").alias("id_a"), F.col("text").alias("ta"))
    b1 = b.select(F.col("ir_key").alias("ir_b_key"), "doc_id", "block_id", F.col("ir_row_id").alias("id_b"), F.col("text").alias("tb"))
    return a1.join(c, "ir_a_key").join(b1, ["ir_b_key", "doc_id", "block_id"]).select("id_a", "id_b", "ta", "tb").distinct()


@q(f"""WITH p AS ({_IRPAIR}), w AS (SELECT id_a, id_b, regexp_split_to_array(ta, ' ') AS a, regexp_split_to_array(tb, ' ') AS b FROM p WHERE ta IS NOT NULL AND tb IS NOT NULL),
g AS (SELECT *, unnest(generate_series(1, least(len(a), len(b)))) AS i FROM w) SELECT id_a, id_b, (i - 1)::INT AS pos, a[i] AS word_a, b[i] AS word_b, 0.5 AS confidence FROM g""")
def token_align_positional(s, d):
    p = _ir_pairs(s, d).where("ta IS NOT NULL AND tb IS NOT NULL")
    return p.select("id_a", "id_b", F.explode(align.token_pairs(F.split("ta", " "), F.split("tb", " "))).alias("t")).select("id_a", "id_b", "t.*")


@q(f"""WITH p AS ({_IRPAIR}), w AS (SELECT id_a, id_b, CASE WHEN ta IS NULL THEN [] ELSE regexp_split_to_array(lower(ta), '\\s+') END AS a, CASE WHEN tb IS NULL THEN [] ELSE regexp_split_to_array(lower(tb), '\\s+') END AS b FROM p),
x AS (SELECT id_a, id_b, len(a) AS na, len(b) AS nb, unnest(list_concat(list_transform(a, lambda z: struct_pack(w := z, s := 0)), list_transform(b, lambda z: struct_pack(w := z, s := 1)))) AS u FROM w),
k AS (SELECT id_a, id_b, na, nb, u.w AS word, least(count(*) FILTER (WHERE u.s = 0), count(*) FILTER (WHERE u.s = 1)) AS c FROM x GROUP BY ALL)
SELECT id_a, id_b, round(sum(c) / greatest(na, nb), 6)::DOUBLE AS similarity FROM k GROUP BY id_a, id_b, na, nb UNION ALL SELECT id_a, id_b, 0.0 FROM w WHERE len(a) = 0 AND len(b) = 0""")
def bag_similarity(s, d):
    words = lambda c: F.coalesce(F.split(F.lower(c), r"\s+"), F.array().cast("array<string>"))
    return align.bag_similarity(_ir_pairs(s, d), ["id_a", "id_b"], words("ta"), words("tb"))


@q("""WITH e AS (SELECT user_id // 2 AS pair, user_id % 2 AS side, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), a AS (SELECT * FROM e WHERE side = 0), b AS (SELECT * FROM e WHERE side = 1)
SELECT coalesce(a.pair, b.pair)::BIGINT AS pair, coalesce(a.pos, b.pos)::INT AS pos, coalesce(a.event_type, '') AS value_a, coalesce(b.event_type, '') AS value_b FROM a FULL JOIN b ON a.pair = b.pair AND a.pos = b.pos WHERE a.event_type IS DISTINCT FROM b.event_type""")
def event_log_diff(s, d):
    """The logs of every even user and the next one."""
    e = rd(s, d, "events").withColumn("pair", F.floor(F.col("user_id") / 2))
    return align.positional_diff(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1"), ["ts", "event_id"], "event_type", ["pair"])


@q("""SELECT r.run_uid, CASE WHEN b.sha256 IS NULL THEN 'new' WHEN r.transcript_blob_sha256 = b.sha256 THEN 'pass' ELSE 'fail' END AS status FROM runs r LEFT JOIN (SELECT DISTINCT sha256 FROM blobs) b ON r.transcript_blob_sha256 = b.sha256""")
def golden_check(s, d):
    r = rd(s, d, "runs")
    g = rd(s, d, "blobs").select("sha256").distinct()
    return r.join(g, r.transcript_blob_sha256 == g.sha256, "left").select("run_uid", F.when(g.sha256.isNull(), "new").otherwise("pass").alias("status"))


_XREFS = "SELECT osis_ref AS source_ref, replace(title, ' ', '.') AS target_ref, doc_id FROM documents WHERE osis_ref IS NOT NULL AND title IS NOT NULL"


@q(f"SELECT side, ref, count(*) AS n_refs, min(doc_id) AS first_id FROM (SELECT 'source' AS side, source_ref AS ref, doc_id FROM ({_XREFS}) UNION ALL SELECT 'target', target_ref, doc_id FROM ({_XREFS})) GROUP BY ALL")
def crossref_index(s, d):
    """Documents as cross references from their reference to their title's place, indexed by source and by target."""
    x = rd(s, d, "documents").where("osis_ref IS NOT NULL AND title IS NOT NULL").select(F.col("osis_ref").alias("source_ref"), F.replace("title", F.lit(" "), F.lit(".")).alias("target_ref"), "doc_id")
    return refs.crossref_index(x, "source_ref", "target_ref").groupBy("side", "ref").agg(F.count("*").alias("n_refs"), F.min("doc_id").alias("first_id"))


# ---- aggregations --------------------------------------------------------------------------------------------------------


@q("SELECT book, count(DISTINCT chapter) AS n_chapters, max(chapter) AS last_chapter, max(verse) AS last_verse, count(*) AS n FROM verses GROUP BY book")
def chapter_counts(s, d):
    return rd(s, d, "verses").groupBy("book").agg(F.count_distinct("chapter").alias("n_chapters"), F.max("chapter").alias("last_chapter"), F.max("verse").alias("last_verse"), F.count("*").alias("n"))


@q("SELECT doc_id, count(DISTINCT regexp_extract(block_id, '\\.(\\d+)\\.(\\d+)', 1)) FILTER (WHERE regexp_matches(block_id, '\\.(\\d+)\\.(\\d+)')) AS n_chapters FROM blocks GROUP BY doc_id")
def chapter_counts_from_ids(s, d):
    return rd(s, d, "blocks").groupBy("doc_id").agg(F.count_distinct(refs.block_ref(F.col("block_id"))["chapter"]).alias("n_chapters"))


@q("SELECT corpus_id, count(DISTINCT doc_id) AS n_documents, count(*) AS n_blocks, sum(strlen(text))::BIGINT AS n_bytes, bool_or(attrs IS NOT NULL) AS any_attrs FROM blocks GROUP BY corpus_id")
def corpus_summary(s, d):
    return rd(s, d, "blocks").groupBy("corpus_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_blocks"), F.sum(F.octet_length("text")).alias("n_bytes"), F.bool_or(F.col("attrs").isNotNull()).alias("any_attrs"))


@q("SELECT lang, sum(len(regexp_extract_all(text, '[A-Za-z0-9''\\x{80}-\\x{10FFFF}]+')))::BIGINT AS n_words FROM documents WHERE text IS NOT NULL GROUP BY lang")
def token_counts(s, d):
    t = F.filter(text.token_texts("text"), lambda x: text.token_kind(x) == "word")
    return rd(s, d, "documents").where("text IS NOT NULL").groupBy("lang").agg(F.sum(F.size(t)).alias("n_words"))


@q("""WITH t AS (SELECT verse_uid, regexp_extract_all(text, '[A-Za-z0-9''\\x{80}-\\x{10FFFF}]+|[ \\t\\n\\r]+|[^A-Za-z0-9''\\x{80}-\\x{10FFFF} \\t\\n\\r]+') AS ts FROM verses WHERE text IS NOT NULL),
u AS (SELECT verse_uid, unnest(ts) AS tok, unnest(generate_series(0, len(ts) - 1)) AS idx FROM t)
SELECT verse_uid, idx::INT AS idx, tok AS text, (sum(strlen(tok)) OVER (PARTITION BY verse_uid ORDER BY idx) - strlen(tok))::INT AS char_start FROM u""")
def token_positions(s, d):
    return tokens.token_rows(rd(s, d, "verses").where("text IS NOT NULL"), ["verse_uid"], "text").select("verse_uid", "idx", "text", "char_start")


@q("SELECT run_status, count(*) AS n, round(count(*) FILTER (WHERE run_status = 'success') / count(*), 6) AS pass_rate FROM runs GROUP BY run_status")
def status_counts(s, d):
    return rd(s, d, "runs").groupBy("run_status").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("run_status") == "success", 1).otherwise(0)) / F.count("*"), 6).alias("pass_rate"))


@q("SELECT engine_id, bool_and(coalesce(run_status, '') = 'success') AS all_pass, count(*) AS n FROM runs GROUP BY engine_id")
def all_pass(s, d):
    return rd(s, d, "runs").groupBy("engine_id").agg(F.bool_and(F.coalesce("run_status", F.lit("")) == "success").alias("all_pass"), F.count("*").alias("n"))


@q("SELECT l_linestatus AS step, 'L' || max(lv)::VARCHAR AS worst, bool_and(lv = 0) AS lossless, bool_and(lv <= 1) AS semantically_lossless FROM (SELECT l_linestatus, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END AS lv FROM lineitem) GROUP BY ALL")
def loss_worst(s, d):
    """Return flags read as loss classes of conversion steps."""
    c = F.when(F.col("l_returnflag") == "A", "L0").when(F.col("l_returnflag") == "N", "L2").otherwise("L4")
    return rd(s, d, "lineitem").groupBy(F.col("l_linestatus").alias("step")).agg(validate.worst_loss(c).alias("worst"), F.bool_and(validate.is_lossless(c)).alias("lossless"), F.bool_and(validate.is_semantically_lossless(c)).alias("semantically_lossless"))


@q("SELECT sha256(text) AS digest, count(*) AS n, min(block_uid) AS first_uid FROM blocks WHERE text <> '' GROUP BY 1 HAVING count(*) > 1")
def hash_dedup(s, d):
    return rd(s, d, "blocks").where("text <> ''").groupBy(text.content_hash("text").alias("digest")).agg(F.count("*").alias("n"), F.min("block_uid").alias("first_uid")).where("n > 1")


@q("SELECT doc_id, sha256(trim(replace(regexp_replace(text, '<[^>]*>?', '', 'g'), '>', ''), e' \\t\\n\\r')) AS digest FROM documents WHERE text IS NOT NULL")
def strip_markup_hash(s, d):
    return rd(s, d, "documents").where("text IS NOT NULL").select("doc_id", text.content_hash(text.strip_markup("text")).alias("digest"))


_Q = "' || chr(39) || '"


@q(f"SELECT doc_id, a AS osis_id FROM (SELECT doc_id, CASE WHEN regexp_matches(x, '\\sosisID=\"[^\"]') THEN regexp_extract(x, '\\sosisID=\"([^\"]*)\"', 1) ELSE regexp_extract(x, '\\sosisID={_Q}([^{_Q}]*){_Q}', 1) END AS a FROM (SELECT doc_id, unnest(regexp_extract_all(text, '<[^>]*>')) AS x FROM documents)) WHERE a <> ''")
def attr_extract(s, d):
    """The reference attribute of every tag, in either kind of quotes."""
    tags = rd(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(<[^>]*>)"), F.lit(1))).alias("tag"))
    return tags.select("doc_id", text.attribute("tag", "osisID").alias("osis_id")).where("osis_id <> ''")


@q("SELECT verse_uid, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> ''), ' ') AS words FROM verses WHERE len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) > 0")
def words_to_text(s, d):
    """Verses taken apart into rows of words and put together again."""
    words = rd(s, d, "verses").select("verse_uid", F.posexplode(F.split("text", r"[ \t\n\r]+")).alias("pos", "word")).where("word <> ''")
    return tokens.words_to_text(words, ["verse_uid"], "word", "pos").withColumnRenamed("text", "words")


@q("""WITH v AS (SELECT module_id, book, chapter, string_agg(verse || ':' || length(text), ',' ORDER BY verse, verse_uid) AS vs FROM verses WHERE text IS NOT NULL AND book IS NOT NULL GROUP BY ALL)
SELECT module_id, string_agg(book || ' ' || chapter || '{' || vs || '}', ';' ORDER BY book, chapter) AS nested FROM v GROUP BY module_id""")
def nested_export(s, d):
    v = rd(s, d, "verses").where("text IS NOT NULL AND book IS NOT NULL AND verse IS NOT NULL AND chapter IS NOT NULL")
    ch = v.groupBy("module_id", "book", "chapter").agg(F.sort_array(F.collect_list(F.struct("verse", "verse_uid", F.length("text").alias("n")))).alias("vs"))
    ch = ch.withColumn("vs", F.array_join(F.transform("vs", lambda x: F.concat_ws(":", x["verse"], x["n"])), ","))
    m = ch.groupBy("module_id").agg(F.sort_array(F.collect_list(F.struct("book", "chapter", "vs"))).alias("bs"))
    return m.select("module_id", F.array_join(F.transform("bs", lambda x: F.concat(x["book"], F.lit(" "), x["chapter"], F.lit("{"), x["vs"], F.lit("}"))), ";").alias("nested"))


@q("SELECT book, chapter, count(*) AS n FROM verses GROUP BY ROLLUP (book, chapter)")
def rollup_book_chapter(s, d):
    return rd(s, d, "verses").rollup("book", "chapter").agg(F.count("*").alias("n"))


@q("""SELECT CASE WHEN blake3 IS NOT NULL THEN 'both' WHEN blob_path IS NOT NULL THEN 'path' ELSE 'hash only' END AS class, count(*) AS n, sum(size_bytes)::BIGINT AS n_bytes FROM blobs GROUP BY 1""")
def blob_classes(s, d):
    c = F.when(F.col("blake3").isNotNull(), "both").when(F.col("blob_path").isNotNull(), "path").otherwise("hash only")
    return rd(s, d, "blobs").groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("n_bytes"))


@q(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("blocks", "verses", "books", "runs", "blobs")))
def table_row_counts(s, d):
    parts = [rd(s, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in ("blocks", "verses", "books", "runs", "blobs")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- windows -------------------------------------------------------------------------------------------------------------


@q("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup FROM events")
def carry_forward(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return rd(s, d, "events").select("event_id", "user_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("last_signup"))


@q("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events),
k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM g) SELECT user_id, grp::BIGINT AS grp, count(*) AS n, min(ts) AS first_ts FROM k GROUP BY ALL""")
def session_groups(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = rd(s, d, "events").withColumn("f", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 6 HOUR"), 0).otherwise(1))
    k = e.withColumn("grp", F.sum("f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return k.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@q("WITH c AS (SELECT DISTINCT book, chapter FROM verses WHERE book IS NOT NULL AND chapter IS NOT NULL) SELECT book, chapter, lag(chapter) OVER (PARTITION BY book ORDER BY chapter) AS prev_chapter, lead(chapter) OVER (PARTITION BY book ORDER BY chapter) AS next_chapter FROM c")
def prev_next(s, d):
    c = rd(s, d, "verses").where("book IS NOT NULL AND chapter IS NOT NULL").select("book", "chapter").distinct()
    w = Window.partitionBy("book").orderBy("chapter")
    return c.select("book", "chapter", F.lag("chapter").over(w).alias("prev_chapter"), F.lead("chapter").over(w).alias("next_chapter"))


@q("SELECT p_partkey, CASE WHEN rn = 1 THEN p_name ELSE p_name || '-' || (rn - 1) END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM part)")
def unique_suffix(s, d):
    rn = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return rd(s, d, "part").withColumn("rn", rn).select("p_partkey", F.when(F.col("rn") == 1, F.col("p_name")).otherwise(F.concat_ws("-", "p_name", F.col("rn") - 1)).alias("unique_name"))


@q("SELECT event_id, event_type, rn::INT AS rn FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50")
def last_k_history(s, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return rd(s, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 50").select("event_id", "event_type", "rn")


@q("SELECT book, first_uid, row_number() OVER (ORDER BY first_uid)::INT AS book_order FROM (SELECT book, min(verse_uid) AS first_uid FROM verses WHERE book IS NOT NULL GROUP BY book)")
def first_seen_order(s, d):
    b = rd(s, d, "verses").where("book IS NOT NULL").groupBy("book").agg(F.min("verse_uid").alias("first_uid"))  # one row per book
    return b.withColumn("book_order", F.row_number().over(Window.orderBy("first_uid")))


# ---- sets ----------------------------------------------------------------------------------------------------------------


@q("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(s, d):
    return rd(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(rd(s, d, "supplier").select("s_nationkey")).distinct()


@q("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(s, d):
    return rd(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(rd(s, d, "supplier").select("s_nationkey"))


@q("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def set_except(s, d):
    return rd(s, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(rd(s, d, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@q("SELECT b.block_uid FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM verses v WHERE v.id = b.block_id)")
def incremental_scan(s, d):
    return rd(s, d, "blocks").join(rd(s, d, "verses").select(F.col("id").alias("block_id")), "block_id", "left_anti").select("block_uid")


# ---- scalars -------------------------------------------------------------------------------------------------------------


@q("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_props(s, d):
    return rd(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@q("SELECT block_uid, json_extract_string(attrs, '$.style') AS style, (json_extract_string(attrs, '$.n'))::INT AS n FROM blocks")
def json_attrs(s, d):
    v = F.try_parse_json("attrs")
    return rd(s, d, "blocks").select("block_uid", F.try_variant_get(v, "$.style", "string").alias("style"), F.try_variant_get(v, "$.n", "int").alias("n"))


@q("SELECT verse_uid, regexp_extract(id, '^([1-4]?[A-Z][A-Za-z]*)(\\.(\\d+)(\\.(\\d+))?)?$', 1) AS book, (nullif(regexp_extract(id, '^([1-4]?[A-Z][A-Za-z]*)(\\.(\\d+)(\\.(\\d+))?)?$', 3), ''))::INT AS chapter, (nullif(regexp_extract(id, '^([1-4]?[A-Z][A-Za-z]*)(\\.(\\d+)(\\.(\\d+))?)?$', 5), ''))::INT AS verse FROM verses WHERE regexp_matches(id, '^([1-4]?[A-Z][A-Za-z]*)(\\.(\\d+)(\\.(\\d+))?)?$')")
def parse_osis_refs(s, d):
    v = rd(s, d, "verses").select("verse_uid", refs.parse_osis(F.col("id")).alias("r")).where("r IS NOT NULL")
    return v.select("verse_uid", "r.book", "r.chapter", "r.verse")


@q("SELECT doc_id, osis_ref AS osis_id FROM documents WHERE regexp_matches(osis_ref, '^[1-4]?[A-Z][A-Za-z]*(\\.[1-9]\\d*(\\.[1-9]\\d*)?)?$')")
def format_osis_refs(s, d):
    x = rd(s, d, "documents").select("doc_id", refs.parse_osis(F.col("osis_ref")).alias("r")).where("r IS NOT NULL")
    return x.select("doc_id", refs.format_ref(F.col("r")).alias("osis_id"))


_HUMAN = "'^\\s*([1-4]?\\s*\\p{L}[\\p{L}. ]*?)\\s*(\\d+)?(?:\\s*[:.]\\s*(\\d+)([a-z])?)?(?:\\s*[-–]\\s*(?:(\\d+)\\s*[:.]\\s*)?(\\d+))?\\s*$'"


@q(f"SELECT doc_id, form, regexp_replace(regexp_extract(t, {_HUMAN}, 1), '[.\\s]+', '', 'g') AS book, nullif(regexp_extract(t, {_HUMAN}, 2), '')::INT AS chapter, nullif(regexp_extract(t, {_HUMAN}, 3), '')::INT AS verse, nullif(regexp_extract(t, {_HUMAN}, 6), '')::INT AS verse_end FROM (SELECT doc_id, unnest(['title', 'verse', 'range']) AS form, unnest([title, title || ':3', title || ':3-7']) AS t FROM documents) WHERE regexp_matches(t, {_HUMAN})")
def parse_human_refs(s, d):
    """Every title as it is, with a verse, and with a range of verses."""
    forms = F.array(F.struct(F.lit("title").alias("form"), F.col("title").alias("t")), F.struct(F.lit("verse").alias("form"), F.concat("title", F.lit(":3")).alias("t")), F.struct(F.lit("range").alias("form"), F.concat("title", F.lit(":3-7")).alias("t")))
    x = rd(s, d, "documents").select("doc_id", F.explode(forms).alias("f")).select("doc_id", "f.form", refs.parse_human(F.col("f.t")).alias("r")).where("r IS NOT NULL")
    return x.select("doc_id", "form", "r.book", "r.chapter", "r.verse", "r.verse_end")


@q("SELECT verse_uid, trim(regexp_replace(lower(regexp_replace(text, '\\p{P}', '', 'g')), '\\s+', ' ', 'g'), e' \\t\\n\\r') AS norm FROM verses")
def normalise_text(s, d):
    return rd(s, d, "verses").select("verse_uid", text.normalise("text").alias("norm"))


@q("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS esc FROM documents")
def escape_xml(s, d):
    return rd(s, d, "documents").select("doc_id", text.escape_xml("text").alias("esc"))


@q("SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS safe FROM documents")
def safe_ids(s, d):
    return rd(s, d, "documents").select("doc_id", text.safe_id("title").alias("safe"))


@q("SELECT p_partkey, array_to_string(list_sort(list_filter([CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, lower(p_brand)], lambda x: x IS NOT NULL)), ',') AS tags FROM part")
def tag_derivation(s, d):
    t = text.tags((F.col("p_size") > 25, "large"), (F.col("p_size") <= 25, "small"), (F.col("p_retailprice") > 1000, "dear"), (F.lit(True), F.lower("p_brand")))
    return rd(s, d, "part").select("p_partkey", F.array_join(t, ",").alias("tags"))


@q("SELECT source, CASE WHEN regexp_matches(lower(source), '^(ztext|rawtext)') THEN 'BIBLE' WHEN regexp_matches(lower(source), '^(zcom|rawcom|hrefcom|rawfiles)') THEN 'COMMENTARY' WHEN regexp_matches(lower(source), '^(zld|rawld)') THEN 'DICTIONARY' WHEN lower(source) LIKE 'rawgenbook%' THEN 'GENBOOK' ELSE 'UNKNOWN' END AS kind, count(*) AS n FROM documents GROUP BY ALL")
def driver_type(s, d):
    return rd(s, d, "documents").groupBy("source", text.module_type("source").alias("kind")).agg(F.count("*").alias("n"))


@q("SELECT blob_id, CASE " + " ".join(f"WHEN size_bytes >= {1024**k} THEN printf('%.1f', round(size_bytes / {1024**k}.0, 1)) || ' {u}'" for k, u in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB"))) + " ELSE size_bytes || ' B' END AS size FROM blobs")
def human_sizes(s, d):
    return rd(s, d, "blobs").select("blob_id", text.human_size("size_bytes").alias("size"))


@q("SELECT doc_id, " + "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for p, n in text.LICENCES) + " ELSE 'NOASSERTION' END AS licence FROM documents")
def licence_cascade(s, d):
    return rd(s, d, "documents").select("doc_id", text.spdx("text").alias("licence"))


@q("SELECT v.book, b.book_name, CASE WHEN b.book_order > 39 THEN 'NT' ELSE 'OT' END AS testament, count(DISTINCT v.chapter) AS n_chapters FROM verses v JOIN (SELECT id, min(book_name) AS book_name, min(book_order) AS book_order FROM books GROUP BY id) b ON b.id = v.book GROUP BY ALL")
def book_projection(s, d):
    b = rd(s, d, "books").groupBy(F.col("id").alias("book")).agg(F.min("book_name").alias("book_name"), F.min("book_order").alias("book_order"))
    j = rd(s, d, "verses").join(broadcast_if_small(b), "book")
    return j.groupBy("book", "book_name", F.when(F.col("book_order") > 39, "NT").otherwise("OT").alias("testament")).agg(F.count_distinct("chapter").alias("n_chapters"))


@q("SELECT row_id, CASE book " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BOOKS, 1)) + " END AS osis FROM esword_bible")
def book_number_lookup(s, d):
    table = F.create_map(*[F.lit(x) for i, b in enumerate(BOOKS, 1) for x in (i, b)])
    return rd(s, d, "esword_bible").select("row_id", table[F.col("book")].alias("osis"))


@q("SELECT corpus_id, sha256('1' || string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT corpus_id, sha256(concat_ws(chr(31), doc_id, block_id, coalesce(seq::VARCHAR, ''), coalesce(text, 'NULL'))) AS h FROM blocks) GROUP BY corpus_id")
def corpus_hash(s, d):
    from folioform.sources import ir_json

    b = rd(s, d, "blocks").select("corpus_id", "doc_id", "block_id", F.col("seq").alias("sequence"), F.coalesce("text", F.lit("NULL")).alias("text"))
    return ir_json.corpus_hash(b)


@q("SELECT module_id, bool_or(contains(scripture, '“') OR contains(scripture, '«')) AS has_quotes, bool_or(regexp_matches(scripture, '[¹²³]')) AS has_notes, bool_or(book > 39) AS has_nt FROM esword_bible GROUP BY module_id")
def feature_detection(s, d):
    t = F.col("scripture")
    return rd(s, d, "esword_bible").groupBy("module_id").agg(F.bool_or(F.contains(t, F.lit("“")) | F.contains(t, F.lit("«"))).alias("has_quotes"), F.bool_or(t.rlike("[¹²³]")).alias("has_notes"), F.bool_or(F.col("book") > 39).alias("has_nt"))


@q("SELECT engine_id, count(*) FILTER (WHERE run_status = 'running') AS running, count(*) FILTER (WHERE run_status = 'queued') AS queued, count(*) FILTER (WHERE run_status NOT IN ('running', 'queued')) AS history FROM runs GROUP BY engine_id")
def queue_partition(s, d):
    st = F.col("run_status")
    n = lambda c: F.count(F.when(c, 1))
    return rd(s, d, "runs").groupBy("engine_id").agg(n(st == "running").alias("running"), n(st == "queued").alias("queued"), n(~st.isin("running", "queued")).alias("history"))


@q("""WITH c AS (SELECT module_id, book, chapter AS c0, chapter + 2 AS c1, row_id FROM esword_bible WHERE verse = 1 AND chapter IS NOT NULL)
SELECT v.row_id, count(*) AS n_comments FROM esword_bible v JOIN c ON c.module_id = v.module_id AND v.book = c.book AND c.c0 <= v.chapter AND c.c1 >= v.chapter GROUP BY v.row_id""")
def chapter_overlap(s, d):
    v = rd(s, d, "esword_bible")
    # an equal key instead of a range: a comment counts for its own chapter and the two after it
    c = v.where("verse = 1 AND chapter IS NOT NULL").select("module_id", "book", F.explode(F.sequence("chapter", F.col("chapter") + 2)).alias("chapter")).groupBy("module_id", "book", "chapter").agg(F.count("*").alias("n"))
    return v.join(c, ["module_id", "book", "chapter"]).groupBy("row_id").agg(F.sum("n").alias("n_comments"))


@q("SELECT b.block_uid, b.block_id, levenshtein(b.corpus_id, b.doc_id) AS distance FROM blocks b")
def edit_distance(s, d):
    return rd(s, d, "blocks").select("block_uid", "block_id", F.levenshtein("corpus_id", "doc_id").alias("distance"))


@q("SELECT run_uid, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS started FROM runs")
def rfc3339_times(s, d):
    return rd(s, d, "runs").select("run_uid", F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started"))


# ---- streaming twins -----------------------------------------------------------------------------------------------------


@q("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS win_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(s, d):
    out = windows.tumbling(windows.table_stream(s, f"{d}/events.parquet"), "ts", "1 hour", ["event_type"])
    return windows.drain(out, "complete").select("win_start", "event_type", "n", F.round("total", 4).alias("total"))


@q("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM g) SELECT user_id, min(ts) AS win_start, count(*) AS n FROM k GROUP BY user_id, grp""")
def stream_session(s, d):
    out = windows.sessions(windows.table_stream(s, f"{d}/events.parquet"), "ts", "30 minutes", ["user_id"])
    return windows.drain(out, "complete").select("user_id", "win_start", "n")


@q("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status(s, d):
    out = windows.job_states(windows.table_stream(s, f"{d}/events.parquet"), "user_id", ["ts", "event_id"], "event_type")
    return windows.drain(out, "complete").withColumnRenamed("event_type", "status")


@q("SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL")
def stream_dedup(s, d):
    """The first event of each user and type, as a stream sees it in one batch ordered by nothing: its keys only are defined."""
    e = windows.table_stream(s, f"{d}/events.parquet")
    kept = windows.drain(windows.dedup_stream(e.select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"], "36500 days").select("user_id", "event_type"), "append")
    return kept.join(rd(s, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts")), ["user_id", "event_type"])


@q()
def stream_token_bucket(s, d):
    """Events let through per user, three at once and one an hour: keyed state of a stream; not to be said in SQL, tested against plain Python."""
    out = windows.token_bucket(windows.table_stream(s, f"{d}/events.parquet"), "user_id", "ts", 3.0, 1 / 3600, None)
    return windows.drain(out, "append").groupBy("key").agg(F.count("*").alias("n_events"), F.count(F.when(F.col("allowed"), 1)).alias("n_allowed"))
