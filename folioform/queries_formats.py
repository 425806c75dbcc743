"""Driver queries that write whole tables in a format and read them back; the SQL twin selects the same verses."""

from __future__ import annotations

import uuid
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioform.functions.text import squeeze, strip_markup
from folioform.schema import BOOKS
from folioform.session import read_table as rd
from folioform.session import shared_dir
from folioform.sources import binary, database, ir_json, registry
from folioform.sources.model import Verse
from folioform.streaming import windows

#: Sinks that name books freely; the SQLite family of numbered books is fed from esword_bible.
NAMED = ["usfm", "osis", "usx", "json", "sqlite", "html", "markdown", "txt", "tei", "xml", "epub", "onlinebible", "sfm", "odf", "dbl"]
NUMBERED = ["zefania", "esword", "mysword", "mybible"]


def all_named(s: SparkSession, d: str) -> DataFrame:
    """Every verse with a text, repeated places too. Book names are trimmed; a verse without one goes where readers put it, into a document named as the file."""
    name = F.trim("book")
    v = rd(s, d, "verses").select(F.col("module_id").alias("corpus_id"), F.when(name != "", name).otherwise(F.col("module_id")).alias("doc_id"), "chapter", "verse", squeeze("text").alias("text"))
    return _all_blocks(v)


def all_numbered(s: SparkSession, d: str) -> DataFrame:
    """Every verse with a text, whatever its characters, place (0 and null: unset) and copies; these formats number 66 books."""
    names = F.create_map(*[F.lit(x) for i, b in enumerate(BOOKS, 1) for x in (i, b)])
    e = rd(s, d, "esword_bible")
    return _all_blocks(e.select(F.col("module_id").alias("corpus_id"), names[F.col("book")].alias("doc_id"), "chapter", "verse", squeeze("scripture").alias("text")).where("doc_id IS NOT NULL"))


def _all_blocks(df: DataFrame) -> DataFrame:
    place = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chapter", "verse")]
    return df.where("text <> ''").select("corpus_id", "doc_id", *place, "text", F.lit(0).alias("doc_order"), F.lit(None).cast("int").alias("verse_end")).withColumn("sequence", F.col("chapter") * 1000 + F.col("verse"))


def round_trip(fmt: str, s: SparkSession, d: str) -> DataFrame:
    made = registry.emit((all_named if fmt in NAMED else all_numbered)(s, d), fmt)
    return registry.read_blocks(made, fmt).select("corpus_id", "doc_id", "chapter", "verse", "text")


def places(s: SparkSession, d: str) -> DataFrame:
    """One text per place of the 66 books, for formats whose places name their verses."""
    return all_numbered(s, d).where("chapter > 0 AND verse > 0").groupBy("corpus_id", "doc_id", "doc_order", "chapter", "verse", "verse_end", "sequence").agg(F.min("text").alias("text"))


def place_trip(fmt: str, s: SparkSession, d: str) -> DataFrame:
    """Formats that know a place once; the word tables hold the New Testament, and two digits of chapter and verse."""
    v, canon = places(s, d), None
    if fmt in ("morphgnt", "sblgnt"):
        v = v.where(F.col("doc_id").isin(BOOKS[39:]) & (F.col("chapter") < 100) & (F.col("verse") < 100))
    if fmt == "theword":
        rows = v.groupBy("doc_id", "chapter").agg(F.max("verse").alias("n")).collect()  # a numbering system: one row a chapter
        last = {(r.doc_id, r.chapter): r.n for r in rows}
        canon = {side: [(b, c, last[b, c]) for b in books for c in sorted(c for x, c in last if x == b)] for side, books in (("ot", BOOKS[:39]), ("nt", BOOKS[39:]))}
    return registry.read_blocks(registry.emit(v, fmt, canon=canon), fmt, canon).select("corpus_id", "doc_id", "chapter", "verse", "text")


def text_trip(fmt: str, s: SparkSession, d: str) -> DataFrame:
    """Formats that keep texts without their places, or without their book."""
    keep = ["corpus_id", "chapter", "verse", "text"] if fmt == "rtf" else ["corpus_id", "text"]
    return registry.read_blocks(registry.emit(all_named(s, d), fmt), fmt).select(*keep)


def side_tables(mysword: bool, s: SparkSession, d: str) -> DataFrame:
    """Commentaries and dictionaries of the SQLite family: every verse as a comment on itself and the next one, and as an entry."""
    fmt = "mysword" if mysword else "esword"

    def write(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        n = lambda a: 0 if pd.isna(a) else int(a)
        verses = [Verse(b, n(c), n(v), t, n(v) + 1) for b, c, v, t in zip(x.doc_id, x.chapter, x.verse, x.text)]
        body = database.write_side_tables(verses, [(f"w{c}.{v}.{i}", t) for i, (c, v, t) in enumerate(zip(x.chapter, x.verse, x.text))], mysword)
        return pd.DataFrame({"name": [f"{key[0]}.cmtx"], "content": [body]})

    made = all_numbered(s, d).groupBy("corpus_id").applyInPandas(write, "name string, content binary")
    got = registry.read_blocks(made, fmt)
    entry = F.col("doc_id").startswith("w")
    return got.select("corpus_id", F.when(entry, "entry").otherwise("comment").alias("kind"), F.when(~entry, F.col("doc_id")).alias("doc_id"), F.when(~entry, F.col("chapter")).alias("chapter"), F.when(~entry, F.col("verse_end")).alias("verse_end"), "text")


def binary_trip(s: SparkSession, d: str) -> DataFrame:
    """Compressed verse-keyed modules written from whole tables and read by block and verse index."""
    v = places(s, d)
    last = {(r.doc_id, r.chapter): r.n for r in v.groupBy("doc_id", "chapter").agg(F.max("verse").alias("n")).collect()}  # a numbering system
    canon = {side: [(b, c, last[b, c]) for b in books for c in sorted(c for x, c in last if x == b)] for side, books in (("ot", BOOKS[:39]), ("nt", BOOKS[39:]))}

    def write(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        verses, rows = [Verse(*r) for r in zip(x.doc_id, x.chapter, x.verse, x.text)], []
        for side in ("ot", "nt"):
            rows += [(f"/m/{key[0]}/{side}.{end}", f"{side}.{end}", part) for end, part in zip(("bzs", "bzv", "bzz"), binary.write_ztext(verses, canon[side]))]
        return pd.DataFrame(rows, columns=["path", "name", "content"])

    files = v.withColumn("text", strip_markup("text")).where("text <> ''").groupBy("corpus_id").applyInPandas(write, "path string, name string, content binary")
    return registry.binary_modules(files, canon).select("corpus_id", "doc_id", "chapter", "verse", "text")


def lexicon_trip(s: SparkSession, d: str) -> DataFrame:
    """Compressed lexicons of documents by title."""

    def write(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        parts = binary.write_zld(dict(zip(x.title, x.text)))
        return pd.DataFrame([(f"/m/{key[0]}.{e}", f"{key[0]}.{e}", p) for e, p in zip(("idx", "dat", "zdx", "zdt"), parts)], columns=["path", "name", "content"])

    one = rd(s, d, "documents").where("source IS NOT NULL AND title IS NOT NULL AND text IS NOT NULL").groupBy("source", "title").agg(F.min("text").alias("text"))
    return registry.lexicons(one.groupBy("source").applyInPandas(write, "path string, name string, content binary"))


def tree_trip(s: SparkSession, d: str) -> DataFrame:
    """Tree-keyed modules: each module's books below its root, with the number of their verses as text; with children and paths."""

    def write(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        parts = binary.write_genbook([(-1, "", ""), *((0, b, str(n)) for b, n in sorted(zip(x.book, x.n)))])
        return pd.DataFrame([(f"/m/{key[0]}.{e}", f"{key[0]}.{e}", p) for e, p in zip(("idx", "dat", "bdt"), parts)], columns=["path", "name", "content"])

    books = rd(s, d, "verses").where("length(book) > 0").groupBy("module_id", "book").agg(F.count("*").alias("n"))
    nodes = registry.tree_modules(books.groupBy("module_id").applyInPandas(write, "path string, name string, content binary"))
    return nodes.where("parent >= 0").select("module", F.col("name").alias("book"), F.col("text").alias("n"))


def transcript_trip(s: SparkSession, d: str) -> DataFrame:
    """Events written as a transcript of JSON lines in two parts, and read again."""
    at = f"{shared_dir(s)}/transcript-{uuid.uuid4().hex}"
    e = rd(s, d, "events").select(F.upper("event_type").alias("t"), F.col("event_id").alias("seq"), *[F.lit(None).cast("string").alias(c) for c in ("engine_id", "plugin_id", "plugin_version", "module")], F.col("user_id").cast("string").alias("key"), *[F.lit(None).cast("string").alias(c) for c in ("profile", "sha256", "blake3")], F.lit(None).cast("bigint").alias("bytes"), F.col("props").alias("message"), F.create_map(F.lit("v"), F.lit("1")).alias("attributes"))
    windows.write_transcripts(e.where("seq % 2 = 0"), at)
    windows.write_transcripts(e.where("seq % 2 = 1"), at)
    return windows.read_transcripts(s, at).select("t", "seq", "key", "message", F.col("attributes")["v"].alias("v"))


def ir_nested(s: SparkSession, d: str) -> DataFrame:
    """Corpora nested to one row each, counted after un-nesting."""
    v = all_named(s, d).withColumn("block_id", F.concat_ws(".", "doc_id", "chapter", "verse"))
    docs = v.groupBy("corpus_id", "doc_id").agg(F.min("chapter").alias("doc_order")).withColumn("title", F.col("doc_id"))
    nested = ir_json.nest(docs, v)
    return nested.select("corpus_id", F.size("documents").alias("n_documents"), F.aggregate(F.transform("documents", lambda x: F.size(x["content_blocks"])), F.lit(0), lambda a, b: a + b).alias("n_blocks"))


_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_BOOK_SQL = "[" + ", ".join(f"'{b}'" for b in BOOKS) + "][book]"
_NAMED = f"SELECT module_id AS corpus_id, coalesce(nullif(trim(book), ''), module_id) AS doc_id, nullif(chapter, 0) AS chapter, nullif(verse, 0) AS verse, {_SQUEEZE.format('text')} AS text FROM verses WHERE {_SQUEEZE.format('text')} <> ''"
_NUMBERED = f"SELECT module_id AS corpus_id, {_BOOK_SQL} AS doc_id, nullif(chapter, 0) AS chapter, nullif(verse, 0) AS verse, {_SQUEEZE.format('scripture')} AS text FROM esword_bible WHERE book BETWEEN 1 AND 66 AND {_SQUEEZE.format('scripture')} <> ''"

QUERIES = {f"format_{f}": partial(round_trip, f) for f in NAMED + NUMBERED} | {"ir_nested": ir_nested}
ORACLE = {f"format_{f}": _NAMED for f in NAMED} | {f"format_{f}": _NUMBERED for f in NUMBERED} | {"ir_nested": f"WITH v AS ({_NAMED}) SELECT corpus_id, count(DISTINCT doc_id)::INT AS n_documents, count(*)::INT AS n_blocks FROM v GROUP BY corpus_id"}

_PLACES = f"SELECT corpus_id, doc_id, chapter, verse, min(text) AS text FROM ({_NUMBERED}) WHERE chapter > 0 AND verse > 0 GROUP BY ALL"
_COMMENT = f"SELECT corpus_id, 'comment' AS kind, doc_id, chapter, coalesce(verse, 0) + 1 AS verse_end, text FROM ({_NUMBERED}) UNION ALL SELECT corpus_id, 'entry', NULL, NULL, NULL, text FROM ({_NUMBERED})"
_STRIPPED = "trim(replace(regexp_replace(text, '<[^>]*>?', '', 'g'), '>', ''), e' \\t\\n\\r')"

QUERIES |= {f"format_{f}": partial(place_trip, f) for f in ("morphgnt", "sblgnt", "oshb", "theword")}
ORACLE |= {f"format_{f}": _PLACES for f in ("oshb", "theword")} | {f"format_{f}": f"SELECT * FROM ({_PLACES}) WHERE list_position([{', '.join(repr(b) for b in BOOKS)}], doc_id) > 39 AND chapter < 100 AND verse < 100" for f in ("morphgnt", "sblgnt")}
QUERIES |= {f"format_{f}": partial(text_trip, f) for f in ("rtf", "flex", "gobible", "accordance", "logos")}
ORACLE |= {"format_rtf": f"SELECT corpus_id, chapter, verse, text FROM ({_NAMED})", "format_flex": f"SELECT corpus_id, text FROM ({_NAMED})", "format_gobible": f"SELECT corpus_id, text FROM ({_NAMED}) WHERE length(text) > 10"}
ORACLE |= {f"format_{f}": f"SELECT corpus_id, text FROM ({_NAMED}) WHERE strlen(text) > 10" for f in ("accordance", "logos")}
QUERIES |= {"format_esword_side_tables": partial(side_tables, False), "format_mysword_side_tables": partial(side_tables, True), "format_binary_modules": binary_trip, "format_lexicons": lexicon_trip, "format_tree_modules": tree_trip, "format_transcripts": transcript_trip}
ORACLE |= {
    "format_esword_side_tables": _COMMENT,
    "format_mysword_side_tables": _COMMENT,
    "format_binary_modules": f"SELECT corpus_id, doc_id, chapter, verse, {_STRIPPED} AS text FROM ({_PLACES}) WHERE {_STRIPPED} <> ''",
    "format_lexicons": "SELECT source AS module, title AS key, min(text) AS text FROM documents WHERE source IS NOT NULL AND title IS NOT NULL AND text IS NOT NULL GROUP BY ALL",
    "format_tree_modules": "SELECT module_id AS module, book, count(*)::VARCHAR AS n FROM verses WHERE length(book) > 0 GROUP BY ALL",
    "format_transcripts": "SELECT upper(event_type) AS t, event_id AS seq, user_id::VARCHAR AS key, props AS message, '1' AS v FROM events",
}
