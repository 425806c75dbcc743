"""Column functions on references: REF = struct<book, chapter, verse, chapter_end, verse_end, sub_verse, osis_id>, 0 or null = unset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioform.schema import BOOKS
from folioform.sources.model import CODES

OSIS = r"^([1-4]?[A-Z][A-Za-z]*)(?:\.(\d+)(?:\.(\d+)([a-z])?(?:-(?:[1-4]?[A-Z][A-Za-z]*\.)?(?:(\d+)\.)?(\d+))?)?)?$"
HUMAN = r"^\s*([1-4]?\s*\p{L}[\p{L}. ]*?)\s*(\d+)?(?:\s*[:.]\s*(\d+)([a-z])?)?(?:\s*[-–]\s*(?:(\d+)\s*[:.]\s*)?(\d+))?\s*$"


def _int(c: Column) -> Column:
    return F.when(c != "", c).cast("int")


def _ref(text: Column, pattern: str, book: Column) -> Column:
    g = lambda i: F.regexp_extract(text, pattern, i)
    ref = F.struct(book.alias("book"), _int(g(2)).alias("chapter"), _int(g(3)).alias("verse"), _int(g(5)).alias("chapter_end"), _int(g(6)).alias("verse_end"), F.when(g(4) != "", g(4)).alias("sub_verse"))
    return F.when(text.rlike(pattern), ref.withField("osis_id", format_osis(ref)))


def parse_osis(text: Column) -> Column:
    """``Book[.C[.V[a][-E]]]`` as a REF; null if it is none."""
    return _ref(text, OSIS, F.regexp_extract(text, OSIS, 1))


def parse_human(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """``Book c:v[-e]`` or ``Book c:v-c:v`` as a REF. ``aliases`` {name in lower case: id} normalises books; unknown ones stay."""
    name = F.regexp_replace(F.regexp_extract(text, HUMAN, 1), r"[.\s]+", "")
    book = name
    if aliases:
        table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.replace(" ", ""), v)])
        book = F.coalesce(table[F.lower(name)], name)
    return _ref(text, HUMAN, book)


#: English names of schema.BOOKS, in their order.
BOOK_NAMES = """Genesis, Exodus, Leviticus, Numbers, Deuteronomy, Joshua, Judges, Ruth, 1 Samuel, 2 Samuel, 1 Kings, 2 Kings, 1 Chronicles, 2 Chronicles, Ezra, Nehemiah,
Esther, Job, Psalms, Proverbs, Ecclesiastes, Song of Solomon, Isaiah, Jeremiah, Lamentations, Ezekiel, Daniel, Hosea, Joel, Amos, Obadiah, Jonah, Micah, Nahum, Habakkuk,
Zephaniah, Haggai, Zechariah, Malachi, Matthew, Mark, Luke, John, Acts, Romans, 1 Corinthians, 2 Corinthians, Galatians, Ephesians, Philippians, Colossians,
1 Thessalonians, 2 Thessalonians, 1 Timothy, 2 Timothy, Titus, Philemon, Hebrews, James, 1 Peter, 2 Peter, 1 John, 2 John, 3 John, Jude, Revelation""".replace("\n", " ").split(", ")
#: Names that no rule gives.
OTHER_NAMES = {"psalm": "Ps", "songofsongs": "Song", "canticles": "Song", "apocalypse": "Rev", "qoheleth": "Eccl"}


def book_aliases() -> dict[str, str]:
    """{name in lower case without blanks: book id}: ids, English names, file codes, every prefix of a name that is of one book only
    (from two letters on), and the ordinals I, II, III, First, Second, Third for 1, 2, 3."""
    out = {b.lower(): b for b in BOOKS} | {n.lower().replace(" ", ""): b for n, b in zip(BOOK_NAMES, BOOKS)} | OTHER_NAMES | {c.lower(): b for c, b in zip(CODES, BOOKS)}
    prefixes: dict[str, set[str]] = {}
    for name, book in zip(BOOK_NAMES, BOOKS):
        n = name.lower().replace(" ", "")
        for k in range(2 + n[0].isdigit(), len(n)):
            prefixes.setdefault(n[:k], set()).add(book)
    out = {p: next(iter(bs)) for p, bs in prefixes.items() if len(bs) == 1} | out
    for word, digit in (("iii", "3"), ("ii", "2"), ("i", "1"), ("third", "3"), ("second", "2"), ("first", "1")):
        out |= {word + a[1:]: b for a, b in list(out.items()) if a[0] == digit and word + a[1:] not in out}
    return out


RANGE = r"^\s*((?:[1-3]|I{1,3}|First|Second|Third)?\s*\p{L}[\p{L}. ]*?)\s*(?:(\d+)(?:\s*[-–—]\s*(\d+)|\s*[:.]\s*(\d+)(?:\s*[-–—]\s*(?:(\d+)\s*[:.]\s*)?(\d+))?)?)?\s*$"


def parse_range(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """struct<book, chapter, verse, chapter_end, verse_end, kind>: a book, a chapter, chapters ``c-c``, a verse, verses ``c:v-v`` or
    ``c:v-c:v``; null for anything else, and for an end before its start. Names not among the ``aliases`` stay as they are."""
    g = lambda i: _int(F.regexp_extract(text, RANGE, i))
    name = F.regexp_replace(F.regexp_extract(text, RANGE, 1), r"[.\s]+", "")
    table = F.create_map(*[F.lit(x) for k, v in (book_aliases() if aliases is None else aliases).items() for x in (k.replace(" ", "").lower(), v)])
    chapter, to_chapter, verse, verses_chapter, to_verse = g(2), g(3), g(4), g(5), g(6)
    kind = F.when(chapter.isNull(), "book").when(to_chapter.isNotNull(), "chapters").when(verse.isNull(), "chapter").when(to_verse.isNull(), "verse").otherwise("verses")
    end = F.coalesce(to_chapter, verses_chapter)
    wrong = (to_chapter < chapter) | (verses_chapter < chapter) | (F.coalesce(verses_chapter, chapter) == chapter) & (to_verse < verse)
    ref = F.struct(F.coalesce(table[F.lower(name)], name).alias("book"), chapter.alias("chapter"), verse.alias("verse"), end.alias("chapter_end"), to_verse.alias("verse_end"), kind.alias("kind"))
    return F.when(text.rlike(RANGE) & ~F.coalesce(wrong, F.lit(False)), ref)


def parse_list(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """A list as in "cf. Gen 1:1; see Exod 2:3-4": array<REF>; parts that are no reference are dropped."""
    parts = F.transform(F.split(text, ";"), lambda p: F.regexp_replace(p, r"^\s*(?i:cf\.?|see(?: also)?|compare)\s+", ""))
    return F.filter(F.transform(parts, lambda p: parse_human(p, aliases)), lambda r: r.isNotNull())


def format_osis(ref: Column) -> Column:
    ch, v, ce, ve = (F.coalesce(ref[x], F.lit(0)) for x in ("chapter", "verse", "chapter_end", "verse_end"))
    point = F.concat(ref["book"], F.when(ch > 0, F.concat(F.lit("."), ch.cast("string"))).otherwise(""), F.when((ch > 0) & (v > 0), F.concat(F.lit("."), v.cast("string"), F.coalesce(ref["sub_verse"], F.lit("")))).otherwise(""))
    return F.concat(point, F.when(ve > 0, F.concat(F.lit("-"), F.when(ce > 0, F.concat(ref["book"], F.lit("."), ce.cast("string"), F.lit("."))).otherwise(""), ve.cast("string"))).otherwise(""))


def format_ref(ref: Column) -> Column:
    """The stored osis_id, else the reference spelled out."""
    return F.when(ref["osis_id"] != "", ref["osis_id"]).otherwise(format_osis(ref))


def contains(outer: Column, inner: Column) -> Column:
    """Whether ``outer`` (a book, a chapter, a verse or a range of verses) contains ``inner``."""
    z = lambda r, f: F.coalesce(r[f], F.lit(0))
    end_c = F.when(z(outer, "chapter_end") > 0, z(outer, "chapter_end")).otherwise(z(outer, "chapter"))
    at = F.struct(z(inner, "chapter"), z(inner, "verse"))
    ranged = at.between(F.struct(z(outer, "chapter"), z(outer, "verse")), F.struct(end_c, z(outer, "verse_end")))
    return (outer["book"] == inner["book"]) & F.when(z(outer, "chapter") == 0, True).when((z(outer, "verse") == 0), z(outer, "chapter") == z(inner, "chapter")).when(z(outer, "verse_end") > 0, ranged).otherwise((z(outer, "chapter") == z(inner, "chapter")) & (z(outer, "verse") == z(inner, "verse")))


def in_range(book: Column, chapter: Column, verse: Column, start: Column, end: Column) -> Column:
    """Same book, and (chapter, verse) between start and end as tuples."""
    at = F.struct(chapter, verse)
    return (book == start["book"]) & (book == end["book"]) & at.between(F.struct(start["chapter"], start["verse"]), F.struct(end["chapter"], end["verse"]))


def block_ref(block_id: Column) -> Column:
    """(chapter, verse) parsed from a block id ``Book.C.V``; nulls for ids of the other conventions."""
    return F.struct(_int(F.regexp_extract(block_id, r"\.(\d+)\.(\d+)", 1)).alias("chapter"), _int(F.regexp_extract(block_id, r"\.(\d+)\.(\d+)", 2)).alias("verse"))


def crossref_index(xrefs: DataFrame, source: str, target: str) -> DataFrame:
    """Cross references under both their ends: ``side`` (source or target), ``ref``, and the reference's other columns. No shuffle; look-ups filter by (side, ref)."""
    ends = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("ref")) for side, c in (("source", source), ("target", target))])
    return xrefs.withColumn("_e", F.explode(ends)).select("_e.side", "_e.ref", *xrefs.columns).where("ref IS NOT NULL")
