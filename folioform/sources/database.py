"""Readers and sinks of the SQLite family. A file's bytes are opened in memory, wherever the task runs; no temporary file is made."""

from __future__ import annotations

import html
import sqlite3
from collections import Counter
from collections.abc import Iterator

from folioform.sources.model import NUMBER_OF_BOOK, Verse, book_by_number, documents
from folioform.sources.textual import SPACE, strip_html, strip_rtf

MAGIC = b"SQLite format 3\x00"


def open_bytes(data: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def tables(con: sqlite3.Connection) -> dict[str, list[str]]:
    """{table: its columns}."""
    names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') ORDER BY name")]
    return {n: [c[1] for c in con.execute(f'PRAGMA table_info("{n}")')] for n in names}


def table_counts(data: bytes) -> list[tuple[str, int]]:
    con = open_bytes(data)
    return [(t, con.execute(f'SELECT count(*) FROM "{t}"').fetchone()[0]) for t in tables(con)]


def _pick(found: dict[str, list[str]], *names: str) -> str | None:
    low = {t.lower(): t for t in found}
    return next((low[n.lower()] for n in names if n.lower() in low), None)


def _is_rtf(t: str) -> bool:
    return t.startswith("{\\rtf") or "\\par" in t


def _stored(t: str) -> str:
    """The reverse of _text: what it would take for markup is escaped."""
    return html.escape(t, quote=False).replace("\\", "&#92;") if _is_rtf(t) or "<" in t or "&" in t else t


def _text(t) -> str:
    t = "" if t is None else str(t)
    return strip_rtf(t) if _is_rtf(t) else strip_html(t) if "<" in t or "&" in t else t.strip(SPACE)


def _verses(con, table: str, book: str, chapter: str, verse: str, text: str, name_of) -> Iterator[Verse]:
    for b, c, v, t in con.execute(f'SELECT "{book}", "{chapter}", "{verse}", "{text}" FROM "{table}" ORDER BY 1, 2, 3'):
        if plain := _text(t):
            yield Verse(name_of(b), int(c or 0), int(v or 0), plain, raw=None if t == plain else str(t))


def read_sqlite(name: str, data: bytes) -> Iterator[Verse]:
    """Tables verses (id, book, chapter, verse, text) and books (id, name, book_order), if there are any."""
    con = open_bytes(data)
    if _pick(tables(con), "verses"):
        yield from _verses(con, "verses", "book", "chapter", "verse", "text", str)


def write_sqlite(verses: list[Verse]) -> bytes:
    con = sqlite3.connect(":memory:")
    con.executescript("CREATE TABLE meta (id TEXT, title TEXT, language TEXT, description TEXT, version TEXT); CREATE TABLE books (id TEXT PRIMARY KEY, name TEXT, book_order INTEGER); CREATE TABLE verses (id TEXT PRIMARY KEY, book TEXT, chapter INTEGER, verse INTEGER, text TEXT);")
    con.executemany("INSERT INTO books VALUES (?, ?, ?)", [(d, vs[0].title or d, i) for i, (d, vs) in enumerate(documents(verses), 1)])
    times = Counter()
    for v in verses:  # a place may have several texts; ids stay unique
        times[v.block_id] += 1
        n = times[v.block_id]
        con.execute("INSERT INTO verses VALUES (?, ?, ?, ?, ?)", (v.block_id if n == 1 else f"{v.block_id}#{n}", v.doc, v.chapter, v.verse, _stored(v.text)))
    con.commit()
    return con.serialize()


def read_esword(name: str, data: bytes) -> Iterator[Verse]:
    """Bible (Book, Chapter, Verse, Scripture), Commentary (Book, ChapterBegin, ...) or Dictionary (Topic, Definition)."""
    con = open_bytes(data)
    found = tables(con)
    if t := _pick(found, "Bible"):
        yield from _verses(con, t, "Book", "Chapter", "Verse", "Scripture", lambda b: book_by_number(int(b or 0)))
    yield from _comments(con, found)
    if t := _pick(found, "Dictionary"):
        yield from _entries(con, t, found[t])


def _comments(con, found: dict[str, list[str]]) -> Iterator[Verse]:
    if t := _pick(found, "Commentary", "commentaries", "VerseCommentary"):
        cols = {c.lower(): c for c in found[t]}
        get = [cols.get(x, None) for x in ("book", "chapterbegin", "versebegin", "verseend", "comments")]
        if all(get):
            for b, c, v, e, x in con.execute("SELECT " + ", ".join(f'"{g}"' for g in get) + f' FROM "{t}" ORDER BY 1, 2, 3'):
                if plain := _text(x):
                    yield Verse(book_by_number(int(b or 0)), int(c or 0), int(v or 0), plain, int(e or 0))


def _entries(con, table: str, cols: list[str]) -> Iterator[Verse]:
    low = {c.lower(): c for c in cols}
    key, val = low.get("topic") or low.get("word"), low.get("definition") or low.get("data")
    if key and val:
        for i, (k, x) in enumerate(con.execute(f'SELECT "{key}", "{val}" FROM "{table}" ORDER BY 1'), 1):
            if plain := _text(x):
                yield Verse(str(k), 0, i, plain, title=str(k))


def write_esword(verses: list[Verse]) -> bytes:
    con = sqlite3.connect(":memory:")
    con.executescript("CREATE TABLE Details (Title TEXT, Abbreviation TEXT, Information TEXT, Version TEXT, Font TEXT, RightToLeft INT); CREATE TABLE Bible (Book INT, Chapter INT, Verse INT, Scripture TEXT);")
    con.executemany("INSERT INTO Bible VALUES (?, ?, ?, ?)", [(NUMBER_OF_BOOK[v.doc], v.chapter, v.verse, _stored(v.text)) for v in verses if v.doc in NUMBER_OF_BOOK])
    con.commit()
    return con.serialize()


def write_side_tables(verses: list[Verse], entries: list[tuple[str, str]], mysword: bool = False) -> bytes:
    """A commentary (a comment per verse, up to its ``verse_end``) and a dictionary, in the tables of either program."""
    con = sqlite3.connect(":memory:")
    comments, words = ("commentaries", "dictionary (word TEXT, data TEXT)") if mysword else ("Commentary", "Dictionary (Topic TEXT, Definition TEXT)")
    con.executescript(f"CREATE TABLE {comments} (Book INT, ChapterBegin INT, ChapterEnd INT, VerseBegin INT, VerseEnd INT, Comments TEXT); CREATE TABLE {words};")
    con.executemany(f"INSERT INTO {comments} VALUES (?, ?, ?, ?, ?, ?)", [(NUMBER_OF_BOOK[v.doc], v.chapter, v.chapter, v.verse, v.verse_end, _stored(v.text)) for v in verses if v.doc in NUMBER_OF_BOOK])
    con.executemany(f"INSERT INTO {words.partition(' ')[0]} VALUES (?, ?)", [(k, _stored(t)) for k, t in entries])
    con.commit()
    return con.serialize()


def write_probe(verses: list[Verse], table: str = "AccVerses") -> bytes:
    """A database with one table of texts, as Accordance and Logos modules are probed for; places are not kept."""
    con = sqlite3.connect(":memory:")
    con.execute(f'CREATE TABLE "{table}" (id INTEGER, body TEXT)')
    con.executemany(f'INSERT INTO "{table}" VALUES (?, ?)', [(i, _stored(v.text)) for i, v in enumerate(verses, 1)])
    con.commit()
    return con.serialize()


def read_mysword(name: str, data: bytes) -> Iterator[Verse]:
    """As e-Sword, the scripture table being Books or Bible; markup is HTML."""
    con = open_bytes(data)
    found = tables(con)
    if t := _pick(found, "Books", "Bible"):
        cols = {c.lower(): c for c in found[t]}
        if {"book", "chapter", "verse", "scripture"} <= set(cols):
            yield from _verses(con, t, cols["book"], cols["chapter"], cols["verse"], cols["scripture"], lambda b: book_by_number(int(b or 0)))
    yield from _comments(con, found)
    if t := _pick(found, "dictionary"):
        yield from _entries(con, t, found[t])


def write_mysword(verses: list[Verse]) -> bytes:
    con = sqlite3.connect(":memory:")
    con.executescript("CREATE TABLE Details (title TEXT, description TEXT, version TEXT); CREATE TABLE Books (Book INT, Chapter INT, Verse INT, Scripture TEXT);")
    con.executemany("INSERT INTO Books VALUES (?, ?, ?, ?)", [(NUMBER_OF_BOOK[v.doc], v.chapter, v.verse, _stored(v.text)) for v in verses if v.doc in NUMBER_OF_BOOK])
    con.commit()
    return con.serialize()


def _mybible_book(n: int) -> str:
    """Book numbers are tens, with gaps for books outside the 66."""
    return book_by_number(n // 10 if n < 470 else (n // 10) - 7) if n % 10 == 0 and 10 <= n <= 730 else f"Book{n}"


def read_mybible(name: str, data: bytes) -> Iterator[Verse]:
    con = open_bytes(data)
    if _pick(tables(con), "verses"):
        yield from _verses(con, "verses", "book_number", "chapter", "verse", "text", lambda b: _mybible_book(int(b or 0)))


def write_mybible(verses: list[Verse]) -> bytes:
    con = sqlite3.connect(":memory:")
    con.executescript("CREATE TABLE info (name TEXT, value TEXT); CREATE TABLE verses (book_number INT, chapter INT, verse INT, text TEXT);")
    num = {_mybible_book(n): n for n in range(10, 740, 10)}
    con.executemany("INSERT INTO verses VALUES (?, ?, ?, ?)", [(num[v.doc], v.chapter, v.verse, _stored(v.text)) for v in verses if v.doc in num])
    con.commit()
    return con.serialize()


def module_info(data: bytes) -> dict[str, str]:
    """Key-value tables (info, details, meta) pivoted to one map."""
    con, out = open_bytes(data), {}
    for t, cols in tables(con).items():
        if t.lower() in ("info", "details", "meta"):
            if [c.lower() for c in cols[:2]] == ["name", "value"]:
                out |= {str(k): str(v) for k, v in con.execute(f'SELECT name, value FROM "{t}"')}
            elif row := con.execute(f'SELECT * FROM "{t}"').fetchone():
                out |= {c: str(v) for c, v in zip(cols, row) if v is not None}
    return out


def read_probe(name: str, data: bytes, candidates: tuple[str, ...] = (), least: int = 10) -> Iterator[Verse]:
    """Unknown databases: of every candidate table (all, if none is named) the first text column of more than ``least`` bytes, whole."""
    con = open_bytes(data)
    n = 0
    found = {t.lower(): t for t in tables(con)}
    for t in [found[c] for c in candidates if c in found] if candidates else found.values():
        for row in con.execute(f'SELECT * FROM "{t}"'):
            texts = [x for x in row if isinstance(x, str) and len(x.encode()) > least]
            if texts:
                n += 1
                yield Verse(name, 0, n, _text(texts[0]))


def looks_sqlite(data: bytes) -> bool:
    return data.startswith(MAGIC)


