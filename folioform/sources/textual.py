"""Readers and sinks of line-oriented and markup formats. A reader takes the bytes of one file, a sink the verses of one corpus."""

from __future__ import annotations

import html as html_lib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

from folioform.sources.model import CODE_OF_BOOK, NUMBER_OF_BOOK, Verse, book_by_code, book_by_number, chapters, documents

#: White space that readers fold. Others (no-break space, line separators, C1 characters) are part of the text.
SPACE = " \t\n\r\f\v"
_WS = re.compile(f"[{SPACE}]+")
#: Characters no XML 1.0 document can hold.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")


def clean(t: str) -> str:
    return _WS.sub(" ", t).strip(SPACE)


def xml_text(t: str) -> str:
    """Escaped text; a character XML cannot hold becomes U+FFFD, as it would cost the whole file."""
    return escape(_NO_XML.sub("\ufffd", t))


def lines_of(data: bytes) -> list[str]:
    """Lines end in CR, LF or both; other separators (U+0085, U+2028) are part of the text."""
    lines = re.split("\r\n|\n|\r", data.decode("utf-8-sig", "replace"))
    return lines[:-1] if lines[-1] == "" else lines


def local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _tree(data: bytes) -> ET.Element | None:
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        return None


# ---- line formats --------------------------------------------------------------------------------------------------------

_INLINE = re.compile(r"\\\+?[a-z]+\d?\*|\\\+?[a-z]+\d?\s?|\|[^\\]*(?=\\)")
_FOOT = re.compile(r"\\(f|x|fe)\b.*?\\\1\*", re.S)


def read_usfm(name: str, data: bytes, keep_inline: bool = False) -> Iterator[Verse]:
    """``\\id \\c \\v``; paragraph markers and continuation lines extend the verse; notes are dropped, inline markers too unless kept."""
    body = data.decode("utf-8-sig", "replace")
    book, chapter, title = name, 0, None
    for m in re.finditer(r"\\id\s+([\w-]+)|\\(?:h|mt1?)\s+([^\\\n]+)|\\c\s+(\d+)|\\v\s+(\d+)(?:-(\d+))?\s*((?:(?!\\c\s|\\v\s|\\id\s).)*)", body, re.S):
        if m[1]:
            book, chapter, title = book_by_code(m[1]), 0, None
        elif m[2]:
            title = title or clean(m[2])
        elif m[3]:
            chapter = int(m[3])
        if not m[4]:
            continue
        raw = re.sub(r"\\(?:s\d?|r|ms\d?|mt\d?|d)\s[^\n]*", "", m[6])
        text = clean(raw if keep_inline else _INLINE.sub("", _FOOT.sub("", raw)))
        if text:
            yield Verse(book, chapter, int(m[4]), text, int(m[5] or 0), clean(m[6]), title)


def write_usfm(verses: list[Verse]) -> bytes:
    out = []
    for doc, vs in documents(verses):
        out += [f"\\id {CODE_OF_BOOK.get(doc, doc)}", f"\\h {vs[0].title or doc}"]
        for c, own in chapters(vs):
            out += [f"\\c {c}", "\\p"] + [f"\\v {v.verse}{f'-{v.verse_end}' if v.verse_end else ''} {v.text}" for v in own]
    return ("\n".join(out) + "\n").encode()


def read_txt(name: str, data: bytes) -> Iterator[Verse]:
    """``[Book] c:v text``; the book is carried forward."""
    book = name
    for line in lines_of(data):
        if m := re.match(r"(?:([1-4]?\s?\w[\w-]*)\s+)?(\d+):(\d+)\s+(.+)$", line.strip()):
            book = (m[1] or book).replace(" ", "")
            yield Verse(book, int(m[2]), int(m[3]), m[4].strip(), raw=line)


def write_txt(verses: list[Verse]) -> bytes:
    return "".join(f"{v.doc} {v.chapter}:{v.verse} {v.text}\n" for v in verses).encode()


def read_sfm(name: str, data: bytes) -> Iterator[Verse]:
    """Standard-format markers; lines without one continue the verse."""
    book, chapter, at, parts = name, 0, 0, []

    def flush():
        if at and parts:
            yield Verse(book, chapter, at, clean(" ".join(parts)))

    for line in [*lines_of(data), "\\end"]:
        m = re.match(r"\\(\w+)\s*(.*)$", line.strip())
        if not m:
            parts.append(line.strip())
            continue
        if m[1] in ("id", "c", "v", "end"):
            yield from flush()
            at, parts = 0, []
        if m[1] == "id":
            book = book_by_code(m[2].split()[0]) if m[2].split() else name
        elif m[1] == "c" and (n := re.match(r"\d+", m[2])):
            chapter = int(n[0])
        elif m[1] == "v" and (n := re.match(r"(\d+)\s*(.*)", m[2])):
            at, parts = int(n[1]), [n[2]]


def write_sfm(verses: list[Verse]) -> bytes:
    out = []
    for doc, vs in documents(verses):
        out.append(f"\\id {CODE_OF_BOOK.get(doc, doc)}")
        for c, own in chapters(vs):
            out += [f"\\c {c or 1}"] + [f"\\v {v.verse} {v.text}" for v in own]
    return ("\n".join(out) + "\n").encode()


def read_markdown(name: str, data: bytes) -> Iterator[Verse]:
    """Front matter ``book:``, ``## Chapter n``, ``**n** text``."""
    body = data.decode("utf-8-sig", "replace")
    book, title, chapter, front = name, None, 1, False
    for line in body.splitlines():
        if line.strip() == "---":
            front, chapter = not front, 1
        elif front and (m := re.match(r"(book|title):\s*(.*)$", line)):
            book, title = (m[2].strip(), title) if m[1] == "book" else (book, m[2].strip() or None)
        elif m := re.match(r"##\s+\D*(\d+)", line):
            chapter = int(m[1])
        elif m := re.match(r"\*\*(\d+)\*\*\s+(.+)$", line.strip()):
            yield Verse(book, chapter, int(m[1]), m[2].strip(), title=title)


def write_markdown(verses: list[Verse]) -> bytes:
    out = []
    for doc, vs in documents(verses):
        out += ["---", f"title: {vs[0].title or doc}", f"book: {doc}", "---", "", f"# {vs[0].title or doc}"]
        for c, own in chapters(vs):
            out += ["", f"## Chapter {c}", ""] + [f"**{v.verse}** {v.text}" for v in own]
    return ("\n".join(out) + "\n").encode()


def read_onlinebible(name: str, data: bytes) -> Iterator[Verse]:
    for line in lines_of(data):
        if m := re.match(r"\$([\w-]+)\s+(\d+):(\d+)\s+(.*)$", line):
            yield Verse(m[1], int(m[2]), int(m[3]), m[4].strip(), raw=line)


def write_onlinebible(verses: list[Verse]) -> bytes:
    return "".join(f"${v.doc} {v.chapter}:{v.verse} {v.text}\n" for v in verses).encode()


def _word_rows(data: bytes, key: re.Pattern, word: int) -> Iterator[Verse]:
    """Word-per-line tables: the first column starts with book, chapter and verse; words of a verse are joined in order."""
    now, words = None, []
    for line in [*lines_of(data), ""]:
        cols = re.split(r"[ \t]+", line.strip(SPACE)) if line.strip(SPACE) else []
        m = key.match(cols[0]) if cols else None
        at = (int(m[1]), int(m[2]), int(m[3])) if m else None
        if at != now and now and words:
            yield Verse(book_by_number(now[0]), now[1], now[2], " ".join(words))
            words = []
        now = at
        if at and len(cols) > abs(word) - (word < 0):
            words.append(cols[word])


def read_morphgnt(name: str, data: bytes) -> Iterator[Verse]:
    """Seven columns, ``BBCCVV`` first; book 1 is the first of the New Testament."""
    for v in _word_rows(data, re.compile(r"(\d\d)(\d\d)(\d\d)"), 3):
        yield Verse(book_by_number(NUMBER_OF_BOOK.get(v.doc, 0) + 39), v.chapter, v.verse, v.text)


def read_sblgnt(name: str, data: bytes) -> Iterator[Verse]:
    """Last column is the word."""
    for v in _word_rows(data, re.compile(r"(\d\d)(\d\d)(\d\d)"), -1):
        yield Verse(book_by_number(NUMBER_OF_BOOK.get(v.doc, 0) + 39), v.chapter, v.verse, v.text)


def read_oshb(name: str, data: bytes) -> Iterator[Verse]:
    """``Book.c.v`` and the rest of the line; lines of one verse are joined."""
    now, parts = None, []
    for line in [*lines_of(data), ""]:
        m = re.match(r"([1-4]?[A-Z]\w*)\.(\d+)\.(\d+)[^ \t]*[ \t]+(.+)$", line, re.S)
        at = (m[1], int(m[2]), int(m[3])) if m else None
        if at != now and now:
            yield Verse(*now, " ".join(parts))
            parts = []
        now = at
        if m:
            parts.append(m[4].strip(SPACE))


def _nt_number(book: str) -> int:
    """1 for the first book of the New Testament; 0 for any other book."""
    return max(0, NUMBER_OF_BOOK.get(book, 0) - 39)


def write_morphgnt(verses: list[Verse]) -> bytes:
    """One word a line; part of speech and parsing are unknown, the word stands for its normal form and lemma. New Testament only."""
    return "".join(f"{_nt_number(v.doc):02}{v.chapter:02}{v.verse:02} -- -------- {w} {w} {w} {w}\n" for v in verses if _nt_number(v.doc) for w in clean(v.text).split(" ")).encode()


def write_sblgnt(verses: list[Verse]) -> bytes:
    return "".join(f"{_nt_number(v.doc):02}{v.chapter:02}{v.verse:02} {w}\n" for v in verses if _nt_number(v.doc) for w in clean(v.text).split(" ")).encode()


def write_oshb(verses: list[Verse]) -> bytes:
    return "".join(f"{v.doc}.{v.chapter}.{v.verse} {w}\n" for v in verses for w in clean(v.text).split(" ")).encode()


def read_theword(name: str, data: bytes, canon: list[tuple[str, int, int]] | None = None) -> Iterator[Verse]:
    """One verse a line; the line's number is the verse's place in ``canon`` (book, chapter, number of verses). Blank lines take a place."""
    places = ((b, c, v) for b, c, n in canon or [] for v in range(1, n + 1))
    for line, (b, c, v) in zip(lines_of(data), places):
        if line.strip(SPACE):
            yield Verse(b, c, v, line.strip(SPACE))


def write_theword(verses: list[Verse], canon: list[tuple[str, int, int]]) -> bytes:
    at = {(v.doc, v.chapter, v.verse): v.text for v in verses}
    return "".join(at.get((b, c, v), "") + "\n" for b, c, n in canon for v in range(1, n + 1)).encode()


# ---- JSON ----------------------------------------------------------------------------------------------------------------


def read_json(name: str, data: bytes) -> Iterator[Verse]:
    """Nested books > chapters > verses, or a flat list of verses."""
    try:
        root = json.loads(data)
    except ValueError:
        return
    if not isinstance(root, dict):
        return
    if root.get("books"):
        for b in root["books"]:
            book = b.get("id") or b.get("name") or name
            for c in b.get("chapters") or []:
                for v in c.get("verses") or []:
                    if v.get("text"):
                        yield Verse(book, int(c.get("number") or 0), int(v.get("number") or v.get("verse") or 0), v["text"], title=b.get("name"))
    else:
        for v in root.get("verses") or []:
            if v.get("text"):
                yield Verse(v.get("book") or name, int(v.get("chapter") or 0), int(v.get("verse") or 0), v["text"])


def write_json(verses: list[Verse]) -> bytes:
    books = [{"id": d, "name": vs[0].title or d, "order": i, "chapters": [{"number": c, "verses": [{"number": v.verse, "text": v.text} for v in own]} for c, own in chapters(vs)]} for i, (d, vs) in enumerate(documents(verses), 1)]
    return json.dumps({"books": books}, ensure_ascii=False).encode()


# ---- XML family ----------------------------------------------------------------------------------------------------------


class _Flow:
    """Collects text between verse marks while walking a tree in document order."""

    def __init__(self, title: str | None = None) -> None:
        self.out: list[Verse] = []
        self.book, self.chapter, self.verse, self.end, self.parts, self.title = "", 0, 0, 0, [], title

    def say(self, t: str | None) -> None:
        if t and self.verse:
            self.parts.append(t)

    def close(self) -> None:
        text = clean("".join(self.parts))
        if self.verse and text:
            self.out.append(Verse(self.book, self.chapter, self.verse, text, self.end, title=self.title))
        self.verse, self.end, self.parts = 0, 0, []

    def open(self, book: str, chapter: int, verse: int, end: int = 0) -> None:
        self.close()
        self.book, self.chapter, self.verse, self.end = book or self.book, chapter or self.chapter, verse, end


_SKIP = {"note", "title", "rdg", "header", "reference"}


def read_osis(name: str, data: bytes) -> Iterator[Verse]:
    """Container verses and milestones alike; notes and titles are no text."""
    root, f = _tree(data), _Flow()
    if root is None:
        return

    def walk(e: ET.Element) -> None:
        tag = local(e.tag)
        if tag in _SKIP:
            return
        container = False
        if tag == "div" and e.get("type") == "book":
            f.close()
            f.book = e.get("osisID") or f.book
        elif tag == "verse":
            ref = e.get("osisID") or e.get("sID")
            if e.get("eID"):
                f.close()
            elif ref and (m := re.match(r"([^.\s]+)\.(\d+)\.(\d+)", ref)):
                last = re.search(r"\.(\d+)$", ref)
                f.open(m[1], int(m[2]), int(m[3]), int(last[1]) if " " in ref and last else 0)
                container = e.get("sID") is None
        f.say(e.text)
        for x in e:
            walk(x)
            f.say(x.tail)
        if container:
            f.close()
        if tag in ("p", "l", "lg", "lb"):
            f.say(" ")
        if tag in ("chapter", "div") and not e.get("sID"):
            f.close()

    walk(root)
    f.close()
    yield from f.out


def write_osis(verses: list[Verse], work: str = "work") -> bytes:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<osis xmlns="http://www.bibletechnologies.net/2003/OSIS/namespace">', f'<osisText osisIDWork={quoteattr(work)}>', f'<header><work osisWork={quoteattr(work)}><title>{escape(work)}</title></work></header>']
    for doc, vs in documents(verses):
        out.append(f'<div type="book" osisID={quoteattr(doc)}><title>{escape(vs[0].title or doc)}</title>')
        for c, own in chapters(vs):
            out.append(f'<chapter osisID="{doc}.{c}"><p>' + "".join(f'<verse osisID="{v.block_id}">{escape(v.text)}</verse>\n' for v in own) + "</p></chapter>")
        out.append("</div>")
    return "\n".join([*out, "</osisText>", "</osis>", ""]).encode()


def read_usx(name: str, data: bytes) -> Iterator[Verse]:
    root = _tree(data)
    if root is None:
        return
    f = _Flow()
    f.book = name

    def walk(e: ET.Element) -> None:
        tag = local(e.tag)
        if tag == "note":
            return
        if tag == "book":
            f.book = book_by_code(e.get("code") or name)
            return
        if tag == "chapter":
            f.close()
            if (e.get("number") or "").isdigit():
                f.chapter = int(e.get("number"))
        elif tag == "verse":
            if e.get("eid"):
                f.close()
            elif m := re.match(r"(\d+)(?:-(\d+))?", e.get("number") or ""):
                f.open(f.book, f.chapter, int(m[1]), int(m[2] or 0))
        if tag == "para":
            f.say(" ")
        f.say(e.text)
        for x in e:
            walk(x)
            f.say(x.tail)

    walk(root)
    f.close()
    yield from f.out


def write_usx(verses: list[Verse]) -> bytes:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<usx version="3.0">']
    for doc, vs in documents(verses):
        code = CODE_OF_BOOK.get(doc, doc)
        out.append(f"<book code={quoteattr(code)} style=\"id\">{escape(vs[0].title or doc)}</book>")
        for c, own in chapters(vs):
            sid = lambda v: f"{code} {c}:{v.verse}"  # noqa: E731, B023
            out.append(f'<chapter number="{c}" style="c" sid="{code} {c}"/><para style="p">' + "".join(f'<verse number="{v.verse}{f"-{v.verse_end}" if v.verse_end else ""}" style="v" sid="{sid(v)}"/>{escape(v.text)}<verse eid="{sid(v)}"/>' for v in own) + "</para>")
    return "\n".join([*out, "</usx>", ""]).encode()


def read_zefania(name: str, data: bytes) -> Iterator[Verse]:
    root = _tree(data)
    for b in root.iter() if root is not None else ():
        if local(b.tag).upper() != "BIBLEBOOK":
            continue
        n = b.get("bnumber") or ""
        book = book_by_number(int(n)) if n.isdigit() else b.get("bname") or name
        for c in b.iter():
            if local(c.tag).upper() != "CHAPTER":
                continue
            for v in c.iter():
                if local(v.tag).upper() == "VERS" and (text := clean("".join(v.itertext()))):
                    yield Verse(book, int(c.get("cnumber") or 0), int(v.get("vnumber") or 0), text, title=b.get("bname"))


def write_zefania(verses: list[Verse]) -> bytes:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<XMLBIBLE>"]
    for i, (doc, vs) in enumerate(documents(verses), 1):
        out.append(f'<BIBLEBOOK bnumber="{NUMBER_OF_BOOK.get(doc, i + 100)}" bname={quoteattr(vs[0].title or doc)}>')
        for c, own in chapters(vs):
            out.append(f'<CHAPTER cnumber="{c}">' + "".join(f'<VERS vnumber="{v.verse}">{xml_text(v.text)}</VERS>' for v in own) + "</CHAPTER>")
        out.append("</BIBLEBOOK>")
    return "\n".join([*out, "</XMLBIBLE>", ""]).encode()


def read_xml(name: str, data: bytes) -> Iterator[Verse]:
    """Any book / chapter / verse elements with n, number, name or id attributes; empty verses are skipped."""
    root = _tree(data)
    if root is None:
        return

    def label(e: ET.Element) -> str:
        return next((e.get(a) for a in ("n", "number", "osisID", "id", "name") if e.get(a)), "")

    def walk(e: ET.Element, book: str, chapter: int) -> Iterator[Verse]:
        tag = local(e.tag).lower()
        if tag in ("book", "b"):
            book = label(e) or book
        elif tag in ("chapter", "c") and (m := re.search(r"\d+", label(e))):
            chapter = int(m[0])
        elif tag in ("verse", "v") and (m := re.search(r"(\d+)$", label(e))):
            if text := clean("".join(e.itertext())):
                yield Verse(book, chapter, int(m[1]), text)
            return
        for x in e:
            yield from walk(x, book, chapter)

    yield from walk(root, name, 0)


def write_xml(verses: list[Verse]) -> bytes:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', "<bible>"]
    for doc, vs in documents(verses):
        out.append(f"<book name={quoteattr(doc)}>")
        for c, own in chapters(vs):
            out.append(f'<chapter number="{c}">' + "".join(f'<verse number="{v.verse}">{escape(v.text)}</verse>' for v in own) + "</chapter>")
        out.append("</book>")
    return "\n".join([*out, "</bible>", ""]).encode()


def read_tei(name: str, data: bytes) -> Iterator[Verse]:
    """``div[type=book]``, ``ab`` or ``seg`` with n; else every ``p`` of more than five bytes."""
    root = _tree(data)
    if root is None:
        return
    parents = {c: p for p in root.iter() for c in p}

    def up(e: ET.Element, kind: str) -> str | None:
        while e in parents:
            e = parents[e]
            if local(e.tag) == "div" and e.get("type") == kind:
                return e.get("n")
        return None

    units = [e for e in root.iter() if local(e.tag) in ("ab", "seg") and (e.get("n") or "").isdigit()]
    for e in units:
        c = up(e, "chapter") or "0"
        if text := clean("".join(e.itertext())):
            yield Verse(up(e, "book") or name, int(c) if c.isdigit() else 0, int(e.get("n")), text)
    if not units:
        for i, e in enumerate((e for e in root.iter() if local(e.tag) == "p"), 1):
            if len((text := clean("".join(e.itertext()))).encode()) > 5:
                yield Verse(name, 0, i, text)


def write_tei(verses: list[Verse]) -> bytes:
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>corpus</title></titleStmt></fileDesc></teiHeader><text><body>']
    for doc, vs in documents(verses):
        out.append(f'<div type="book" n={quoteattr(doc)}>')
        for c, own in chapters(vs):
            out.append(f'<div type="chapter" n="{c}">' + "".join(f'<ab n="{v.verse}">{escape(v.text)}</ab>' for v in own) + "</div>")
        out.append("</div>")
    return "\n".join([*out, "</body></text></TEI>", ""]).encode()


def read_flex(name: str, data: bytes) -> Iterator[Verse]:
    """Interlinear text: the txt and punct items of a phrase's words, joined."""
    root = _tree(data)
    for i, ph in enumerate((e for e in root.iter() if local(e.tag) == "phrase") if root is not None else (), 1):
        words = [(x.text or "").strip(SPACE) for w in ph.iter() if local(w.tag) == "word" for x in w if local(x.tag) == "item" and x.get("type") in ("txt", "punct")]
        if text := " ".join(w for w in words if w):
            yield Verse(name, 1, i, text)


# ---- HTML, RTF -----------------------------------------------------------------------------------------------------------

def write_flex(verses: list[Verse]) -> bytes:
    """Interlinear text: a phrase per verse, an item per word. Places are not kept."""
    phrases = []
    for v in verses:
        words = "".join(f'<word><item type="txt" lang="x">{xml_text(w)}</item></word>' for w in clean(v.text).split(" "))
        phrases.append(f'<phrase><item type="segnum" lang="en">{v.chapter}:{v.verse}</item><words>{words}</words></phrase>')
    return ('<?xml version="1.0" encoding="utf-8"?>\n<document version="2"><interlinear-text><paragraphs><paragraph><phrases>\n' + "\n".join(phrases) + "\n</phrases></paragraph></paragraphs></interlinear-text></document>\n").encode()


_TAG = re.compile(r"<[^>]*>?")
_NBSP = re.compile(r"&nbsp;|&#160;|&#xa0;", re.I)


def strip_html(t: str) -> str:
    return clean(html_lib.unescape(_NBSP.sub(" ", _TAG.sub("", t))))


_H_CHAPTER = r"<h[1-4][^>]*>[^<]*?(\d+)\s*</h[1-4]>"
_H_VERSE = r"<(?P<el>p|span|div)\b[^>]*(?:data-verse|class=\"verse\"[^>]*\bid)=\"(?:[^\"]*?[.:\-])?(\d+)\"[^>]*>(.*?)</(?P=el)>"
_H_SUP = r"<sup[^>]*>\s*(\d+)\s*</sup>((?:(?!<sup|<h[1-4]).)*)"


def read_html(name: str, data: bytes) -> Iterator[Verse]:
    """Verses marked by data-verse or by superscript numbers; the chapter heading before a verse is its chapter."""
    body = data.decode("utf-8-sig", "replace")
    title = re.search(r"<title>([^<]*)</title>|<h1[^>]*>([^<]*)</h1>", body)
    doc, head = name, clean(title[1] or title[2] or "") or None if title else None
    chapter, marked = 1, bool(re.search(_H_VERSE, body, re.S))
    for m in re.finditer(f"<article[^>]*\\bid=\"([^\"]+)\"|{_H_CHAPTER}|{_H_VERSE if marked else _H_SUP}", body, re.S | re.I):
        if m[1]:
            doc, chapter = m[1], 1
            continue
        if m[2]:
            chapter = int(m[2])
            continue
        number, inner = (m[4], m[5]) if marked else (m[3], m[4])
        if text := re.sub(rf"^{number}\s+", "", strip_html(re.sub(r"<sup.*?</sup>", "", inner, flags=re.S))):
            yield Verse(doc, chapter, int(number), text, title=head)


def write_html(verses: list[Verse]) -> bytes:
    out = ["<!DOCTYPE html>", "<html><head><meta charset=\"utf-8\"><title>corpus</title></head><body>"]
    for doc, vs in documents(verses):
        out.append(f"<article id={quoteattr(doc)}>")
        for c, own in chapters(vs):
            out.append(f'<section class="chapter"><h2>Chapter {c}</h2>' + "".join(f'<p class="verse" data-verse="{v.verse}"><sup>{v.verse}</sup> {escape(v.text)}</p>' for v in own) + "</section>")
        out.append("</article>")
    return "\n".join([*out, "</body></html>", ""]).encode()


_RTF = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
_RTF_SKIP = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator"}


def rtf_runs(t: str) -> Iterator[tuple[str, bool, bool]]:
    """(text, bold, italic) of an RTF string: \\par and \\line are line feeds, hex and unicode escapes are decoded, tables skipped."""
    stack, skip, bold, italic = [], False, False, False
    for m in _RTF.finditer(t):
        hexa, uni, word, number, symbol, brace, plain = m.groups()
        got = None
        if brace == "{":
            stack.append((skip, bold, italic))
        elif brace == "}":
            skip, bold, italic = stack.pop() if stack else (False, False, False)
        elif word in _RTF_SKIP or symbol == "*":
            skip = True
        elif skip:
            continue
        elif hexa:
            got = bytes([int(hexa, 16)]).decode("cp1252", "replace")
        elif uni:
            got = chr(int(uni) % 65536)
        elif word in ("par", "line", "sect", "page"):
            got = "\n"
        elif word == "tab":
            got = "\t"
        elif word == "b":
            bold = number != "0"
        elif word == "i":
            italic = number != "0"
        elif word == "plain":
            bold = italic = False
        elif symbol:
            got = "\xa0" if symbol == "~" else "" if symbol in "-_" else symbol
        elif plain:
            got = plain
        if got:
            yield got, bold, italic


def strip_rtf(t: str) -> str:
    return "".join(x for x, _, _ in rtf_runs(t)).strip()


def _styled(t: str, bold: tuple[str, str], italic: tuple[str, str], esc, line: str) -> str:
    out, now = [], (False, False)
    for x, b, i in [*rtf_runs(t), ("", False, False)]:
        if (b, i) != now:
            out.append((italic[1] if now[1] else "") + (bold[1] if now[0] else "") + (bold[0] if b else "") + (italic[0] if i else ""))
            now = (b, i)
        out.append(line.join(esc(p) for p in x.split("\n")))
    return "".join(out).strip()


def rtf_to_html(t: str) -> str:
    return _styled(t, ("<b>", "</b>"), ("<i>", "</i>"), escape, "<br/>")


def rtf_to_latex(t: str) -> str:
    special = {c: "\\" + c for c in "&%$#_{}"} | {"\\": "\\textbackslash{}", "~": "\\textasciitilde{}", "^": "\\textasciicircum{}"}
    return _styled(t, ("\\textbf{", "}"), ("\\textit{", "}"), lambda x: "".join(special.get(c, c) for c in x), "\\\\\n")


def read_rtf(name: str, data: bytes) -> Iterator[Verse]:
    chapter = 1
    for line in strip_rtf(data.decode("latin-1")).split("\n"):
        if m := re.match(r"\s*Chapter\s+(\d+)\s*$", line, re.I):
            chapter = int(m[1])
        elif m := re.match(r"\s*(?:(\d+):)?(\d+)[.\s]+(\S.*)$", line):
            chapter = int(m[1] or chapter)
            yield Verse(name, chapter, int(m[2]), m[3].strip())


def _rtf_char(c: str) -> str:
    return "\\" + c if c in "\\{}" else c if c < "\x80" else f"\\u{ord(c) - 65536 if ord(c) > 32767 else ord(c)}?" if ord(c) < 65536 else "?"


def write_rtf(verses: list[Verse]) -> bytes:
    body = "".join(f"{v.chapter}:{v.verse} " + "".join(map(_rtf_char, v.text)) + "\\par\n" for v in verses)
    return ("{\\rtf1\\ansi\n" + body + "}").encode("latin-1", "replace")
