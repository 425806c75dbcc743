"""What every reader yields and every sink takes: verses with their place."""

from __future__ import annotations

from dataclasses import dataclass

from folioform.schema import BOOKS

#: Fixed three-letter book codes in the order of schema.BOOKS.
CODES = """GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB
ZEP HAG ZEC MAL MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV""".split()
BOOK_OF_CODE = dict(zip(CODES, BOOKS))
CODE_OF_BOOK = {b: c for c, b in BOOK_OF_CODE.items()}
NUMBER_OF_BOOK = {b: i + 1 for i, b in enumerate(BOOKS)}


def book_by_number(n: int) -> str:
    return BOOKS[n - 1] if 1 <= n <= len(BOOKS) else f"Book{n}"


def book_by_code(code: str) -> str:
    return BOOK_OF_CODE.get(code.upper(), code)


@dataclass
class Verse:
    """One block. ``chapter`` and ``verse`` of 0 are unset; ``doc`` is the book, article or entry it belongs to."""

    doc: str
    chapter: int
    verse: int
    text: str
    verse_end: int = 0
    raw: str | None = None
    title: str | None = None

    @property
    def block_id(self) -> str:
        return ".".join([self.doc, *(str(x) for x in (self.chapter, self.verse) if x)])


def chapters(verses: list[Verse]):
    """(chapter, verses) of one document, a new group whenever the chapter changes."""
    out: list[tuple[int, list[Verse]]] = []
    for v in verses:
        if not out or out[-1][0] != v.chapter:
            out.append((v.chapter, []))
        out[-1][1].append(v)
    return out


def documents(verses: list[Verse]):
    """(doc, verses) in the order first seen."""
    out: dict[str, list[Verse]] = {}
    for v in verses:
        out.setdefault(v.doc, []).append(v)
    return list(out.items())
