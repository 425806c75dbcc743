"""Visually identical text with different characters: one consistent form by a compiled longest-match transducer.

The transducer reads grapheme clusters (a base character with the combining marks and invisible characters that follow)
and writes their print form in one pass: invisible characters vanish, every single space becomes U+0020, full- and
half-width forms and typographic ligatures become plain letters, look-alike letters become the Latin prototype of their
shape, and accents are joined (NFC). Case, superscript figures, letters with another accent and runs of several spaces stay
apart. The mapping is precomputed and checked for conflicts: no chains, no cycles, and the form of a form is itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType

from folioform.session import materialize

#: Characters of another script drawn like a Latin letter, and that letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ѵ": "V", "ү": "y",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, and Latin letters of another design
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ո": "n", "Օ": "O", "Տ": "S", "Լ": "L", "ɡ": "g", "ɑ": "a",
    # letter-like symbols
    "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M"
}

#: Invisible characters that Unicode does not class as format characters.
EXTRA_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"
#: Blocks of presentation forms whose compatibility decompositions are typographic joins.
JOINS = ((0xFB00, 0xFB06), (0xFB13, 0xFB17), (0x0132, 0x0133), (0x01C7, 0x01CC), (0x01F1, 0x01F3))


#: Code points in which widths, spaces, joins, marks and format characters are assigned.
ASSIGNED = [*range(0x20000), *range(0xE0000, 0xE01F0)]


def build_mapping() -> dict[str, str]:
    """{character: its print form}, '' for invisible ones. Raises ValueError on a conflict."""
    out: dict[str, str] = {}

    def put(c: str, to: str, why: str) -> None:
        if c in out and out[c] != to:
            raise ValueError(f"{why} maps U+{ord(c):04X} to {to!r}, but it maps to {out[c]!r} already")
        out[c] = to

    for cp in ASSIGNED:
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or c in EXTRA_INVISIBLE:
            put(c, "", "invisible")
        elif kind == "Zs" and c != " ":
            put(c, " ", "space")
        elif (d := unicodedata.decomposition(c)).startswith(("<wide>", "<narrow>")) or d.startswith("<compat>") and any(a <= cp <= b for a, b in JOINS):
            put(c, "".join(chr(int(x, 16)) for x in d.split()[1:]), "width or join")
    for c, to in LOOKALIKES.items():
        if len(c) == 1:
            put(c, to, "look-alike")
    for c, to in list(out.items()):  # a wide or joined form of a look-alike
        out[c] = "".join(out.get(x, x) for x in unicodedata.normalize("NFD", to)) if to.strip() else to
    for c, to in out.items():
        again = "".join(out.get(x, x) for x in to)
        if again != to:
            raise ValueError(f"U+{ord(c):04X} maps to {to!r}, which maps on to {again!r}")
    return out


MAPPING = build_mapping()
#: Widths, spaces, joins and invisible characters only: what is the same letter whatever its script.
PLAIN = {c: to for c, to in MAPPING.items() if c not in LOOKALIKES}


def _class(chars: Iterator[str]) -> str:
    """A regex class of characters, runs as ranges."""
    cps, runs = sorted(map(ord, chars)), []
    for cp in cps:
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"


#: Texts of ASCII, composed Latin-1 letters and typographic punctuation only are their own print form.
_STORED = re.compile("[\\x00-\\x7f\\u00a1-\\u00ac\\u00ae-\\u00ff\\u0152\\u0153\\u2010-\\u2027]*")


class Transducer:
    """Longest-match, one-pass rewriting by clusters; outputs are memoised per cluster."""

    def __init__(self, mapping: dict[str, str]) -> None:
        self.mapping = mapping
        self.table = {ord(c): to for c, to in mapping.items()}
        marks = [chr(cp) for cp in ASSIGNED if unicodedata.combining(chr(cp))]
        hidden = [c for c, to in mapping.items() if not to]
        # precomposed letters whose base is mapped ('ё'), or whose canonical form differs, are active too
        composed = [c for cp in range(0xC0, 0x33FF) if (c := chr(cp)) not in mapping and (n := unicodedata.normalize("NFD", c)) != c and (any(x in mapping for x in n) or unicodedata.normalize("NFC", c) != c)]
        tail = _class(iter(marks + hidden))
        self.active = re.compile(f"(?s:.){tail}+|{_class(iter([*(c for c in mapping), *composed, *marks]))}")
        self.memo: dict[str, str] = {}

    def _form(self, m: re.Match) -> str:
        cluster = m[0]
        got = self.memo.get(cluster)
        if got is None:
            got = unicodedata.normalize("NFC", unicodedata.normalize("NFD", cluster.translate(self.table)).translate(self.table))
            if len(self.memo) < 200_000:
                self.memo[cluster] = got
        return got

    def __call__(self, text: str) -> str:
        if text.isascii() or _STORED.fullmatch(text):
            return text
        out = self.active.sub(self._form, text)
        return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


@lru_cache(maxsize=1)
def print_transducer() -> Transducer:
    return Transducer(MAPPING)


@lru_cache(maxsize=1)
def plain_transducer() -> Transducer:
    return Transducer(PLAIN)


def print_form(text: str) -> str:
    """The form under which texts that look the same in print are equal."""
    return print_transducer()(text)


# ---- words as they look in print -----------------------------------------------------------------------------------------

WORD = re.compile(r"[^\W_]+")
_TO_LATIN = {ord(c): to for c, to in LOOKALIKES.items() if len(c) == 1}
_LATIN_ONLY, _CYR_ONLY, _GREEK_ONLY = "latin", "cyrillic", "greek"
_BACK = {
    _CYR_ONLY: {ord(to): c for c, to in LOOKALIKES.items() if len(c) == 1 and "Ѐ" <= c <= "ӿ" and c not in "ӏӀүҮѵѴһѕЅіІјЈ"},
    _GREEK_ONLY: {ord(to): c for c, to in LOOKALIKES.items() if len(c) == 1 and "Ͱ" <= c <= "Ͽ" and c not in "ϲϳϹϿ"},
}
_AMBIGUOUS = set(LOOKALIKES) | {to for to in LOOKALIKES.values()}


def _exclusive(ranges: tuple[tuple[int, int], ...]) -> re.Pattern:
    """Letters of the ranges that are drawn in no other script."""
    return re.compile(_class(c for a, b in ranges for c in map(chr, range(a, b)) if c.isalpha() and unicodedata.normalize("NFD", c)[0] not in _AMBIGUOUS))


_EXCLUSIVE = {_LATIN_ONLY: _exclusive(((0x41, 0x5B), (0x61, 0x7B), (0xC0, 0x250))), _CYR_ONLY: _exclusive(((0x400, 0x530),)), _GREEK_ONLY: _exclusive(((0x370, 0x400), (0x1F00, 0x2000)))}
#: Texts of ASCII, Latin-1 letters and typographic punctuation only: their words are as stored.
_SIMPLE = re.compile("[\x00-\x7f\u00a0-\u00ac\u00ae-\u00ff\u0152\u0153\u2010-\u2027]*")


def _script_of(chars: str) -> str | None:
    """The script of most letters that are drawn in no other script; None if there are none."""
    n, script = max((len(p.findall(chars)), s) for s, p in _EXCLUSIVE.items())
    return script if n else None


@lru_cache(maxsize=200_000)
def _word_in(word: str, default: str | None) -> str:
    script = _script_of(word) or default or _LATIN_ONLY
    d = unicodedata.normalize("NFD", word).translate(_TO_LATIN)
    return unicodedata.normalize("NFC", d.translate(_BACK[script]) if script in _BACK else d).lower()


def print_words(text: str) -> list[str]:
    """Words (maximal runs of letters or digits, lower case) of a text as it looks in print.

    Lower case is not defined on the print form, where capital В and small в have different prototypes; so a word whose
    letters mix scripts is first rewritten in the script of its unambiguous letters (of its text's, if it has none).
    """
    if text.isascii() or _SIMPLE.fullmatch(text):
        return WORD.findall(text.lower())
    words = WORD.findall(plain_transducer()(text))
    if all(w.isascii() for w in words):
        return [w.lower() for w in words]
    default = _script_of("".join(w for w in words if not w.isascii())) or _LATIN_ONLY
    return [_word_in(w, default) for w in words]


# ---- Spark ---------------------------------------------------------------------------------------------------------------


def confusables(spark: SparkSession) -> dict[str, str]:
    """{letter of another script: the ASCII letter drawn like it}, beyond LOOKALIKES, from the public confusables data (UTS 39) of
    the ICU library that Spark brings along; see confusables_version.

    A letter goes to the ASCII letter of its own case with the same skeleton, one without case to a capital if there is one.
    Conflict check: where two letters of one script and case have the same skeleton, readers of that script tell them
    apart, and neither is taken. Letters of the Latin script are left to LOOKALIKES, styled ones to themselves.
    """
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    ascii_letters = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    letters = [c for c in map(chr, ASSIGNED) if c > "\x7f" and unicodedata.category(c) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(c) and unicodedata.name(c, "LATIN").split()[0] not in ("LATIN", "CJK", "HANGUL", "MODIFIER", "MATHEMATICAL")]
    skeletons = checker.getSkeleton("\n".join(ascii_letters + letters)).split("\n")
    plain: dict[tuple[str, str], str] = {}
    for c, k in zip(ascii_letters, skeletons):
        plain.setdefault((k, unicodedata.category(c)), c)
    met: dict[tuple[str, str, str], list[str]] = {}
    for c, k in zip(letters, skeletons[len(ascii_letters) :]):
        case = unicodedata.category(c)
        to = plain.get((k, case)) if case != "Lo" else plain.get((k, "Lu")) or plain.get((k, "Ll"))
        if to:
            met.setdefault((unicodedata.name(c).split()[0], case, to), []).append(c)
    return {cs[0]: to for (_, _, to), cs in met.items() if len(cs) == 1 and cs[0] not in MAPPING and not any(x in LOOKALIKES for x in cs)}


def confusables_version(spark: SparkSession) -> str:
    """Versions of the ICU library and of the Unicode data it holds."""
    icu = spark._jvm.com.ibm.icu
    return f"ICU {icu.util.VersionInfo.ICU_VERSION.toString()}, Unicode {icu.lang.UCharacter.getUnicodeVersion().toString()}"


@lru_cache(maxsize=4)
def extended_transducer(extra: tuple[tuple[str, str], ...]) -> Transducer:
    return Transducer(MAPPING | dict(extra))


def print_key(text: Column, extra: dict[str, str]) -> Column:
    """A 128-bit hash of the print form under MAPPING and ``extra`` look-alikes; null for null."""
    pairs = tuple(sorted(extra.items()))

    @pandas_udf(BinaryType())
    def key(texts: pd.Series) -> pd.Series:
        import hashlib

        form = extended_transducer(pairs)
        return texts.map(lambda t: None if t is None else hashlib.blake2b(form(t).encode("utf-8", "surrogatepass"), digest_size=16).digest())

    return key(text)


@pandas_udf(StringType())
def print_form_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else print_form(t))


def lookalike_pairs(df: DataFrame, row_id: str, text: Column, src_table: str) -> DataFrame:
    """Pairs (src_table, id_a, id_b), id_a < id_b, of rows with different stored texts of one print form.

    Rows are shuffled as two hashes (print form 128 bits, stored text 64 bits), never as texts. Forms with a single stored
    text fall away after a pre-aggregated minimum / maximum of the text hash, so copies of one text never meet in a join.
    Null texts pair with nothing; empty texts are equal as stored; a repeated row (same id) is paired once.
    """
    rows = df.select(F.col(row_id).cast("bigint").alias("id"), text.alias("t")).where("t IS NOT NULL").select("id", print_key(F.col("t"), confusables(df.sparkSession)).alias("form"), F.xxhash64("t").alias("stored"))
    rows = materialize(rows, "print-forms")  # three hashes a row, made once
    mixed = rows.groupBy("form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("form")
    few = rows.join(mixed, "form", "left_semi").distinct()
    a, b = few.select("form", F.col("stored").alias("sa"), F.col("id").alias("ia")), few.select("form", F.col("stored").alias("sb"), F.col("id").alias("ib"))
    pairs = a.join(b, "form").where("sa <> sb AND ia < ib")
    return pairs.select(F.lit(src_table).alias("src_table"), F.col("ia").alias("id_a"), F.col("ib").alias("id_b"))
