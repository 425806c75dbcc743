"""Column functions on text: markup, tokens, normal forms, hashes, escapes, classification. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Str = Column | str


def _c(x: Str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: Str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def squeeze(x: Str) -> Column:
    return F.regexp_replace(trim_ws(x), r"\s+", " ")


def strip_markup(x: Str) -> Column:
    """Tags dropped (an unclosed one swallows the rest), stray '>' dropped, trimmed."""
    return trim_ws(F.replace(F.regexp_replace(_c(x), "<[^>]*>?", ""), F.lit(">"), F.lit("")))


def decode_entities(x: Str) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")], _c(x))


def escape_xml(x: Str) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")], _c(x))


def escape_html(x: Str) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")], _c(x))


def escape_xml_text(x: Str) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], _c(x))


def escape_latex(x: Str) -> Column:
    c = F.replace(_c(x), F.lit("\\"), F.lit("\x00"))
    c = F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), [("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"), ("\x00", r"\textbackslash{}")], c)


#: Token classes of the interchange model: letters, digits, apostrophes and everything beyond ASCII are words.
TOKEN = r"([A-Za-z0-9'\x{80}-\x{10FFFF}]+|[ \t\n\r]+|[^A-Za-z0-9'\x{80}-\x{10FFFF} \t\n\r]+)"


def token_texts(x: Str) -> Column:
    """All maximal runs of white space, word characters and other characters."""
    return F.regexp_extract_all(_c(x), F.lit(TOKEN), F.lit(1))


def token_kind(t: Column) -> Column:
    return F.when(t.rlike(r"^[ \t\n\r]"), "whitespace").when(t.rlike(r"^[A-Za-z0-9'\x{80}-\x{10FFFF}]"), "word").otherwise("punctuation")


def tokens(x: Str) -> Column:
    """array<struct<idx, text, type, char_start, char_end>> with byte offsets, as running sums of octet lengths."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<idx:int,text:string,type:string,char_start:int,char_end:int>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.octet_length(t)
        one = F.struct(F.size(acc["out"]).alias("idx"), t.alias("text"), token_kind(t).alias("type"), acc["at"].alias("char_start"), end.alias("char_end"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

    return F.aggregate(token_texts(x), empty, step, lambda a: a["out"])


def plain_words(x: Str) -> Column:
    """Words of the reader's tokenizer: runs of letters, digits and apostrophes."""
    return F.regexp_extract_all(_c(x), F.lit(r"([\p{L}\p{Nd}']+)"), F.lit(1))


def attribute(x: Str, name: str) -> Column:
    """Value of ``name="v"`` or ``name='v'`` of a tag; '' if it has none."""
    c = _c(x)
    double, single = F.regexp_extract(c, rf'(?:^|\s){name}="([^"]*)"', 1), F.regexp_extract(c, rf"(?:^|\s){name}='([^']*)'", 1)
    return F.when(double != "", double).otherwise(single)


def word_elements(x: Str) -> Column:
    """array<struct<text, lemma, morph, strongs>> of <w> elements."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit(r"(<w\b[^>]*>[^<]*</w>)"), F.lit(1)), lambda w: F.struct(F.regexp_extract(w, ">([^<]*)<", 1).alias("text"), attribute(w, "lemma").alias("lemma"), attribute(w, "morph").alias("morph"), strongs(attribute(w, "lemma")).alias("strongs")))


def strongs(lemma: Column) -> Column:
    """Numbers H1234 / G1234 among the fields of a lemma attribute, ``strong:`` dropped."""
    return F.filter(F.transform(F.split(lemma, r"\s+"), lambda s: F.regexp_replace(s, "^strong:", "")), lambda s: s.rlike(r"^[HG]\d+$"))


def notes(x: Str) -> Column:
    """array<struct<kind, text>>: <note> as FOOTNOTE, <reference> as CROSS_REF (its osisRef, else its text)."""
    c = _c(x)
    foot = F.transform(F.regexp_extract_all(c, F.lit("<note[^>]*>([^<]*)</note>"), F.lit(1)), lambda t: F.struct(F.lit("FOOTNOTE").alias("kind"), t.alias("text")))
    refs = F.transform(F.regexp_extract_all(c, F.lit("(<reference[^>]*>[^<]*</reference>)"), F.lit(1)), lambda t: F.struct(F.lit("CROSS_REF").alias("kind"), F.when(attribute(t, "osisRef") != "", attribute(t, "osisRef")).otherwise(F.regexp_extract(t, ">([^<]*)<", 1)).alias("text")))
    return F.concat(foot, refs)


def marked_places(x: Str, pattern: str) -> Column:
    """array<struct<at, markup>>: matches of ``pattern`` (without groups) and the byte each begins at, from the lengths of what lies before."""
    c = _c(x)
    gaps, hits = F.split(c, pattern), F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,markup:string>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        at = acc["at"] + F.octet_length(z["gap"])
        return F.struct((at + F.octet_length(z["markup"])).alias("at"), F.array_append(acc["out"], F.struct(at.alias("at"), z["markup"].alias("markup"))).alias("out"))

    return F.aggregate(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("markup")), start, step, lambda a: a["out"])


def placed_notes(x: Str) -> Column:
    """array<struct<kind, text, at>> of notes and references with the byte each begins at, notes first."""

    def kind(pattern: str, name: str, text: Column) -> Column:
        return F.transform(marked_places(x, pattern), lambda m: F.struct(F.lit(name).alias("kind"), text(m["markup"]).alias("text"), m["at"].alias("at")))

    inner = lambda m: F.regexp_extract(m, ">([^<]*)<", 1)
    return F.concat(kind("<note[^>]*>[^<]*</note>", "FOOTNOTE", inner), kind("<reference[^>]*>[^<]*</reference>", "CROSS_REF", lambda m: F.when(attribute(m, "osisRef") != "", attribute(m, "osisRef")).otherwise(inner(m))))


def versification_message(x: Str) -> Column:
    """What a block of chapter marks without text says about the source's numbering; '' for any other block."""
    marks = F.filter(chapter_markers(x), lambda m: (m["osis_id"] != "") | (m["boundary"] != "container"))
    told = F.transform(F.filter(marks, lambda m: (m["osis_id"] != "") & (m["boundary"] != "container")), lambda m: F.concat(F.lit("versification: chapter "), m["osis_id"], F.when(m["boundary"] == "start", " begins here in source").otherwise(" ends here in source")))
    found = F.coalesce(F.try_element_at(told, F.lit(1)), F.lit("versification: structural marker only"))
    return F.when((F.size(marks) > 0) & (strip_markup(x) == ""), found).otherwise("")


def chapter_markers(x: Str) -> Column:
    """array<struct<osis_id, boundary>> of chapter elements and milestones."""
    return F.transform(F.regexp_extract_all(_c(x), F.lit("(<chapter[^>]*>)"), F.lit(1)), lambda t: F.struct(attribute(t, "osisID").alias("osis_id"), F.when(attribute(t, "sID") != "", "start").when(attribute(t, "eID") != "", "end").otherwise("container").alias("boundary")))


def normalise(x: Str, case: bool = True, punctuation: bool = True, white: bool = True) -> Column:
    c = _c(x)
    if punctuation:
        c = F.regexp_replace(c, r"\p{P}", "")
    if case:
        c = F.lower(c)
    return squeeze(c) if white else c


def content_hash(x: Str) -> Column:
    return F.sha2(_c(x), 256)


def highlight(x: Str, term: str, mark: str = "mark") -> Column:
    """Every occurrence wrapped, whatever its case; terms over 100 characters or empty ones are ignored."""
    if not term or len(term) > 100:
        return _c(x)
    quoted = "".join("\\" + ch if not ch.isalnum() and not ch.isspace() else ch for ch in term)
    return F.regexp_replace(_c(x), f"(?i)({quoted})", f"<{mark}>$1</{mark}>")


def unquote_query(q: str) -> str:
    """A search term without the double quotes around it; a lone quote is the empty term."""
    return q[1:-1] if len(q) > 1 and q[0] == q[-1] == '"' else "" if q == '"' else q


def safe_id(x: Str) -> Column:
    """Lower case; every run of characters other than letters, digits, '-' and '_' becomes one '-'; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9_-]+", "-"), "^-+|-+$", "")


def trim_archive_suffix(x: Str, inner: str = "") -> Column:
    """Without the suffix of an archive, and without ``.inner`` before it."""
    return F.regexp_replace(_c(x), rf"(?i)(\.{inner})?\.(tar\.xz|tar\.gz|tgz|txz|tar|zip)$" if inner else r"(?i)\.(tar\.xz|tar\.gz|tgz|txz|tar|zip)$", "")


def human_size(n: Str) -> Column:
    """Bytes as B, KB, MB, GB or TB with one decimal."""
    c, out = _c(n).cast("double"), F.concat(_c(n).cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(c >= 1024**k, F.concat(F.format_string("%.1f", c / 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def truncate(x: Str, n: int) -> Column:
    c = _c(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def is_placeholder(x: Str) -> Column:
    """Under five bytes once trimmed, or only "Book c:v", the book's name being words after at most one ordinal."""
    c = trim_ws(x)
    ordinal, word = r"(?:(?:[1-4]|I{1,3}|IV|IIV|IIIV)\s+)?", "[A-Za-z]+"
    return (F.octet_length(c) < 5) | c.rlike(rf"^{ordinal}{word}(?:\s+{word})*\s+\d+:\d+:?\z")


def empty_kind(raw: Str) -> Column:
    """Why a block has no text: loss (no raw), parse_error (text outside tags), chapter, book, section, milestone or markup."""
    c = _c(raw)
    return F.when(c.isNull() | (trim_ws(c) == ""), "loss").when(strip_markup(c) != "", "parse_error").when(c.rlike("<chapter"), "chapter").when(c.rlike(r'<div[^>]*type="book"'), "book").when(c.rlike(r'<div[^>]*type="(section|subSection|majorSection)"'), "section").when(c.rlike("<(milestone|lb|pb|verse)"), "milestone").otherwise("markup_only")


# ---- licences, tags, drivers, versions -----------------------------------------------------------------------------------

#: Patterns tried in order over a licence text in lower case, and the identifier they stand for.
LICENCES = [("public domain", "CC-PDDC"), ("cc0", "CC0-1.0"), ("by-nc-nd", "CC-BY-NC-ND-4.0"), ("by-nc-sa", "CC-BY-NC-SA-4.0"), ("by-nc", "CC-BY-NC-4.0"), ("by-nd", "CC-BY-ND-4.0"), ("by-sa", "CC-BY-SA-4.0"), ("cc[- ]by|creative commons attribution", "CC-BY-4.0"), ("lgpl", "LGPL-3.0-or-later"), ("gpl|gnu general public", "GPL-3.0-or-later"), ("mit licen", "MIT"), ("apache", "Apache-2.0"), ("copyrighted|all rights reserved", "LicenseRef-Proprietary")]


def spdx(x: Str) -> Column:
    low, out = F.lower(_c(x)), None
    for pattern, name in LICENCES:
        cond = low.rlike(pattern)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("NOASSERTION")


DRIVERS = [("^(ztext|rawtext)", "BIBLE"), ("^(zcom|rawcom|hrefcom|rawfiles)", "COMMENTARY"), ("^(zld|rawld)", "DICTIONARY"), ("^rawgenbook", "GENBOOK")]


def module_type(driver: Str) -> Column:
    """Module type from the name of its storage driver, by prefix."""
    low, out = F.lower(_c(driver)), None
    for pattern, name in DRIVERS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("UNKNOWN")


def tags(*conditions: tuple[Column, str | Column]) -> Column:
    """Sorted distinct tags whose condition holds."""
    parts = F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in conditions])
    return F.sort_array(F.array_distinct(F.filter(parts, lambda t: t.isNotNull())))


#: What tags say about a module, by language, numbering and name.
LANGUAGE_TAGS = {"en": "English", "la": "Latin", "grc": "Greek", "he": "Hebrew"}
CANON_TAGS = {"Vulg": ["Catholic Canon"], "LXX": ["Orthodox Canon", "Septuagint"], "Leningrad": ["Masoretic Text"]}
ONE_TESTAMENT = {"sblgnt": "New Testament", "oeb": "New Testament", "osmhb": "Old Testament", "lxx": "Old Testament"}
HISTORICAL = ["kjv", "asv", "tyndale", "geneva1599", "drc", "vulgate", "lxx"]
MODERN = ["web", "oeb", "sblgnt"]


def module_tags(module: Str, language: Str, versification: Str, licence: Str, description: Str) -> Column:
    """Sorted tags of a Bible module: language, testaments, canon, text type, licence, era, features."""
    name, canon = F.lower(_c(module)), _c(versification)
    only = F.create_map(*[F.lit(x) for kv in ONE_TESTAMENT.items() for x in kv])[name]
    both = only.isNull()
    language_tag = F.create_map(*[F.lit(x) for kv in LANGUAGE_TAGS.items() for x in kv])[_c(language)]
    canons = [(canon == c, t) for c, ts in CANON_TAGS.items() for t in ts]
    return tags(
        (language_tag.isNotNull(), language_tag), (both | (only == "Old Testament"), "Old Testament"), (both | (only == "New Testament"), "New Testament"),
        *canons, (~F.coalesce(canon.isin(*CANON_TAGS), F.lit(False)), "Protestant Canon"), (name == "sblgnt", "Critical Text"),
        (F.contains(F.lower(_c(licence)), F.lit("public domain")), "Public Domain"), (name.isin(HISTORICAL), "Historical Translation"), (name.isin(MODERN), "Modern Translation"),
        (F.contains(F.lower(_c(description)), F.lit("strong")), "Strong's Numbers"),
    )


def version_key(x: Str) -> Column:
    """array<int> of a dotted version, 'v' and pre-release dropped, padded to three: compares as versions do."""
    parts = F.transform(F.split(F.regexp_replace(F.regexp_replace(_c(x), "^[vV]", ""), "[-+].*$", ""), r"\."), lambda p: F.coalesce(F.try_to_number(p, F.lit("999999999")).cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array(F.lit(0), F.lit(0), F.lit(0))), 1, 3)


def version_matches(x: Str, constraint: str) -> Column:
    """``>=1.2``, ``<2``, ``^1.2.3`` (same major), ``~1.2.3`` (same minor), ``1.2.3``."""
    for op in (">=", "<=", ">", "<", "^", "~", "="):
        if constraint.startswith(op):
            break
    else:
        op = "="
    k, c = version_key(x), version_key(F.lit(constraint[len(op) :] if constraint.startswith(op) else constraint))
    return {">=": k >= c, "<=": k <= c, ">": k > c, "<": k < c, "=": k == c, "^": (k >= c) & (k[0] == c[0]), "~": (k >= c) & (k[0] == c[0]) & (k[1] == c[1])}[op]


# ---- markup to Markdown --------------------------------------------------------------------------------------------------


def _rules(x: Str, rules: list[tuple[str, str]]) -> Column:
    return squeeze(decode_entities(F.regexp_replace(reduce(lambda c, r: F.regexp_replace(c, *r), rules, _c(x)), "<[^>]*>", "")))


OSIS_RULES = [(r'<hi[^>]*type="bold"[^>]*>([^<]*)</hi>', r"**$1**"), (r'<hi[^>]*type="italic"[^>]*>([^<]*)</hi>', r"*$1*"), (r"<transChange[^>]*>([^<]*)</transChange>", r"*$1*"), (r"<divineName[^>]*>([^<]*)</divineName>", r"**$1**"), (r'<q[^>]*who="Jesus"[^>]*>([^<]*)</q>', r"**$1**"), (r"<note[^>]*>([^<]*)</note>", r" [^$1]"), (r"<title[^>]*>([^<]*)</title>", r"### $1 "), (r"<(?:lb|p|l)\b[^>]*/?>", " ")]


def osis_to_markdown(x: Str) -> Column:
    return _rules(x, OSIS_RULES)


THML_RULES = [(r"(?i)<(?:b|strong)>([^<]*)</(?:b|strong)>", r"**$1**"), (r"(?i)<(?:i|em)>([^<]*)</(?:i|em)>", r"*$1*"), (r"(?i)<font color=\"?red\"?>([^<]*)</font>", r"**$1**"), (r"(?i)<h[1-6]>([^<]*)</h[1-6]>", r"### $1 "), (r"(?i)<scripRef[^>]*>([^<]*)</scripRef>", r"[$1]"), (r"(?i)<note[^>]*>([^<]*)</note>", r" [^$1]"), (r"(?i)<(?:br|p)\b[^>]*/?>", " ")]


def thml_to_markdown(x: Str) -> Column:
    return _rules(x, THML_RULES)


GBF_RULES = [(r"<FB>(.*?)<Fb>", r"**$1**"), (r"<FI>(.*?)<Fi>", r"*$1*"), (r"<FR>(.*?)<Fr>", r"**$1**"), (r"<FO>(.*?)<Fo>", r"*$1*"), (r"<RF>(.*?)<Rf>", r" [^$1]"), (r"<TS>(.*?)<Ts>", r"### $1 "), (r"<(?:CM|CL|PP|PI)>", " ")]


def gbf_to_markdown(x: Str) -> Column:
    return _rules(x, GBF_RULES)


def tei_entry(x: Str) -> Column:
    """struct<headword, pos, etym, defs, refs> of a TEI dictionary entry."""
    c = _c(x)
    return F.struct(F.regexp_extract(c, "<orth[^>]*>([^<]*)</orth>", 1).alias("headword"), F.regexp_extract(c, "<pos[^>]*>([^<]*)</pos>", 1).alias("pos"), F.regexp_extract(c, "<etym[^>]*>([^<]*)</etym>", 1).alias("etym"), F.regexp_extract_all(c, F.lit("<def[^>]*>([^<]*)</def>"), F.lit(1)).alias("defs"), F.regexp_extract_all(c, F.lit("<ref[^>]*>([^<]*)</ref>"), F.lit(1)).alias("refs"))


def tei_to_markdown(x: Str) -> Column:
    e = tei_entry(x)
    numbered = F.array_join(F.transform(e["defs"], lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d)), " ")
    return squeeze(F.concat_ws(" ", F.when(e["headword"] != "", F.concat(F.lit("**"), e["headword"], F.lit("**"))), F.when(e["pos"] != "", F.concat(F.lit("*"), e["pos"], F.lit("*"))), F.when(e["etym"] != "", F.concat(F.lit("["), e["etym"], F.lit("]"))), numbered, F.when(F.size(e["refs"]) > 0, F.concat(F.lit("See: "), F.array_join(e["refs"], ", ")))))


def strongs_key(key: Str, language: Str) -> Column:
    """A lexicon key as a Strong's number: H/G kept, else prefixed by the module's language; zeros dropped."""
    k = F.upper(trim_ws(key))
    digits = F.regexp_replace(F.regexp_replace(k, "^[HG]", ""), "^0+(?=.)", "")
    prefix = F.when(k.rlike("^[HG]"), F.substring(k, 1, 1)).when(F.lower(_c(language)).rlike("^(he|heb)"), "H").otherwise("G")
    return F.concat(prefix, digits)


def rendered_verses(x: Str) -> Column:
    """array<struct<ref, text>> of tool output "Book c:v: text ..."; attribution in parentheses at the end and placeholders dropped."""
    c = F.regexp_replace(_c(x), r"\s*\([^()]*\)\s*\z", "")
    pattern = r"((?:[1-4] )?\p{L}[\p{L} ]*\d+:\d+): "
    refs = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    texts = F.slice(F.split(c, pattern), 2, F.greatest(F.size(refs), F.lit(0)))
    return F.filter(F.transform(F.arrays_zip(refs.alias("r"), texts.alias("t")), lambda z: F.struct(z["r"].alias("ref"), squeeze(z["t"]).alias("text"))), lambda z: ~is_placeholder(z["text"]))
