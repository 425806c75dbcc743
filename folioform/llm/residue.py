"""Template residue and error-page text: labelled exemplars retrieved through an inverted index, TF-IDF containment over windows.

A text is read as words, numbers and shape tokens (template syntax of any name is one token), its features are single
tokens and neighbouring pairs. The inverted index names the exemplars that share enough weight with the text; for these,
windows of the exemplar's length slide over the text, and the weight of the features in both is set against the weight of the
lighter of the two (containment). A text with a window that reaches COVERAGE and that no content exemplar fits better is residue.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioform.llm.exemplars import CONTENT, LOREM, RESIDUE
from folioform.llm.printform import print_form

COVERAGE = 0.62
#: An exemplar of up to SHORT words must stand there as it is: of few words some are soon met in any order.
SHORT, SHORT_COVERAGE = 3, 0.9
#: Tokens a filler window has, and the fewest it may have in a shorter text.
FILLER_WINDOW, FILLER_LEAST = 8, 4
#: Weight a filler window must have, in weights of a token found nowhere: common words alone are no filler.
FILLER_MASS = 1.5
#: Weight of a token the index does not know, as a share of the greatest weight.
UNKNOWN = 0.75

#: Template syntax, tried in order; whatever stands between the marks, however long, is one token <slot>. No mark is searched beyond the next of its kind.
SHAPES = [
    ("<slot>", r"\{\{(?:[^{}]++|\{(?!\{)[^{}]*+\}|\}(?!\}))*+\}\}|\{%(?:[^%{]++|%(?!\})|\{(?!%))*+%\}|<%(?:[^%<]++|%(?!>)|<(?!%))*+%>|[$#]\{(?:[^{}]++|\{[^{}]*+\})++\}|%\([\w.]++\)[sd]|%%[\w.]++%%|@@[\w.]++@@|__[A-Z][A-Z_]*__|\$[A-Z][A-Z_]++\$|\[\[(?:TODO|FIXME|TBD)\b[^\[\]]*+\]\]|\[(?:INSERT|ENTER|ADD|YOUR)\b[A-Z _]*+\]|\{\d{1,2}\}|\{[A-Za-z][\w.]*+:[^{}\s]++\}|\{[A-Za-z]\w*(?:[_.]\w+)+\}|%(?:\d\$)?[sd](?![\w])|\[%(?:[^%\[]++|%(?!\])|\[(?!%))*+%\]"
     r"|\bdear \{[^{}]*+\}|\{(?:first|last|full|user|your|company|customer|recipient|contact)[ _-]?name\}|\{e-?mail(?: address)?\}|<<(?:(?-i:[A-Z][A-Z0-9]*_[A-Z0-9_]*)|(?:first|last|full|user|company)_?name|e?mail|address|city|zip|date|title|body|content)>>|%%?[A-Z]++(?:_[A-Z]++)*+%%?(?![\w%])|\[(?:your|insert|enter|add) [\w /]++\]|\{\{\{[^{}]*+\}\}\}|\*\|[A-Z_:]++\|\*|\[-[^\[\]]*+-\]"),
    ("<route>", r"(?-i:Cannot (?:GET|POST|PUT|PATCH|DELETE) )/\S*+"),
    ("<goes-here>", r"(?:&lt;|<)[\w .]+ goes here(?:&gt;|>)"),
    ("<object>", r"\[object \w++\]"),
    ("<placeholder>", r"\((?:placeholder|platzhalter|sans texte|marcador)\)"),
    ("<noscript>", r"<noscript>"),
    ("</noscript>", r"</noscript>"),
    ("<tag>", r"<(?:html|head|title|body|h1|center|div|p)>"),
    ("</tag>", r"</(?:html|head|title|body|h1|center|div|p)>"),
]
_MARK = re.compile(r"[{}$#%@_\[<&(*]")
_SHAPE = re.compile("|".join(f"({p})" for _, p in SHAPES), re.I)
_SLOT_CASED = re.compile(r"\$[A-Z][A-Z_]{1,60}\$|__[A-Z][A-Z_]{0,60}__")
_WORD = re.compile(r"\x00\d\x00|[^\W_]+")
_NAMES = [n for n, _ in SHAPES]


def _shaped(m: re.Match) -> str:
    return f" \x00{m.lastindex - 1}\x00 "


def tokens(text: str) -> list[str]:
    """Words in lower case, numbers as <n> or (status codes) <code>, template syntax as shape tokens."""
    if not text.isascii():
        text = print_form(text)
    if _MARK.search(text) or "annot " in text:
        text = _SHAPE.sub(_shaped, text)
        if "\x00" in text:
            return [_NAMES[int(w[1])] if w[0] == "\x00" else _word(w) for w in _WORD.findall(text.lower())]
    return [_word(w) for w in _WORD.findall(text.lower())]


#: Status codes in use: those assigned, and those proxies answer with.
CODES = {*range(400, 419), *range(421, 427), 428, 429, 431, 451, *range(500, 509), 510, 511, *range(520, 528), 530}


def _word(w: str) -> str:
    if w.isdigit():
        return "<code>" if len(w) == 3 and int(w) in CODES else "<n>"
    return w


def exemplar_tokens(text: str) -> list[str]:
    return ["_" if w == "_" else w if w[0] == "<" else print_form(w).lower() for w in text.split()]


def features(toks: list[str]) -> list[str]:
    """Single tokens and neighbouring pairs; a variable part has no features."""
    out = [t for t in toks if t != "_"]
    return out + [f"{a} {b}" for a, b in zip(toks, toks[1:]) if a != "_" and b != "_"]


class ResidueIndex:
    """Exemplars by feature, with weights from corpus counts."""

    def __init__(self, counts: dict[str, int], total: int) -> None:
        self.top = math.log(total + 2)
        self.weight: dict[str, float] = {}
        self.exemplars: list[tuple[str, set[str], float, int]] = []  # kind, features, weight, length
        for kind, texts in (("residue", RESIDUE), ("content", CONTENT)):
            for t in texts:
                toks = exemplar_tokens(t)
                self._add(kind, features(toks), len(toks), counts, total)
        self._add("filler", sorted(set(LOREM.split())), FILLER_WINDOW, counts, total)
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, (_, fs, _, _) in enumerate(self.exemplars):
            for f in fs:
                self.postings[f].append(i)
        self.need = [COVERAGE * (min(w, self.top) if k == "filler" else w) for k, _, w, _ in self.exemplars]

    def _add(self, kind: str, fs: list[str], length: int, counts: dict[str, int], total: int) -> None:
        for f in fs:
            self.weight[f] = math.log((total + 2) / (counts.get(f, 0) + 1))
        kept = set(fs)
        self.exemplars.append((kind, kept, sum(self.weight[f] for f in kept), length))

    def containments(self, toks: list[str]) -> Iterator[tuple[str, float, int, int]]:
        """(kind, containment, first and last token) of every window of every exemplar retrieved."""
        grams = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
        mass: dict[int, float] = {}
        for g in set(grams):
            for e in self.postings.get(g, ()):
                mass[e] = mass.get(e, 0.0) + self.weight[g]
        n = len(toks)
        for e, m in mass.items():
            if m < self.need[e]:
                continue
            kind, fs, total, length = self.exemplars[e]
            if kind == "filler":
                yield from self._filler(toks, fs)
                continue
            span = length + 3
            at = [i for i in range(n) if toks[i] in fs]
            for s in at:
                window = grams[s : min(n, s + span)] + grams[n + s : n + min(n, s + span) - 1]
                got = sum(self.weight[g] for g in set(window) if g in fs)
                if kind == "residue" and length <= SHORT and got < SHORT_COVERAGE * total:
                    continue
                yield kind, got / total, s, min(n, s + span)

    def _filler(self, toks: list[str], fs: set[str]) -> Iterator[tuple[str, float, int, int]]:
        size = min(FILLER_WINDOW, len(toks))
        if size < FILLER_LEAST:
            return
        w = [self.weight[t] if t in fs else self.top * UNKNOWN for t in toks]
        hit = [x if t in fs else 0.0 for t, x in zip(toks, w)]
        for s in range(len(toks) - size + 1):
            got = sum(hit[s : s + size])
            if got >= FILLER_MASS * self.top:
                yield "filler", got / sum(w[s : s + size]), s, s + size

    def coverage(self, text: str | None) -> float:
        """The best containment of a residue exemplar in a window no content exemplar fits better; 0 for null and empty texts."""
        if not text:
            return 0.0
        found = list(self.containments(tokens(text)))
        content = [(c, s, e) for k, c, s, e in found if k == "content" and c >= COVERAGE]
        return max((c for k, c, s, e in found if k != "content" and not any(d >= c and s < y and x < e for d, x, y in content)), default=0.0)


def index_features() -> set[str]:
    return {f for t in RESIDUE + CONTENT for f in features(exemplar_tokens(t))} | set(LOREM.split())


def residue_index(rows: DataFrame) -> ResidueIndex:
    """Weights from all of ``rows`` (t): records counted per index feature, per task and then summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n, total = index_features(), Counter(), 0
        for b in batches:
            for t in b["t"]:
                if t:
                    toks = tokens(t)
                    n.update(known.intersection(toks))
                    n.update(known.intersection(map(" ".join, zip(toks, toks[1:]))))
                    total += 1
        yield pd.DataFrame({"f": [*n, ""], "n": [*n.values(), total]})

    counts = {r.f: r.n for r in rows.select("t").mapInPandas(run, "f string, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()}  # one row per index feature
    return ResidueIndex(counts, counts.pop("", 0))


def scored_rows(rows: DataFrame) -> DataFrame:
    """(src_table, src_id, coverage) of all rows (src_table, src_id, t), one per id, in one pass over the texts.

    Null and empty texts have none (0). Whole texts are read. A row repeated under one id has its greatest coverage.
    """
    index = rows.sparkSession.sparkContext.broadcast(residue_index(rows))  # as many features as the exemplars have

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["src_table", "src_id"]].assign(coverage=pd.Series([index.value.coverage(t) for t in b["t"]], index=b.index, dtype="float64"))

    found = rows.select("src_table", "src_id", "t").mapInPandas(run, "src_table string, src_id bigint, coverage double")
    return found.groupBy("src_table", "src_id").agg(F.max("coverage").alias("coverage"))


def residue_rows(rows: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(src_table, src_id, coverage) of the rows whose text is or contains residue; empty tables give no rows."""
    return scored_rows(rows).where(F.col("coverage") >= coverage)


def clean_rows(rows: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(src_table, src_id) of the rows that stay."""
    return scored_rows(rows).where(F.col("coverage") < coverage).select("src_table", "src_id")


def text_rows(df: DataFrame, src_table: str, src_id: str, text: str) -> DataFrame:
    return df.select(F.lit(src_table).alias("src_table"), F.col(src_id).cast("bigint").alias("src_id"), F.col(text).cast("string").alias("t"))
