"""Garbled text from wrong character encoding: expectation-maximisation over latent encoding chains.

A chain (true encoding, encoding it was read with) turns a text into another; undoing it word by word gives the words it
would explain. How much more probable the undone words are under a character-pair model is the row's gain for the chain.
The weak evidence of single rows is pooled: every source and field has its own chain probabilities, which start equal and
are re-estimated from the rows' posteriors; the character model is re-estimated from the rows believed clean. A row is
garbled if its posterior for no chain falls below a half, and is restored by the chain of the greatest posterior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioform.llm.printform import print_form
from folioform.session import broadcast_if_small, materialize

#: Chains by name: steps of (true encoding, encoding it was read with), outermost first.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {f"utf8-{r}": (("utf-8", r),) for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8-r", "cp1253", "cp1255")}
CHAINS |= {f"{t}-{r}": ((t, r),) for t, r in (("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp1251", "mac_roman"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp1253", "cp1252"), ("iso8859-7", "latin-1"), ("cp1255", "cp1252"), ("iso8859-8", "latin-1"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"))}
CHAINS |= {"utf8-cp1252-twice": (("utf-8", "cp1252"), ("utf-8", "cp1252")), "utf8-latin-1-twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")), "utf8-cp1252-thrice": (("utf-8", "cp1252"),) * 3}
#: Central European and Turkish pages, and the double-byte encodings of East Asia, read as a Western page or as one another.
CHAINS |= {f"utf8-{r}": (("utf-8", r),) for r in ("cp1250", "cp1254", "gbk", "big5", "shift_jis", "euc_kr")}
CHAINS |= {f"{t}-{r}": ((t, r),) for t, r in (("cp1250", "cp1252"), ("cp1252", "cp1250"), ("iso8859-2", "latin-1"), ("cp1254", "cp1252"), ("gbk", "cp1252"), ("big5", "cp1252"), ("shift_jis", "cp1252"), ("euc_kr", "cp1252"), ("gbk", "latin-1"), ("shift_jis", "latin-1"), ("euc_kr", "latin-1"), ("big5", "latin-1"))}
DOUBLE_BYTE = {"gbk", "big5", "shift_jis", "euc_kr"}
CLEAN, LOST = "clean", "lost"
#: A word is undone only if that makes it this many nats more probable; a row with characters that no clean text has gains LOST_GAIN for the chain LOST.
MARGIN, LOST_GAIN = 1.0, 12.0
#: The second character model is made of rows whose posterior for being clean is at least SURELY_CLEAN.
SURELY_CLEAN = 0.99
#: Chain probabilities of a pool lean on those of all rows as if by PRIOR_ROWS rows more.
PRIOR_ROWS, FIRST_GARBLED, ROUNDS = 20.0, 0.05, 4
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: What no word of a single-byte encoding can have been: white space and control characters within.
_BREAK = re.compile("[\x00-\x20\x7f-\xa0]")
#: Characters that no clean text has.
OPAQUE = "[\\x{80}-\\x{84}\\x{86}-\\x{9f}\\x{fffd}]"


@lru_cache(maxsize=None)
def byte_of(encoding: str) -> dict[int, int]:
    """{code point: byte} of a single-byte encoding; undefined bytes stand for themselves, as lenient readers have it."""
    table = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            table.setdefault(b, b)
    return table


@lru_cache(maxsize=None)
def _as_bytes(read: str) -> dict[int, str]:
    """Translation of characters to the bytes they were read from, as Latin-1; a character of no byte breaks a sequence."""
    table = byte_of(read)
    return {c: "\uffff" for c in range(0x80, 0x100)} | {c: chr(b) for c, b in table.items()}


@lru_cache(maxsize=None)
def _direct(true: str, read: str) -> tuple[dict[int, str], frozenset[str]]:
    """Translation of one single-byte encoding read as another, and the characters it covers."""
    out = {}
    for c, b in byte_of(read).items():
        try:
            out[c] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
    return out, frozenset(map(chr, out))


def _utf8(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m[0]


def _double(word: str, true: str, read: str) -> str | None:
    """undo_step where one of the encodings has characters of two bytes: all or nothing, for a lost byte shifts the rest."""
    try:
        if read in DOUBLE_BYTE:
            out = word.encode(read).decode(true)
        else:
            table = byte_of(read)
            out = bytes(table[ord(c)] for c in word).decode(true)
    except (KeyError, UnicodeError):
        return None
    return None if _BREAK.search(out) else out


def undo_step(word: str, true: str, read: str) -> str | None:
    """The word before it was read wrongly, None if it can't have been."""
    if true in DOUBLE_BYTE or read in DOUBLE_BYTE:
        return _double(word, true, read)
    if true == "utf-8":
        as_bytes = word.translate(_as_bytes(read))
        if not _UTF8.search(as_bytes):
            return None
        out, last = [], 0
        for m in _UTF8.finditer(as_bytes):
            out += [word[last : m.start()], _utf8(m) if len(_utf8(m)) == 1 else word[m.start() : m.end()]]
            last = m.end()
        return "".join([*out, word[last:]])
    table, known = _direct(true, read)
    if not known.issuperset(word):
        return None
    out = word.translate(table)
    return None if _BREAK.search(out) else out


def undo(word: str, chain: str) -> str | None:
    for true, read in CHAINS[chain]:
        word = undo_step(word, true, read)
        if word is None:
            return None
    return word


#: Buckets that character pairs are counted in, so that the model is of bounded size whatever alphabets occur.
BUCKETS = 1 << 22
_SINGLE = 1 << 21  # keys below are single characters, keys from here on buckets of pairs


def _bucket(a, b):
    return _SINGLE + ((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) % BUCKETS


class PairModel:
    """Character pairs with back-off to single characters. ``keys`` (sorted) and ``counts`` are of pair_counts(): single
    characters exactly, pairs by bucket; at most 2^21 + BUCKETS entries."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = keys, counts.astype(np.float64)
        self.total = float(self.counts[keys < _SINGLE].sum()) + 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)

    def log_p(self, words: list[str]) -> np.ndarray:
        """Log probability of every word (without spaces) between spaces."""
        if not words:
            return np.zeros(0)
        cps = code_points(" " + " ".join(words) + " ")
        first, second = cps[:-1], cps[1:]
        used, inv = np.unique(cps, return_inverse=True)
        single = self.of(used)
        back = (single[inv[1:]] + 0.001) / self.total
        got = np.log((self.of(_bucket(first, second)) + 5 * back) / (single[inv[:-1]] + 5))
        starts = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words])[:-1]))
        return np.add.reduceat(got, starts)

    def gains(self, words: list[str]) -> Iterator[tuple[str, str, float]]:
        """(word, chain, nats gained) of the chains that make a word more probable by MARGIN."""
        words = [w for w in words if w and not w.isascii()]
        # characters that only look alike make a word odd too, but no chain made them
        base = np.maximum(self.log_p(words), self.log_p([print_form(w).replace(" ", "_") or "_" for w in words]))
        for chain in CHAINS:
            at, new = undone(words, chain)
            if len(at):
                g = self.log_p(new) - base[at] - MARGIN
                for k in np.flatnonzero(g > 0).tolist():
                    yield words[at[k]], chain, float(g[k])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@lru_cache(maxsize=None)
def _bmp(true: str, read: str) -> np.ndarray:
    """Single-byte chains as a table over the first 65,536 code points: the character meant, 0 where there is none.
    ``true`` 'utf-8': the byte read plus 1."""
    out = np.zeros(1 << 16, np.int32)
    if true == "utf-8":
        for c, b in byte_of(read).items():
            out[c] = b + 1
    else:
        for c, to in _direct(true, read)[0].items():
            out[c] = ord(to)
    return out


def undone(words: list[str], chain: str) -> tuple[np.ndarray, list[str]]:
    """The words that the chain can be undone in, and what they become; what can't be is sorted out by whole batches first."""
    true, read = CHAINS[chain][0]
    cps = code_points(" ".join([*words, ""]))
    lens = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    low = np.where(cps < (1 << 16), cps, 0)
    if read in DOUBLE_BYTE:
        maybe = np.ones(len(words), bool)
    elif true in DOUBLE_BYTE:
        known = (_bmp("utf-8", read)[low] > 0) | (cps == 32)
        maybe = np.logical_and.reduceat(known, starts)
    elif true == "utf-8":
        byte = _bmp("utf-8", read)[low] - 1
        lead = (byte >= 0xC2) & (byte <= 0xF4)
        tail = np.append((byte[1:] >= 0x80) & (byte[1:] <= 0xBF), False)
        maybe = np.logical_or.reduceat(lead & tail, starts)
    else:
        to = _bmp(true, read)[low]
        space = cps == 32
        good = space | (to > 0x20) & ~((to >= 0x7F) & (to <= 0xA0))
        at = np.flatnonzero(np.logical_and.reduceat(good, starts) & np.logical_or.reduceat(~space & (to != cps), starts))
        text = np.where(space, 32, to).astype(np.uint32).tobytes().decode("utf-32-le", "replace")
        return at, [text[starts[k] : starts[k] + lens[k]] for k in at.tolist()]
    at, new = [], []
    for k in np.flatnonzero(maybe).tolist():
        w = undo(words[k], chain)
        if w is not None and w != words[k] and " " not in w and w:
            at.append(k)
            new.append(w)
    return np.array(at, np.int64), new


def pair_counts(texts: list[str], into: Counter) -> None:
    """Counts of characters and of the buckets of neighbouring ones, each text standing between spaces."""
    cps = code_points((" " + " ".join(texts) + " ").replace("\n", " "))
    for keys in (cps[:-1], _bucket(cps[:-1], cps[1:])):
        keys, n = np.unique(keys, return_counts=True)
        for k, c in zip(keys.tolist(), n.tolist()):
            into[k] += c


def restore(text: str, chain: str, model: PairModel) -> str | None:
    """The text with the words undone that the chain explains; None if the chain is LOST."""
    if chain == LOST:
        return None
    out = text.split(" ")
    could = [(k, new) for k, w in enumerate(out) if not w.isascii() and (new := undo(w, chain)) and " " not in new]
    gain = model.log_p([new for _, new in could]) - model.log_p([out[k] for k, _ in could])
    for (k, new), g in zip(could, gain):
        if g >= 0:
            out[k] = new
    return " ".join(out)


# ---- Spark ---------------------------------------------------------------------------------------------------------------


def pair_model(rows: DataFrame) -> PairModel:
    """Characters and pairs of all of ``rows`` (t), counted per task and summed; of bounded size (see PairModel)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            if texts := [t for t in b["t"] if t]:
                pair_counts(texts, n)
        yield pd.DataFrame({"k": list(n), "n": list(n.values())})

    counts = rows.select("t").mapInPandas(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # at most 2^21 + BUCKETS rows
    keys, n = counts.column("k").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(keys)
    return PairModel(keys[order], n[order])


def words_of(rows: DataFrame) -> DataFrame:
    """``rows`` (…, t) with one row per word that is not of ASCII (w)."""
    return rows.withColumn("w", F.explode(F.split("t", " "))).where(NOT_ASCII.format("w")).drop("t")


NOT_ASCII = "{} RLIKE '[^\\\\x00-\\\\x7f]'"


def word_gains(words: DataFrame, model: PairModel) -> DataFrame:
    """(w, chain, gain) of the words that some chain makes more probable; every distinct word is judged once."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(list(shared.value.gains(b.w.tolist())), columns=["w", "chain", "gain"])

    return words.mapInPandas(run, "w string, chain string, gain double")


def row_gains(odd: DataFrame, gains: DataFrame) -> DataFrame:
    """(src_table, src_id, pool, chain, gain): the gains of a row's words summed by chain, and that of LOST."""
    key = ["src_table", "src_id", "pool"]
    explained = words_of(odd.select(*key, "t")).join(broadcast_if_small(gains), "w").groupBy(*key, "chain").agg(F.sum("gain").alias("gain"))
    n = F.size(F.regexp_extract_all("t", F.lit(OPAQUE), F.lit(0)))
    lost = odd.select(*key, n.alias("n")).where("n > 0").select(*key, F.lit(LOST).alias("chain"), (LOST_GAIN + F.least("n", F.lit(20)) * 0.1).alias("gain"))
    return explained.unionByName(lost)


def posteriors(alt: DataFrame, pools: DataFrame, n_rounds: int = ROUNDS) -> DataFrame:
    """(src_table, src_id, chain, p_chain, p_clean) of rows of row_gains(): EM over the pools' chain probabilities.

    ``pools`` (pool, n): rows of each pool, also those no chain could explain, which count as clean. Only rows with
    evidence take part; a round is one aggregation per pool and chain, written to the shared folder.
    """
    # every row may be clean or of any chain it has a gain for
    alt = materialize(alt, "mojibake-gains")
    base = alt.select("src_table", "src_id", "pool").distinct().select("*", F.lit(CLEAN).alias("chain"), F.lit(0.0).alias("gain"))
    hyp = alt.unionByName(base)
    n_chains = len(CHAINS) + 1
    total = pools.agg(F.sum("n")).first()[0] or 1
    prior = None
    for k in range(n_rounds):
        if prior is None:
            start = F.when(F.col("chain") == CLEAN, math.log(1 - FIRST_GARBLED)).otherwise(math.log(FIRST_GARBLED / n_chains))
            scored = hyp.withColumn("score", F.col("gain") + start)
        else:
            scored = hyp.join(prior, ["pool", "chain"], "left").withColumn("score", F.col("gain") + F.coalesce("log_prior", F.lit(math.log(1e-6))))
        row = ["src_table", "src_id"]
        top = scored.groupBy(*row, "pool").agg(F.max("score").alias("top"), F.collect_list(F.struct("chain", "score")).alias("hs"))  # at most n_chains + 1 hypotheses a row
        z = F.aggregate("hs", F.lit(0.0), lambda a, h: a + F.exp(h["score"] - F.col("top")))
        post = top.withColumn("z", z).select(*row, "pool", F.explode("hs").alias("h"), "top", "z").select(*row, "pool", "h.chain", (F.exp(F.col("h.score") - F.col("top")) / F.col("z")).alias("p"))
        if k == n_rounds - 1:
            break
        mass = post.groupBy("pool", "chain").agg(F.sum("p").alias("mass"))
        mass = materialize(mass, "mojibake-mass")
        overall = mass.where(F.col("chain") != CLEAN).groupBy("chain").agg(F.sum("mass").alias("all_mass"))
        overall = overall.select("chain", (F.col("all_mass") / total).alias("share"))
        known = {r.chain: float(r.share) for r in overall.collect()}  # at most one row per chain
        known[CLEAN] = max(1e-6, 1.0 - sum(known.values()))
        shares = F.array(*[F.struct(F.lit(c).alias("chain"), F.lit(x).alias("share")) for c, x in sorted(known.items())])
        dirty = mass.where(F.col("chain") != CLEAN).groupBy("pool").agg(F.sum("mass").alias("dirty"))
        per = pools.join(dirty, "pool", "left").select("pool", "n", "dirty", F.explode(shares).alias("s")).select("pool", "n", "dirty", "s.chain", "s.share")
        per = per.join(mass, ["pool", "chain"], "left")
        own = F.when(F.col("chain") == CLEAN, F.col("n") - F.coalesce("dirty", F.lit(0.0))).otherwise(F.coalesce("mass", F.lit(0.0)))
        prior = materialize(per.select("pool", "chain", F.log(F.greatest((own + PRIOR_ROWS * F.col("share")) / (F.col("n") + PRIOR_ROWS), F.lit(1e-9))).alias("log_prior")), "mojibake-prior")
    best = post.groupBy("src_table", "src_id").agg(F.max(F.when(F.col("chain") == CLEAN, F.col("p"))).alias("p_clean"), F.max_by("chain", F.when(F.col("chain") != CLEAN, F.col("p"))).alias("chain"), F.max(F.when(F.col("chain") != CLEAN, F.col("p"))).alias("p_chain"))
    return best


def source_rows(df: DataFrame, src_table: str, src_id: str, pool: str, text: str) -> DataFrame:
    return df.select(F.lit(src_table).alias("src_table"), F.col(src_id).cast("bigint").alias("src_id"), F.concat_ws(":", F.lit(src_table), F.coalesce(F.col(pool).cast("string"), F.lit(""))).alias("pool"), F.col(text).cast("string").alias("t"))


def garbled_rows(rows: DataFrame) -> DataFrame:
    """(src_table, src_id, chain, p_clean, restored): rows of source_rows() whose text is garbled.

    ``restored`` is null where the text can't be brought back. Null, empty and ASCII texts are clean. Repeated rows are
    reported once. Empty tables give no rows. Two passes: the second pair model leaves out what the first found garbled.
    """
    rows = rows.where("t IS NOT NULL AND src_id IS NOT NULL")
    pools = materialize(rows.groupBy("pool").agg(F.count("*").alias("n")), "mojibake-pools")
    odd = materialize(rows.where(NOT_ASCII.format("t")).dropDuplicates(["src_table", "src_id"]), "mojibake-rows")
    words = materialize(words_of(odd.select("t")).distinct(), "mojibake-words")
    suspect = posteriors(row_gains(odd, materialize(word_gains(words, pair_model(rows)), "mojibake-word-gains")), pools, 2).where(F.col("p_clean") < SURELY_CLEAN).select("src_table", "src_id")
    suspect = broadcast_if_small(materialize(suspect, "mojibake-suspects"))
    model = pair_model(rows.join(suspect, ["src_table", "src_id"], "left_anti"))
    gains = materialize(word_gains(words, model), "mojibake-word-gains")
    found = materialize(posteriors(row_gains(odd, gains), pools).where("p_clean < 0.5"), "mojibake-found")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="t").assign(restored=[restore(t, c, shared.value) for t, c in zip(b.t, b.chain)])

    texts = odd.select("src_table", "src_id", "t").join(broadcast_if_small(found.select("src_table", "src_id", "chain", "p_clean")), ["src_table", "src_id"])
    return texts.select("src_table", "src_id", "chain", "p_clean", "t").mapInPandas(run, "src_table string, src_id bigint, chain string, p_clean double, restored string")
