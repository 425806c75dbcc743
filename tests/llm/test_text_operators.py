"""Text operators against brute force, with the edge cases their docstrings define."""

import random
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioform.llm import leaks, mojibake, neardup, packing, printform, residue, spans, textvec

ROWS = "id long, text string"
LONG = "word " * 60_000
WORDS = ["alpha", "beta", "gamma", "delta", "über", "sigma", "omega", "kappa", "когда", "stone", "river", "lamp"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def clashing(df):
    for c in ("uid", "cls", "t", "key", "band", "words", "src_id", "win", "tokens", "pos", "stored", "form"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---- print form ----------------------------------------------------------------------------------------------------------


def test_mapping_has_no_conflicts():
    m = printform.build_mapping()
    assert all("".join(m.get(x, x) for x in to) == to for to in m.values()) and not any(c.isascii() for c in m)


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("abc", "ａｂｃ", True), ("abc", "аbс", True), ("é", "é", True), ("é", "е́", True), ("ё", "ë", True), ("a b", "a b", True), ("a b", "a　b", True), ("ab", "a​b", True), ("ab", "a­b", True),
        ("fig", "ﬁg", True), ("ο", "o", True), ("vi", "νі", True), ("e‍́", "é", True), ("ã", "ａ̃", True), ("й", "й", True),
        ("e", "é", False), ("a", "A", False), ("x2", "x²", False), ("a b", "a  b", False), ("o", "ö", False), ("'", "’", False), ("u", "ü", False), ("-", "–", False),
    ],
)
def test_print_form(a, b, same):
    assert (printform.print_form(a) == printform.print_form(b)) == same
    assert printform.print_form(printform.print_form(b)) == printform.print_form(b)


def test_confusables_of_other_scripts(spark):
    extra = printform.confusables(spark)
    assert extra["Ꭺ"] == "A" and all(len(c) == len(to) == 1 and to.isascii() and to.isalpha() for c, to in extra.items()) and not set(extra) & set(printform.MAPPING)
    assert "σ" not in extra and "ICU" in printform.confusables_version(spark)
    form = printform.extended_transducer(tuple(sorted(extra.items())))
    assert form("ᎪB") == form("AB") and all(form(form(c)) == form(c) for c in extra)


def test_print_words_keep_case_pairs_of_other_scripts():
    assert printform.print_words("Вода и ВОТ") == printform.print_words("вода И вот")
    assert printform.print_words("Вecause оf tһe") == ["because", "of", "the"]
    assert printform.print_words("Tότε o") == printform.print_words("τότε ο")
    assert printform.print_words("naïve “x’s” ａ1") == ["naïve", "x", "s", "a1"] and printform.print_words("") == []


def test_lookalike_pairs(spark):
    df = clashing(spark.createDataFrame([(1, "abc"), (2, "аbc"), (3, "abc"), (4, "ab​c"), (5, None), (6, ""), (7, "ABC"), (8, ""), (2, "аbc"), (9, "​")], ROWS))
    got = sorted((r.id_a, r.id_b) for r in printform.lookalike_pairs(df, "id", F.col("text"), "x").collect())
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4), (6, 9), (8, 9)]
    assert printform.lookalike_pairs(df.where("false"), "id", F.col("text"), "x").count() == 0


# ---- near duplicates -----------------------------------------------------------------------------------------------------


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, 40, dtype=np.uint32)
    b = np.concatenate((a[:30], rng.integers(0, 2**32, 10, dtype=np.uint32)))
    common = {int(x): 3.0 for x in a[:10]}
    s = neardup.Signer(common, 1.0, 400, 5).sign(np.concatenate((a, b)), np.repeat([0, 1], 40), 2)
    assert abs((s[0] == s[1]).mean() - (10 * 3 + 20) / (10 * 3 + 40)) < 0.05
    again = neardup.Signer(common, 1.0, 400, 5).sign(b[::-1].copy(), np.zeros(40, int), 1)
    assert (again[0] == s[1]).all()


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    base = [sentence(rng, rng.randrange(12, 30)) for _ in range(60)]
    rows = []
    for t in base:
        rows.append(t)
        for _ in range(rng.randrange(4)):
            w = t.split()
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(1000))
            rng.shuffle(w) if rng.random() < 0.3 else None
            rows.append(" ".join(w))
    rows += [base[0]] * 3 + [None, "", "few words", LONG]
    x = pd.DataFrame({"uid": range(len(rows)), "text": rows})
    df = clashing(spark.createDataFrame([*zip(x.uid.tolist(), rows), (0, rows[0])], ROWS))
    members, pairs = neardup.near_duplicates(df, "id", "text", 0.7, 12, 1)
    got = [(r.uid_a, r.uid_b) for r in neardup.expand_pairs(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == neardup.pandas_pairs(x, 0.7, 12)
    groups = {r.uid: r.group_id for r in neardup.connected_groups(members, pairs).collect()}
    parent = {u: u for u in groups}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in got:
        parent[find(a)] = find(b)
    assert len({(find(u), g) for u, g in groups.items()}) == len(set(groups.values())) == len({find(u) for u in groups})


def test_near_duplicates_empty(spark):
    m, p = neardup.near_duplicates(spark.createDataFrame([(1, None)], ROWS), "id", "text")
    assert m.count() == 0 and neardup.expand_pairs(m, p).count() == 0 and neardup.connected_groups(m, p).count() == 0


@pytest.mark.parametrize("largest", [3, 50, 10_000])
def test_large_bands_are_split(spark, largest):
    rng = random.Random(largest)
    rows = [(b, c) for b in range(20) for c in rng.sample(range(500), rng.choice([1, 2, 5, 60]))]
    want = set()
    for b in range(20):
        own = sorted({c for bb, c in rows if bb == b})
        want |= {(x, y) for i, x in enumerate(own) for y in own[i + 1 :]}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {tuple(r) for r in neardup.candidate_pairs(spark.createDataFrame(rows, "band long, cls long"), largest).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want


# ---- encoding ------------------------------------------------------------------------------------------------------------

CLEAN = ["der Müller öffnete die Tür für den König", "le pêcheur répondit près de la forêt élevée", "когда пастух открыл ворота у дома", "ο κήπος φύτεψε το λιμάνι", "la montaña guardará el corazón", "the lamp of the harbour was bright"]


def garble(t, true, read):
    return t.encode(true).decode(read)


def test_undo_inverts_every_chain():
    for name, steps in mojibake.CHAINS.items():
        for w in ("überquerte", "répondit", "пустыня", "λιμάνι", "שלום", "“x”"):
            g = w
            try:
                for true, read in reversed(steps):
                    g = bytes(g.encode(true)).decode(read)
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if g != w and not any(c.isspace() for c in g) and steps[0][0] == "utf-8":
                assert mojibake.undo(g, name) == w, (name, w)


def test_garbled_rows(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(600):
        ws = [rng.choice(CLEAN).split() for _ in range(3)]
        t = " ".join(rng.choice(w) for w in ws for _ in range(4))
        bad = None
        if i % 10 == 0 and not t.isascii():
            bad = garble(t, "utf-8", "cp437")
            want[i] = t
        rows.append((i, f"m{i % 3}", bad or t))
    rows += [(1000, "m0", None), (1001, "m0", ""), (1002, None, "gar�led"), (1003, "m1", "la montaña " * 3000), (0, "m0", rows[0][2])]
    df = clashing(spark.createDataFrame(rows, "id long, m string, text string"))
    got = {r.src_id: r.restored for r in mojibake.garbled_rows(mojibake.source_rows(df, "x", "id", "m", "text")).collect()}
    assert set(got) == set(want) | {1002} and got[1002] is None
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert mojibake.garbled_rows(mojibake.source_rows(df.where("false"), "x", "id", "m", "text")).count() == 0


# ---- residue -------------------------------------------------------------------------------------------------------------

RESIDUE = ["Please enable JavaScript to view Foo 12.", "x y z {{title}} a b", "404 Not Found: /a/1 is not on this server", "the road to ${book.name} was", "Lorem ipsum dolor sit amet elit magna", "see %%BODY%%", "[INSERT TITLE HERE]", "asdf asdf asdf", "Seite nicht gefunden: Xyz (98912)", "__BODY__", "old <%= ref %> new", "{0} and {1}"]
CONTENT = ["And the king said {and} went", "he wrote [the] law [25]", "<<A song of Asaph.>> praise", "$11 was the price of the field", "In the 404th year he was sought and was not found", "It is not found in the copy of Seth that 500 scribes wrote", "the scripts of Seth were required of the scribes", "et non in est qui", "", "The error of Seth was great, and the page of the scroll could not be opened, and so on"]


def test_residue(spark):
    filler = [sentence(random.Random(i), 9) for i in range(300)] + [f"et rex{i} non dux{i} in urbe est qui" for i in range(200)]
    rows = [(i, t) for i, t in enumerate(RESIDUE + CONTENT + filler)] + [(9000, None), (9001, LONG), (0, RESIDUE[0])]
    df = clashing(spark.createDataFrame(rows, ROWS))
    got = sorted(r.src_id for r in residue.residue_rows(residue.text_rows(df, "x", "id", "text")).collect())
    assert got == list(range(len(RESIDUE)))
    assert residue.residue_rows(residue.text_rows(df.where("false"), "x", "id", "text")).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------------


def test_best_fit():
    rng = random.Random(4)
    sizes = [rng.randrange(0, 101) for _ in range(500)]
    placed = packing.best_fit(sizes, 100)
    used = {}
    for (c, at), s in zip(placed, sizes):
        used.setdefault(c, []).append((at, s))
    for own in used.values():
        own.sort()
        assert sum(s for _, s in own) <= 100 and all(a + s <= b for (a, s), (b, _) in zip(own, own[1:]))
    assert len(used) <= 1.1 * sum(sizes) / 100 + 1


@pytest.mark.parametrize("targets", [None, {"hot": 0.5, "b": 0.2}])
def test_packing(spark, targets):
    rng = random.Random(6)
    rows = [(i, sentence(rng, rng.choice([1, 5, 30, 80])), rng.choice(["hot", "hot", "b", "c", None])) for i in range(900)]
    rows += [(2000, None, "b"), (2001, "", "b"), (2002, LONG[:30_000], "c"), (2003, "dup", "c"), (2003, "dup", "c")]
    df = clashing(spark.createDataFrame(rows, "id long, text string, src string"))
    out = packing.pack(df, "id", "text", "src", capacity=512, containers=8, targets=targets).toPandas()
    count = packing.encoder(packing.TOKENIZER).encode_ordinary
    size = {i: len(count(t)) if t else 0 for i, t, _ in rows}
    assert len(out[out.doc_id == 2003]) == 2
    once = out.drop_duplicates(["doc_id", "part"])
    assert once.groupby("doc_id").n_tokens.sum().to_dict() == size
    parts = once.groupby("doc_id").part.count()
    assert all(parts[i] == max(1, -(-n // 512)) for i, n in size.items())
    per = out.groupby("container_id").n_tokens.sum()
    assert per.max() <= 512
    for _, own in out.sort_values("start_token").groupby("container_id"):
        own = own[own.n_tokens > 0]
        assert (own.start_token + own.n_tokens).iloc[:-1].le(own.start_token.iloc[1:].to_numpy()).all()
    items = packing.sized_items(df, "id", "text", "src")
    kept = packing.conservation(spark.createDataFrame(out), items, 512).toPandas().set_index("doc_id")
    assert len(kept) == len(size) and kept[["whole", "fits", "tokens_kept"]].all().all() and (kept.copies == 1 + (kept.index == 2003)).all()
    cut = packing.conservation(spark.createDataFrame(out[out.doc_id != 5]), items, 512).where("doc_id = 5").first()
    assert (cut.copies, cut.whole, cut.tokens_kept) == (0, False, False)
    if targets:
        errors = packing.share_errors(spark.createDataFrame(out), targets).toPandas()
        assert set(errors.source) == set(targets) and errors.error.max() < 0.1 and len(errors) > 6
    if targets is None:
        assert per.sum() / (512 * len(per)) > 0.93
        mix = packing.mixture_report(spark.createDataFrame(out)).toPandas()
        whole = out.groupby("source").n_tokens.sum() / out.n_tokens.sum()
        big = mix[(mix.source == "hot") & (mix.win < mix.win.max() - 1)]
        assert (big.share - whole["hot"]).abs().max() < 0.2
    assert packing.pack(df.where("false"), "id", "text", "src").count() == 0


def test_rounds_are_deficit_round_robin(spark):
    """The closed form against a queue-by-queue simulation."""
    rng = random.Random(9)
    items = [(i, rng.choice("ab"), rng.randrange(1, 60)) for i in range(300)]
    df = spark.createDataFrame(items, "doc_id long, source string, tokens int")
    for shard_docs in (10_000, 40):
        got = packing.rounds(df, 100, 10, None, shard_docs).toPandas()
        total = sum(t for _, _, t in items)
        for s in "ab":
            own = got[got.source == s]
            quantum = 1000 * own.tokens.sum() / total
            sent = own.groupby("win").tokens.sum().sort_index().cumsum()
            for w, v in sent.items():  # after round w a queue has sent at most its quanta, and lacks less than one item
                assert v <= quantum * (w + 1) + 1 and v > quantum * (w + 1) - 60 or w == own.win.max()


def test_items_of_no_tokens_are_spread(spark):
    df = spark.range(3000).select("id", F.lit("").alias("text"), F.lit("none").alias("src")).unionByName(spark.createDataFrame([(10**6 + i, sentence(random.Random(i), 60), "x") for i in range(300)], "id long, text string, src string"))
    out = packing.pack(df, "id", "text", "src", capacity=512, containers=4).where("source = 'none'").groupBy(F.shiftright("container_id", 20)).count().collect()
    assert len(out) > 5 and max(r["count"] for r in out) < 1500 and sum(r["count"] for r in out) == 3000


# ---- leaks ---------------------------------------------------------------------------------------------------------------


def test_word_hashes_agree_with_regex():
    texts = ["Hello, WORLD ß_x", None, "", "über² a1", "\U0001f600x", "no", "end\n"]
    got = [[], [], [], [], [], [], []]
    seen = {}
    for rows, hs in textvec.word_hashes(texts):
        for r, h in zip(rows, hs):
            got[r].append(int(h))
    for t, hs in zip(texts, got):
        words = printform.WORD.findall(t.lower()) if t else []
        assert len(words) == len(hs)
        for w, h in zip(words, hs):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_leaks_match_brute_force(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, rng.choice([5, 13, 20, 40]))) for i in range(30)]
    docs = []
    for i in range(150):
        t = sentence(rng, rng.choice([3, 60, 200]))
        if rng.random() < 0.6:
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            piece = w[a : a + rng.randrange(1, 30)]
            if rng.random() < 0.3 and len(piece) > 4:
                piece[len(piece) // 2] = "changed"
            t += " " + ", ".join(piece).upper() + "! " + sentence(rng, 5)
        docs.append((i, t))
    docs += [(900, None), (901, ""), (902, LONG + items[3][1] + LONG), docs[0]]
    items += [(100, None), (101, ""), (102, items[1][1])]
    words = lambda t: printform.WORD.findall((t or "").lower())
    want = set()
    for i, p in items:
        w = words(p)
        runs = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        for d, t in docs:
            x = words(t)
            if any(tuple(x[k : k + 13]) in runs for k in range(len(x) - 12)):
                want.add((i, d))
    df, it = clashing(spark.createDataFrame(docs, ROWS)), spark.createDataFrame(items, "item long, passage string")
    found = leaks.leaked_passages(df, "id", "text", it, "item", "passage")
    assert {tuple(r) for r in leaks.exact_leaks(found).collect()} == want and want
    assert leaks.exact_leaks(found).count() == len(want)
    assert leaks.leaked_passages(df.where("false"), "id", "text", it, "item", "passage").count() == 0
    assert leaks.leaked_passages(df, "id", "text", it.where("false"), "item", "passage").count() == 0


def test_leaks_without_broadcasts_and_with_a_full_filter(spark, monkeypatch):
    rng = random.Random(18)
    items = [(i, sentence(rng, 20)) for i in range(10)]
    docs = [(i, sentence(rng, 90) + " x " + p + " y " + sentence(rng, 300)) for i, p in items]
    monkeypatch.setattr(leaks, "BROADCAST_WORDS", 0)
    monkeypatch.setattr(leaks, "broadcast_if_small", lambda df: df)
    for bits in (8, 27):
        monkeypatch.setattr(leaks, "FILTER_BITS", bits)
        found = leaks.leaked_passages(spark.createDataFrame(docs, ROWS), "id", "text", spark.createDataFrame(items, "item long, passage string"), "item", "passage")
        assert {tuple(r) for r in leaks.exact_leaks(found).collect()} == {(i, i) for i in range(10)}


def test_overlap_tolerates_substitutions():
    eq = np.array([1] * 10 + [0] + [1] * 9 + [0] * 20, bool)
    assert leaks.overlap(eq) == (10, 20, 19)
    assert leaks.overlap(np.zeros(5, bool))[0] == 0


def test_substituted_leaks_are_reported(spark):
    words = [f"w{i}" for i in range(30)]
    changed = [("x" if i % 10 == 4 else w) for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, " ".join(words[:12])), (3, " ".join(reversed(words)))], ROWS)
    items = spark.createDataFrame([(7, " ".join(words))], "item long, passage string")
    found = leaks.leaked_passages(docs, "id", "text", items, "item", "passage").collect()
    assert [(r.doc_id, r.exact_words, r.equal_words) for r in found] == [(1, 9, 27)]


# ---- shared spans --------------------------------------------------------------------------------------------------------


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 300).astype(np.uint64)
    for w in (1, 7, 300):
        assert (spans.sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()


def longest_common(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                now[j] = prev[j - 1] + 1
        best = max(best, max(now))
        prev = now
    return best


def test_shared_pairs_match_brute_force(spark):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice(string.ascii_lowercase + "é \n") for _ in range(n))
    g, w = 60, 40
    shared = [noise(n) for n in (30, 45, 59, 60, 61, 80, 120)]
    docs = []
    for i in range(50):
        t = noise(rng.randrange(0, 120))
        for _ in range(2):
            t += rng.choice(shared) + noise(rng.randrange(1, 40))
        docs.append((i, t))
    docs += [(60, docs[0][1]), (61, docs[0][1]), (62, None), (63, ""), (64, "z" * 500), (65, "y" + "z" * 70), docs[1]]
    df = clashing(spark.createDataFrame(docs, ROWS))
    got = [(r.doc_a, r.doc_b) for r in spans.shared_pairs(df, "id", "text", g, w).collect()]
    text = dict(docs)
    want = {(a, b) for a in text for b in text if a < b and text[a] and text[b] and longest_common(text[a], text[b]) >= g}
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    per = {r.doc_id: r for r in spans.removal_intervals(df, "id", "text", g, w).collect()}
    assert set(per) == {x for p in want for x in p} and per[60].shared_share == 1.0
    holders = {}
    for i, t in text.items():
        for k in range(len(t or "") - g + 1):
            holders.setdefault(t[k : k + g], set()).add(i)
    for i, r in per.items():
        inside = [k for k in range(len(text[i]) - g + 1) if len(holders[text[i][k : k + g]]) > 1]
        covered = {x for k in inside for x in range(k, k + g)}
        assert (r.n_spans, r.shared_chars, r.n_chars) == (sum(b - a > g for a, b in zip([-g - 1, *inside], inside)), len(covered), len(text[i]))
    assert spans.removal_intervals(df.where("false"), "id", "text").count() == 0
    assert spans.shared_pairs(df.where("false"), "id", "text").count() == 0
