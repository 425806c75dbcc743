"""Numbering systems: canons, absolute verse indexes, mappings between systems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows before the first verse of a testament: a module heading and a testament heading.
LEAD = 2
#: Absolute indexes of one bucket of a range join.
BUCKET = 64


def load_canon(spark, path: str, lines: bool = False) -> DataFrame:
    """(system, testament, book_idx, book, name, chapter, n_verses) of canon files {id, ot_books, nt_books: [{name, osis, chapters}]}, one a file, or (``lines``) one a line."""
    book = "array<struct<name:string,osis:string,chapters:array<int>>>"
    raw = spark.read.schema(f"id string, ot_books {book}, nt_books {book}").option("multiLine", str(not lines).lower()).json(path)
    sides = [raw.select(F.col("id").alias("system"), F.lit(t).alias("testament"), F.posexplode(c).alias("book_idx", "b")) for t, c in (("OT", "ot_books"), ("NT", "nt_books"))]
    both = sides[0].unionByName(sides[1])
    return both.select("system", "testament", "book_idx", F.col("b.osis").alias("book"), F.col("b.name").alias("name"), F.posexplode("b.chapters").alias("c", "n_verses")).withColumn("chapter", F.col("c") + 1).drop("c")


def resolve_canon(canon: DataFrame, name: str, aliases: dict[str, str] | None = None, fallback: str | None = None) -> tuple[DataFrame, str]:
    """The rows of the system ``name`` (whatever its case, or one of its ``aliases``), those of ``fallback`` if it has none, and the system taken."""
    wanted = {k.lower(): v for k, v in (aliases or {}).items()}.get(name.lower(), name)
    known = {r.system.lower(): r.system for r in canon.select("system").distinct().collect() if r.system}  # a handful of systems
    for n in (wanted, fallback):
        if n and n.lower() in known:
            return canon.where(F.col("system") == known[n.lower()]), known[n.lower()]
    raise ValueError(f"no numbering system {name}")


def canon_totals(canon: DataFrame) -> DataFrame:
    """Chapters and verses per system, testament and book, with subtotals."""
    return canon.rollup("system", "testament", "book").agg(F.count("*").alias("n_chapters"), F.sum("n_verses").alias("n_verses"))


def verse_index(canon: DataFrame, part: list[str]) -> DataFrame:
    """``canon`` (*part, book_idx, chapter, n_verses) with ``start``, the absolute index of each chapter's first verse.

    A testament opens with LEAD headings, every book with one, every chapter with one. Running sums per testament: a window
    over one row per chapter, never over verses.
    """
    ordered = Window.partitionBy(*part).orderBy("book_idx", "chapter")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    book_head = F.when(F.row_number().over(Window.partitionBy(*part, "book_idx").orderBy("chapter")) == 1, 1).otherwise(0)
    rows = canon.withColumn("_own", F.col("n_verses") + 1 + book_head).withColumn("_head", book_head)
    return rows.withColumn("start", LEAD + F.coalesce(F.sum("_own").over(before), F.lit(0)) + F.col("_head") + 1).drop("_own", "_head")


def index_to_ref(indexes: DataFrame, starts: DataFrame, part: list[str], idx: str = "idx") -> DataFrame:
    """(…, book_idx, chapter, verse) of absolute indexes within a part: a join on the part and on the BUCKET of indexes, to which
    each chapter is added once for every bucket it reaches into, so that an index meets a bucket's chapters only."""
    x = indexes.withColumn("_bucket", F.floor(F.col(idx) / BUCKET))
    s = starts.where("n_verses > 0").withColumn("_end", F.col("start") + F.col("n_verses"))
    s = s.select(*part, "book_idx", "chapter", "start", "_end", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("_end") - 1) / BUCKET))).alias("_bucket"))
    met = x.join(s, [*part, "_bucket"]).where((F.col(idx) >= F.col("start")) & (F.col(idx) < F.col("_end")))
    return met.select(*indexes.columns, "book_idx", "chapter", (F.col(idx) - F.col("start") + 1).alias("verse"))


def map_refs(refs: DataFrame, mappings: DataFrame, keys: list[str], to: list[str], order: list[str]) -> DataFrame:
    """Each reference mapped by the first mapping (by ``order``) of its keys; itself if there is none. ``to`` name the columns mapped to, one per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = mappings.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*keys, *to, F.lit(True).alias("_hit"))
    joined = refs.join(first, keys, "left")
    return joined.select(*[c for c in refs.columns if c not in keys], *keys, *[F.when(F.col("_hit"), F.col(t)).otherwise(F.col(k)).alias(f"mapped_{k}") for k, t in zip(keys, to)])


def chain_mappings(ab: DataFrame, bc: DataFrame, keys: list[str], to: list[str]) -> DataFrame:
    """Mappings A→B joined to B→C: a reference B→C does not know stays as B has it; mappings to nothing are dropped."""
    mid = ab.where(" AND ".join(f"{t} IS NOT NULL" for t in to))
    nxt = bc.select(*[F.col(k).alias(t) for k, t in zip(keys, to)], *[F.col(t).alias(f"_{t}") for t in to])
    return mid.join(nxt, to, "left").select(*keys, *[F.coalesce(f"_{t}", t).alias(t) for t in to])


def rule_map(refs: DataFrame, rules: list[tuple], keys: list[str], to: list[str]) -> DataFrame:
    """Rules (*keys, *to), in order, where a key of 0 stands for any: the first rule that fits. Rules are literals of the plan, so nothing is joined."""
    fits = [reduce(lambda x, y: x & y, [(F.col(k) == v) if v != 0 else F.lit(True) for k, v in zip(keys, r)]) for r in rules]

    def mapped(i: int, k: str):
        out = None
        for fit, r in zip(fits, rules):
            out = F.when(fit, F.lit(r[len(keys) + i])) if out is None else out.when(fit, F.lit(r[len(keys) + i]))
        return (F.col(k) if out is None else out.otherwise(F.col(k))).alias(f"mapped_{k}")

    return refs.select(*refs.columns, *[mapped(i, k) for i, k in enumerate(keys)])


def greek_psalm(chapter, verse):
    """(chapter, verse, kind) of a Hebrew-numbered psalm in the Greek numbering."""
    c, v = chapter, verse
    to_c = F.when(c <= 8, c).when(c == 9, c).when(c == 10, F.lit(9)).when(c.between(11, 113), c - 1).when(c == 114, F.lit(113)).when(c == 115, F.lit(113)).when((c == 116) & (v <= 9), F.lit(114)).when(c == 116, F.lit(115)).when(c.between(117, 146), c - 1).when((c == 147) & (v <= 11), F.lit(146)).when(c == 147, F.lit(147)).otherwise(c)
    to_v = F.when(c == 10, v + 21).when(c == 115, v + 8).when((c == 116) & (v > 9), v - 9).when((c == 147) & (v > 11), v - 11).otherwise(v)
    kind = F.when(c.isin(10, 115), "merge").when(c.isin(116, 147), "split").when((c <= 9) | (c >= 148), "direct").otherwise("renumber")
    return F.struct(to_c.cast("int").alias("chapter"), to_v.cast("int").alias("verse"), kind.alias("kind"))


def hebrew_psalm(chapter, verse):
    """(chapter, verse, kind) of a Greek-numbered psalm in the Hebrew numbering: the inverse of greek_psalm within the psalms' lengths."""
    c, v = chapter, verse
    to_c = F.when(c <= 8, c).when((c == 9) & (v <= 21), c).when(c == 9, F.lit(10)).when(c.between(10, 112), c + 1).when((c == 113) & (v <= 8), F.lit(114)).when(c == 113, F.lit(115)).when(c.isin(114, 115), F.lit(116)).when(c.between(116, 145), c + 1).when(c.isin(146, 147), F.lit(147)).otherwise(c)
    to_v = F.when((c == 9) & (v > 21), v - 21).when((c == 113) & (v > 8), v - 8).when(c == 115, v + 9).when(c == 147, v + 11).otherwise(v)
    kind = F.when(c.isin(9, 113), "split").when(c.isin(114, 115, 146, 147), "merge").when((c <= 8) | (c >= 148), "direct").otherwise("renumber")
    return F.struct(to_c.cast("int").alias("chapter"), to_v.cast("int").alias("verse"), kind.alias("kind"))


def split_refs(refs: DataFrame, mappings: DataFrame, keys: list[str], targets: str, itself: str) -> DataFrame:
    """``refs`` with one row per ``target`` of their mapping (an array column); without one, or with an empty one, the column ``itself`` is the target."""
    joined = refs.join(mappings.select(*keys, targets), keys, "left")
    return joined.withColumn("target", F.explode(F.when(F.size(targets) > 0, F.col(targets)).otherwise(F.array(itself)))).drop(targets)


def merge_refs(refs: DataFrame, key: list[str], order: str, ref: list[str]) -> DataFrame:
    """References merged into one per ``key``: the first by ``order``."""
    return refs.groupBy(*key).agg(F.min_by(F.struct(*ref), order).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in ref])


def map_between(refs: DataFrame, tables: list[tuple[str, str, DataFrame]], source: str, target: str, keys: list[str], to: list[str]) -> tuple[DataFrame, str]:
    """References of system ``source`` in ``target``, and how they came there: by the ``direct`` table, ``chained`` over one system
    between, or as they are (``identity``). ``tables`` are (from, to, mappings); of several chains the first by name is taken."""
    by = {(a, b): m for a, b, m in tables}
    if source == target:
        return map_refs(refs, next(iter(by.values())).limit(0), keys, to, to), "identity"
    if (source, target) in by:
        return map_refs(refs, by[source, target], keys, to, to), "direct"
    for mid in sorted({b for a, b in by if a == source and (b, target) in by}):
        return map_refs(refs, chain_mappings(by[source, mid], by[mid, target], keys, to), keys, to, to), "chained"
    return map_refs(refs, next(iter(by.values())).limit(0), keys, to, to), "identity"


def canon_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Chapters where two systems (book, chapter, n_verses) differ."""
    j = a.alias("a").join(b.alias("b"), ["book", "chapter"], "full_outer")
    return j.where(~F.col("a.n_verses").eqNullSafe(F.col("b.n_verses"))).select("book", "chapter", F.col("a.n_verses").alias("n_a"), F.col("b.n_verses").alias("n_b"))


def expand_canon(canon: DataFrame) -> DataFrame:
    """One row per verse of a canon."""
    return canon.where("n_verses > 0").withColumn("verse", F.explode(F.sequence(F.lit(1), F.col("n_verses"))))


def apply_mapping(verses: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verses re-numbered, and the losses: mappings of type missing, merge or split that were used."""
    keys, to = ["book", "chapter", "verse"], ["to_book", "to_chapter", "to_verse"]
    mapped = map_refs(verses, mappings, keys, to, to)
    used = verses.select(*keys).distinct().join(mappings, keys).where(F.col("type").isin("missing", "merge", "split"))
    return mapped, used.select(*keys, F.col("type").alias("loss"))
