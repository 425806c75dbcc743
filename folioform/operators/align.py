"""Alignment and comparison of parallel texts and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parallel(df: DataFrame, keys: list[str], side: str, text: str, sides: list[str]) -> DataFrame:
    """One row per key and a column per side with its text (the least one if there are several), "not available" if it has none."""
    p = df.groupBy(*keys).pivot(side, sides).agg(F.min(text))
    return p.select(*keys, *[F.coalesce(F.col(f"`{s}`"), F.lit("not available")).alias(s) for s in sides])


def positional_diff(a: DataFrame, b: DataFrame, order: list[str], value: str, by: list[str] | None = None) -> DataFrame:
    """(*by, pos, value_a, value_b): positions where two logs differ; a missing line is ''. Logs are compared per ``by``, so that
    positions come from one window per log and not from one over the table."""
    by = by or []

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("pos"), F.col(value).alias(name))

    j = numbered(a, "value_a").join(numbered(b, "value_b"), [*by, "pos"], "full_outer")
    return j.where(~F.col("value_a").eqNullSafe(F.col("value_b"))).select(*by, "pos", F.coalesce("value_a", F.lit("")).alias("value_a"), F.coalesce("value_b", F.lit("")).alias("value_b"))


def line_diff(a: Column, b: Column) -> Column:
    """array<struct<line, kind, old, new>> of two texts by line number; an empty line counts as missing."""
    zipped = F.arrays_zip(F.split(a, "\n").alias("o"), F.split(b, "\n").alias("n"))
    rows = F.transform(zipped, lambda z, i: F.struct((i + 1).alias("line"), F.coalesce(z["o"], F.lit("")).alias("old"), F.coalesce(z["n"], F.lit("")).alias("new")))
    kind = lambda z: F.when(z["old"] == "", "added").when(z["new"] == "", "removed").otherwise("changed")
    return F.transform(F.filter(rows, lambda z: z["old"] != z["new"]), lambda z: F.struct(z["line"].alias("line"), kind(z).alias("kind"), z["old"].alias("old"), z["new"].alias("new")))


def truncated_diff(diff: Column, n: int) -> Column:
    """struct<shown, more>: the first ``n`` differences and the number of the others."""
    return F.struct(F.slice(diff, 1, n).alias("shown"), F.greatest(F.size(diff) - n, F.lit(0)).alias("more"))


def token_pairs(a: Column, b: Column) -> Column:
    """Words of two texts paired by position, as far as both go; confidence 0.5."""
    n = F.least(F.size(a), F.size(b))
    return F.transform(F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), 1, n), lambda z, i: F.struct(i.alias("pos"), z["a"].alias("word_a"), z["b"].alias("word_b"), F.lit(0.5).alias("confidence")))


def unique_words(df: DataFrame, key: list[str], side: str, words: Column) -> DataFrame:
    """Words (over two characters) that only one side of a key has."""
    w = df.select(*key, side, F.explode(words).alias("word")).where(F.length("word") > 2).distinct()
    only = w.groupBy(*key, "word").agg(F.count("*").alias("_n"), F.min(side).alias(side))
    return only.where("_n = 1").drop("_n")


def bag_similarity(pairs: DataFrame, ids: list[str], words_a: Column, words_b: Column) -> DataFrame:
    """Share of equal words, as bags: sum of the lesser counts over the greater number of words; 0 if both are empty.

    Row by row: each word is numbered among its equals, which makes bags sets. No shuffle.
    """

    def numbered(words: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("k"))
        runs = F.aggregate(F.array_sort(words), F.array(start), lambda acc, w: F.array_append(acc, F.struct(w.alias("w"), F.when(F.element_at(acc, -1)["w"] == w, F.element_at(acc, -1)["k"] + 1).otherwise(1).alias("k"))))
        return F.slice(runs, 2, F.size(words) + 1)

    common = F.size(F.array_intersect(numbered(words_a), numbered(words_b)))
    most = F.greatest(F.size(words_a), F.size(words_b))
    return pairs.select(*ids, F.round(F.when(most > 0, common / most).otherwise(0.0), 6).alias("similarity"))


def interval_lookup(points: DataFrame, point_id: str, intervals: DataFrame, key: str, at: list[str], lo: list[str], hi: list[str], order: list[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """(point_id, first): the first interval (by ``order``) that contains each point, compared as tuples, within an equal key.

    ``bucket`` maps the first column of ``at`` to a whole number, monotonically: points then meet only the intervals that
    reach into their bucket, so that one hot key is spread over its buckets. The least interval is kept before and after the
    shuffle by ``point_id``; points in no interval have no row.
    """
    p = points.select(point_id, key, *at)
    i = intervals.select(F.struct(*lo).alias("_lo"), F.struct(*hi).alias("_hi"), F.struct(*order).alias("_o"), F.col(key).alias("_key"), *([F.explode(F.sequence(bucket(F.col(lo[0])), bucket(F.col(hi[0])))).alias("_ib")] if bucket else [F.lit(0).alias("_ib")]))
    p = p.withColumn("_pb", bucket(F.col(at[0])) if bucket else F.lit(0))
    t = F.struct(*[F.col(c).alias(x) for c, x in zip(at, lo)])
    u = F.struct(*[F.col(c).alias(x) for c, x in zip(at, hi)])
    j = p.join(i, (F.col(key) == F.col("_key")) & (F.col("_pb") == F.col("_ib")) & (t >= F.col("_lo")) & (u <= F.col("_hi")))
    return j.groupBy(point_id).agg(F.min("_o").alias("first"))


def overlaps(spans: DataFrame, key: str, span_id: str, start: str, end: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs of spans of one block that overlap, the lesser id first.

    With ``bucket`` (see interval_lookup; of [start, end]) spans meet in the buckets they both reach into, and a pair is
    taken from the first of these only, so a hot block is spread and nothing is paired twice.
    """
    rows = spans.select(key, F.col(span_id).alias("id"), F.col(start).alias("s"), F.col(end).alias("e"))
    rows = rows.withColumn("_first", bucket(F.col("s")) if bucket else F.lit(0))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.col("_first"), F.greatest("_first", bucket(F.col("e"))))) if bucket else F.lit(0))
    a, b = (rows.select(key, "_b", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "s", "e", "_first")]) for x in "ab")
    met = a.join(b, [key, "_b"]).where("id_a < id_b AND s_a < e_b AND s_b < e_a AND _b = greatest(_first_a, _first_b)")
    return met.select(key, "id_a", "id_b")
