"""Differences between two copies of data: EXCEPT ALL both ways, by one count of every row's surplus, then a full join of the two residues by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioform.session import broadcast_if_small, materialize

MISSING_A, MISSING_B = "missing_in_a", "missing_in_b"


def latest_state(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple (nulls lowest; later columns of ``order`` break ties).

    An aggregation, not a window: partial maxima are taken before the shuffle, so a hot key costs one row per map task.
    """
    best = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)]))
    return df.groupBy(*keys).agg(best.alias("_s")).select(*keys, *[F.col(f"_s.f{i}").alias(c) for i, c in enumerate(fields)])


def diff_tables(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows (``*keys``, ``diff``) where the two tables differ.

    ``diff`` is ``missing_in_a`` / ``missing_in_b`` for a key one side lacks, else the name of each differing field.
    Null equals only null, in keys and fields. Rows repeated on one side only leave a residue on that side and are
    reported once per key. Empty tables give every row of the other side; two empty tables give no rows.
    Columns beyond ``keys`` and ``fields`` are ignored, whatever their names.
    """
    a, b = (x.select(*keys, *fields) for x in (a, b))
    n = "_n" + "_" * max(len(c) for c in (*keys, *fields))  # no column has this name
    # EXCEPT ALL both ways in one aggregation: what a row occurs more often on one side is that side's residue
    counted = a.withColumn(n, F.lit(1)).unionByName(b.withColumn(n, F.lit(-1))).groupBy(*keys, *fields).agg(F.sum(n).alias(n))
    only_a, only_b = counted.where(F.col(n) > 0), counted.where(F.col(n) < 0)
    ka, kb = [f"a_{i}" for i in range(len(keys))], [f"b_{i}" for i in range(len(keys))]

    def residue(df: DataFrame, side: str, names: list[str]) -> DataFrame:
        return df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[F.col(f).alias(f"{side}f_{i}") for i, f in enumerate(fields)], F.lit(True).alias(f"in_{side}"))

    ra, rb = residue(only_a, "a", ka), residue(only_b, "b", kb)
    on: Column = reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(ka, kb)])
    both = F.col("in_a") & F.col("in_b")
    changed = F.filter(F.array(*[F.when(~F.col(f"af_{i}").eqNullSafe(F.col(f"bf_{i}")), F.lit(f)) for i, f in enumerate(fields)]), lambda x: x.isNotNull())
    diffs = F.when(both, changed).when(F.col("in_a"), F.array(F.lit(MISSING_B))).otherwise(F.array(F.lit(MISSING_A)))
    key_out = [F.when(F.col("in_a"), F.col(x)).otherwise(F.col(y)).alias(k) for k, x, y in zip(keys, ka, kb)]
    return ra.join(rb, on, "full_outer").select(*key_out, F.explode(diffs).alias("diff")).distinct()


def compare_extractions(compare: DataFrame, blocks: DataFrame) -> DataFrame:
    """Compare pairs of extractions: (compare_id, doc_id, block_id, diff).

    A comparison with a null key is skipped; one logged twice counts once; a key without rows makes every block of the
    other side missing. Of several rows of a block the one with the latest ``extracted_at`` holds, the greater
    ``ir_row_id`` on a tie.
    """
    fields = ["seq", "text", "osis_id", "token_count"]
    keys = ["compare_id", "doc_id", "block_id"]
    pairs = compare.where("ir_a_key IS NOT NULL AND ir_b_key IS NOT NULL").select("compare_id", "ir_a_key", "ir_b_key").distinct()
    named = broadcast_if_small(pairs.select(F.explode(F.array("ir_a_key", "ir_b_key")).alias("ir_key")).distinct())
    current = materialize(latest_state(blocks.join(named, "ir_key", "left_semi"), ["ir_key", "doc_id", "block_id"], ["extracted_at", "ir_row_id"], fields), "current-blocks")
    pairs = broadcast_if_small(pairs)

    def side(key: str) -> DataFrame:
        return current.join(pairs.select("compare_id", F.col(key).alias("ir_key")).distinct(), "ir_key").select(*keys, *fields)

    return diff_tables(side("ir_a_key"), side("ir_b_key"), keys, fields).select(*keys, "diff")
