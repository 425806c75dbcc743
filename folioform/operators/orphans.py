"""References to records that do not exist: a skew-aware anti-join of pre-aggregated references on keys with lifetimes.

References are counted per key and period before anything is joined. A group is judged as a whole wherever no target of its
key begins or ends between its first and its last reference; only rows of the other groups are judged singly, by an
anti-join on key and time. Keys that carry more than HEAVY_SHARE of all references are few by construction, so their groups
and lifetimes are joined by a size-checked broadcast, and heavy references never move; all other keys are shuffled. Both
halves are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioform.session import broadcast_if_small, materialize

#: A key with more than this share of all references is heavy; there are fewer than 1 / HEAVY_SHARE such keys.
HEAVY_SHARE = 0.01

_BLANK = r"^[\s\u0085 ]+|[\s\u0085 ]+$"


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _BLANK, "")


def hash_key(c: Column) -> Column:
    """A content hash without case, surrounding white space and ``sha256:``; blank becomes null."""
    return _or_null(trimmed(F.regexp_replace(F.lower(trimmed(c)), "^sha256:", "")))


def name_key(c: Column) -> Column:
    """A name without case and surrounding blanks; blank becomes null."""
    return _or_null(F.lower(trimmed(c)))


def lifetimes(targets: DataFrame, key: Column, born: str, died: str) -> DataFrame:
    """(_k, _b, _d, _first): the disjoint intervals [_b, _d) in which some target row of a key is there, and when its first row was
    born. Overlapping intervals are merged by a sorted window that spills, so no key's rows are ever collected."""
    kind = targets.schema[born].dataType
    start, end = F.lit("0001-01-01 00:00:00").cast(kind), F.lit("9999-12-31 00:00:00").cast(kind)
    rows = targets.select(key.alias("_k"), F.coalesce(F.col(born), start).alias("_b"), F.coalesce(F.col(died), end).alias("_d")).where("_k IS NOT NULL")
    rows = rows.groupBy("_k", "_b").agg(F.greatest("_b", F.max("_d")).alias("_d"))
    w = Window.partitionBy("_k").orderBy("_b")
    rows = rows.withColumn("_new", F.when(F.max("_d").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("_b"), 0).otherwise(1))
    rows = rows.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_first", F.first("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("_k", "_i").agg(F.min("_b").alias("_b"), F.max("_d").alias("_d"), F.min("_first").alias("_first")).drop("_i")


@dataclass
class Judged:
    """References judged per key and period."""

    keyed: DataFrame  # src_id, _k, _t, _m: every reference
    life: DataFrame  # of lifetimes()
    groups: DataFrame  # _k, _m, _n, _first, _verdict: groups with orphans; the verdict 'rows' leaves it to the rows
    heavy: list[str]

    def split(self, left: DataFrame, right: DataFrame, on: list[str], how: str, extra: Column | None = None) -> DataFrame:
        """``left`` joined to ``right``, of which heavy keys' rows are broadcast if they are few."""

        def join(x: DataFrame, y: DataFrame) -> DataFrame:
            if extra is None:
                return x.join(y, on, how)
            return x.join(y.withColumnRenamed("_k", "_rk"), (F.col("_k") == F.col("_rk")) & extra, how)

        if not self.heavy:
            return join(left, right)
        hot = F.col("_k").isin(self.heavy)
        return join(left.where(hot), broadcast_if_small(right.where(hot), 100_000)).unionByName(join(left.where(~hot), right.where(~hot)))


def judge(refs: DataFrame, targets: DataFrame, ref_key: Column, target_key: Column, src_id: str, at: Column, born: str, died: str, heavy_share: float = HEAVY_SHARE) -> Judged:
    keyed = refs.select(F.col(src_id).alias("src_id"), ref_key.alias("_k"), at.alias("_t")).where("_k IS NOT NULL").withColumn("_m", F.coalesce(F.date_format("_t", "yyyy-MM"), F.lit("")))
    counted = materialize(keyed.groupBy("_k", "_m").agg(F.count("*").alias("_n"), F.min("_t").alias("_lo"), F.max("_t").alias("_hi")), "orphan-groups")
    total = counted.agg(F.sum("_n")).first()[0] or 0
    heavy = [r[0] for r in counted.groupBy("_k").agg(F.sum("_n").alias("_n")).where(F.col("_n") > heavy_share * total).select("_k").collect()]  # fewer than 1 / heavy_share rows
    life = materialize(lifetimes(targets, target_key, born, died), "lifetimes")
    out = Judged(keyed, life, counted, heavy)
    met = out.split(counted, life, ["_k"], "left")
    lo, hi, b, d = (F.col(c) for c in ("_lo", "_hi", "_b", "_d"))
    seen = met.groupBy("_k", "_m").agg(F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.min("_first").alias("_first"), F.bool_or((b <= lo) & (hi < d)).alias("_cover"), F.bool_or((b <= hi) & (lo < d)).alias("_touch"))
    first, no = F.col("_first"), F.lit(False)
    verdict = F.when(first.isNull(), "missing").when(lo.isNull() | F.coalesce("_cover", no), None).when(F.coalesce("_touch", no), "rows").when(first > hi, "late").when(first <= lo, "deleted").otherwise("rows")
    out.groups = materialize(seen.select("_k", "_m", "_n", "_first", verdict.alias("_verdict")).where("_verdict IS NOT NULL"), "orphan-verdicts")
    return out


def single_rows(j: Judged) -> DataFrame:
    """(src_id, _m, reason): the orphans of groups that can't be judged as a whole."""
    mixed = j.split(j.keyed, j.groups.where("_verdict = 'rows'").select("_k", "_m", "_first"), ["_k", "_m"], "inner")
    alone = j.split(mixed, j.life.select("_k", "_b", "_d"), ["_k"], "left_anti", (F.col("_b") <= F.col("_t")) & (F.col("_t") < F.col("_d")))
    return alone.select("src_id", "_m", F.when(F.col("_first") > F.col("_t"), "late").otherwise("deleted").alias("reason"))


def orphan_references(j: Judged, src_table: str) -> DataFrame:
    """Orphans: (src_table, src_id, ref_month, reason).

    Null or blank keys are no references. A target row is there from ``born`` (inclusive; null: always was) to ``died``
    (exclusive; null: still is). ``missing``: no target row has the key; ``late``: all were born after the reference;
    ``deleted``: otherwise none is there. A reference without a time is judged ``missing`` only, with a null month.
    Empty references give no rows; empty targets make every reference ``missing``. Repeated rows are reported once.
    """
    whole = j.split(j.keyed, j.groups.where("_verdict <> 'rows'").select("_k", "_m", F.col("_verdict").alias("reason")), ["_k", "_m"], "inner").select("src_id", "_m", "reason")
    return whole.unionByName(single_rows(j)).select(F.lit(src_table).alias("src_table"), "src_id", F.nullif("_m", F.lit("")).alias("ref_month"), "reason").distinct()


def orphan_counts(j: Judged, src_table: str) -> DataFrame:
    """(src_table, ref_month, reason, n_orphans): groups judged as a whole count by their pre-aggregated number, so only rows of
    the other groups are read again. A reference delivered twice counts twice."""
    whole = j.groups.where("_verdict <> 'rows'").select("_m", F.col("_verdict").alias("reason"), "_n")
    both = whole.unionByName(single_rows(j).groupBy("_m", "reason").agg(F.count("*").alias("_n")))
    return both.groupBy("_m", "reason").agg(F.sum("_n").alias("n_orphans")).select(F.lit(src_table).alias("src_table"), F.nullif("_m", F.lit("")).alias("ref_month"), "reason", "n_orphans")


def judged_runs(runs: DataFrame, blobs: DataFrame, **kw) -> Judged:
    return judge(runs, blobs, hash_key(F.col("transcript_blob_sha256")), hash_key(F.col("sha256")), "run_uid", F.coalesce("finished_at", "started_at"), "created_at", "deleted_at", **kw)


def judged_verses(verses: DataFrame, books: DataFrame, **kw) -> Judged:
    return judge(verses, books, name_key(F.col("book")), name_key(F.col("id")), "verse_uid", F.col("created_at"), "added_at", "deleted_at", **kw)
