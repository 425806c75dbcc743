"""Stand-off annotations: from an annotation over its span and anchor to the block, by equal keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(annotations: DataFrame, spans: DataFrame, anchors: DataFrame, blocks: DataFrame, record: str = "rec_id") -> DataFrame:
    """(record, annotation_id, type, span_id, anchor_id, char_offset, block_id): annotations whose whole chain exists.

    All four tables are joined within ``record``, so the planner can keep them co-partitioned by it. Keys that occur several
    times in a record give every combination; an annotation with a gap in its chain has no row (see ``broken``).
    """
    n = annotations.select(record, "annotation_id", "type", "span_id")
    s = spans.select(record, "span_id", F.col("start_anchor_id").alias("anchor_id"))
    a = anchors.select(record, "anchor_id", "char_offset", F.col("content_block_id").alias("block_id"))
    b = blocks.select(record, "block_id")
    return n.join(s, [record, "span_id"]).join(a, [record, "anchor_id"]).join(b, [record, "block_id"]).select(record, "annotation_id", "type", "span_id", "anchor_id", "char_offset", "block_id")


def broken(annotations: DataFrame, spans: DataFrame, anchors: DataFrame, blocks: DataFrame, record: str = "rec_id") -> DataFrame:
    """(record, annotation_id, missing): annotations with a gap, and the first link that is missing: span, anchor or block."""
    n = annotations.select(record, "annotation_id", "span_id").distinct()
    s = spans.select(record, "span_id", F.col("start_anchor_id").alias("anchor_id"), F.lit(True).alias("_s")).distinct()
    a = anchors.select(record, "anchor_id", F.col("content_block_id").alias("block_id"), F.lit(True).alias("_a")).distinct()
    b = blocks.select(record, "block_id", F.lit(True).alias("_b")).distinct()
    j = n.join(s, [record, "span_id"], "left").join(a, [record, "anchor_id"], "left").join(b, [record, "block_id"], "left")
    reach = F.when(F.col("_s").isNull(), 0).when(F.col("_a").isNull(), 1).when(F.col("_b").isNull(), 2).otherwise(3)
    per = j.groupBy(record, "annotation_id").agg(F.max(reach).alias("r")).where("r < 3")
    return per.select(record, "annotation_id", F.element_at(F.array(*map(F.lit, ("span", "anchor", "block"))), F.col("r") + 1).alias("missing"))


def rollup_entries(entries: DataFrame, keys: list[str], chapter: str, order: list[str], text: str, sep: str = "\n") -> tuple[DataFrame, DataFrame]:
    """Commentary entries rolled up to chapters and books: (*keys, chapter, n_entries, text) and (*keys, n_chapters, n_entries, text).

    Empty entries are skipped, and so are chapters without any. A book is put together from its chapters' texts, so an
    entry moves once as part of its chapter.
    """
    full = entries.where(F.length(F.trim(text)) > 0)
    by = ", ".join(order)
    chapters = full.groupBy(*keys, chapter).agg(F.count("*").alias("n_entries"), F.expr(f"listagg({text}, '{sep}') WITHIN GROUP (ORDER BY {by})").alias("text"))
    books = chapters.groupBy(*keys).agg(F.count("*").alias("n_chapters"), F.sum("n_entries").alias("n_entries"), F.expr(f"listagg(text, '{sep}') WITHIN GROUP (ORDER BY {chapter})").alias("text"))
    return chapters, books
