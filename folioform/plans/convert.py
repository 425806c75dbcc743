"""End-to-end plans: convert files between formats, prove a round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioform.operators.validate import combined_loss, same_rows
from folioform.session import materialize
from folioform.sources import registry

KEYS = ["doc_id", "chapter", "verse", "verse_end", "text"]


def convert(spark: SparkSession, path: str, to: str, out: str, fmt: str | None = None) -> DataFrame:
    """Read the files below ``path``, write them as format ``to`` into folder ``out``; returns (name, sha256) of the files."""
    made = materialize(registry.emit(registry.read_blocks(registry.files(spark, path), fmt), to), "converted")
    registry.save(made, out)
    return made.select("name", "sha256")


def derived_export(spark: SparkSession, path: str, to: str, out: str, fmt: str) -> DataFrame:
    """convert(), and the loss of both steps together: (name, sha256, source, target, loss_class, lost)."""
    steps = [("x", 1, fmt, "blocks", registry.BY_NAME[fmt].loss, [f"read {fmt}"] if registry.BY_NAME[fmt].loss != "L0" else []), ("x", 2, "blocks", to, registry.BY_NAME[to].loss, [f"write {to}"] if registry.BY_NAME[to].loss != "L0" else [])]
    reports = spark.createDataFrame(steps, "k string, step int, source string, target string, loss_class string, lost array<string>")
    loss = combined_loss(reports, ["k"]).drop("k")
    return convert(spark, path, to, out, fmt).join(F.broadcast(loss), F.lit(True))  # one row of losses


def round_trip(blocks: DataFrame, fmt: str) -> bool:
    """Whether blocks written as ``fmt`` and read again are the same verses (corpora of one file each)."""
    again = registry.read_blocks(registry.emit(blocks, fmt), fmt)
    return same_rows(blocks.select(*KEYS), again.select(*KEYS))
