"""``spark.read.format("folioform")``: any readable format as a data source, one partition per file."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "corpus_id string, doc_id string, block_id string, sequence int, chapter int, verse int, text string"


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class FolioReader(DataSourceReader):
    def __init__(self, path: str, fmt: str | None) -> None:
        self.path, self.fmt = path, fmt

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path.removeprefix("file://"))
        found = sorted(x for x in p.rglob("*") if x.is_file()) if p.is_dir() else [p]
        return [FilePartition(str(x)) for x in found]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        from folioform.sources import registry

        p = Path(partition.path)
        data = p.read_bytes()
        fmt = self.fmt or registry.detect(p.name, data)
        f = registry.BY_NAME.get(fmt or "")
        if f is None or f.read is None:
            return
        seq: dict[str, int] = {}
        for v in f.read(p.stem, data):
            seq[v.doc] = seq.get(v.doc, -1) + 1
            yield p.stem, v.doc, v.block_id, seq[v.doc], v.chapter or None, v.verse or None, v.text


class FolioSource(DataSource):
    """Options: ``path`` (a file or folder all executors share), ``format`` (detected if absent)."""

    @classmethod
    def name(cls) -> str:
        return "folioform"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolioReader(self.options["path"], self.options.get("format"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolioSource)
