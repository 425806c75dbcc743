"""The interchange model as JSON: one document per corpus, read by an explicit schema into flat tables and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REF = "struct<book:string,chapter:int,verse:int,verse_end:int,sub_verse:string,osis_id:string>"
_SPAN = f"struct<id:string,type:string,start_anchor_id:string,end_anchor_id:string,ref:{_REF}>"
_ANCHOR = f"struct<id:string,char_offset:int,position:int,spans:array<{_SPAN}>>"
_TOKEN = "struct<id:string,index:int,char_start:int,char_end:int,text:string,type:string,lemma:string,strongs:array<string>,morphology:string>"
_BLOCK = f"struct<id:string,sequence:int,text:string,hash:string,tokens:array<{_TOKEN}>,anchors:array<{_ANCHOR}>>"
_NOTE = "struct<id:string,span_id:string,type:string,value:string,confidence:double,source:string>"
_DOC = f"struct<id:string,title:string,order:int,canonical_ref:{_REF},content_blocks:array<{_BLOCK}>,annotations:array<{_NOTE}>>"
CORPUS = f"id string, version string, module_type string, versification string, language string, title string, source_format string, source_hash string, loss_class string, attributes map<string,string>, documents array<{_DOC}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per corpus file; members outside the schema are ignored, values of another shape become null."""
    return spark.read.schema(CORPUS).option("multiLine", "true").json(path)


def tables(corpora: DataFrame) -> dict[str, DataFrame]:
    """documents, blocks, tokens, spans and annotations with the keys of their parents. Only explodes: no shuffle."""
    docs = corpora.select(F.col("id").alias("corpus_id"), F.explode("documents").alias("d"))
    blocks = docs.select("corpus_id", F.col("d.id").alias("doc_id"), F.explode("d.content_blocks").alias("b"))
    spans = blocks.select("corpus_id", "doc_id", F.col("b.id").alias("block_id"), F.explode("b.anchors").alias("a"))
    spans = spans.select("corpus_id", "doc_id", "block_id", F.col("a.char_offset").alias("start_byte"), F.explode("a.spans").alias("s"))
    ref = F.coalesce(F.try_element_at(F.filter(F.flatten(F.transform("b.anchors", lambda a: a["spans"])), lambda s: s["type"] == "VERSE"), F.lit(1))["ref"], F.lit(None))
    return {
        "documents": docs.select("corpus_id", F.col("d.id").alias("doc_id"), F.col("d.title").alias("title"), F.col("d.order").alias("doc_order"), F.col("d.canonical_ref").alias("canonical_ref")),
        # the place of a block: its first VERSE span, else its id
        "blocks": blocks.select("corpus_id", "doc_id", F.col("b.id").alias("block_id"), F.col("b.sequence").alias("sequence"), F.col("b.text").alias("text"), F.col("b.hash").alias("hash"), F.coalesce(ref["chapter"], F.regexp_extract("b.id", r"\.(\d+)\.(\d+)", 1).try_cast("int")).alias("chapter"), F.coalesce(ref["verse"], F.regexp_extract("b.id", r"\.(\d+)\.(\d+)", 2).try_cast("int")).alias("verse")),
        "tokens": blocks.select("corpus_id", "doc_id", F.col("b.id").alias("block_id"), F.explode("b.tokens").alias("t")).select("corpus_id", "doc_id", "block_id", "t.*"),
        "spans": spans.select("corpus_id", "doc_id", "block_id", "start_byte", "s.*"),
        "annotations": docs.select("corpus_id", F.col("d.id").alias("doc_id"), F.explode("d.annotations").alias("n")).select("corpus_id", "doc_id", "n.*"),
    }


def nest(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(corpus_id, documents array) from flat tables: two aggregations, blocks by sequence, documents by order. A corpus is one row, so it must fit one task."""
    b = blocks.groupBy("corpus_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("sequence", F.col("block_id").alias("id"), "text"))).alias("content_blocks"))
    d = documents.join(b, ["corpus_id", "doc_id"], "left")
    return d.groupBy("corpus_id").agg(F.sort_array(F.collect_list(F.struct(F.col("doc_order").alias("order"), F.col("doc_id").alias("id"), "title", "content_blocks"))).alias("documents"))


def write(nested: DataFrame, path: str, compact: bool = True) -> None:
    """One JSON object per corpus and line; without ``compact`` null members are written too."""
    nested.write.option("ignoreNullFields", str(compact).lower()).json(path)


def canonical_hash(df: DataFrame, key: list[str], row: list[str], order: list[str], empty: bool = False) -> DataFrame:
    """(*key, digest): SHA-256 of the canonical JSON of each document, corpus or mapping table.

    A row is one JSON object with its members in the order of ``row``, null ones left out (``empty`` keeps them); the
    hash of a key is that of its rows' hashes in the ``order`` given, one digest of 64 characters per row, so it does not
    depend on partitioning and no texts are gathered.
    """
    one = F.sha2(F.to_json(F.struct(*row), {"ignoreNullFields": str(not empty).lower()}), 256)
    rows = df.select(*key, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], one.alias("_h"))
    by = ", ".join([*(f"_o{i}" for i in range(len(order))), "_h"])
    return rows.groupBy(*key).agg(F.sha2(F.expr(f"listagg(_h) WITHIN GROUP (ORDER BY {by})"), 256).alias("digest"))


def corpus_hash(blocks: DataFrame, version: str = "1") -> DataFrame:
    """(corpus_id, digest): SHA-256 over the sorted digests of its blocks, so order and partitioning don't matter."""
    one = F.sha2(F.concat_ws("\x1f", "doc_id", "block_id", F.coalesce(F.col("sequence").cast("string"), F.lit("")), F.coalesce("text", F.lit("\x00"))), 256)
    return blocks.select("corpus_id", one.alias("h")).groupBy("corpus_id").agg(F.sha2(F.concat(F.lit(version), F.array_join(F.sort_array(F.collect_list("h")), "")), 256).alias("digest"))
