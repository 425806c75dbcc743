"""Self-check plans over files: export, extract, emit, compare; canned plans; reports with a hash."""

from __future__ import annotations

import hashlib
import json

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioform.operators import compare, validate
from folioform.plans.convert import KEYS
from folioform.session import shared_dir
from folioform.sources import registry

#: A plan that proves that reading, writing and reading again gives the same verses; ``format`` is filled in.
ROUND_TRIP = {"id": "round-trip", "steps": [{"type": "EXTRACT_IR", "input": "files", "output": "ir"}, {"type": "EMIT_NATIVE", "input": "ir", "output": "native"}, {"type": "EXTRACT_IR", "input": "native", "output": "again"}], "checks": [{"type": "IR_STRUCTURE_EQUAL", "a": "ir", "b": "again"}]}
#: A plan that proves that stored bytes are the bytes taken in.
IDENTITY = {"id": "identity-bytes", "steps": [{"type": "EXPORT", "input": "files", "output": "out"}], "checks": [{"type": "BYTE_EQUAL", "a": "files", "b": "out"}]}

#: A plan that proves that two runs of a tool left the same transcript.
BEHAVIOUR = {"id": "behaviour-identity", "checks": [{"type": "TRANSCRIPT_EQUAL", "a": "run_a", "b": "run_b"}]}
#: Loss within a class after a conversion.
FIDELITY = {"id": "fidelity", "checks": [{"type": "IR_FIDELITY", "ir": "ir", "max_loss_class": "L1"}]}


def _steps(fmt: str):
    def extract(tables: dict[str, DataFrame], s: dict) -> DataFrame:
        return registry.read_blocks(tables[s["input"]], s.get("format", fmt)).select(*KEYS)

    def emit(tables: dict[str, DataFrame], s: dict) -> DataFrame:
        t = tables[s["input"]].selectExpr("'x' AS corpus_id", "*", "0 AS sequence", "0 AS doc_order") if "corpus_id" not in tables[s["input"]].columns else tables[s["input"]]
        return registry.emit(t, s.get("format", fmt))

    def export(tables: dict[str, DataFrame], s: dict) -> DataFrame:
        """Through stored bytes: contents go into a blob store and are read back by their hashes."""
        files = tables[s["input"]].select("name", "content")
        store = f"{shared_dir(files.sparkSession)}/store-{uuid.uuid4().hex}"
        registry.put_blobs(store, registry.as_blobs(files))
        kept = files.sparkSession.read.schema(registry.BLOB).parquet(store).select("sha256", "content")
        return files.select("name", F.sha2("content", 256).alias("sha256")).join(kept, "sha256").select("name", "content")

    def compare_ir(tables: dict[str, DataFrame], s: dict) -> DataFrame:
        """Rows missing on either side and fields that differ."""
        keys = s.get("keys", ["doc_id", "chapter", "verse"])
        return compare.diff_tables(tables[s["a"]], tables[s["b"]], keys, [c for c in s.get("fields", ["verse_end", "text"])])

    return {"EXTRACT_IR": extract, "EMIT_NATIVE": emit, "EXPORT": export, "COMPARE_IR": compare_ir}


def run(spark: SparkSession, plan: dict, path: str, fmt: str) -> dict:
    """The report of a plan over the files below ``path``: {plan, status, results, hash}; the hash leaves nothing but the times out, as there are none."""
    files = registry.files(spark, path).select("name", "content")
    ok, results = validate.run_plan(plan, {"files": files}, _steps(fmt))
    body = {"plan": plan["id"], "status": "pass" if ok else "fail", "results": results}
    return body | {"hash": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}


def golden(files_df: DataFrame) -> DataFrame:
    """(name, digest) to save as golden hashes."""
    return files_df.selectExpr("name", "sha2(content, 256) AS digest")


def check_golden(files_df: DataFrame, saved: DataFrame) -> DataFrame:
    return validate.hash_check(golden(files_df), saved, "name", "digest")
