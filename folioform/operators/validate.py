"""Rules over the interchange model, loss classes and budgets, fidelity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioform import schema


def violations(df: DataFrame, ids: list[str], rules: dict[str, Column]) -> DataFrame:
    """(*ids, path, message) for every rule (``path: message`` -> condition of a violation) a row breaks. One pass, no shuffle."""
    found = F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k.partition(": ")[0]).alias("path"), F.lit(k.partition(": ")[2]).alias("message"))) for k, c in rules.items()])
    return df.select(*ids, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("v")).select(*ids, "v.path", "v.message")


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def block_rules(text_hash: str = "hash") -> dict[str, Column]:
    return {"id: required": blank("block_id"), "sequence: negative": F.col("sequence") < 0, "hash: does not match the text": (F.col(text_hash) != "") & (F.col(text_hash) != F.sha2("text", 256))}




def corpus_rules() -> dict[str, Column]:
    return {"id: required": blank("corpus_id"), "version: required": blank("version"), "module_type: unknown": ~F.coalesce(F.col("module_type").isin(schema.MODULE_TYPES), F.lit(False)), "loss_class: unknown": (F.col("loss_class") != "") & ~F.col("loss_class").isin(schema.LOSS_CLASSES)}


def document_rules() -> dict[str, Column]:
    return {"id: required": blank("doc_id"), "order: negative": F.col("doc_order") < 0}


def span_rules() -> dict[str, Column]:
    return {"id: required": blank("span_id"), "type: unknown": ~F.coalesce(F.col("type").isin(schema.SPAN_TYPES), F.lit(False)), "start_anchor: required": blank("start_anchor"), "end: before start": F.col("end_byte") < F.col("start_byte")}


def annotation_rules() -> dict[str, Column]:
    return {"id: required": blank("annotation_id"), "span_id: required": blank("span_id"), "type: unknown": ~F.coalesce(F.col("type").isin(schema.ANNOTATION_TYPES), F.lit(False)), "confidence: outside 0..1": ~F.col("confidence").between(0, 1)}


def ref_rules(book: str = "book", chapter: str = "chapter", verse: str = "verse", verse_end: str | None = None) -> dict[str, Column]:
    rules = {"book: required": blank(book), "chapter: negative": F.col(chapter) < 0, "verse: negative": F.col(verse) < 0}
    return rules | ({"verse_end: before verse": (F.col(verse_end) > 0) & (F.col(verse_end) < F.col(verse))} if verse_end else {})


def mapping_rules() -> dict[str, Column]:
    return {"from_system: required": blank("from_system"), "to_system: required": blank("to_system"), "type: unknown": ~F.coalesce(F.col("type").isin(schema.MAPPING_TYPES), F.lit(False)), "to: required": (F.col("type") != "missing") & F.col("to_book").isNull()}


# ---- loss ----------------------------------------------------------------------------------------------------------------


def loss_level(c: Column) -> Column:
    """0..4 of L0..L4, -1 for anything else."""
    return F.coalesce(F.when(c.rlike("^L[0-4]$"), F.substring(c, 2, 1).cast("int")), F.lit(-1))


def worst_loss(c: Column) -> Column:
    """Aggregate: the class of the highest level; L0 if there is none."""
    return F.concat(F.lit("L"), F.greatest(F.max(loss_level(c)), F.lit(0)).cast("string"))


def is_lossless(c: Column) -> Column:
    return c == "L0"


def is_semantically_lossless(c: Column) -> Column:
    return c.isin("L0", "L1")


def combined_loss(reports: DataFrame, key: list[str]) -> DataFrame:
    """Reports (step, source, target, loss_class, lost array) of a chain as one: first source, last target, worst class, all lost elements in order."""
    return reports.groupBy(*key).agg(F.min_by("source", "step").alias("source"), F.max_by("target", "step").alias("target"), worst_loss(F.col("loss_class")).alias("loss_class"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("step", "lost"))), lambda x: x["lost"])).alias("lost"))


def within_budget(reports: DataFrame, lost: DataFrame, key: str, max_class: str, max_lost: int, allowed: list[str]) -> DataFrame:
    """(key, passed): level at most that of ``max_class``, and at most ``max_lost`` elements (0: any number) of types not allowed."""
    counted = lost.where(~F.col("element_type").isin(allowed) if allowed else F.lit(True)).groupBy(key).agg(F.count("*").alias("_n"))
    j = reports.join(counted, key, "left")
    ok = (loss_level(F.col("loss_class")) <= int(max_class[1:])) & ((F.lit(max_lost) == 0) | (F.coalesce("_n", F.lit(0)) <= max_lost))
    return j.select(key, ok.alias("passed"))


# ---- self-checks ---------------------------------------------------------------------------------------------------------


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, each as often, in any order."""
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def hash_check(actual: DataFrame, golden: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): pass, fail, missing (golden only) or new (actual only)."""
    j = actual.select(key, F.col(digest).alias("_a")).join(golden.select(key, F.col(digest).alias("_g")), key, "full_outer")
    return j.select(key, F.when(F.col("_g").isNull(), "new").when(F.col("_a").isNull(), "missing").when(F.col("_a") == F.col("_g"), "pass").otherwise("fail").alias("status"))


def bytes_equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of files (name, content) hold the same bytes under the same names."""
    digests = [x.select("name", F.sha2("content", 256).alias("digest")) for x in (a, b)]
    return same_rows(*digests)


def transcripts_equal(a: DataFrame, b: DataFrame, order: str = "seq") -> bool:
    """Whether two transcripts have the same events at the same positions, whatever their times. Rows are compared by position, not gathered."""
    cols = [c for c in a.columns if c not in ("t_wall", "started_at", "finished_at")]
    return sorted(a.columns) == sorted(b.columns) and same_rows(a.select(order, *[c for c in cols if c != order]), b.select(order, *[c for c in cols if c != order]))


def fidelity(ir: DataFrame, max_class: str, lost: DataFrame | None = None, max_lost: int = 0, allowed: list[str] | None = None) -> bool:
    """Whether the loss class of every corpus of ``ir`` (corpus_id, loss_class; null counts as L0) is at most ``max_class``, and, with
    ``lost`` (corpus_id, element_type), its lost elements keep the budget: no more than ``max_lost`` (0: any number) of types not allowed."""
    reports = ir.select("corpus_id", F.coalesce("loss_class", F.lit("L0")).alias("loss_class")).distinct()
    if lost is None:
        return reports.where(loss_level(F.col("loss_class")) > int(max_class[1:])).isEmpty()
    return within_budget(reports, lost, "corpus_id", max_class, max_lost, allowed or []).where("NOT passed").isEmpty()


#: Checks by type: each takes the tables and the check, and tells whether it holds.
CHECKS = {
    "BYTE_EQUAL": lambda t, c: bytes_equal(t[c["a"]], t[c["b"]]),
    "TRANSCRIPT_EQUAL": lambda t, c: transcripts_equal(t[c["a"]], t[c["b"]], c.get("order", "seq")),
    "IR_STRUCTURE_EQUAL": lambda t, c: same_rows(t[c["a"]], t[c["b"]]),
    "IR_ROUNDTRIP": lambda t, c: same_rows(t[c["a"]], t[c["b"]]),
    "IR_FIDELITY": lambda t, c: fidelity(t[c["ir"]], c.get("max_loss_class", "L0"), t.get(c.get("lost", "")), c.get("max_lost", 0), c.get("allowed")),
}


def run_plan(plan: dict, tables: dict[str, DataFrame], steps: dict) -> tuple[bool, list[dict]]:
    """Run a self-check plan {steps: [{type, output, ...}], checks: [{type, ...}]}; steps {type: function(tables, step) -> table}.

    A step that raises ends the plan as failed, and so does one of an unknown type. A check of an unknown type, or one that
    names a table that is not there, fails. Returns whether all checks passed, and a report row per step or check.
    """
    tables, report = dict(tables), []
    for s in plan.get("steps", []):
        try:
            tables[s["output"]] = steps[s["type"]](tables, s)
            report.append({"kind": "step", "type": s["type"], "status": "pass"})
        except Exception as e:
            return False, [*report, {"kind": "step", "type": s["type"], "status": f"fail: {e}"}]
    for c in plan.get("checks", []):
        try:
            status = "pass" if CHECKS[c["type"]](tables, c) else "fail"
        except KeyError as e:
            status = f"fail: {e.args[0]} is not known"
        report.append({"kind": "check", "type": c["type"], "status": status})
    return all(r["status"] == "pass" for r in report), report
