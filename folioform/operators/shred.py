"""Deeply nested JSON into related flat tables.

Each record is read once by an event parser without recursion, which turns it into triples: ``names`` is the path of members,
``ords`` the position taken at every level (-1 where the level is no array item), ``value`` the scalar found there. Triples
are then grouped by their innermost repeated ancestor; which levels repeat is found in the data, so a lone object counts as
an array of one wherever other records hold arrays. Pivoting a group turns its paths into columns, and a row's parents are
found by cutting its path and positions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioform.session import materialize

TRIPLES = "rec_id bigint, rec_no bigint, pos int, names array<string>, ords array<int>, kind string, value string"
#: Levels of a path. What lies deeper is kept as one value, its JSON text (kind ``json``), which can be shredded again.
MAX_DEPTH = 256

_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_TOKEN = re.compile(rf"[ \t\n\r]*+(?:({_STRING})|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([{{}}\[\],:]))")
_SPACE = re.compile(r"[ \t\n\r]*")


class Unreadable(ValueError):
    """The payload is no JSON object."""


def _text(token: str) -> str:
    """A string token's text; half of a surrogate pair becomes U+FFFD, for no Spark string holds it."""
    if "\\" not in token:
        return token[1:-1]
    return json.loads(token).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def triples(payload: str | None, max_depth: int = MAX_DEPTH) -> Iterator[tuple[tuple[str, ...], tuple[int, ...], str, str | None]]:
    """(names, ords, kind, value) of one payload in document order. Raises Unreadable, if only at its end.

    Kinds: ``row`` for every object, ``value`` for scalars, ``null``, ``empty`` for arrays without items, ``json`` beyond
    ``max_depth``. An array within an array takes a level of the name ''. Of a member given twice both are yielded; two
    arrays under one name are numbered on.
    """
    if payload is None:
        raise Unreadable("null")
    names: list[str] = []
    ords: list[int] = []
    stack: list[list] = []  # a frame: [is an array, next ordinal, array sizes by member name, whether it took a level]
    at, skipped, skip_from = 0, 0, 0
    want = "value"  # value, first (item or end), key, first key, colon, more
    while True:
        m = _TOKEN.match(payload, at)
        if not m:
            break
        at = m.end()
        text, other, mark = m.groups()
        if want in ("key", "first key"):
            if text is not None:
                if not skipped:
                    names.append(_text(text))
                    ords.append(-1)
                want = "colon"
                continue
            if mark != "}" or want == "key":
                raise Unreadable("not json")
        elif want == "colon":
            if mark != ":":
                raise Unreadable("not json")
            want = "value"
            continue
        elif want == "more":
            if mark == ",":
                want = "value" if stack[-1][0] else "key"
                if want == "value" and not skipped:
                    stack[-1][1] += 1
                    ords[-1] = stack[-1][1]
                continue
            if mark not in ("}", "]"):
                raise Unreadable("not json")
        elif want == "value" and mark in ("}", "]") or want == "first" and mark == "}":
            raise Unreadable("not json")
        # here a value begins, or an object or array ends
        if mark == "{" or mark == "[":
            is_array = mark == "["
            if not stack and is_array:
                raise Unreadable("not an object")
            if skipped or len(names) >= max_depth:
                if not skipped:
                    skip_from = at - 1
                skipped += 1
                stack.append([is_array, 0, None, False])
            elif is_array:
                owner = stack[-1]
                took = owner[0]  # an array within an array takes a level of its own
                if took:
                    names.append("")
                    ords.append(-1)
                    first = 0
                else:
                    first = owner[2].get(names[-1], 0)
                stack.append([True, first, None, took])
                ords[-1] = first
            else:
                yield tuple(names), tuple(ords), "row", None
                stack.append([False, 0, {}, False])
            want = "first" if is_array else "first key"
            continue
        if mark == "}" or mark == "]":
            if stack[-1][0] != (mark == "]"):
                raise Unreadable("not json")
            is_array, last, _, took = stack.pop()
            if skipped:
                skipped -= 1
                if not skipped:
                    yield tuple(names), tuple(ords), "json", payload[skip_from:at]
            elif is_array:
                if want == "first":
                    yield tuple(names), (*ords[:-1], -1), "empty", None
                if took:
                    names.pop()
                    ords.pop()
                else:
                    stack[-1][2][names[-1]] = last + (want != "first")
                    ords[-1] = -1
            if not stack:
                if _SPACE.fullmatch(payload, at):
                    return
                raise Unreadable("not json")
        elif mark:
            raise Unreadable("not json")
        else:
            if not stack:
                raise Unreadable("not an object" if _SPACE.fullmatch(payload, at) else "not json")
            if not skipped:
                yield tuple(names), tuple(ords), "null" if other == "null" else "value", _text(text) if text is not None else None if other == "null" else other
        if not stack[-1][0] and not skipped:
            names.pop()
            ords.pop()
        want = "more"
    raise Unreadable("not json")


def shred(df: DataFrame, rec_id: str, payload: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All triples of all records (schema TRIPLES), no shuffle; an unreadable record is one triple of kind ``reject`` with the reason.

    ``rec_no`` is a hash of the payload: rows repeated under one id fall together, different payloads under one id stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for i, no, text in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    found = list(triples(text, max_depth))
                except Unreadable as e:
                    found = [((), (), "reject", str(e))]
                for pos, (n, o, kind, value) in enumerate(found):
                    for c, x in zip(cols, (i, no, pos, n, o, kind, value)):
                        c.append(x)
                if len(cols[0]) > 50_000:
                    yield _batch(cols)
                    cols = [[] for _ in range(7)]
            yield _batch(cols)

    text = F.col(payload).cast("string")
    return df.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.xxhash64(text).alias("rec_no"), text.alias("payload")).mapInArrow(run, TRIPLES)


def _batch(cols: list[list]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["rec_id", "rec_no", "pos", "names", "ords", "kind", "value"])


def rejects(shredded: DataFrame) -> DataFrame:
    """(rec_id, reason) of the unreadable records: ``null``, ``not json`` or ``not an object``."""
    return shredded.where("kind = 'reject'").select("rec_id", F.col("value").alias("reason")).distinct()


def mixed_levels(shredded: DataFrame) -> list[list[str]]:
    """Paths that hold an array of objects in some records and a lone object in others; as many as the schema has such places."""
    rows = shredded.where("kind = 'row' AND size(names) > 0").groupBy("names").agg(F.bool_or(F.element_at("ords", -1) >= 0).alias("many"), F.bool_or(F.element_at("ords", -1) < 0).alias("lone"))
    return [list(r.names) for r in rows.where("many AND lone").select("names").collect()]


def grouped(shredded: DataFrame) -> DataFrame:
    """Triples with their group: ``grp`` names of the innermost repeated ancestor ([] at the root), ``at`` a position per name
    (-1 where it does not repeat), ``path`` the names below."""
    mixed = mixed_levels(shredded)
    ok = shredded.where("kind <> 'reject'")
    if mixed:
        known = F.array(*[F.array(*map(F.lit, p)) for p in mixed])
        lone = lambda o, i: (o < 0) & F.array_contains(known, F.slice("names", 1, i + 1))
        itself = F.col("kind").isin("null", "empty")  # where objects are expected these are no item
        ok = ok.withColumn("ords", F.transform("ords", lambda o, i: F.when(lone(o, i) & ~(itself & (i + 1 == F.size("names"))), 0).otherwise(o)))
    depth = F.coalesce(F.array_max(F.transform("ords", lambda o, i: F.when(o >= 0, i + 1).otherwise(0))), F.lit(0))
    ok = ok.withColumn("_d", depth)
    return ok.select("rec_id", "rec_no", "pos", F.slice("names", 1, F.col("_d")).alias("grp"), F.slice("ords", 1, F.col("_d")).alias("at"), F.slice("names", F.col("_d") + 1, F.size("names") - F.col("_d")).alias("path"), "kind", "value")


def catalogue(groups: DataFrame) -> DataFrame:
    """(grp, paths, n_rows): the tables found, with the paths that become columns; one row per repeated level of the schema."""
    return groups.groupBy("grp").agg(F.array_sort(F.collect_set(F.when(F.col("kind").isin("value", "json"), F.col("path")))).alias("paths"), F.count(F.when((F.col("kind") == "row") & (F.size("path") == 0), 1)).alias("n_rows"))


def path_is(path: list[str]) -> Column:
    return F.col("path") == (F.array(*map(F.lit, path)) if path else F.array().cast("array<string>"))


def pivot(groups: DataFrame, columns: dict[str, list[str]], which: Column | None = None) -> DataFrame:
    """Groups as tables: (rec_id, rec_no, grp, at, is_object, *columns), one row per item, ``columns`` {name: path below the item}.

    The last value of a repeated member holds. A row's triples stand together in the task that parsed it, so they are
    combined before the shuffle, and one row per item is shuffled, with the columns asked for only.
    """
    rows = groups if which is None else groups.where(which)
    aggs = [F.max_by(F.when(path_is(p), F.col("value")), F.when(path_is(p) & F.col("kind").isin("value", "json", "null"), F.col("pos"))).alias(c) for c, p in columns.items()]
    return rows.groupBy("rec_id", "rec_no", "grp", "at").agg(F.bool_or((F.col("kind") == "row") & (F.size("path") == 0)).alias("is_object"), *aggs)


def flat_tables(df: DataFrame, rec_id: str, payload: str) -> dict[tuple[str, ...], DataFrame]:
    """Every table found in the data, by the names of its group: keys rec_id, rec_no, grp, at and a column per path found
    (its names joined by '.', numbered on where that makes two columns one)."""
    groups = grouped(materialize(shred(df, rec_id, payload), "triples"))
    out: dict[tuple[str, ...], DataFrame] = {}
    for r in catalogue(groups).collect():  # the schema's size
        columns: dict[str, list[str]] = {}
        for p in r.paths:
            name, k = ".".join(p) or "value", 1
            while (name if k == 1 else f"{name}_{k}").lower() in {*map(str.lower, columns), "rec_id", "rec_no", "grp", "at", "is_object"}:
                k += 1
            columns[name if k == 1 else f"{name}_{k}"] = list(p)
        out[tuple(r.grp)] = pivot(groups, columns, F.col("grp") == (F.array(*map(F.lit, r.grp)) if r.grp else F.array().cast("array<string>")))
    return out


# ---- the tables of IR documents ------------------------------------------------------------------------------------------

KINDS = {"content_blocks": "content_block", "spans": "span", "annotations": "annotation"}


def last_name() -> Column:
    return F.try_element_at("grp", F.lit(-1))


def level(name: str) -> Column:
    """The position taken at the level ``name``, null where the path has none."""
    return F.try_element_at("at", F.nullif(F.array_position("grp", name), F.lit(0)).cast("int"))


def ir_groups(df: DataFrame, rec_id: str = "raw_id", payload: str = "payload") -> DataFrame:
    return grouped(materialize(shred(df, rec_id, payload), "triples"))


def ir_tables(df: DataFrame, rec_id: str = "raw_id", payload: str = "payload") -> dict[str, DataFrame]:
    """documents, content_blocks, tokens, anchors, spans, annotations and rejects of IR payloads, each with the keys of its parents.

    A span belongs to the block whose position its path goes through; annotations may stand at the root or below a block.
    """
    shredded = materialize(shred(df, rec_id, payload), "triples")
    g = grouped(shredded)

    def table(name: str, columns: dict[str, list[str]]) -> DataFrame:
        return pivot(g, columns, last_name() == name).where("is_object")

    docs = pivot(g, {"doc_id": ["id"], "ref_text": ["canonical_ref"], "ref_osis": ["canonical_ref", "osis_id"], "title": ["title"], "doc_order": ["order"]}, F.size("grp") == 0)
    docs = docs.select("rec_id", "doc_id", F.coalesce("ref_osis", "ref_text").alias("root_osis_id"), "title", "doc_order")
    blocks = table("content_blocks", {"block_id": ["id"], "sequence": ["sequence"], "text": ["text"]}).select("rec_id", level("content_blocks").alias("block_no"), "block_id", "sequence", "text")
    spans = table("spans", {"span_id": ["id"], "type": ["type"], "start_anchor_id": ["start_anchor_id"], "osis_id": ["ref", "osis_id"]})
    spans = spans.select("rec_id", level("content_blocks").alias("block_no"), level("anchors").alias("anchor_no"), level("spans").alias("span_no"), "span_id", "type", "start_anchor_id", "osis_id")
    notes = table("annotations", {"annotation_id": ["id"], "span_id": ["span_id"], "type": ["type"], "source": ["source"]})
    notes = notes.select("rec_id", level("content_blocks").alias("block_no"), level("annotations").alias("note_no"), "annotation_id", "span_id", "type", "source")
    tokens = table("tokens", {"token_id": ["id"], "text": ["text"], "type": ["type"]}).select("rec_id", level("content_blocks").alias("block_no"), level("tokens").alias("token_no"), "token_id", "text", "type")
    anchors = table("anchors", {"anchor_id": ["id"], "char_offset": ["char_offset"], "content_block_id": ["content_block_id"]})
    anchors = anchors.select("rec_id", level("content_blocks").alias("block_no"), level("anchors").alias("anchor_no"), "anchor_id", F.col("char_offset").try_cast("int").alias("char_offset"), "content_block_id")
    return {"documents": docs, "tokens": tokens, "anchors": anchors, "content_blocks": blocks, "spans": spans, "annotations": notes, "rejects": rejects(shredded)}


def nested_nodes(df: DataFrame, rec_id: str = "raw_id", payload: str = "payload") -> DataFrame:
    """(raw_id, node_kind, node_id, parent_id, root_osis_id): the content blocks, spans and annotations of every readable payload, linked.

    Read from the pivoted tables: a span's parent is the block its path was cut from, an annotation's its ``span_id`` if a
    span of the record has it, a block's the document. Missing ids become ''; a node repeated in a record is one row; null,
    empty, cut-off and non-object payloads give none (see ``rejects``); empty tables give an empty result.
    """
    columns = {"id": ["id"], "span_id": ["span_id"], "ref_text": ["canonical_ref"], "ref_osis": ["canonical_ref", "osis_id"]}
    rows = pivot(ir_groups(df, rec_id, payload), columns, (F.size("grp") == 0) | last_name().isin(*KINDS)).where("is_object")
    kind = F.coalesce(*[F.when(last_name() == name, k) for name, k in KINDS.items()])
    cut = F.array_position("grp", "content_blocks").cast("int")
    rows = rows.select("rec_id", "rec_no", kind.alias("kind"), F.coalesce("id", F.lit("")).alias("id"), F.coalesce("span_id", F.lit("")).alias("span_id"), F.coalesce(F.nullif("ref_osis", F.lit("")), "ref_text", F.lit("")).alias("osis"), F.slice("grp", 1, cut).alias("b_grp"), F.slice("at", 1, cut).alias("b_at"))
    # one shuffle by record: the windows below share its partitioning
    record = Window.partitionBy("rec_id", "rec_no")
    block = Window.partitionBy("rec_id", "rec_no", "b_grp", "b_at")
    link = Window.partitionBy("rec_id", "rec_no", "link")
    root = F.col("kind").isNull()
    rows = rows.withColumn("doc", F.max(F.when(root, F.col("id"))).over(record)).withColumn("root_osis_id", F.max(F.when(root, F.col("osis"))).over(record))
    rows = rows.withColumn("holder", F.max(F.when(F.col("kind") == "content_block", F.col("id"))).over(block))
    rows = rows.withColumn("link", F.when(F.col("kind") == "annotation", F.col("span_id")).when(F.col("kind") == "span", F.col("id")))
    rows = rows.withColumn("linked", F.max(F.col("kind") == "span").over(link))
    parent = F.when(F.col("kind") == "content_block", F.col("doc")).when(F.col("kind") == "span", F.col("holder")).when(F.col("linked"), F.col("span_id"))
    return rows.where(~root).select(F.col("rec_id").alias("raw_id"), F.col("kind").alias("node_kind"), F.col("id").alias("node_id"), F.coalesce(parent, F.lit("")).alias("parent_id"), "root_osis_id").distinct()
