"""Formats by name: detection, reading files into tables, writing tables as files."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioform import schema
from folioform.session import materialize
from folioform.sources import binary, database, textual
from folioform.sources.model import Verse

Reader = Callable[[str, bytes], Iterator[Verse]]
Sink = Callable[[list[Verse]], bytes]


@dataclass(frozen=True)
class Format:
    name: str
    suffixes: tuple[str, ...]
    detect: Callable[[str, bytes], bool]
    read: Reader | None
    write: Sink | None = None
    loss: str = "L1"


def _has(*patterns: bytes) -> Callable[[str, bytes], bool]:
    """Whether the whole content has all patterns, one after the other."""
    rxs = [re.compile(p, re.I | re.S | re.M) for p in patterns]

    def test(name: str, data: bytes) -> bool:
        at = 0
        for rx in rxs:
            if not (m := rx.search(data, at)):
                return False
            at = m.end()
        return True

    return test


def _sqlite(*wanted: str) -> Callable[[str, bytes], bool]:
    def test(name: str, data: bytes) -> bool:
        if not database.looks_sqlite(data):
            return False
        try:
            cols = {f"{t}.{c}".lower() for t, cs in database.tables(database.open_bytes(data)).items() for c in ["", *cs]}
        except Exception:
            return False
        return all(w in cols for w in wanted)

    return test


def _zip(pattern: str) -> Callable[[str, bytes], bool]:
    rx = re.compile(pattern, re.I)

    def test(name: str, data: bytes) -> bool:
        try:
            return binary.compression(data) == "zip" and any(rx.search(p) for p, _, _, _ in binary.entries(data))
        except Exception:
            return False

    return test


def _json(name: str, data: bytes) -> bool:
    try:
        return isinstance(json.loads(data), dict)
    except ValueError:
        return False


#: The tables of an Accordance database that may hold its text, in the order they are read.
ACCORDANCE = ("verses", "content", "text", "accverses", "acccontent")

#: Tried in this order; the first that accepts a file reads it.
FORMATS = [
    Format("epub", (".epub",), _zip(r"^META-INF/container\.xml$"), binary.read_epub, binary.write_epub),
    Format("odf", (".odt",), _zip(r"^content\.xml$"), binary.read_odf, binary.write_odf),
    Format("dbl", (".zip",), _zip(r"\.usx$"), binary.read_dbl, binary.write_dbl),
    Format("gobible", (".jar",), _zip(r"^Bible Data/|\.class$"), binary.read_gobible, binary.write_gobible, "L3"),
    Format("mybible", (".sqlite3",), _sqlite("verses.book_number"), database.read_mybible, database.write_mybible),
    Format("mysword", (".mybible", ".bbl.mybible"), _sqlite("books.scripture"), database.read_mysword, database.write_mysword),
    Format("esword", (".bblx", ".cmtx", ".dctx", ".bbli"), lambda n, d: any(_sqlite(x)(n, d) for x in ("bible.scripture", "commentary.comments", "dictionary.topic")), database.read_esword, database.write_esword),
    Format("sqlite", (".db", ".sqlite"), _sqlite("verses.chapter"), database.read_sqlite, database.write_sqlite),
    Format("accordance", (".atext",), lambda n, d: any(_sqlite(x)(n, d) for x in ("accverses.", "acccontent.", "verses.content")), lambda n, d: database.read_probe(n, d, ACCORDANCE), database.write_probe, "L2"),
    Format("logos", (".lbxlls", ".logos4"), lambda n, d: database.looks_sqlite(d), lambda n, d: database.read_probe(n, d), lambda vs: database.write_probe(vs, "Segments"), "L2"),
    Format("pdb", (".pdb",), lambda n, d: len(d) > 78 and d[60:64].isalpha() and d[60:68].isascii() and n.endswith(".pdb"), binary.read_pdb, loss="L3"),
    Format("theword", (".ont", ".ot", ".nt"), lambda n, d: n.endswith((".ont", ".ot", ".nt")), textual.read_theword),  # read and written with a canon
    Format("rtf", (".rtf",), lambda n, d: d.startswith(b"{\\rtf"), textual.read_rtf, textual.write_rtf, "L2"),
    Format("osis", (".osis", ".xml"), _has(rb"<osis\b"), textual.read_osis, textual.write_osis, "L0"),
    Format("usx", (".usx",), _has(rb"<usx\b"), textual.read_usx, textual.write_usx, "L0"),
    Format("zefania", (".xml",), _has(rb"<XMLBIBLE\b"), textual.read_zefania, textual.write_zefania),
    Format("tei", (".tei", ".xml"), _has(rb"<TEI(\.2)?\b"), textual.read_tei, textual.write_tei),
    Format("flex", (".flextext",), _has(rb"<(document|interlinear-text)\b", rb"<phrase"), textual.read_flex, textual.write_flex, "L2"),
    Format("html", (".html", ".htm"), _has(rb"<!doctype html|<html\b"), textual.read_html, textual.write_html),
    Format("xml", (".xml",), _has(rb"^\s*<\?xml|^\s*<(bible|book)\b"), textual.read_xml, textual.write_xml),
    Format("usfm", (".usfm", ".sfm"), _has(rb"\\id\s+\w{3}\b", rb"\\(c|h|mt|toc)"), textual.read_usfm, textual.write_usfm, "L0"),
    Format("sfm", (".sfm", ".txt"), _has(rb"^\\(id|c|v)\s"), textual.read_sfm, textual.write_sfm),
    Format("json", (".json",), _json, textual.read_json, textual.write_json, "L0"),
    Format("markdown", (".md",), _has(rb"^\*\*\d+\*\*\s"), textual.read_markdown, textual.write_markdown),
    Format("onlinebible", (".exp",), _has(rb"^\$\w+\s+\d+:\d+\s"), textual.read_onlinebible, textual.write_onlinebible, "L0"),
    Format("morphgnt", (".txt",), _has(rb"^\d{6}\s\S+\s\S{8}\s"), textual.read_morphgnt, textual.write_morphgnt, "L2"),
    Format("sblgnt", (".txt",), _has(rb"^\d{6}\S*\s\S"), textual.read_sblgnt, textual.write_sblgnt, "L2"),
    Format("oshb", (".txt",), _has(rb"^[1-4]?[A-Z]\w*\.\d+\.\d+\S*\s"), textual.read_oshb, textual.write_oshb, "L2"),
    Format("txt", (".txt",), _has(rb"^([1-4]?\s?\w+\s+)?\d+:\d+\s+\S"), textual.read_txt, textual.write_txt, "L3"),
    Format("olivetree", (".oti", ".ot4i"), lambda n, d: n.endswith((".oti", ".ot4i")), None),
]
BY_NAME = {f.name: f for f in FORMATS}


def detect(name: str, data: bytes) -> str | None:
    """The first format that accepts the file; null if none does."""
    return next((f.name for f in FORMATS if f.detect(name.lower(), data)), None)


def file_kind(name: str, data: bytes) -> str:
    """A content type by magic bytes, else by the share of printable bytes."""
    if kind := binary.compression(data):
        return {"zip": "application/zip", "gz": "application/gzip", "xz": "application/x-xz", "bz2": "application/x-bzip2", "tar": "application/x-tar"}[kind]
    if database.looks_sqlite(data):
        return "application/vnd.sqlite3"
    head = data.lstrip()
    if head.startswith(b"<"):
        return "text/html" if re.match(rb"\s*<(!doctype html|html)", head, re.I) else "text/xml"
    if head[:1] in (b"{", b"["):
        return "application/json"
    printable = len(data) - len(data.translate(None, b"\t\n\r" + bytes(range(32, 256))))
    return "text/plain" if data and printable / len(data) > 0.95 else "application/octet-stream"


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, name, length, content) of the files below a folder."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", glob) if glob else r).load(path)
    return df.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "content")


def catalogue(files_df: DataFrame) -> DataFrame:
    """(path, name, length, sha256, format, kind) of files; one pass, no shuffle."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b.path, "name": b.name, "length": b.length, "sha256": [hashlib.sha256(c).hexdigest() for c in b.content], "format": [detect(n, c) for n, c in zip(b.name, b.content)], "kind": [file_kind(n, c) for n, c in zip(b.name, b.content)]})

    return files_df.mapInPandas(run, "path string, name string, length bigint, sha256 string, format string, kind string")


def undetected(files_df: DataFrame) -> DataFrame:
    """(path, name, length, kind) of the files no format accepts, which read_blocks leaves out."""
    return catalogue(files_df).where("format IS NULL").select("path", "name", "length", "kind")


#: {"ot": [(book, chapter, number of verses)], "nt": ...}
Canon = dict[str, list[tuple[str, int, int]]]


def _canon_of(name: str, canon: Canon) -> list[tuple[str, int, int]]:
    """The part of the canon a TheWord file holds: .ot, .nt, or both in .ont."""
    sides = (name.lower().rpartition(".")[2],) if name.lower().endswith((".ot", ".nt")) else ("ot", "nt")
    return [row for side in sides for row in canon.get(side, [])]


def read_blocks(files_df: DataFrame, fmt: str | None = None, canon: Canon | None = None) -> DataFrame:
    """Blocks (schema.BLOCKS) of files, in ``fmt`` or as detected. One task a group of files; files no format accepts give no rows and are listed by undetected().

    ``corpus_id`` is the file's name without suffix, ``sequence`` counts the blocks of a document from 0. TheWord files
    name no places: they are read along ``canon``, and without one give no rows.
    """
    reader = BY_NAME[fmt].read if fmt else None
    if fmt and reader is None:
        raise ValueError(f"{fmt} files can be detected, not read")
    if fmt == "theword" and not canon:
        raise ValueError("theword files are read along a canon")

    def run(batches):
        for b in batches:
            for name, content in zip(b.name, b.content):
                found = reader or ((f := BY_NAME.get(detect(name, content) or "")) and f.read)
                if not found:
                    continue
                corpus, order, seq, rows = re.sub(r"\.[^.]*$", "", name), {}, {}, []
                verses = found(corpus, content, _canon_of(name, canon or {})) if found is textual.read_theword else found(corpus, content)
                for v in verses:
                    o = order.setdefault(v.doc, len(order) + 1)
                    k = seq[v.doc] = seq.get(v.doc, -1) + 1
                    rows.append((corpus, v.doc, o, v.block_id, k, v.doc, v.chapter or None, v.verse or None, v.verse_end or None, v.text, v.raw))
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.BLOCKS.split(", ")]).astype({"chapter": "Int32", "verse": "Int32", "verse_end": "Int32"})

    return files_df.select("name", "content").mapInPandas(run, schema.BLOCKS)


def read_corpus(spark: SparkSession, path: str, fmt: str | None = None) -> dict[str, DataFrame]:
    """documents and blocks of all files below ``path``."""
    blocks = read_blocks(files(spark, path), fmt)
    docs = blocks.groupBy("corpus_id", "doc_id").agg(F.min("doc_order").alias("doc_order"), F.count("*").alias("n_blocks"))
    return {"documents": docs, "blocks": blocks}


def emit(blocks: DataFrame, fmt: str, per: str = "corpus_id", canon: Canon | None = None) -> DataFrame:
    """(name, sha256, content): one file per value of ``per`` (corpus_id, or doc_id for corpora too large for one task). TheWord needs the ``canon``."""
    f = BY_NAME[fmt]
    write = f.write
    if fmt == "theword" and canon:
        write = lambda verses: textual.write_theword(verses, _canon_of(".ont", canon))
    if write is None:
        raise ValueError(f"{fmt} has no sink")

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["doc_order", "sequence"], kind="stable")
        n = lambda a: 0 if pd.isna(a) else int(a)
        body = write([Verse(d, n(c), n(v), t, n(e)) for d, c, v, e, t in zip(x.doc_id, x.chapter, x.verse, x.verse_end, x.text)])
        return pd.DataFrame({"name": [f"{key[0]}{f.suffixes[0]}"], "sha256": [hashlib.sha256(body).hexdigest()], "content": [body]})

    return blocks.groupBy(per).applyInPandas(run, "name string, sha256 string, content binary")


def save(files_df: DataFrame, folder: str) -> None:
    """Write (name, content) rows as files of a folder all executors share, a path or the URI of any file system pyarrow opens
    (hdfs, object stores); names that leave it are refused. Each file appears at once, by a move."""

    def put(rows) -> None:
        import os

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        store.create_dir(root, recursive=True)
        for r in rows:
            if not binary.safe_path(r.name):
                raise ValueError(f"unsafe name {r.name}")
            tmp, to = f"{root}/.{r.name.replace('/', '_')}.part", f"{root}/{r.name}"
            with store.open_output_stream(tmp) as out:
                out.write(bytes(r.content))
            store.create_dir(to.rpartition("/")[0], recursive=True)
            store.move(tmp, to)

    files_df.select("name", "content").foreachPartition(put)


def pack_files(files_df: DataFrame, kinds: list[str]) -> DataFrame:
    """(name, kind, content): every file (name, content) as an archive of its own, in each of the ``kinds`` zip, xz, gz (compressed tar) and tar."""

    def run(batches):
        for b in batches:
            rows = [(n, k, binary.pack({n: bytes(c)}, "" if k == "tar" else k)) for n, c in zip(b.name, b.content) for k in kinds]
            yield pd.DataFrame(rows, columns=["name", "kind", "content"])

    return files_df.select("name", "content").mapInPandas(run, "name string, kind string, content binary")


def archive_entries(files_df: DataFrame) -> DataFrame:
    """(archive, name, length, is_dir, content) of all archives; unsafe paths are left out."""

    def run(batches):
        for b in batches:
            for a, content in zip(b.path, b.content):
                rows = [(a, p, s, d, c) for p, s, d, c in binary.entries(content) if binary.safe_path(p)]
                if rows:
                    yield pd.DataFrame(rows, columns=["archive", "name", "length", "is_dir", "content"])

    return files_df.mapInPandas(run, "archive string, name string, length bigint, is_dir boolean, content binary")


def modules(entries_df: DataFrame) -> DataFrame:
    """Module catalogue (module, conf map<string, array<string>>, features) of *.conf entries (name, content)."""

    def run(batches):
        for b in batches:
            rows = []
            for content in b.content:
                name, conf = binary.read_conf(content.decode("utf-8", "replace"))
                if name:
                    rows.append((name, [{"k": k, "v": v} for k, v in conf.items()]))
            yield pd.DataFrame(rows, columns=["module", "kv"])

    found = entries_df.where(F.col("name").endswith(".conf")).select("content").mapInPandas(run, "module string, kv array<struct<k:string,v:array<string>>>")
    conf = F.map_from_entries(F.transform("kv", lambda x: F.struct(x["k"], x["v"])))
    return found.select("module", conf.alias("conf")).withColumn("features", F.coalesce(F.col("conf")["Feature"], F.array().cast("array<string>")))


def binary_modules(files_df: DataFrame, canon: dict[str, list[tuple[str, int, int]]]) -> DataFrame:
    """Blocks of compressed verse-keyed modules. Files of one folder are one module: {ot,nt}.{bzs,bzv,bzz} (block index, verse
    index, data). ``canon`` {"ot": [(book, chapter, number of verses)], "nt": ...}. One module is one task."""
    found = files_df.where(F.col("name").rlike(r"^(ot|nt)\.bz[svz]$")).withColumn("module", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        have, rows = dict(zip(x.name, x.content)), []
        for t in ("ot", "nt"):
            parts = [have.get(f"{t}.{s}") for s in ("bzs", "bzv", "bzz")]
            if all(p is not None for p in parts):
                rows += [(key[0], v.doc, v.block_id, v.chapter, v.verse, v.text, v.raw) for v in binary.read_ztext(*parts, canon.get(t, []))]
        return pd.DataFrame(rows, columns=["corpus_id", "doc_id", "block_id", "chapter", "verse", "text", "raw_markup"])

    return found.groupBy("module").applyInPandas(run, "corpus_id string, doc_id string, block_id string, chapter int, verse int, text string, raw_markup string")


def _parts(files_df: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Files of one folder and stem that end in ``suffixes``; ``module`` is the stem, ``_at`` folder and stem."""
    df = files_df.where(F.lower("name").rlike(r"\.(" + "|".join(suffixes) + ")$"))
    return df.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("_at"), F.regexp_extract("name", r"^(.*)\.", 1).alias("module"), F.lower(F.regexp_extract("name", r"([^.]+)$", 1)).alias("suffix"), "content")


def lexicons(files_df: DataFrame) -> DataFrame:
    """(module, key, text) of compressed lexicons: X.idx, X.dat, X.zdx and X.zdt of one folder. One module is one task."""
    suffixes = ("idx", "dat", "zdx", "zdt")

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        have = dict(zip(x.suffix, x.content))
        rows = [(x.module.iloc[0], k, text) for k, text in binary.read_zld(*(have[s] for s in suffixes))] if len(have) == len(suffixes) else []
        return pd.DataFrame(rows, columns=["module", "key", "text"])

    return _parts(files_df, suffixes).groupBy("_at").applyInPandas(run, "module string, key string, text string")


def tree_modules(files_df: DataFrame) -> DataFrame:
    """(module, node, parent, name, text) of tree-keyed modules: X.idx, X.dat and X.bdt of one folder. One module is one task; see tree_paths."""
    suffixes = ("idx", "dat", "bdt")

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        have = dict(zip(x.suffix, x.content))
        rows = [(x.module.iloc[0], *r) for r in binary.read_genbook(*(have[s] for s in suffixes))] if len(have) == len(suffixes) else []
        return pd.DataFrame(rows, columns=["module", "node", "parent", "name", "text"])

    return _parts(files_df, suffixes).groupBy("_at").applyInPandas(run, "module string, node int, parent int, name string, text string")


# ---- content-addressed store ---------------------------------------------------------------------------------------------

BLOB = "sha256 string, size_bytes bigint, content binary"


def as_blobs(files_df: DataFrame) -> DataFrame:
    return files_df.select(F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size_bytes"), "content")


def put_blobs(store: str, blobs: DataFrame) -> int:
    """Append the blobs the store (a Parquet folder) lacks; returns how many. Equal contents are stored once."""
    spark = blobs.sparkSession
    new = blobs.dropDuplicates(["sha256"])
    try:
        new = new.join(spark.read.schema(BLOB).parquet(store).select("sha256"), "sha256", "left_anti")
    except Exception as e:  # no store yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = new.cache()
    n = new.count()
    if n:
        new.write.mode("append").parquet(store)
    new.unpersist()
    return n


def verify_artifacts(artifacts: DataFrame, store: DataFrame) -> DataFrame:
    """(artifact_id, status): ok, missing or corrupt (the content's hash is not its key)."""
    b = store.select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("_ok"))
    return artifacts.join(b, "sha256", "left").select("artifact_id", F.when(F.col("_ok").isNull(), "missing").when(F.col("_ok"), "ok").otherwise("corrupt").alias("status"))


def tree_children(nodes: DataFrame) -> DataFrame:
    """(node, children): every node's children in the order of their numbers; a node without any has an empty array."""
    kids = nodes.where("parent >= 0").groupBy(F.col("parent").alias("node")).agg(F.sort_array(F.collect_list("node")).alias("children"))
    return nodes.select("node").join(kids, "node", "left").select("node", F.coalesce("children", F.array().cast("array<int>")).alias("children"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(node, path) of a tree (node, parent, name): paths from the root, which has parent -1.

    By doubling: each round every path jumps to its ancestor's ancestor, so a tree of depth n takes log2(n) joins, each
    written to the shared folder. Nodes whose parents lead nowhere, or round in a circle, have no path.
    """
    now = nodes.select("node", F.col("parent").alias("up"), F.when(F.col("parent") == -1, "").otherwise(F.concat(F.lit("/"), "name")).alias("path"))
    left = -1
    while True:
        now = materialize(now, "tree-paths")
        waiting = now.where("up <> -1").count()
        if waiting in (0, left):
            return now.where("up = -1").select("node", "path")
        left = waiting
        above = now.select(F.col("node").alias("up"), F.col("up").alias("upper"), F.col("path").alias("above"))
        now = now.join(above, "up", "left").select("node", F.when(F.col("up") == -1, -1).otherwise(F.coalesce("upper", F.lit(-2))).alias("up"), F.when(F.col("up") == -1, F.col("path")).otherwise(F.concat("above", "path")).alias("path")).where("up <> -2 OR path IS NOT NULL")
