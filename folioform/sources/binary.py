"""Archives, packed documents and binary modules."""

from __future__ import annotations

import gzip
import io
import lzma
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from folioform.sources.model import Verse, book_by_code
from folioform.sources.textual import clean, read_usx, strip_html

# ---- archives ------------------------------------------------------------------------------------------------------------


def compression(data: bytes) -> str:
    """zip, gz, xz, bz2, tar or '' by magic bytes."""
    for magic, kind in ((b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gz"), (b"\xfd7zXZ\x00", "xz"), (b"BZh", "bz2")):
        if data.startswith(magic):
            return kind
    return "tar" if data[257:262] == b"ustar" else ""


def entries(data: bytes) -> Iterator[tuple[str, int, bool, bytes]]:
    """(path, size, is_dir, content) of a zip or (compressed) tar archive, in archive order."""
    kind = compression(data)
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                yield i.filename, i.file_size, i.is_dir(), b"" if i.is_dir() else z.read(i)
    elif kind:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
            for m in t:
                yield m.name, m.size, m.isdir(), (t.extractfile(m).read() if m.isfile() else b"")


def pack(files: dict[str, bytes], kind: str = "xz") -> bytes:
    """A tar archive (xz, gz or plain) or a zip of the files, in name order and without times, so equal files give equal bytes."""
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n in sorted(files):
                z.writestr(zipfile.ZipInfo(n), files[n])
        return out.getvalue()
    with tarfile.open(fileobj=out, mode="w") as t:
        for n in sorted(files):
            i = tarfile.TarInfo(n)
            i.size = len(files[n])
            t.addfile(i, io.BytesIO(files[n]))
    raw = out.getvalue()
    return lzma.compress(raw) if kind == "xz" else gzip.compress(raw, mtime=0) if kind == "gz" else raw


def safe_path(path: str) -> bool:
    """Whether an archive path stays below the folder it is unpacked to."""
    parts = path.replace("\\", "/").split("/")
    return not path.startswith("/") and ".." not in parts and not re.match(r"[A-Za-z]:", path)


# ---- packed documents ----------------------------------------------------------------------------------------------------


def read_epub(name: str, data: bytes) -> Iterator[Verse]:
    """One document per XHTML file; verses are spans or paragraphs of class verse, else paragraphs."""
    for i, (path, _, _, body) in enumerate(e for e in entries(data) if re.search(r"\.x?html?$", e[0], re.I)):
        text = body.decode("utf-8", "replace")
        title = re.search(r"<title>([^<]*)</title>", text)
        doc = re.sub(r".*/|\.x?html?$", "", path)
        chapter, found = 1, 0
        for m in re.finditer(r"<h[1-3][^>]*>[^<]*?(\d+)\s*</h[1-3]>|<(span|p)\b[^>]*class=\"verse\"[^>]*>(.*?)</\2>", text, re.S):
            if m[1]:
                chapter = int(m[1])
                continue
            number = re.search(r"<sup[^>]*>\s*(\d+)\s*</sup>", m[3])
            found += 1
            if t := strip_html(re.sub(r"<sup.*?</sup>", "", m[3], flags=re.S)):
                yield Verse(doc, chapter, int(number[1]) if number else found, t, title=clean(title[1]) if title else None)
        if not found:
            for n, m in enumerate(re.finditer(r"<p\b[^>]*>(.*?)</p>", text, re.S), 1):
                if t := strip_html(m[1]):
                    yield Verse(doc, 1, n, t, title=clean(title[1]) if title else None)


def write_epub(verses: list[Verse]) -> bytes:
    from xml.sax.saxutils import escape

    from folioform.sources.model import chapters, documents

    files = {"mimetype": b"application/epub+zip", "META-INF/container.xml": b'<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'}
    items, refs = [], []
    for d, vs in documents(verses):
        body = "".join(f"<h2>{c}</h2>" + "".join(f'<p class="verse"><sup>{v.verse}</sup> {escape(v.text)}</p>' for v in own) for c, own in chapters(vs))
        files[f"OEBPS/{d}.xhtml"] = f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(vs[0].title or d)}</title></head><body>{body}</body></html>'.encode()
        items.append(f'<item id="{d}" href="{d}.xhtml" media-type="application/xhtml+xml"/>')
        refs.append(f'<itemref idref="{d}"/>')
    files["OEBPS/content.opf"] = f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><manifest>{"".join(items)}</manifest><spine>{"".join(refs)}</spine></package>'.encode()
    return pack(files, "zip")


def read_odf(name: str, data: bytes) -> Iterator[Verse]:
    """Headings with a number open chapters; paragraphs that start with a number are verses."""
    body = next((c for p, _, _, c in entries(data) if p == "content.xml"), b"").decode("utf-8", "replace")
    chapter, book = 1, name
    for m in re.finditer(r"<text:(h|p)\b([^>]*)>(.*?)</text:\1>", body, re.S):
        t = strip_html(m[3])
        if m[1] == "h" and 'style-name="Book"' in m[2]:
            book, chapter = t or name, 1
        elif m[1] == "h":
            chapter = int(n[0]) if (n := re.search(r"\d+", t)) else chapter
        elif v := re.match(r"(\d+)\s+(\S.*)$", t):
            yield Verse(book, chapter, int(v[1]), v[2])


def write_odf(verses: list[Verse]) -> bytes:
    """One text document: a heading of style Book per document, one per chapter, a paragraph per verse."""
    from folioform.sources.model import chapters, documents
    from folioform.sources.textual import xml_text

    out = ['<?xml version="1.0" encoding="UTF-8"?><office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:text>']
    for d, vs in documents(verses):
        out.append(f'<text:h text:style-name="Book" text:outline-level="1">{xml_text(d)}</text:h>')
        for c, own in chapters(vs):
            out.append(f'<text:h text:outline-level="2">Chapter {c}</text:h>')
            out += [f"<text:p>{v.verse} {xml_text(v.text)}</text:p>" for v in own]
    out.append("</office:text></office:body></office:document-content>")
    return pack({"mimetype": b"application/vnd.oasis.opendocument.text", "content.xml": "".join(out).encode()}, "zip")


def read_dbl(name: str, data: bytes) -> Iterator[Verse]:
    """A zip of USX files."""
    for path, _, _, body in entries(data):
        if path.lower().endswith(".usx"):
            yield from read_usx(book_by_code(re.sub(r".*/|\.usx$", "", path, flags=re.I)), body)


def write_dbl(verses: list[Verse]) -> bytes:
    """A bundle: metadata, and one USX file per document, numbered in their order."""
    from folioform.sources.model import documents
    from folioform.sources.textual import write_usx

    files = {"metadata.xml": b'<?xml version="1.0" encoding="utf-8"?><DBLMetadata type="text" typeVersion="1.5"/>'}
    for i, (_, vs) in enumerate(documents(verses), 1):
        files[f"release/USX_1/{i:05}.usx"] = write_usx(vs)
    return pack(files, "zip")


def printable_runs(data: bytes, least: int) -> list[str]:
    """Runs of more than ``least`` printable characters."""
    text = data.decode("utf-8", "replace")
    return [t for t in (clean(r) for r in re.findall(r"[^\x00-\x1f\x7f-\x9f�]+", text)) if len(t) > least]


def read_gobible(name: str, data: bytes) -> Iterator[Verse]:
    n = 0
    for path, _, _, body in entries(data):
        if not path.lower().endswith((".class", ".mf", ".png")):
            for t in printable_runs(body, 10):
                n += 1
                yield Verse(name, 0, n, t)


def write_gobible(verses: list[Verse]) -> bytes:
    """A phone archive: per document one data file of its texts, a zero byte between; places are not kept, nor texts of ten characters or less."""
    from folioform.sources.model import documents

    files = {"META-INF/MANIFEST.MF": b"Manifest-Version: 1.0\n"}
    for i, (_, vs) in enumerate(documents(verses), 1):
        files[f"Bible Data/{i:05}/Index"] = b"\x00".join(v.text.encode() for v in vs)
    return pack(files, "zip")


def read_pdb(name: str, data: bytes, most: int = 10_000) -> Iterator[Verse]:
    """Palm databases: a 78-byte header, big-endian record offsets, text runs of more than five characters."""
    if len(data) < 78:
        return
    count = min(struct.unpack(">H", data[76:78])[0], most)
    offsets = [struct.unpack(">I", data[78 + 8 * i : 82 + 8 * i])[0] for i in range(count) if 82 + 8 * i <= len(data)]
    n = 0
    for a, b in zip(offsets, [*offsets[1:], len(data)]):
        for t in printable_runs(data[a:b], 5):
            n += 1
            yield Verse(name, 0, n, t)


# ---- binary modules ------------------------------------------------------------------------------------------------------


def read_conf(text: str) -> tuple[str, dict[str, list[str]]]:
    """(module id, {key: values}) of an INI module description; a value ending in a backslash continues on the next line."""
    name, out = "", {}
    for line in re.sub(r"\\\r?\n[ \t]*", " ", text).splitlines():
        if m := re.match(r"\[([^\]]+)\]\s*$", line.strip()):
            if name:
                break
            name = m[1]
        elif (m := re.match(r"\s*([A-Za-z0-9_.]+)\s*=\s*(.*)$", line)) and name:
            out.setdefault(m[1], []).append(m[2].strip())
    return name, out


def slots(canon: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(book, chapter, verse) of every index slot of a testament: two headings, then one per book and chapter before its verses."""
    out, now = [("", 0, 0), ("", 0, 0)], None
    for book, chapter, n in canon:
        if book != now:
            out.append((book, 0, 0))
            now = book
        out.append((book, chapter, 0))
        out += [(book, chapter, v) for v in range(1, n + 1)]
    return out


def read_ztext(blocks_idx: bytes, verses_idx: bytes, data: bytes, canon: list[tuple[str, int, int]]) -> Iterator[Verse]:
    """Compressed verse-keyed modules (scripture or commentary). The block index has 12 bytes a block (offset, size, plain size),
    the verse index 10 a slot (block, offset, size), little-endian; blocks are zlib streams. Empty slots are skipped."""
    plain: dict[int, bytes] = {}
    for i, (book, chapter, verse) in enumerate(slots(canon)):
        if 10 * i + 10 > len(verses_idx):
            return
        block, at, size = struct.unpack_from("<IIH", verses_idx, 10 * i)
        if not size or not book or not verse:
            continue
        if block not in plain:
            if 12 * block + 12 > len(blocks_idx):
                continue
            start, packed, _ = struct.unpack_from("<III", blocks_idx, 12 * block)
            plain = {block: zlib.decompress(data[start : start + packed])}  # slots go through blocks in order
        raw = plain[block][at : at + size].decode("utf-8", "replace")
        if text := clean(re.sub(r"<[^>]*>?", "", raw)):
            yield Verse(book, chapter, verse, text, raw=raw)


def write_ztext(verses: list[Verse], canon: list[tuple[str, int, int]], block_bytes: int = 4096) -> tuple[bytes, bytes, bytes]:
    """(block index, verse index, data) of a module; a new block starts once the last has ``block_bytes``."""
    at = {(v.doc, v.chapter, v.verse): (v.raw or v.text).encode() for v in verses}
    bidx, vidx, data, plain, n = b"", b"", b"", b"", 0

    def flush() -> None:
        nonlocal bidx, data, plain, n
        packed = zlib.compress(plain)
        bidx += struct.pack("<III", len(data), len(packed), len(plain))
        data, plain, n = data + packed, b"", n + 1

    for slot in slots(canon):
        raw = at.get(slot, b"")
        vidx += struct.pack("<IIH", n, len(plain), len(raw)) if raw else struct.pack("<IIH", 0, 0, 0)
        plain += raw
        if len(plain) >= block_bytes:
            flush()
    if plain:
        flush()
    return bidx, vidx, data


def read_zld(idx: bytes, dat: bytes, zdx: bytes, zdt: bytes) -> Iterator[tuple[str, str]]:
    """(key, text) of a compressed lexicon: index and key file of (offset, size), keys end in CR LF and name block and entry."""
    plain: dict[int, bytes] = {}
    for i in range(len(idx) // 8):
        at, size = struct.unpack_from("<II", idx, 8 * i)
        key, _, rest = dat[at : at + size].partition(b"\r\n")
        if len(rest) < 8:
            continue
        block, entry = struct.unpack("<II", rest[:8])
        if block not in plain:
            start, packed = struct.unpack_from("<II", zdx, 8 * block)
            plain = {block: zlib.decompress(zdt[start : start + packed])}
        body = plain[block]
        off, n = struct.unpack_from("<II", body, 4 + 8 * entry)
        yield key.decode("utf-8", "replace"), body[off : off + n].rstrip(b"\x00").decode("utf-8", "replace")


def write_zld(items: dict[str, str], per_block: int = 50) -> tuple[bytes, bytes, bytes, bytes]:
    idx, dat, zdx, zdt = b"", b"", b"", b""
    keys = sorted(items)
    for b, start in enumerate(range(0, len(keys), per_block)):
        own = keys[start : start + per_block]
        texts = [items[k].encode() + b"\x00" for k in own]
        head, off = struct.pack("<I", len(own)), 4 + 8 * len(own)
        for t in texts:
            head += struct.pack("<II", off, len(t))
            off += len(t)
        packed = zlib.compress(head + b"".join(texts))
        zdx += struct.pack("<II", len(zdt), len(packed))
        zdt += packed
        for e, k in enumerate(own):
            row = k.encode() + b"\r\n" + struct.pack("<II", b, e)
            idx += struct.pack("<II", len(dat), len(row))
            dat += row
    return idx, dat, zdx, zdt


def read_genbook(idx: bytes, dat: bytes, bdt: bytes) -> Iterator[tuple[int, int, str, str]]:
    """(node, parent, name, text) of a tree of keys: nodes name parent, next sibling and first child; user data is offset and size of the text."""
    for i in range(len(idx) // 4):
        (at,) = struct.unpack_from("<I", idx, 4 * i)
        parent, _, _ = struct.unpack_from("<iii", dat, at)
        end = dat.index(b"\x00", at + 12)
        (size,) = struct.unpack_from("<H", dat, end + 1)
        off, n = struct.unpack_from("<II", dat, end + 3) if size >= 8 else (0, 0)
        yield i, -1 if parent < 0 else parent // 4, dat[at + 12 : end].decode("utf-8", "replace"), bdt[off : off + n].decode("utf-8", "replace")


def write_genbook(nodes: list[tuple[int, str, str]]) -> tuple[bytes, bytes, bytes]:
    """(idx, dat, bdt) of nodes (parent, name, text) in order; the first is the root with parent -1."""
    kids: dict[int, list[int]] = {}
    for i, (p, _, _) in enumerate(nodes):
        kids.setdefault(p, []).append(i)
    idx, dat, bdt = b"", b"", b""
    for i, (p, name, text) in enumerate(nodes):
        sib = kids[p]
        nxt = sib[sib.index(i) + 1] * 4 if sib.index(i) + 1 < len(sib) else -1
        child = kids[i][0] * 4 if i in kids else -1
        idx += struct.pack("<I", len(dat))
        dat += struct.pack("<iii", p * 4 if p >= 0 else -1, nxt, child) + name.encode() + b"\x00" + struct.pack("<H", 8) + struct.pack("<II", len(bdt), len(text.encode()))
        bdt += text.encode()
    return idx, dat, bdt
