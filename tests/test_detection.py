"""Detection reads the whole file; what no format accepts is listed."""

import pytest

from folioform.sources import registry
from folioform.sources.model import Verse

PREFACE = "licence and comment\n" * 5000


@pytest.mark.parametrize("fmt", ["osis", "usx", "zefania", "tei"])
def test_late_root_element(fmt):
    f = registry.BY_NAME[fmt]
    head, _, rest = f.write([Verse("Gen", 1, 1, "First words")]).partition(b"?>")
    data = head + b"?><!--" + PREFACE.encode() + b"-->" + rest
    assert registry.detect(f"x{f.suffixes[0]}", data) == fmt
    assert [v.text for v in f.read("x", data)] == ["First words"]


@pytest.mark.parametrize("fmt, line", [("onlinebible", "$Gen 1:1 First words"), ("markdown", "**1** First words"), ("txt", "Gen 1:1 First words")])
def test_late_first_verse(fmt, line):
    assert registry.detect("x", f"{PREFACE}{line}\n".encode()) == fmt


def test_late_phrase():
    assert registry.detect("x", f"<document><!--{PREFACE}--><phrase/></document>".encode()) == "flex"
    assert registry.detect("x", b"<phrase/><document/>") != "flex"


def test_undetected_files_are_listed(spark, tmp_path):
    (tmp_path / "junk.bin").write_bytes(bytes(range(256)))
    (tmp_path / "a.txt").write_bytes(f"{PREFACE}Gen 1:1 First words\n".encode())
    files = registry.files(spark, str(tmp_path))
    assert [(r.name, r.length, r.kind) for r in registry.undetected(files).collect()] == [("junk.bin", 256, "application/octet-stream")]
    assert [r.text for r in registry.read_blocks(files).collect()] == ["First words"]
