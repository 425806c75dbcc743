"""TheWord, lexicons and tree modules from a folder."""

import pytest

from folioform.sources import binary, registry, textual
from folioform.sources.model import Verse

CANON = {"ot": [("Gen", 1, 2), ("Gen", 2, 1)], "nt": [("Matt", 1, 1)]}
VERSES = [Verse("Gen", 1, 2, "b é"), Verse("Gen", 2, 1, "c"), Verse("Matt", 1, 1, "d")]


def test_theword_in_spark(spark, tmp_path):
    (tmp_path / "x.ont").write_bytes(textual.write_theword(VERSES, CANON["ot"] + CANON["nt"]))
    (tmp_path / "y.nt").write_bytes(b"d\n")
    files = registry.files(spark, str(tmp_path))
    assert {r.name: r.format for r in registry.catalogue(files).collect()} == {"x.ont": "theword", "y.nt": "theword"}
    blocks = registry.read_blocks(files, canon=CANON)
    want = [(v.doc, v.chapter, v.verse, v.text) for v in VERSES]
    places = lambda df, c: sorted((r.doc_id, r.chapter, r.verse, r.text) for r in df.where(df.corpus_id == c).collect())
    assert places(blocks, "x") == want and places(blocks, "y") == want[2:]
    again = registry.read_blocks(registry.emit(blocks.where("corpus_id = 'x'"), "theword", canon=CANON), "theword", CANON)
    assert places(again, "x") == want
    with pytest.raises(ValueError):
        registry.read_blocks(files, "theword")
    with pytest.raises(ValueError):
        registry.emit(blocks, "theword")


def test_lexicons_and_trees_in_spark(spark, tmp_path):
    items = {f"k{i:03}": f"text {i} é" for i in range(120)}
    nodes = [(-1, "", ""), (0, "A", "ta"), (1, "A1", "é"), (0, "B", "tb")]
    for folder, suffixes, data in (("lex", ("idx", "dat", "zdx", "zdt"), binary.write_zld(items)), ("book", ("idx", "dat", "bdt"), binary.write_genbook(nodes))):
        (tmp_path / folder).mkdir()
        for s, body in zip(suffixes, data):
            (tmp_path / folder / f"{folder}.{s}").write_bytes(body)
    files = registry.files(spark, str(tmp_path))
    assert {r.key: r.text for r in registry.lexicons(files).collect()} == items
    assert [tuple(r) for r in registry.tree_modules(files).orderBy("node").collect()] == [("book", i, *n) for i, n in enumerate(nodes)]
