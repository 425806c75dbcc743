"""The registered text queries on the smallest tables."""

import pytest

from folioform.llm import queries

SRC = "/root/testdata/sf0.001"
COLUMNS = {"p1_found": ["uid_a", "uid_b"], "p5_found": ["src_table", "id_a", "id_b"], "p6_found": ["src_table", "src_id"], "p7_found": ["src_table", "src_id"], "p9_found": ["item_id", "doc_id"], "p10_found": ["doc_a", "doc_b"]}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SRC)
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
