"""Registered training-data queries: against SQL where there is some, else that they run with the named columns."""

import pytest

from corpusmill.llm import queries

COLUMNS = {
    "p1_found": ["page_id"], "p2_found": ["page_id", "line_no"], "p3_found": ["page_id", "line_no"], "p4_found": ["page_a", "page_b", "field"], "p5_found": ["page_id"], "p6_found": ["page_id", "section_no"], "p9_found": ["doc_id", "block_no", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(name, check_sql):
    check_sql(queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(name, spark, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    rows = df.select([c for c, kind in df.dtypes if not kind.startswith("array")]).collect()
    assert rows and len(rows) == len(set(rows))
