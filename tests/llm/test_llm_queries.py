"""The registered queries of the subpackage over the smallest tables; and that nothing else imports it."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from fathomry.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p1_found": ["group_id", "row_index"], "p2_found": ["feature_id", "row_index"], "p4_found": ["pos", "ref_id"], "p5_found": ["dup_group", "field", "pos"],
    "p6_found": ["chunk_id", "kind", "line_no", "word"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    found = queries.QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert sorted(found.columns) == COLUMNS[name]
    rows = found.collect()
    assert rows
    if name.endswith("_found"):
        assert len({str(r) for r in rows}) == len(rows)


def test_nothing_else_imports_it():
    root = Path(__file__).resolve().parents[2]
    for p in [*root.glob("fathomry/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", p.read_text(), re.M), p


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    expected = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in expected.description]
    found = queries.QUERIES[name](spark, DATA).select(*columns)
    assert sorted(map(tuple, found.collect())) == sorted(expected.fetchall())
