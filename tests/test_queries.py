"""Each registered query with SQL gives what DuckDB gives over the same whole tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 4) + 0.0
    if hasattr(value, "tolist"):
        return tuple(plain(x) for x in value.tolist())
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if value is None or value != value:
        return None
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime().replace(tzinfo=None)
    if hasattr(value, "item"):
        return plain(value.item())
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracles():
    from fathomry.plans import registry

    return dict(registry.ORACLES), dict(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(oracles()[0]))
def test_same_as_sql(spark, name):
    import duckdb

    sql, queries = oracles()
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    expected = con.execute(sql[name])
    columns = [d[0] for d in expected.description]
    right = rows_of(columns, expected.fetchall())
    found = queries[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    assert len(got) == len(right)
    differing = [(a, b) for a, b in zip(got, right, strict=True) if a != b]
    assert not differing[:3]


def test_p3_found(spark):
    """Without SQL: positions are dense, values hold no marks around them, and plain fields are split as by hand."""
    rows = oracles()[1]["p3_found"](spark, DATA).collect()
    held = {}
    for r in rows:
        held.setdefault((r.feature_id, r.field), []).append((r.position, r.value))
    assert rows and all(v == v.strip() and v for x in held.values() for _, v in x)
    assert all({p for p, _ in x} == set(range(1, max(p for p, _ in x) + 1)) for x in held.values())
    plain_rows = 0
    for name in ("expected_features", "inventory_rows"):
        for r in spark.read.parquet(f"{DATA}/{name}.parquet").select("feature_id", "matching_aliases").distinct().collect():
            text = r.matching_aliases or ""
            if text and all(c.isalnum() or c in " |" for c in text):
                plain_rows += 1
                expected = [x.strip() for x in text.split("|") if x.strip()]
                assert set(enumerate(expected, 1)) <= set(held.get((r.feature_id, "matching_aliases"), []))
    assert plain_rows


def test_resolved_papers(spark):
    """Without SQL: against union-find over the keys of all rows."""
    from pyspark.sql import functions as F

    from fathomry.operators import resolve

    c = spark.read.parquet(f"{DATA}/candidates.parquet")
    held = resolve.paper_keys(c, "pos", F.col("doi"), [F.col("landing_page_url"), F.array_join("candidate_pdf_urls", " ")], F.col("title"), F.col("year"), F.get("authors", F.lit(0))).collect()
    root = {r.pos: r.pos for r in c.select("pos").collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for r in sorted(held):
        a, b = find(first.setdefault(r.key, r.item)), find(r.item)
        root[max(a, b)] = min(a, b)
    sizes = {}
    for x in root:
        sizes[find(x)] = sizes.get(find(x), 0) + 1
    got = oracles()[1]["resolved_papers"](spark, DATA).collect()
    assert {r.group: r.records for r in got} == sizes


def test_every_query_is_checked():
    assert set(oracles()[1]) - set(oracles()[0]) == {"p3_found", "resolved_papers"}
