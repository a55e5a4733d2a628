"""Every registered cube query against its SQL."""

from __future__ import annotations

import pytest

from meridian.queries import ORACLE, QUERIES

from conftest import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()]
    assert rows
    if name in ORACLE:
        expected = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({ORACLE[name]})").fetchall()
        assert same_rows(rows, expected)
    else:
        assert all(v == v for r in rows for v in r if isinstance(v, float))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
