"""Registered queries against their SQL."""

from __future__ import annotations

import pytest

from meridian.llm.queries import ORACLE, QUERIES

from conftest import same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    assert rows
    if name in ORACLE:
        assert same_rows(rows, duck.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE[name]})").fetchall())


def test_entry_has_every_operator_and_the_pipeline():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, len(QUERIES) + 1)) and names >= {*QUERIES, "pipeline"}
