"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from coppice import catalogue


def norm(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted([tuple(norm(r[k]) for k in order) for r in data], key=repr)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees(name, spark, small, con):
    df = catalogue.queries()[name](spark, small)
    got = con.execute(catalogue.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, got.fetchall())


def test_search_grows_and_never_scores_more(spark, small):
    found = catalogue.entry(spark, small).collect()
    by = {}
    for r in found:
        by.setdefault(r.prog, []).append((r.gen, len(r.members.split(",")), r.score))
    assert by
    for steps in by.values():
        steps.sort()
        assert all(g == n for g, n, _ in steps)
        assert all(a[2] >= b[2] for a, b in zip(steps, steps[1:], strict=False))
