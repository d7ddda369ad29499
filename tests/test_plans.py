"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from driftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)[:10]
    return float(v) if isinstance(v, float) else str(v)


def table(names, rows):
    """Columns by name; rows by their exact values, then roughly by their floating ones."""
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(rows, key=lambda r: ([x for x in r if isinstance(x, str)], [x for x in r if isinstance(x, float)]))


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = table(df.columns, df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if not all(map(same, g, w))]
    assert not wrong, wrong[:3]


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
