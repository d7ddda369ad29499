"""The registered text queries: SQL twins on the smallest tables, whole tables elsewhere, and the pipeline's registration."""

import duckdb
import pytest

from driftline.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = q.queries()[name](spark, SF)
    names = sorted(df.columns)
    cursor = duck.execute(q.oracle_sql()[name])
    found = [c[0] for c in cursor.description]
    assert sorted(found) == names
    plain = lambda rows, order: sorted(tuple(str(r[order.index(n)]) for n in names) for r in rows)
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), found)


def test_all_numbers_are_registered():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in q.queries()} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in e.queries() and set(q.queries()) <= set(e.queries())
