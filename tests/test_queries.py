"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from trackframe.plans import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(x):
    if isinstance(x, (bool, str)) or x is None:
        return str(x)
    try:
        return repr(float(x) + 0.0)
    except (TypeError, ValueError):
        return str(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, sf_dir, name):
    df = q.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    assert got
    if sql := q.oracle_sql().get(name):
        rel = duck.sql(sql)
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())


def test_no_query_sorts_a_large_side_in_one_task(spark, sf_dir):
    """Ranks come without a window over the whole table: the only unpartitioned window is over bucket sizes."""
    from trackframe.operators.splits import split_random
    from trackframe.plans import views

    plan = split_random(views.t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 8, 1, 1)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert any("bucket_" in w for w in windows)
    assert all("bucket_" in w for w in windows)
