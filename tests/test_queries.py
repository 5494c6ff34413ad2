import duckdb
import pytest

import __spark_entry__ as entry_points
from chronoweave.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
GRAPH = sorted(registry.SQL)


def rows(names, table):
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(text(r[i]) for i in order) for r in table)


@pytest.mark.parametrize("name", GRAPH)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry_points.queries()[name](spark, DIR)
    want = con.sql(entry_points.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
