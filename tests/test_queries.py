"""Every registered query of the core runs, and equals its SQL where it has any."""

import os

import pytest

from seqloom.plans import all_queries

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()
#: Clusterings align many pairs; their tests are in test_cluster.py.
SLOW = {"screen_2d", "screen_2d_best", "novel_2d", "cluster_protein_best"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


def rows(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(repr([int(v) if hasattr(v, "__index__") and not isinstance(v, bool) else v for v in r]) for r in frame.values.tolist())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", [q for q in QUERIES if q not in SLOW])
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).fetchdf()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        assert rows(got, columns) == rows(want, columns)
