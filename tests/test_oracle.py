"""Every query that has SQL gives DuckDB's rows on the smallest tables; the others give rows."""

import duckdb
import pytest

from normlens.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(value, 9) + 0.0 if isinstance(value, float) else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    rows = [tuple(r) for r in got.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    want_rows = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want.fetchall()]
    assert rows_of(got.columns, rows) == rows_of(columns, want_rows)
