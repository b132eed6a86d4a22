"""Queries against their SQL on a table with one very large group of copies, which the small test tables do not have."""

import duckdb

from normlens.plans import registry

DIR = "/root/testdata/sf0.001"


def test_duplicate_paths_of_a_large_group(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute(f"""COPY (SELECT doc_id + k * 200 AS doc_id, source, lang, CASE WHEN k < 13 THEN 'a copy' WHEN doc_id < 10 THEN NULL ELSE text END AS text
        FROM '{DIR}/documents.parquet', range(14) r(k) WHERE doc_id < 200) TO '{tmp_path}/documents.parquet' (FORMAT PARQUET)""")
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = registry.queries()["duplicate_paths"](spark, str(tmp_path))
    want = duck.execute(registry.oracle_sql()["duplicate_paths"])
    columns = [c[0] for c in want.description]
    rows = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows
    assert sum(r.startswith("(None") for r in rows) == 1 and len({r.split(",")[1] for r in rows}) == 6
