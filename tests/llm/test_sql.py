"""The corpus queries that SQL can say, against their SQL on the smallest test tables."""

import os

import pytest

from rankfield.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ORACLES)
def test_corpus_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    cursor = con.execute(ORACLES[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
