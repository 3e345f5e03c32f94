"""Registered queries against their SQL on the smallest test tables, where these are there."""

import math
import os

import pytest

from rankfield.plans import entrants, ingest, models, pages, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# What every other part builds on, and each third of the rest; the driver compares all of them.
CORE = ("r1_latest_observations", "r4_ranked_fields", "r7_r9_page_context", "f1_f8_field_quantiles", "f9_f11_given_groups", "h3_h5_field_deltas", "h8_load_sessions", "x2_features_of_fixed_groups", "m13_crowding", "c3_read_residuals", "st4_stream_transitions")
SOME = tuple(dict.fromkeys((*CORE, *sorted(registry.ORACLES)[::3])))


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (int, str, bytes)) or v is None or hasattr(v, "isoformat"):
        return v
    return None if math.isnan(v) else round(float(v), 4) + 0.0


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    cursor = duck.execute(registry.ORACLES[name])
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted((plain(tuple(r[i] for i in order)) for r in cursor.fetchall()), key=repr)


def test_every_query_is_registered_under_its_name():
    assert len(registry.QUERIES) > 130 and set(registry.ORACLES) <= set(registry.QUERIES)
