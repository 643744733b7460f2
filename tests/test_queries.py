"""Every catalogue query against its SQL on the smallest generated tables, where they are there."""

import os

import pytest

from spindrift import detail_queries  # noqa: F401
from spindrift.queries import ORACLES, QUERIES

DATA = os.environ.get("SPINDRIFT_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no generated tables")
FAST = [n for n in ORACLES if not n.startswith("lens_") or n in ("lens_conjunction", "lens_missions")]


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", FAST)
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("orders", "customer", "events"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    want = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted((tuple(plain(v) for v in r) for r in df.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
