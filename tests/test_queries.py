"""Every registered query against its SQL on the smallest tables, and the streaming query against the batch one."""

import os

import duckdb
import pytest

from echolith.plans.registry import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype("float32"), want[c].astype("float32")
        elif want[c].dtype.kind in "iuf" and got[c].dtype != want[c].dtype:
            got[c], want[c] = got[c].astype("Int64"), want[c].astype("Int64")
    assert rows(got) == rows(want)


def test_stream_equals_batch(spark):
    batch = {(r.id, r.window_idx, r.timestamp_ms, r.hashes) for r in QUERIES["wave_windows"](spark, SF).collect() if r.code is None}
    stream = {(r.stream_id, r.window_idx, r.timestamp_ms, r.hashes) for r in QUERIES["stream_windows"](spark, SF).collect()}
    assert len(batch) > 100 and batch == stream
