"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from logmill.plans.oracles import ORACLES
from logmill.plans.queries import QUERIES

ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf, con):
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    b = sorted(repr(tuple(plain(r[i]) for i in order)) for r in want.fetchall())
    a = sorted(repr(tuple(plain(v) for v in r)) for r in got.select(*columns).collect())
    assert a == b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_views(spark, sf):
    from logmill.plans.views import register_views

    for name in register_views(spark, sf):
        assert spark.sql(f"SELECT count(*) AS n FROM {name}").first()["n"] > 0
    got = {r["partition"]: r["n"] for r in spark.sql("SELECT partition, max(offset) + 1 AS n FROM event_log GROUP BY partition").collect()}
    assert got == {r["partition"]: r["next_offset"] for r in spark.table("watermarks").collect()}


@pytest.mark.parametrize("name", ["stream_tumbling_counts", "stream_sessions", "stream_dedup", "stream_ema", "stream_bandwidth", "stream_playout"])
def test_streams_of_many_files(name, spark, sf, con, tmp_path):
    """More files than a batch used to take, the latest rows first."""
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf}/events.parquet").sort_by([("ts", "descending")])
    (tmp_path / "events.parquet").mkdir()
    step = -(-rows.num_rows // 130)
    for k in range(130):
        pq.write_table(rows.slice(k * step, step), f := tmp_path / f"events.parquet/part-{k:03}.parquet")
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(repr(tuple(map(plain, r))) for r in got) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())
