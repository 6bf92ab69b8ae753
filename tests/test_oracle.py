"""Each query with SQL gives the rows of its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from sightline.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_stream_alerts_equal_batch(spark):
    """The first alert of each stand is where the batch timeline turns still."""
    from sightline.operators import behavior as B
    from sightline.sources import adapter as A

    alerts = {(r.tracklet_id, r.frame_no) for r in QUERIES["stream_still_alerts"](spark, SF).collect()}
    t = A.tracklets(spark, SF).drop("scene_segment").selectExpr("*", "0 AS scene_segment")
    starts = {(e.tracklet_id, e.frame_start) for e in B.behavior_events(B.status_timeline(t, A.FPS), A.FPS).filter("category = 'STILLA'").collect()}
    assert alerts <= starts
    assert {a for a, _ in alerts} == {a for a, _ in starts}
