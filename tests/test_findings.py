"""Queries on inputs that the small sample tables don't have: what a review found."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sightline.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name, *tables):
    db = duckdb.connect()
    for t in tables:
        at = f"{folder}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    found = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    got = QUERIES[name](spark, folder).select(*names).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(found.fetchall(), key=repr)


def test_marker_when_the_last_row_has_none(spark, tmp_path):
    # 1 and 4 set a marker, 10 and 15 have none.
    spark.createDataFrame([(i, 1, 0) for i in (1, 4, 10, 15)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    same_as_sql(spark, str(tmp_path), "hazard_marker", "labels")


@pytest.mark.parametrize("name", ["stream_windows", "stream_sessions"])
def test_late_rows_are_dropped_where_events_lie_in_many_files(spark, tmp_path, name):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    same_as_sql(spark, str(tmp_path), name, "events")


def test_centroids_move_no_components(spark):
    """Vectors by number give the centroids of whole ones, and neither way makes a row of a component."""
    from sightline.operators import identity as P

    t = spark.createDataFrame([(1, i % 3, i) for i in range(30)], "run_id bigint, tracklet_id bigint, det_id bigint")
    v = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, -2.0]), (2, [1.0, 0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id bigint, embedding array<double>")
    d = t.select("det_id", F.when(F.col("det_id") % 2 == 0, "a").otherwise("b").alias("embedding_method"), (F.col("det_id") % 5).alias("vec_id"))
    whole, named = P.centroids(t, d.join(v, "vec_id").drop("vec_id")), P.centroids(t, d, v)
    got = [{(r.tracklet_id, r.embedding_method): ([round(x, 9) for x in r.centroid], r.n) for r in c.collect()} for c in (whole, named)]
    assert got[0] == got[1] and len(got[0]) == 6
    units = {0: (0.6, 0.8, 0.0), 1: (0.0, -1.0, 0.0), 2: (0.5**0.5, 0.0, 0.5**0.5)}
    for (k, m), (c, n) in got[0].items():
        mine = [units[i % 5] for i in range(30) if i % 3 == k and (i % 2 == 0) == (m == "a") and i % 5 < 3]
        total = [sum(x) for x in zip(*mine, strict=True)]
        size = sum(x * x for x in total) ** 0.5
        assert n == len(mine) and c == [round(x / size, 9) for x in total]
    for c in (whole, named):
        assert "Generate" not in c._jdf.queryExecution().optimizedPlan().toString()


def test_paced_task_reads_its_own_rows_only(tmp_path):
    """A task of a few frames holds a few rows, not its whole file."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.types import LongType, StructType

    from sightline.streaming.paced import Frames, PacedReader

    n = 400_000
    pq.write_table(pa.table({"x": pa.array(range(n), pa.int64()), "text": [f"{i:064d}" for i in range(n)]}), f"{tmp_path}/one.parquet", row_group_size=20_000, use_dictionary=False)
    schema = StructType().add("x", LongType()).add("frame_no", LongType())
    reader = PacedReader({"path": str(tmp_path), "fps": "24", "max_fps": "8"}, schema)
    base, most, got = pa.total_allocated_bytes(), 0, []
    for batch in reader.read(Frames(0, 199_990, 260_000)):
        most = max(most, pa.total_allocated_bytes() - base)
        got += batch.column(0).to_pylist()
    assert got == [f - 1 for f in range(199_991, 260_001) if f % 3 == 0]
    assert most < 4_000_000


def test_suppression_makes_no_python_call_for_a_frame(spark):
    """Boxes of many frames against a plain loop, in Spark's own expressions."""
    import random

    from sightline.operators import motion as O

    rng = random.Random(5)
    rows = [(f, f * 100 + i, rng.randrange(4) / 4, x := rng.uniform(0, 40), y := rng.uniform(0, 40), x + rng.uniform(0, 40), y + rng.uniform(0, 40)) for f in range(40) for i in range(rng.randrange(1, 12))]
    rows += [(99, 1, 0.5, 0.0, 0.0, 5.0, 5.0), (99, 2, 0.9, None, 0.0, 5.0, 5.0), (98, 1, None, 0.0, 0.0, 5.0, 5.0), (98, 2, 0.1, 0.0, 0.0, 5.0, 5.0)]
    found = O.suppress(spark.createDataFrame(rows, "f int, box_id int, score double, x0 double, y0 double, x1 double, y1 double"), ["f"])
    want = {(99, 2), (98, 2)}
    for f in range(40):
        kept = []
        for b in sorted((r for r in rows if r[0] == f), key=lambda r: (-r[2], r[1])):
            shared = [max(min(a[5], b[5]) - max(a[3], b[3]), 0) * max(min(a[6], b[6]) - max(a[4], b[4]), 0) for a in kept]
            if all(s / max((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - s, 1e-9) <= 0.5 for a, s in zip(kept, shared, strict=True)):
                kept.append(b)
        want |= {(f, b[1]) for b in kept}
    assert {(r.f, r.box_id) for r in found.collect()} == want
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_oscillation_goes_over_batches_of_many_tracks(spark):
    """Tracks longer and shorter than a batch, against a plain search in each; no Python call for a track."""
    import numpy as np

    from sightline.operators import irrational as I

    rng, rows = np.random.default_rng(3), []
    for track, n in enumerate([1, 3, 90, 250, 40, 2, 7, 130]):
        x, y = np.cumsum(rng.normal(0, 30, n)), np.cumsum(rng.normal(0, 30, n))
        rows += [(1, track, 0, f, float(x[f]), float(y[f]), 20.0) for f in range(n)]
    cfg = I.Irrational(oscillation_excursion_bh=0.8)
    k = spark.createDataFrame(rows, "run_id bigint, tracklet_id bigint, segment_run bigint, frame_no int, x double, y double, body double").repartition(3, "frame_no")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 32)
    try:
        found = I.oscillation(k, 2.0, cfg)
        got = {(r.tracklet_id, r.frame_no): r.reversals for r in found.collect()}
        assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, back = {}, int(cfg.oscillation_window_s * 2)
    for track in {r[1] for r in rows}:
        x, y, body = np.array([r[4:] for r in rows if r[1] == track]).T
        turns = I._turns(x, y, body, cfg.oscillation_excursion_bh)
        for f in range(len(x)):
            n = sum(f - back <= t <= f for t in turns)
            if n >= cfg.oscillation_reversals:
                want[track, f] = n
    assert got == want and len(want) > 10


@pytest.mark.parametrize("name", ["hazard_hold", "hold_spans", "mot_fara_events", "export_events"])
def test_tasks_hold_a_bounded_number_of_events(spark, monkeypatch, name):
    """Tasks are dealt by rows, which an adaptive plan does not join again for their few bytes, and nothing is dealt a second time."""
    from sightline.sources import adapter as A

    monkeypatch.setattr(A, "TASK_EVENTS", 50)
    same_as_sql(spark, SF, name, "events")
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert A.parts(spark, SF) == n / 50 > 10
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all(f", {n // 50})" in line for line in dealt if "user_id" in line)
    if name.startswith("h"):
        assert all("user_id" in line for line in dealt)


def test_settings_are_flattened_in_one_pass(spark):
    """However deep they are: each text is read and parsed once, and its places are those of a plain search."""
    import json

    from sightline.functions import canonical as C

    texts = {1: {"a": {"b": [[1, {"c": None, "": "{["}], [], {}]}, "d": 0.5}, 2: [], 3: None, 4: [None, {"x": {"y": {"z": [True]}}}], 5: 'q"[[[['}
    d = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()] + [(6, "[[["), (7, None)], "k int, s string")
    found = C.flattened(d, ["k"], "s")

    def places(v, path=""):
        inner = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        return [p for k, x in inner for p in places(x, f"{path}.{k}" if path else str(k))] if v and inner else [(path, v)]

    assert sorted((r.k, r.path, r.value) for r in found.collect()) == sorted((k, p, json.dumps(x, separators=(",", ":"))) for k, v in texts.items() for p, x in places(v))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan


def test_token_groups_are_small():
    """What an encoder holds at once is bounded by a group of 6 MB of texts."""
    import pyarrow as pa
    import public_tokenizers
    from sightline.llm.token_files import LibraryEncoder

    texts = pa.array(["some words and more of them, " * 35_000] * 20)
    code = LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    groups = [n for _, n in code.encode(texts)]
    assert sum(map(len, groups)) == 20 and max(map(len, groups)) <= 6
    assert len({int(x) for n in groups for x in n}) == 1


class Store:
    """Stands for a state, its timers and how often it was written."""

    def __init__(self):
        self.rows, self.writes, self.timers = None, 0, []

    def getListState(self, name, schema):
        return self if name == "waiting" else Store()

    def getValueState(self, name, schema):
        return Store()

    def exists(self):
        return self.rows is not None

    def get(self):
        return self.rows

    def appendValue(self, row):
        self.rows, self.writes = [*(self.rows or []), row], self.writes + 1

    def appendList(self, rows):
        self.rows, self.writes = [*(self.rows or []), *rows], self.writes + len(rows)

    def update(self, row):
        self.rows = row

    put = update

    def clear(self):
        self.rows = None

    def registerTimer(self, at):
        self.timers.append(at)

    deleteTimer = registerTimer


def test_waiting_rows_of_a_call_are_one_value():
    """Rows of a call wait as one value, and come in order with nulls and arrays as they were."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.types import StructType

    from sightline.streaming.ordered import Ordered

    class Seen(Ordered):
        columns, order, key, output = ("ts_ms", "look", "present"), ("present",), "k", StructType().add("k", "long").add("seen", "string")

        def take(self, row):
            return [(repr(row),)]

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 1_000

    store, seen = Store(), Seen()
    seen.init(store)
    part = pd.DataFrame({"k": 1, "ts_ms": [5 + 10 * i for i in range(200)], "look": [np.array([0.1, i]) if i % 2 else None for i in range(200)], "present": [i % 3 == 0 for i in range(200)]})
    assert list(seen.handleInputRows((1,), iter([part[100:], part[:100]]), None)) == []
    assert store.writes == 1 and store.timers == [5]
    (out,) = seen.handleExpiredTimer((1,), Clock(), None)
    assert out.seen.tolist() == [repr({"ts_ms": 5 + 10 * i, "look": [0.1, float(i)] if i % 2 else None, "present": i % 3 == 0}) for i in range(100)]
    assert store.timers == [5, 1005]  # the others wait for their time


def test_signals_that_share_a_state_are_held_alone(spark, tmp_path):
    """Many signals of one key, with ends by timers, against the same by windows."""
    from sightline.streaming import live, persons

    rows = [(i % 2, f"s{i}", (t * (i + 3)) % 7 < 4 + i % 3, 86_400_000 + 500 * t) for i in range(6) for t in range(60)]
    df = spark.createDataFrame(rows, "run_id bigint, signal string, present boolean, ts_ms bigint").withColumn("ts", F.timestamp_millis("ts_ms"))
    df.write.parquet(f"{tmp_path}/in/1")
    df.limit(1).select("run_id", F.lit("z").alias("signal"), F.lit(False).alias("present"), F.lit(2**50).alias("ts_ms"), F.timestamp_millis(F.lit(10**10)).alias("ts")).write.parquet(f"{tmp_path}/in/2")
    stream = live.open_stream(spark, f"{tmp_path}/in/*", df.schema, 8)
    got = live.run_to_end(persons.held_signals(stream, 1.0, 4.0, "1 hour", "run_id"), f"{tmp_path}/out", f"{tmp_path}/state")
    want = persons.held_spans(df, 1.0, 4.0).select("signal", "event", "since_ms", "at_ms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_tracklets_that_share_a_state_alert_alone(spark, tmp_path):
    """Stillness of a video's tracklets in one state, as of each in its own, and over two batches."""
    from sightline.streaming import live

    rows = [(t // 3, t, f, float(f * (t % 2 if f < 30 else 0) * 9), 5.0, 2.0, 86_400_000 + 500 * f) for t in range(9) for f in range(60)]
    df = spark.createDataFrame(rows, "run_id bigint, tracklet_id bigint, frame_no int, x double, y double, body double, at bigint").withColumn("ts", F.timestamp_millis("at")).drop("at")
    got = {}
    for by in ("tracklet_id", "run_id"):
        root = f"{tmp_path}/{by}"
        df.filter("frame_no < 35").coalesce(1).write.parquet(f"{root}/in/1")
        df.filter("frame_no >= 35").coalesce(1).write.parquet(f"{root}/in/2")
        out = live.run_to_end(live.still_alerts(live.open_stream(spark, f"{root}/in/*", df.schema), 2.0, by=by), f"{root}/out", f"{root}/state")
        got[by] = sorted(map(tuple, out.collect()))
    assert got["run_id"] == got["tracklet_id"] and {r[0] for r in got["run_id"]} == set(range(9))


def test_behaviour_looks_at_its_rows_once(spark):
    from sightline.plans import catalog

    plan = lambda name: catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("status_timeline").count("Relation [") == 1
    # The log reads behaviour's events, and not once more what they are made of.
    assert "now_speed" in plan("still_events") and "now_speed" not in plan("event_log")
