"""Constructed trajectories: each signal fires where it must, and nowhere else."""

import math

import pytest
from pyspark.sql import functions as F

from sightline.operators import behavior as B
from sightline.operators import hazard as H
from sightline.operators import heatmap as M
from sightline.operators import irrational as I

SCHEMA = "run_id bigint, tracklet_id bigint, frame_no int, det_id bigint, cls string, conf double, x0 double, y0 double, x1 double, y1 double, scene_segment int"
FPS = 10.0


def track(tid, points, segment=lambda f: 0, run=1, skip=0):
    return [(run, tid, f, tid * 10_000 + f, "person", 0.9, x - 15.0, y - 80.0, x + 15.0, float(y), segment(f)) for f, (x, y) in enumerate(points) if f >= skip]


def frame(spark, *tracks):
    return spark.createDataFrame([r for t in tracks for r in t], SCHEMA)


def events(df, cfg=B.Behavior(), danger=None):
    return B.behavior_events(B.status_timeline(df, FPS, cfg, danger), FPS, cfg).collect()


def test_still_person_gives_one_event(spark):
    got = events(frame(spark, track(1, [(115, 180)] * 100)))
    assert [e.category for e in got] == ["STILLA"]
    assert got[0].frame_end == 99 and got[0].event_id == "stilla-000000"


def test_brief_pause_gives_none(spark):
    assert events(frame(spark, track(1, [(5 * f, 180) for f in range(40)] + [(200, 180)] * 10))) == []


def test_motion_toward_a_danger_point(spark):
    t = frame(spark, track(1, [(8 * f, 180) for f in range(80)]))
    assert {e.category for e in events(t, danger=(2000.0, 180.0))} == {"MOT_FARA"}
    assert events(t) == []
    assert events(t, danger=(-2000.0, 180.0)) == []


def test_segment_change_resets_history(spark):
    t = frame(spark, track(1, [(115, 180)] * 100, segment=lambda f: f // 50))
    assert events(t) == []


def test_event_ends_before_the_next_row(spark):
    t = frame(spark, [r for r in track(1, [(115, 180)] * 100 + [(115 + 30 * f, 180) for f in range(60)]) if not 100 <= r[2] < 110])
    got = events(t)
    assert len(got) == 1 and got[0].frame_end >= 109


@pytest.mark.parametrize("name", ["erratic", "sprint", "counterflow", "oscillation", "freeze_bolt"])
def test_signals_fire_and_hold_their_fire(spark, name):
    circle = [(300 + 15 * math.cos(1.5 * f), 300 + 15 * math.sin(1.5 * f)) for f in range(150)]
    line = [(5 * f, 300) for f in range(150)]
    zigzag = [(300 + (400 if (f // 15) % 2 else -400) * ((f % 15) / 15) * (1 if (f // 15) % 2 else -1) * 1.0, 300) for f in range(300)]
    fires = {
        "erratic": [track(1, circle)],
        "sprint": [track(1, [(25 * f, 300) for f in range(60)]), track(2, [(900, 300)] * 60), track(3, [(800, 300)] * 60)],
        "counterflow": [track(1, [(600 - 5 * f, 300) for f in range(60)]), *(track(k, [(300 + 5 * f, 300 + 10 * k) for f in range(60)]) for k in (2, 3, 4, 5))],
        "oscillation": [track(1, zigzag)],
        "freeze_bolt": [track(1, [(300, 300)] * 50 + [(300 + 30 * f, 300) for f in range(1, 20)])],
    }
    rests = {
        "erratic": [track(1, line)],
        "sprint": [track(k, [(25 * f, 300 + 10 * k) for f in range(60)]) for k in (1, 2, 3)],
        "counterflow": [track(1, [(600 - 5 * f, 300) for f in range(60)]), track(2, [(300 + 5 * f, 310) for f in range(60)])],
        "oscillation": [track(1, line)],
        "freeze_bolt": [track(1, [(300, 300)] * 20 + [(300 + 30 * f, 300) for f in range(1, 20)])],
    }
    run = getattr(I, name)
    fired = run(B.kinematics(frame(spark, *fires[name]), FPS), FPS)
    assert {r.tracklet_id for r in fired.select("tracklet_id").distinct().collect()} == {1}
    assert run(B.kinematics(frame(spark, *rests[name]), FPS), FPS).count() == 0


def test_results_do_not_depend_on_partitioning(spark):
    t = frame(spark, track(1, [(115, 180)] * 100), track(2, [(8 * f, 180) for f in range(80)]))
    assert sorted(events(t, danger=(2000.0, 180.0))) == sorted(events(t.repartition(7).orderBy(F.desc("det_id")), danger=(2000.0, 180.0)))


def test_hazard_spans(spark):
    rows = [(1, f, "fire", 10 <= f < 20, 0.02) for f in range(30)] + [(1, f, "smoke", f >= 25, 0.01) for f in range(30)]
    got = H.hazard_events(spark.createDataFrame(rows, "stream_id bigint, frame_no int, kind string, present boolean, area double"), FPS).orderBy("event_id").collect()
    assert [(e.kind, e.frame_start, e.frame_end, e.t_end) for e in got] == [("fire", 10, 19, 2.0), ("smoke", 25, 29, 3.0)]


def test_heatmap_cell_and_clamp(spark):
    ten = frame(spark, track(1, [(100, 200)] * 10))
    assert [(c.gx, c.gy, c.seconds) for c in M.raw_heatmap(ten, FPS, 1000, 500, 10).collect()] == [(1, 2, 1.0)]
    outside = frame(spark, track(1, [(-100, 9000)] * 10))
    assert [(c.gx, c.gy) for c in M.raw_heatmap(outside, FPS, 1000, 500, 10).collect()] == [(0, 4)]
