"""Queries over tracklets: motion, behaviour, irrational movement, hazards, heatmaps, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import behavior as B
from ..operators import grid as GR
from ..operators import hazard as H
from ..operators import heatmap as M
from ..operators import irrational as I
from ..operators import motion as O
from ..sources import adapter as A
from .registry import query

FPS = A.FPS
DANGER = (40.0, 40.0)
#: Looser thresholds than the defaults, so that the sample tracklets fire each signal.
IRR = I.Irrational(sprint_speed=0.5, sprint_time_s=0.5, sprint_multiple=1.5, counterflow_angle=90.0, counterflow_time_s=0.5, counterflow_neighbors=2, counterflow_coherence=0.3, oscillation_excursion_bh=0.8, freeze_speed=0.6, freeze_time_s=1.0, bolt_speed=0.7, bolt_within_s=2.0, sustain_s=1.5)
BEH = B.Behavior(toward_speed=0.05, toward_time_s=0.5)

POS_SQL = """
pos0 AS (
  SELECT *, (x0 + x1) / 2 AS x, y1 AS y, greatest(y1 - y0, 1.0) AS body,
         greatest((x1 - x0) / greatest(y1 - y0, 1.0), 0.0) AS aspect,
         lag(scene_segment) OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no) AS seg_before
  FROM tracklets
), pos AS (
  SELECT *, sum(CASE WHEN seg_before IS NOT NULL AND seg_before <> scene_segment THEN 1 ELSE 0 END)
            OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no)::BIGINT AS segment_run
  FROM pos0
)"""
KIN_SQL = f"""
kin0 AS (
  SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, (frame_no - lag(frame_no) OVER w) / {FPS} AS dt,
         greatest((body + lag(body) OVER w) / 2, 1.0) AS mean_body
  FROM pos WINDOW w AS (PARTITION BY run_id, tracklet_id, segment_run ORDER BY frame_no)
), kin AS (
  SELECT *, sqrt(dx * dx + dy * dy) AS dist,
         CASE WHEN dt > 0 THEN sqrt(dx * dx + dy * dy) / dt / mean_body ELSE 0.0 END AS speed,
         CASE WHEN dt > 0 AND sqrt(dx * dx + dy * dy) > 1e-6 THEN ((degrees(atan2(dy, dx)) % 360) + 360) % 360 END AS heading
  FROM kin0
)"""
WITH = f"WITH RECURSIVE {A.TRACKLETS_SQL}, {POS_SQL}, {KIN_SQL}"


def kinematics(spark, sf_dir):
    return B.kinematics(A.tracklets(spark, sf_dir), FPS)


@query(f"WITH {A.TRACKLETS_SQL} SELECT * FROM tracklets")
def tracklets_adapter(spark, sf_dir):
    return A.tracklets(spark, sf_dir)


@query(f"{WITH} SELECT run_id, tracklet_id, frame_no, round(speed, 6) AS speed, round(heading, 6) AS heading FROM kin", "kinematics")
def kinematics_query(spark, sf_dir):
    return kinematics(spark, sf_dir).select("run_id", "tracklet_id", "frame_no", F.round("speed", 6).alias("speed"), F.round("heading", 6).alias("heading"))


@query(f"WITH {A.TRACKLETS_SQL} SELECT run_id, tracklet_id, min(frame_no) AS first_frame, max(frame_no) AS last_frame, min(frame_no) / {FPS} AS first_s, max(frame_no) / {FPS} AS last_s FROM tracklets GROUP BY run_id, tracklet_id")
def tracklet_spans(spark, sf_dir):
    t = A.tracklets(spark, sf_dir).groupBy("run_id", "tracklet_id").agg(F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"))
    return t.withColumn("first_s", F.col("first_frame") / FPS).withColumn("last_s", F.col("last_frame") / FPS)


def status_sql(cfg: B.Behavior, danger) -> str:
    toward = "false"
    if danger:
        dx, dy = f"({danger[0]} - x)", f"({danger[1]} - y)"
        toward = f"coalesce(n >= 4 AND now_speed > {cfg.toward_speed} AND moved > 1e-6 AND sqrt({dx}*{dx} + {dy}*{dy}) > 1.0 AND (mx * {dx} + my * {dy}) / moved / sqrt({dx}*{dx} + {dy}*{dy}) > cos(radians({cfg.toward_angle_deg})), false)"
    return f"""
win AS (
  SELECT run_id, tracklet_id, segment_run, frame_no, x, y,
         list({{'f': frame_no, 'x': x, 'y': y, 'b': body, 'a': aspect}}) OVER (PARTITION BY run_id, tracklet_id, segment_run ORDER BY frame_no RANGE BETWEEN {int(cfg.window_s * FPS)} PRECEDING AND CURRENT ROW) AS h
  FROM pos
), mid AS (
  SELECT *, len(h) AS n, (frame_no - h[1].f) / {FPS} >= {cfg.min_history_s} AS evaluated,
         CASE WHEN (frame_no - h[len(h) // 2 + 1].f) / {FPS} < 0.5 THEN h[1] ELSE h[len(h) // 2 + 1] END AS m
  FROM win
), mot AS (
  SELECT *, x - m.x AS mx, y - m.y AS my, sqrt((x - m.x) * (x - m.x) + (y - m.y) * (y - m.y)) AS moved, (frame_no - m.f) / {FPS} AS mdt FROM mid
), spd AS (
  SELECT *, CASE WHEN evaluated THEN CASE WHEN n >= 4 AND mdt > 0 THEN moved / mdt / greatest(list_sort(list_transform(h, lambda s: s.b))[n // 2 + 1], 1.0) ELSE 0.0 END END AS now_speed,
         evaluated AND list_sort(list_transform(h, lambda s: s.a))[n // 2 + 1] > {cfg.prone_aspect} AS prone
  FROM mot
), kept AS (
  SELECT *, coalesce(last_value(now_speed IGNORE NULLS) OVER (PARTITION BY run_id, tracklet_id, segment_run ORDER BY frame_no), 0.0) AS speed,
         coalesce(now_speed < {cfg.still_speed}, false) AS is_still, {toward} AS is_toward
  FROM spd
), isl AS (
  SELECT *, sum(CASE WHEN is_still THEN 0 ELSE 1 END) OVER w AS si, sum(CASE WHEN is_toward THEN 0 ELSE 1 END) OVER w AS ti
  FROM kept WHERE evaluated WINDOW w AS (PARTITION BY run_id, tracklet_id, segment_run ORDER BY frame_no)
), since AS (
  SELECT *, min(CASE WHEN is_still THEN frame_no END) OVER (PARTITION BY run_id, tracklet_id, segment_run, si) AS s0,
            min(CASE WHEN is_toward THEN frame_no END) OVER (PARTITION BY run_id, tracklet_id, segment_run, ti) AS t0
  FROM isl
), timeline AS (
  SELECT run_id, tracklet_id, frame_no, CASE WHEN is_still AND (frame_no - s0) / {FPS} >= {cfg.still_time_s} THEN 'still' WHEN is_toward AND (frame_no - t0) / {FPS} >= {cfg.toward_time_s} THEN 'toward_danger' ELSE 'ok' END AS status, prone, speed FROM since
  UNION ALL SELECT run_id, tracklet_id, frame_no, 'ok', false, speed FROM kept WHERE NOT evaluated
), chg AS (
  SELECT *, CASE WHEN status <> lag(status) OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no) THEN 1 ELSE 0 END AS c FROM timeline
), num AS (
  SELECT *, sum(c) OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no) AS island FROM chg
), runs AS (
  SELECT run_id, tracklet_id, island, any_value(status) AS status, min(frame_no) AS frame_start, max(frame_no) AS last_row, avg(speed) AS avg_speed,
         sum(prone::INT) > count(*) / 2 AS prone_majority, count(*) AS samples
  FROM num GROUP BY run_id, tracklet_id, island
), ended AS (
  SELECT *, coalesce(lead(frame_start) OVER (PARTITION BY run_id, tracklet_id ORDER BY island) - 1, last_row)::INT AS frame_end FROM runs
), picked AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tracklet_id, frame_start) - 1 AS seq, CASE status WHEN 'still' THEN 'STILLA' ELSE 'MOT_FARA' END AS category,
         CASE status WHEN 'still' THEN {cfg.still_time_s} ELSE {cfg.toward_time_s} END AS thr, (frame_end - frame_start + 1) / {FPS} AS duration_s
  FROM ended WHERE status <> 'ok'
), behavior AS (
  SELECT run_id, printf('%s-%06d', lower(category), seq) AS event_id, category, tracklet_id, frame_start, frame_end, frame_start / {FPS} AS t_start, frame_end / {FPS} AS t_end,
         duration_s, least(1.0, duration_s / thr / 2 + 0.3) AS confidence, round(avg_speed, 4) AS avg_speed, prone_majority, samples
  FROM picked
)"""


BEHAVIOR_SQL = f"{WITH}, {status_sql(B.Behavior(), None)}"
DANGER_SQL = f"{WITH}, {status_sql(BEH, DANGER)}"


def behavior(spark, sf_dir, cfg=B.Behavior(), danger=None):
    return B.behavior_events(B.status_timeline(A.tracklets(spark, sf_dir), FPS, cfg, danger), FPS, cfg)


@query(f"{DANGER_SQL} SELECT run_id, tracklet_id, frame_no, status, prone, round(speed, 6) AS speed FROM timeline")
def status_timeline(spark, sf_dir):
    return B.status_timeline(A.tracklets(spark, sf_dir), FPS, BEH, DANGER).withColumn("speed", F.round("speed", 6))


@query(f"{BEHAVIOR_SQL} SELECT * FROM behavior WHERE category = 'STILLA'")
def still_events(spark, sf_dir):
    return behavior(spark, sf_dir).filter("category = 'STILLA'")


@query(f"{DANGER_SQL} SELECT * FROM behavior WHERE category = 'MOT_FARA'")
def mot_fara_events(spark, sf_dir):
    return behavior(spark, sf_dir, BEH, DANGER).filter("category = 'MOT_FARA'")


@query(f"{DANGER_SQL} SELECT run_id, category, count(*) AS events FROM behavior GROUP BY run_id, category")
def events_by_category(spark, sf_dir):
    return behavior(spark, sf_dir, BEH, DANGER).groupBy("run_id", "category").agg(F.count(F.lit(1)).alias("events"))


def neighbours_sql(cfg: I.Irrational) -> str:
    return f"""
met AS (
  SELECT k.run_id, k.tracklet_id, k.frame_no, o.speed AS os, o.heading AS oh, sqrt((o.x - k.x) * (o.x - k.x) + (o.y - k.y) * (o.y - k.y)) <= {cfg.counterflow_radius_bh} * greatest(k.body, 1.0) AND o.heading IS NOT NULL AS near
  FROM kin k JOIN kin o ON o.run_id = k.run_id AND o.frame_no = k.frame_no AND o.tracklet_id <> k.tracklet_id
), summed AS (
  SELECT run_id, tracklet_id, frame_no, list_sort(list(os))[count(*) // 2 + 1] AS group_speed, count(*) FILTER (near) AS near,
         sum(sin(radians(oh))) FILTER (near) AS s, sum(cos(radians(oh))) FILTER (near) AS c
  FROM met GROUP BY run_id, tracklet_id, frame_no
), around AS (
  SELECT *, CASE WHEN near > 0 THEN sqrt(s * s + c * c) / near ELSE 1.0 END AS coherence, CASE WHEN abs(s) >= 1e-9 OR abs(c) >= 1e-9 THEN ((degrees(atan2(s, c)) % 360) + 360) % 360 END AS flow FROM summed
), joined AS (
  SELECT k.*, a.group_speed, a.near, a.coherence, a.flow, abs(k.heading - a.flow) % 360 AS d FROM kin k LEFT JOIN around a USING (run_id, tracklet_id, frame_no)
), flags AS (
  SELECT *, CASE WHEN d <= 180 THEN d ELSE 360 - d END AS angle,
         coalesce(speed > {cfg.sprint_speed} AND speed > {cfg.sprint_multiple} * group_speed, false) AS fast,
         coalesce(near >= {cfg.counterflow_neighbors} AND coherence > {cfg.counterflow_coherence} AND CASE WHEN d <= 180 THEN d ELSE 360 - d END > {cfg.counterflow_angle}, false) AS against
  FROM joined
), fisl AS (
  SELECT *, sum(CASE WHEN fast THEN 0 ELSE 1 END) OVER w AS fi, sum(CASE WHEN against THEN 0 ELSE 1 END) OVER w AS ai FROM flags WINDOW w AS (PARTITION BY run_id, tracklet_id, segment_run ORDER BY frame_no)
), fsince AS (
  SELECT *, min(CASE WHEN fast THEN frame_no END) OVER (PARTITION BY run_id, tracklet_id, segment_run, fi) AS f0, min(CASE WHEN against THEN frame_no END) OVER (PARTITION BY run_id, tracklet_id, segment_run, ai) AS a0 FROM fisl
), sprint AS (
  SELECT run_id, tracklet_id, segment_run, frame_no, speed, group_speed, (frame_no - f0) / {FPS} AS duration_s FROM fsince WHERE fast AND (frame_no - f0) / {FPS} >= {cfg.sprint_time_s}
), counterflow AS (
  SELECT run_id, tracklet_id, segment_run, frame_no, angle, flow, coherence, near, (frame_no - a0) / {FPS} AS duration_s FROM fsince WHERE against AND (frame_no - a0) / {FPS} >= {cfg.counterflow_time_s}
)"""


def erratic_sql(cfg: I.Irrational) -> str:
    return f"""
estep AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY run_id, tracklet_id, segment_run ORDER BY frame_no) = 1 THEN 0.0 ELSE dist / mean_body END AS st FROM kin
), ewin AS (
  SELECT *, sum(st) OVER w AS steps, count(*) OVER w AS n, avg(speed) OVER w AS mean_speed, first_value(frame_no) OVER w AS f0, first_value(x) OVER w AS x00, first_value(y) OVER w AS y00, first_value(st) OVER w AS st0,
         sum(sin(radians(heading))) OVER w AS s, sum(cos(radians(heading))) OVER w AS c, count(heading) OVER w AS hn, list(body) OVER w AS bodies
  FROM estep WINDOW w AS (PARTITION BY run_id, tracklet_id, segment_run ORDER BY frame_no RANGE BETWEEN {int(cfg.erratic_window_s * FPS)} PRECEDING AND CURRENT ROW)
), emea AS (
  SELECT *, (steps - st0) / greatest(sqrt((x - x00) * (x - x00) + (y - y00) * (y - y00)) / greatest(list_sort(bodies)[n // 2 + 1], 1.0), 1e-6) AS tortuosity,
         CASE WHEN hn >= 3 THEN 1 - sqrt(s * s + c * c) / hn ELSE 0.0 END AS circ_var, (frame_no - f0) / {FPS} AS span_s
  FROM ewin
), erratic AS (
  SELECT run_id, tracklet_id, segment_run, frame_no, tortuosity, mean_speed, circ_var, span_s FROM emea
  WHERE n >= 4 AND span_s >= {cfg.erratic_window_s / 2} AND ((tortuosity > {cfg.erratic_tortuosity} AND mean_speed > {cfg.erratic_min_speed}) OR circ_var > {cfg.erratic_circ_var})
)"""


def sequential_sql(cfg: I.Irrational) -> str:
    """Oscillation by legs, each of which ends at its first row that has come back far enough; freeze and bolt by
    islands of still rows, the first fast row behind each, and the last bolt before each row."""
    same = lambda a, b: f"{a}.run_id = {b}.run_id AND {a}.tracklet_id = {b}.tracklet_id AND {a}.segment_run = {b}.segment_run"
    return f"""
ordered AS MATERIALIZED (
  SELECT run_id, tracklet_id, segment_run, frame_no, frame_no / {FPS} AS t, x, y, greatest(body, 1.0) AS body, speed,
         row_number() OVER (PARTITION BY run_id, tracklet_id, segment_run ORDER BY frame_no) AS i FROM kin
), legs AS (
  SELECT run_id, tracklet_id, segment_run, i AS origin, i AS start, 0.0::DOUBLE AS reach FROM ordered WHERE i = 1
  UNION ALL
  SELECT run_id, tracklet_id, segment_run, far, i, back FROM (
    SELECT m.*, sqrt((m.x - f.x) ** 2 + (m.y - f.y) ** 2) / m.body AS back, row_number() OVER (PARTITION BY m.run_id, m.tracklet_id, m.segment_run ORDER BY m.i) AS nth
    FROM (SELECT *, coalesce(max(CASE WHEN record THEN i END) OVER (PARTITION BY run_id, tracklet_id, segment_run ORDER BY i), start) AS far
          FROM (SELECT *, away > greatest(reach, coalesce(max(away) OVER (PARTITION BY run_id, tracklet_id, segment_run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS record
                FROM (SELECT r.*, l.start, l.reach, sqrt((r.x - o.x) ** 2 + (r.y - o.y) ** 2) / r.body AS away
                      FROM legs l JOIN ordered o ON {same("o", "l")} AND o.i = l.origin JOIN ordered r ON {same("r", "l")} AND r.i > l.start))) m
    JOIN ordered f ON {same("f", "m")} AND f.i = m.far
    WHERE NOT m.record AND sqrt((m.x - f.x) ** 2 + (m.y - f.y) ** 2) / m.body >= {cfg.oscillation_excursion_bh}
  ) WHERE nth = 1
), oscillation AS (
  SELECT o.run_id, o.tracklet_id, o.segment_run, o.frame_no, count(*)::INT AS reversals
  FROM ordered o JOIN legs l ON {same("l", "o")} AND l.start > 1 AND l.start <= o.i JOIN ordered p ON {same("p", "l")} AND p.i = l.start AND o.t - p.t <= {cfg.oscillation_window_s}
  GROUP BY o.run_id, o.tracklet_id, o.segment_run, o.frame_no HAVING count(*) >= {cfg.oscillation_reversals}
), stops AS (
  SELECT run_id, tracklet_id, segment_run, max(t) AS stop, max(t) - min(t) AS freeze_s
  FROM (SELECT *, i - row_number() OVER (PARTITION BY run_id, tracklet_id, segment_run ORDER BY i) AS island FROM ordered WHERE speed < {cfg.freeze_speed})
  GROUP BY run_id, tracklet_id, segment_run, island HAVING max(t) - min(t) >= {cfg.freeze_time_s}
), bolts AS (
  SELECT run_id, tracklet_id, segment_run, stop, min(t) AS t, any_value(freeze_s) AS freeze_s, arg_min(speed, t) AS bolt_speed
  FROM (SELECT o.*, s.stop, s.freeze_s FROM (SELECT * FROM ordered WHERE speed >= {cfg.freeze_speed} AND speed > {cfg.bolt_speed}) o ASOF JOIN stops s ON {same("s", "o")} AND s.stop < o.t)
  WHERE t - stop <= {cfg.bolt_within_s} GROUP BY run_id, tracklet_id, segment_run, stop
), freeze_bolt AS (
  SELECT o.run_id, o.tracklet_id, o.segment_run, o.frame_no, b.freeze_s, b.bolt_speed
  FROM ordered o ASOF JOIN bolts b ON {same("b", "o")} AND b.t <= o.t WHERE o.t <= b.t + {cfg.bolt_hold_s}
)"""


ALL_SQL = f"{WITH}, {neighbours_sql(IRR)}, {erratic_sql(IRR)}, {sequential_sql(IRR)}"


def rounded(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(f"{WITH}, {erratic_sql(IRR)} SELECT run_id, tracklet_id, segment_run, frame_no, round(mean_speed, 6) AS mean_speed, round(circ_var, 6) AS circ_var, span_s FROM erratic")
def erratic_frames(spark, sf_dir):
    return rounded(I.erratic(kinematics(spark, sf_dir), FPS, IRR), "mean_speed", "circ_var").drop("tortuosity")


@query(f"{WITH}, {neighbours_sql(IRR)} SELECT run_id, tracklet_id, segment_run, frame_no, round(speed, 6) AS speed, round(group_speed, 6) AS group_speed, duration_s FROM sprint")
def sprint_frames(spark, sf_dir):
    return rounded(I.sprint(kinematics(spark, sf_dir), FPS, IRR), "speed", "group_speed")


@query(f"{WITH}, {neighbours_sql(IRR)} SELECT run_id, tracklet_id, segment_run, frame_no, round(angle, 6) AS angle, round(flow, 6) AS flow, round(coherence, 6) AS coherence, near, duration_s FROM counterflow")
def counterflow_frames(spark, sf_dir):
    return rounded(I.counterflow(kinematics(spark, sf_dir), FPS, IRR), "angle", "flow", "coherence")


@query(f"{WITH}, {sequential_sql(IRR)} SELECT * FROM oscillation")
def oscillation_frames(spark, sf_dir):
    return I.oscillation(kinematics(spark, sf_dir), FPS, IRR)


@query(f"{WITH}, {sequential_sql(IRR)} SELECT run_id, tracklet_id, segment_run, frame_no, round(freeze_s, 6) AS freeze_s, round(bolt_speed, 6) AS bolt_speed FROM freeze_bolt")
def freeze_bolt_frames(spark, sf_dir):
    return rounded(I.freeze_bolt(kinematics(spark, sf_dir), FPS, IRR), "freeze_s", "bolt_speed")


IRRATIONAL_CTES = f"""{ALL_SQL}, {status_sql(B.Behavior(), None)},
scored AS (
  SELECT k.run_id, k.tracklet_id, k.segment_run, k.frame_no, c.angle IS NOT NULL AS counterflow, e.span_s IS NOT NULL AS erratic, s.speed IS NOT NULL AS sprint, o.reversals IS NOT NULL AS oscillation, f.freeze_s IS NOT NULL AS freeze_bolt
  FROM kin k LEFT JOIN counterflow c USING (run_id, tracklet_id, segment_run, frame_no) LEFT JOIN erratic e USING (run_id, tracklet_id, segment_run, frame_no)
  LEFT JOIN sprint s USING (run_id, tracklet_id, segment_run, frame_no) LEFT JOIN oscillation o USING (run_id, tracklet_id, segment_run, frame_no) LEFT JOIN freeze_bolt f USING (run_id, tracklet_id, segment_run, frame_no)
), points AS (
  SELECT *, counterflow::INT + erratic::INT + sprint::INT + oscillation::INT + freeze_bolt::INT AS score FROM scored
), pisl AS (
  SELECT *, sum(CASE WHEN score >= {IRR.score} THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, tracklet_id, segment_run ORDER BY frame_no) AS pi FROM points
), psince AS (
  SELECT *, min(CASE WHEN score >= {IRR.score} THEN frame_no END) OVER (PARTITION BY run_id, tracklet_id, segment_run, pi) AS p0 FROM pisl
), fired AS (
  SELECT p.*, score >= {IRR.score} AND (frame_no - p0) / {FPS} >= {IRR.sustain_s} AND NOT EXISTS (SELECT 1 FROM behavior b WHERE b.category = 'STILLA' AND b.run_id = p.run_id AND b.tracklet_id = p.tracklet_id AND p.frame_no BETWEEN b.frame_start AND b.frame_end) AS fired FROM psince p
), fchg AS (
  SELECT *, CASE WHEN fired <> lag(fired) OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no) THEN 1 ELSE 0 END AS c FROM fired
), fnum AS (
  SELECT *, sum(c) OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no) AS island FROM fchg
), fruns AS (
  SELECT run_id, tracklet_id, island, any_value(fired) AS fired, min(frame_no) AS frame_start, max(frame_no) AS last_row, max(score) AS top, bool_or(counterflow) AS counterflow, bool_or(erratic) AS erratic, bool_or(sprint) AS sprint, bool_or(oscillation) AS oscillation, bool_or(freeze_bolt) AS freeze_bolt
  FROM fnum GROUP BY run_id, tracklet_id, island
), fended AS (
  SELECT *, coalesce(lead(frame_start) OVER (PARTITION BY run_id, tracklet_id ORDER BY island) - 1, last_row)::INT AS frame_end FROM fruns
), quality AS (
  SELECT run_id, tracklet_id, (least(1.0, (max(frame_no) - min(frame_no) + 1) / {FPS} / 10) + count(*) / (max(frame_no) - min(frame_no) + 1) + 0.7) / 3 AS quality FROM kin GROUP BY run_id, tracklet_id
)"""

def irrational_sql(person: str = "", stable: str = "0.7") -> str:
    """The events; ``person``: a column more, ``stable``: what stability counts."""
    return f"""SELECT f.run_id, printf('irrationell-%06d', row_number() OVER (PARTITION BY f.run_id ORDER BY f.tracklet_id, frame_start) - 1) AS event_id, 'IRRATIONELL' AS category, f.tracklet_id, frame_start, frame_end,
       frame_start / {FPS} AS t_start, (frame_end + 1) / {FPS} AS t_end, round(least(1.0, 0.3 + 0.7 * greatest(0.0, least(1.0, (top - {IRR.score}) / {IRR.score})) * (quality + ({stable} - 0.7) / 3)), 6) AS confidence,
       concat_ws(' + ', CASE WHEN counterflow THEN 'counter-flow' END, CASE WHEN erratic THEN 'erratic' END, CASE WHEN sprint THEN 'panic-sprint' END, CASE WHEN oscillation THEN 'oscillation' END, CASE WHEN freeze_bolt THEN 'freeze-and-bolt' END) AS summary{person}
FROM fended f JOIN quality q ON q.run_id = f.run_id AND q.tracklet_id = f.tracklet_id WHERE fired"""


IRRATIONAL_SQL = f"{IRRATIONAL_CTES}, irr AS ({irrational_sql()})"


@query(f"{IRRATIONAL_SQL} SELECT * FROM irr")
def irrational_events(spark, sf_dir):
    return irrational_beside(spark, sf_dir, behavior(spark, sf_dir))


@query(f"""{IRRATIONAL_CTES}, irr AS ({irrational_sql(", CASE WHEN f.tracklet_id % 4 <> 0 THEN f.tracklet_id // 3 END AS person_id", "CASE WHEN f.tracklet_id % 4 <> 0 THEN 1.0 ELSE 0.7 END")}) SELECT * FROM irr""")
def irrational_persons(spark, sf_dir):
    """The same with persons for most tracklets, which count as stable then."""
    k = kinematics(spark, sf_dir)
    persons = k.select("run_id", "tracklet_id").distinct().select("run_id", "tracklet_id", F.when(F.col("tracklet_id") % 4 != 0, F.expr("tracklet_id div 3")).alias("person_id"))
    return I.irrational_events(I.ensemble(k, FPS, IRR, behavior(spark, sf_dir).filter("category = 'STILLA'")), FPS, IRR, persons)


def irrational_beside(spark, sf_dir, events):
    """The irrational events where ``events`` are those of behaviour."""
    still = events.filter("category = 'STILLA'")
    return I.irrational_events(I.ensemble(kinematics(spark, sf_dir), FPS, IRR, still), FPS, IRR).drop("person_id")


HAZ = f"WITH RECURSIVE {A.TRACKLETS_SQL}, {A.HAZARD_SQL}"


HAZARD_EVENTS_SQL = f"""{HAZ}, chg AS (
  SELECT *, CASE WHEN present <> lag(present) OVER (PARTITION BY stream_id, kind ORDER BY frame_no) THEN 1 ELSE 0 END AS c FROM hazards
), num AS (
  SELECT *, sum(c) OVER (PARTITION BY stream_id, kind ORDER BY frame_no) AS island FROM chg
), runs AS (
  SELECT stream_id, kind, island, any_value(present) AS present, min(frame_no) AS frame_start, max(frame_no) AS last_row, avg(area) AS m, max(area) AS p FROM num GROUP BY stream_id, kind, island
), ended AS (
  SELECT *, coalesce(lead(frame_start) OVER (PARTITION BY stream_id, kind ORDER BY island) - 1, last_row)::INT AS frame_end FROM runs
)
SELECT stream_id, printf('hazard-%06d', row_number() OVER (PARTITION BY stream_id ORDER BY frame_start, kind) - 1) AS event_id, 'HAZARD' AS category, kind, frame_start, frame_end, frame_start / {FPS} AS t_start, (frame_end + 1) / {FPS} AS t_end,
       round(least(1.0, m * 20 + (frame_end - frame_start + 1) / {FPS} / 4), 6) AS confidence, round(m, 7) AS area_mean, round(p, 7) AS area_peak
FROM ended WHERE present"""


@query(HAZARD_EVENTS_SQL)
def hazard_events(spark, sf_dir):
    return H.hazard_events(A.hazard_frames(spark, sf_dir), FPS)


HOLD_EVENTS_SQL = f"""{HAZ}, large AS (
  SELECT stream_id, kind, frame_no, frame_no / {FPS} AS t, area >= {H.MIN_AREA} AS present FROM hazards
), islands AS (
  SELECT *, frame_no - row_number() OVER (PARTITION BY stream_id, kind, present ORDER BY frame_no) AS island FROM large
), runs AS (
  SELECT stream_id, kind, present, min(t) AS a, max(t) AS z FROM islands GROUP BY stream_id, kind, present, island
), onsets AS (
  SELECT r.stream_id, r.kind, r.a AS since, min(l.t) AS t FROM runs r JOIN large l ON l.stream_id = r.stream_id AND l.kind = r.kind AND l.t BETWEEN r.a + {H.HOLD_S} AND r.z
  WHERE r.present GROUP BY r.stream_id, r.kind, r.a
), ends AS (
  SELECT o.stream_id, o.kind, o.since, min(greatest(r.a, o.since + {4 * H.HOLD_S})) AS t
  FROM (SELECT *, lead(since, 1, 'infinity'::DOUBLE) OVER (PARTITION BY stream_id, kind ORDER BY since) AS replaced FROM onsets) o
  JOIN (SELECT *, lead(a, 1, 'infinity'::DOUBLE) OVER (PARTITION BY stream_id, kind ORDER BY a) AS back FROM runs) r
    ON r.stream_id = o.stream_id AND r.kind = o.kind AND NOT r.present AND r.a > o.since AND r.a < o.replaced AND greatest(r.a, o.since + {4 * H.HOLD_S}) < r.back
  GROUP BY o.stream_id, o.kind, o.since
)"""


@query(f"""{HOLD_EVENTS_SQL}
SELECT l.stream_id, l.kind, l.frame_no, CASE WHEN e.t IS NULL OR l.t < e.t THEN o.since END AS since
FROM large l ASOF LEFT JOIN onsets o ON o.stream_id = l.stream_id AND o.kind = l.kind AND o.t <= l.t
LEFT JOIN ends e ON e.stream_id = o.stream_id AND e.kind = o.kind AND e.since = o.since""")
def hazard_hold(spark, sf_dir):
    return H.held_hazards(A.hazard_frames(spark, sf_dir), FPS, parts=A.parts(spark, sf_dir))


RAW_SQL = f"""
cells AS (
  SELECT run_id, greatest(0, least(9, floor((x0 + x1) / 2 / 120 * 10)))::INT AS gx, greatest(0, least(7, floor(y1 / 100 * 8)))::INT AS gy FROM tracklets
), raw AS (SELECT run_id, gx, gy, count(*) / {FPS} AS seconds FROM cells GROUP BY run_id, gx, gy)"""


@query(f"WITH {A.TRACKLETS_SQL}, {RAW_SQL} SELECT * FROM raw")
def heatmap_raw(spark, sf_dir):
    return M.raw_heatmap(A.tracklets(spark, sf_dir), FPS, 120.0, 100.0, 10)


#: Seconds from which a cell counts as occupied.
OCCUPIED_S = 4.0


@query(f"""WITH RECURSIVE {A.TRACKLETS_SQL}, {RAW_SQL}, c AS MATERIALIZED (SELECT run_id, gx, gy, gy * 100 + gx AS name FROM raw WHERE seconds >= {OCCUPIED_S}),
reach AS (SELECT run_id, name AS a, gx, gy FROM c UNION SELECT r.run_id, r.a, c.gx, c.gy FROM reach r JOIN c ON c.run_id = r.run_id AND abs(c.gx - r.gx) <= 1 AND abs(c.gy - r.gy) <= 1),
least AS (SELECT run_id, gx, gy, min(a) AS blob FROM reach GROUP BY run_id, gx, gy),
sizes AS (SELECT run_id, blob, count(*) AS cells, avg(gx) / 10 AS x, avg(gy) / 8 AS y, count(*) / 80.0::DOUBLE AS area FROM least GROUP BY run_id, blob)
SELECT run_id, cells, round(x, 6) AS x, round(y, 6) AS y, area FROM sizes QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY cells DESC, blob) = 1""")
def occupied_blobs(spark, sf_dir):
    """The largest connected area of cells where people stay."""
    blobs = GR.largest_blobs(heatmap_raw(spark, sf_dir).filter(F.col("seconds") >= OCCUPIED_S), ["run_id"], 10, 8)
    return blobs.withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


@query(f"""WITH {A.TRACKLETS_SQL}, {RAW_SQL}, g AS (
  SELECT r.run_id, x.gx, y.gy, coalesce(w.seconds, 0) < {OCCUPIED_S} AS open FROM (SELECT DISTINCT run_id FROM raw) r, (SELECT unnest(range(20))::INT AS gx) x, (SELECT unnest(range(16))::INT AS gy) y
  LEFT JOIN raw w ON w.run_id = r.run_id AND w.gx = x.gx // 2 AND w.gy = y.gy // 2
), looks AS (
  SELECT g.run_id, g.gx, g.gy, d.k, d.name, count(*) AS n, avg(o.open::INT) AS free
  FROM g, (VALUES (1, 'vänster', -1, 0), (2, 'höger', 1, 0), (3, 'uppåt', 0, -1), (4, 'nedåt', 0, 1)) AS d(k, name, dx, dy), (SELECT unnest(range(0, 20, 2)) AS s) s
  JOIN g o ON o.run_id = g.run_id AND o.gx = g.gx + d.dx * s.s AND o.gy = g.gy + d.dy * s.s GROUP BY ALL
)
SELECT run_id, gx, gy, string_agg(name, ',' ORDER BY k) AS ways FROM looks WHERE n > 5 AND free > 0.65 GROUP BY run_id, gx, gy""")
def ways_out(spark, sf_dir):
    """From which cells of the half-size grid the edge is reached over cells where few people stay."""
    raw = heatmap_raw(spark, sf_dir)
    cells = raw.select("run_id").distinct().withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(15))))
    at = cells.withColumn("hx", F.expr("int(gx div 2)")).withColumn("hy", F.expr("int(gy div 2)"))
    seen = at.join(raw.select("run_id", F.col("gx").alias("hx"), F.col("gy").alias("hy"), "seconds"), ["run_id", "hx", "hy"], "left")
    grid = seen.select("run_id", "gx", "gy", (F.coalesce("seconds", F.lit(0.0)) < OCCUPIED_S).alias("open"))
    return GR.ways_out(grid, ["run_id"]).filter(F.size("ways") > 0).select("run_id", "gx", "gy", F.array_join("ways", ",").alias("ways"))


@query(f"WITH {A.TRACKLETS_SQL}, {RAW_SQL} SELECT run_id, round(max(seconds), 3) AS max_s, round(sum(seconds), 3) AS total_s FROM raw GROUP BY run_id")
def heatmap_totals(spark, sf_dir):
    return M.heatmap_totals(heatmap_raw(spark, sf_dir))


@query(f"""WITH {A.TRACKLETS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame_no, tracklet_id) - 1 AS r, ceil(count(*) OVER (PARTITION BY run_id) / 100.0)::BIGINT AS n FROM tracklets
) SELECT run_id, tracklet_id, frame_no, x0, y1 FROM r WHERE r % n = 0""")
def trajectory_downsample(spark, sf_dir):
    return M.downsample(A.tracklets(spark, sf_dir), ["run_id"], 100).select("run_id", "tracklet_id", "frame_no", "x0", "y1")


RECTS = [(0.1, 0.1, 0.2, 0.3), (0.5, 0.0, 0.25, 0.25)]


@query(f"""WITH {A.TRACKLETS_SQL}, c AS (SELECT *, (x0 + x1) / 2 / 120 AS nx, (y0 + y1) / 2 / 100 AS ny FROM tracklets)
SELECT run_id, tracklet_id, frame_no FROM c WHERE NOT ({' OR '.join(f'(nx >= {x} AND nx <= {x + w} AND ny >= {y} AND ny <= {y + h})' for x, y, w, h in RECTS)})""")
def ignore_filter(spark, sf_dir):
    t = A.tracklets(spark, sf_dir)
    inside = G.in_any_rect((F.col("x0") + F.col("x1")) / 2 / 120, (F.col("y0") + F.col("y1")) / 2 / 100, RECTS)
    return t.filter(~inside).select("run_id", "tracklet_id", "frame_no")


MATRIX = [[1.1, 0.02, 5.0], [-0.01, 0.95, -3.0], [0.0005, 0.0002, 1.25]]


def _projected_sql(x, y):
    m = [[v / MATRIX[2][2] for v in r] for r in MATRIX]
    w = f"({m[2][0]} * ({x}) + {m[2][1]} * ({y}) + {m[2][2]})"
    return [f"({m[i][0]} * ({x}) + {m[i][1]} * ({y}) + {m[i][2]}) / {w}" for i in (0, 1)]


_FX, _FY = _projected_sql("(x0 + x1) / 2", "y1")
_TX, _TY = _projected_sql("(x0 + x1) / 2", "y0")


@query(f"WITH {A.TRACKLETS_SQL} SELECT run_id, tracklet_id, frame_no, round({_FX}, 4) AS scene_x, round({_FY}, 4) AS scene_y, round(greatest(sqrt(({_FX} - {_TX}) ^ 2 + ({_FY} - {_TY}) ^ 2), 1.0), 4) AS scene_box_h FROM tracklets")
def scene_project(spark, sf_dir):
    t = A.tracklets(spark, sf_dir)
    cx = (F.col("x0") + F.col("x1")) / 2
    (fx, fy), (tx, ty) = G.project(MATRIX, cx, F.col("y1")), G.project(MATRIX, cx, F.col("y0"))
    return t.select("run_id", "tracklet_id", "frame_no", F.round(fx, 4).alias("scene_x"), F.round(fy, 4).alias("scene_y"), F.round(F.greatest(G.distance(fx - tx, fy - ty), F.lit(1.0)), 4).alias("scene_box_h"))


@query(f"""WITH {A.TRACKLETS_SQL} SELECT run_id, tracklet_id, frame_no, round(x0 / 120, 7) AS nx, round(y0 / 100, 7) AS ny, round((x1 - x0) / 120, 7) AS nw, round((y1 - y0) / 100, 7) AS nh,
  least(x1 - x0, y1 - y0) < 32 AS below_floor, least(1.0, greatest(0.0, (x0 + x1) / 2 / 120)) AS danger_x, (x0 + x1) / 2 / 120 < 0 OR (x0 + x1) / 2 / 120 > 1 AS off FROM tracklets""")
def box_projections(spark, sf_dir):
    cx = (F.col("x0") + F.col("x1")) / 2 / 120
    return A.tracklets(spark, sf_dir).select(
        "run_id", "tracklet_id", "frame_no", F.round(F.col("x0") / 120, 7).alias("nx"), F.round(F.col("y0") / 100, 7).alias("ny"),
        F.round((F.col("x1") - F.col("x0")) / 120, 7).alias("nw"), F.round((F.col("y1") - F.col("y0")) / 100, 7).alias("nh"),
        (F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < 32).alias("below_floor"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), cx)).alias("danger_x"), ((cx < 0) | (cx > 1)).alias("off"),
    )


_DIRS = ", ".join(f"'{d}'" for d in G.DIRECTIONS)


@query(f"{WITH} SELECT run_id, tracklet_id, frame_no, [{_DIRS}][floor((((degrees(atan2(dy, dx)) + 22.5) % 360 + 360) % 360) / 45)::INT + 1] AS direction, CASE WHEN floor(frame_no / {FPS} * 60) >= 3600 THEN printf('%d:%02d:%02d', (floor(frame_no / {FPS} * 60)::INT // 3600)::INT, (floor(frame_no / {FPS} * 60)::INT % 3600 // 60)::INT, (floor(frame_no / {FPS} * 60)::INT % 60)::INT) ELSE printf('%02d:%02d', (floor(frame_no / {FPS} * 60)::INT % 3600 // 60)::INT, (floor(frame_no / {FPS} * 60)::INT % 60)::INT) END AS clock FROM kin WHERE dist > 0.5")
def directions_and_clock(spark, sf_dir):
    k = kinematics(spark, sf_dir).filter("dist > 0.5")
    return k.select("run_id", "tracklet_id", "frame_no", G.direction_name(F.col("dx"), F.col("dy")).alias("direction"), G.clock(F.col("frame_no") / FPS * 60).alias("clock"))


@query(f"{WITH} SELECT run_id, tracklet_id, frame_no, round(sum(CASE WHEN abs(coalesce(dx, 0)) < 20 AND abs(coalesce(dy, 0)) < 20 THEN coalesce(dx, 0) ELSE 0 END) OVER w, 6) AS off_x, round(sum(CASE WHEN abs(coalesce(dx, 0)) < 20 AND abs(coalesce(dy, 0)) < 20 THEN coalesce(dy, 0) ELSE 0 END) OVER w, 6) AS off_y FROM kin WINDOW w AS (PARTITION BY run_id, tracklet_id ORDER BY frame_no)")
def motion_offset(spark, sf_dir):
    k = kinematics(spark, sf_dir).select("run_id", "tracklet_id", "frame_no", F.coalesce("dx", F.lit(0.0)).alias("shift_x"), F.coalesce("dy", F.lit(0.0)).alias("shift_y"))
    return rounded(O.offsets(k, ["run_id", "tracklet_id"], "frame_no", 20.0).drop("shift_x", "shift_y"), "off_x", "off_y")


@query(f"""{WITH}, ordered AS MATERIALIZED (SELECT run_id, tracklet_id, frame_no, speed, row_number() OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no) AS i FROM kin), m AS (
  SELECT run_id, tracklet_id, frame_no, i, speed AS ema FROM ordered WHERE i = 1
  UNION ALL SELECT o.run_id, o.tracklet_id, o.frame_no, o.i, (1 - 0.1) * m.ema + 0.1 * o.speed FROM m JOIN ordered o ON o.run_id = m.run_id AND o.tracklet_id = m.tracklet_id AND o.i = m.i + 1
) SELECT run_id, tracklet_id, frame_no, round(ema, 6) AS ema FROM m""")
def speed_ema(spark, sf_dir):
    k = kinematics(spark, sf_dir).select("run_id", "tracklet_id", "frame_no", "speed")
    return rounded(O.ema(k, ["run_id", "tracklet_id"], "frame_no", "speed", 0.1), "ema")


@query(f"""{WITH}, ordered AS MATERIALIZED (SELECT run_id, tracklet_id, frame_no, x, y, row_number() OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no) AS i FROM kin), m AS (
  SELECT run_id, tracklet_id, frame_no, i, x, y FROM ordered WHERE i = 1
  UNION ALL SELECT o.run_id, o.tracklet_id, o.frame_no, o.i, CASE WHEN sqrt((o.x - m.x) ^ 2 + (o.y - m.y) ^ 2) > 25 THEN o.x ELSE m.x END, CASE WHEN sqrt((o.x - m.x) ^ 2 + (o.y - m.y) ^ 2) > 25 THEN o.y ELSE m.y END
  FROM m JOIN ordered o ON o.run_id = m.run_id AND o.tracklet_id = m.tracklet_id AND o.i = m.i + 1
) SELECT run_id, tracklet_id, frame_no, x, y FROM m""")
def base_hysteresis(spark, sf_dir):
    k = kinematics(spark, sf_dir).select("run_id", "tracklet_id", "frame_no", F.col("x").alias("px"), F.col("y").alias("py"))
    return O.hysteresis(k, ["run_id", "tracklet_id"], "frame_no", 25.0)


@query(f"""{WITH}, ordered AS MATERIALIZED (SELECT run_id, tracklet_id, frame_no, frame_no / {FPS} AS t, [x, y, 30.0 + frame_no % 5, 80.0 + frame_no % 7] AS b, row_number() OVER (PARTITION BY run_id, tracklet_id ORDER BY frame_no) AS i FROM kin), m AS (
  SELECT run_id, tracklet_id, frame_no, i, t, b FROM ordered WHERE i = 1
  UNION ALL SELECT o.run_id, o.tracklet_id, o.frame_no, o.i, o.t, list_transform(range(1, 5), lambda k: m.b[k] + greatest(-(3.0 * greatest(m.b[3], m.b[4], 8.0) * (o.t - m.t)), least(3.0 * greatest(m.b[3], m.b[4], 8.0) * (o.t - m.t), (1 - exp(-(o.t - m.t) / CASE WHEN k <= 2 THEN 0.12 ELSE 0.18 END)) * (o.b[k] - m.b[k]))))
  FROM m JOIN ordered o ON o.run_id = m.run_id AND o.tracklet_id = m.tracklet_id AND o.i = m.i + 1
) SELECT run_id, tracklet_id, frame_no, round(b[1], 6) AS sx, round(b[2], 6) AS sy, round(b[3], 6) AS sw, round(b[4], 6) AS sh FROM m""")
def box_smoothing(spark, sf_dir):
    k = kinematics(spark, sf_dir).select("run_id", "tracklet_id", "frame_no", F.col("x").alias("cx"), F.col("y").alias("cy"), (30.0 + F.col("frame_no") % 5).alias("w"), (80.0 + F.col("frame_no") % 7).alias("h"))
    return rounded(O.smooth_boxes(k, ["run_id", "tracklet_id"], "frame_no", FPS), "sx", "sy", "sw", "sh")


@query("""WITH p AS (SELECT DISTINCT (640 + p_size)::INT AS width, (360 + p_size * 2)::INT AS height FROM part), t AS (SELECT *, unnest(range(3)) AS tile_x FROM p), g AS (SELECT *, unnest(range(3)) AS tile_y FROM t),
s AS (SELECT *, round_even(width / 2.7, 0)::INT AS tw, round_even(height / 2.7, 0)::INT AS th FROM g),
c AS (SELECT *, round_even(tile_x * (width - tw) / 2.0, 0)::INT AS x0, round_even(tile_y * (height - th) / 2.0, 0)::INT AS y0 FROM s)
SELECT width, height, tile_x::INT AS tile_x, tile_y::INT AS tile_y, x0, y0, least(width, x0 + tw) AS x1, least(height, y0 + th) AS y1 FROM c""")
def tile_grid(spark, sf_dir):
    p = A.table(spark, sf_dir, "part").select((F.col("p_size") + 640).cast("int").alias("width"), (F.col("p_size") * 2 + 360).cast("int").alias("height")).distinct()
    return O.tile_grid(p, 3)


@query(f"""WITH RECURSIVE {A.TRACKLETS_SQL}, rounds AS (
  SELECT run_id, frame_no, det_id AS box_id, conf AS score, x0, y0, x1, y1, row_number() OVER (PARTITION BY run_id, frame_no ORDER BY conf DESC, det_id) AS place, false AS won FROM tracklets
  UNION ALL
  SELECT run_id, frame_no, box_id, score, x0, y0, x1, y1, place, won FROM (
    SELECT *, greatest(least(x1, top.x1) - greatest(x0, top.x0), 0) * greatest(least(y1, top.y1) - greatest(y0, top.y0), 0) AS shared, (top.x1 - top.x0) * (top.y1 - top.y0) + (x1 - x0) * (y1 - y0) AS areas FROM (
      SELECT * EXCLUDE (won), place = min(place) OVER w AS won, first_value({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) OVER w AS top FROM rounds WHERE NOT won WINDOW w AS (PARTITION BY run_id, frame_no ORDER BY place)
    )
  ) WHERE won OR shared / greatest(areas - shared, 1e-9) <= 0.5
) SELECT run_id, frame_no, box_id, score FROM rounds WHERE won""")
def nms(spark, sf_dir):
    """The boxes of each frame that no better box covers; in SQL the best box left of each frame wins a round."""
    t =A.tracklets(spark, sf_dir)
    boxes = t.select("run_id", "frame_no", F.col("det_id").alias("box_id"), F.col("conf").alias("score"), "x0", "y0", "x1", "y1")
    return O.suppress(boxes, ["run_id", "frame_no"]).select("run_id", "frame_no", "box_id", "score")


@query(f"""WITH {A.TRACKLETS_SQL}, v AS (
  SELECT run_id, tracklet_id, frame_no, CASE WHEN det_id % 3 = 0 THEN NULL ELSE 'layout' || det_id % 2 END AS layout FROM tracklets
), w AS (
  SELECT run_id, tracklet_id, frame_no, count(*) FILTER (layout = 'layout0') OVER s AS n0, count(*) FILTER (layout = 'layout1') OVER s AS n1 FROM v WINDOW s AS (PARTITION BY run_id, tracklet_id ORDER BY frame_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
) SELECT run_id, tracklet_id, min(frame_no) AS locked_at FROM w WHERE greatest(n0, n1) >= 4 GROUP BY run_id, tracklet_id""")
def layout_lock(spark, sf_dir):
    """The first frame at which one of the layouts has 4 of the last 10 votes."""
    from pyspark.sql import Window

    t = A.tracklets(spark, sf_dir)
    layout = F.when(F.col("det_id") % 3 != 0, F.concat(F.lit("layout"), F.col("det_id") % 2))
    w = Window.partitionBy("run_id", "tracklet_id").orderBy("frame_no").rowsBetween(-9, 0)
    votes = [F.count(F.when(layout == f"layout{i}", 1)).over(w) for i in (0, 1)]
    return t.select("run_id", "tracklet_id", "frame_no", F.greatest(*votes).alias("most")).filter("most >= 4").groupBy("run_id", "tracklet_id").agg(F.min("frame_no").alias("locked_at"))


@query(f"""WITH {A.TRACKLETS_SQL}, f AS (SELECT cls, run_id, frame_no, count(*) FILTER (conf >= 0.3) AS n, avg(conf) AS c FROM tracklets GROUP BY cls, run_id, frame_no)
SELECT cls, count(*) AS frames, round(avg(n), 6) AS mean_persons, max(n) AS max_persons, count(*) FILTER (n > 0) AS frames_with FROM f GROUP BY cls""")
def detection_eval(spark, sf_dir):
    f = A.tracklets(spark, sf_dir).groupBy("cls", "run_id", "frame_no").agg(F.count(F.when(F.col("conf") >= 0.3, 1)).alias("n"))
    return f.groupBy("cls").agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("n"), 6).alias("mean_persons"), F.max("n").alias("max_persons"), F.count(F.when(F.col("n") > 0, 1)).alias("frames_with"))


@query(f"""{WITH} SELECT run_id, tracklet_id, count(*) AS packets, round(max(greatest(abs(dx), abs(dy))), 6) AS max_jump FROM kin GROUP BY run_id, tracklet_id""")
def packet_jumps(spark, sf_dir):
    return kinematics(spark, sf_dir).groupBy("run_id", "tracklet_id").agg(F.count(F.lit(1)).alias("packets"), F.round(F.max(F.greatest(F.abs("dx"), F.abs("dy"))), 6).alias("max_jump"))


@query(f"WITH {A.TRACKLETS_SQL} SELECT run_id, frame_no, list_sort(list(tracklet_id)) AS tracklet_ids, count(*) AS n FROM tracklets WHERE frame_no BETWEEN 10 AND 20 GROUP BY run_id, frame_no")
def tracklets_range(spark, sf_dir):
    t = A.tracklets(spark, sf_dir).filter(F.col("frame_no").between(10, 20))
    return t.groupBy("run_id", "frame_no").agg(F.array_sort(F.collect_list("tracklet_id")).alias("tracklet_ids"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {A.TRACKLETS_SQL}, p AS (SELECT run_id, scene_segment, round({_FX}, 4) AS x, round({_FY}, 4) AS y FROM tracklets),
e AS (SELECT run_id, scene_segment, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, greatest(max(x) - min(x), 1.0) AS span_x, greatest(max(y) - min(y), 1.0) AS span_y FROM p GROUP BY run_id, scene_segment),
g AS (SELECT *, greatest(1, round_even(12.0::DOUBLE * span_y / span_x, 0)::INT) AS n FROM e), h AS (SELECT *, span_x / 12 AS w, span_y / n AS h FROM g),
c AS (SELECT run_id, scene_segment, least(11, floor((x - min_x) / w)::INT) AS gx, least(n - 1, floor((y - min_y) / h)::INT) AS gy, any_value(min_x) AS min_x, any_value(min_y) AS min_y, any_value(max_x) AS max_x, any_value(max_y) AS max_y, any_value(w) AS w, any_value(h) AS h, count(*) AS k
  FROM p JOIN h USING (run_id, scene_segment) GROUP BY 1, 2, 3, 4)
SELECT run_id, scene_segment, round(min_x + (gx + 0.5) * w, 4) AS x, round(min_y + (gy + 0.5) * h, 4) AS y, round(w, 4) AS width, round(h, 4) AS height, round(k / {FPS}, 3) AS seconds,
  round(min_x, 4) AS min_x, round(min_y, 4) AS min_y, round(max_x, 4) AS max_x, round(max_y, 4) AS max_y FROM c""")
def heatmap_scene(spark, sf_dir):
    t = A.tracklets(spark, sf_dir)
    return M.scene_heatmap(scene_project(spark, sf_dir).join(t.select("run_id", "tracklet_id", "frame_no", "scene_segment"), ["run_id", "tracklet_id", "frame_no"]), FPS, 12)
