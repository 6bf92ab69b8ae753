"""Stillness and motion toward a danger point: windowed motion, hysteresis, events."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .islands import island_of, spans, sustained_since

STILL, TOWARD, OK = "still", "toward_danger", "ok"
#: Event categories of the statuses.
CATEGORY = {STILL: "STILLA", TOWARD: "MOT_FARA"}


@dataclass(frozen=True)
class Behavior:
    """The thresholds' defaults (seconds, body heights a second, degrees)."""

    window_s: float = 6.0
    min_history_s: float = 3.0
    still_speed: float = 0.10
    still_time_s: float = 4.0
    toward_speed: float = 0.25
    toward_angle_deg: float = 40.0
    toward_time_s: float = 1.5
    prone_aspect: float = 1.4
    max_samples: int = 512


def with_positions(tracklets: DataFrame) -> DataFrame:
    """Add x, y (foot point), body, aspect and segment_run (one higher at each change of scene segment)."""
    keys = ["run_id", "tracklet_id"]
    before = F.lag("scene_segment").over(Window.partitionBy(*keys).orderBy("frame_no"))
    changed = F.coalesce(F.col("scene_segment") != before, F.lit(False))
    return (
        tracklets.withColumn("x", G.foot_x()).withColumn("y", F.col("y1")).withColumn("body", G.body_height()).withColumn("aspect", G.aspect())
        .withColumn("segment_run", island_of(changed, keys, "frame_no"))
    )


def kinematics(tracklets: DataFrame, fps: float) -> DataFrame:
    """Backward differences: speed in body heights a second, heading in degrees; speed 0 and no
    heading on a tracklet's first row and behind a segment change."""
    w = Window.partitionBy("run_id", "tracklet_id", "segment_run").orderBy("frame_no")
    k = with_positions(tracklets)
    lag = lambda c: F.lag(c).over(w)
    k = k.withColumn("dx", F.col("x") - lag("x")).withColumn("dy", F.col("y") - lag("y")).withColumn("dt", (F.col("frame_no") - lag("frame_no")) / F.lit(fps))
    k = k.withColumn("mean_body", F.greatest((F.col("body") + lag("body")) / 2, F.lit(1.0))).withColumn("dist", G.distance(F.col("dx"), F.col("dy")))
    return k.withColumn("speed", F.when(F.col("dt") > 0, F.col("dist") / F.col("dt") / F.col("mean_body")).otherwise(0.0)).withColumn(
        "heading", F.when((F.col("dt") > 0) & (F.col("dist") > 1e-6), G.heading(F.col("dx"), F.col("dy")))
    )


def status_timeline(tracklets: DataFrame, fps: float, cfg: Behavior = Behavior(), danger: tuple[float, float] | None = None) -> DataFrame:
    """run_id, tracklet_id, frame_no, status, prone, speed for each row."""
    keys = ["run_id", "tracklet_id", "segment_run"]
    w = Window.partitionBy(*keys).orderBy("frame_no")
    recent = w.rangeBetween(-math.floor(cfg.window_s * fps + 1e-9), 0)
    k = with_positions(tracklets).select(*keys, "frame_no", "x", "y", "body", "aspect")
    k = k.withColumn("h", F.slice(F.collect_list(F.struct("frame_no", "x", "y", "body", "aspect")).over(recent), -1 * F.least(F.count(F.lit(1)).over(recent), F.lit(cfg.max_samples)).cast("int"), cfg.max_samples))
    n = F.size("h")
    k = k.withColumn("evaluated", (F.col("frame_no") - F.col("h")[0]["frame_no"]) / F.lit(fps) >= cfg.min_history_s)
    middle = F.col("h")[(n / 2).cast("int")]
    k = k.withColumn("from", F.when((F.col("frame_no") - middle["frame_no"]) / F.lit(fps) < 0.5, F.col("h")[0]).otherwise(middle))
    k = k.withColumn("dx", F.col("x") - F.col("from.x")).withColumn("dy", F.col("y") - F.col("from.y")).withColumn("moved", G.distance(F.col("dx"), F.col("dy")))
    dt = (F.col("frame_no") - F.col("from.frame_no")) / F.lit(fps)
    known = F.col("evaluated") & (n >= 4) & (dt > 0)
    now = F.when(known, F.col("moved") / dt / F.greatest(G.upper_median(F.transform("h", lambda s: s["body"])), F.lit(1.0))).otherwise(0.0)
    k = k.withColumn("now_speed", F.when(F.col("evaluated"), now)).withColumn("prone", F.col("evaluated") & (G.upper_median(F.transform("h", lambda s: s["aspect"])) > cfg.prone_aspect))
    k = k.withColumn("speed", F.coalesce(F.last("now_speed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    toward: Column = F.lit(False)
    if danger:
        ax, ay = F.lit(danger[0]) - F.col("x"), F.lit(danger[1]) - F.col("y")
        far = G.distance(ax, ay)
        cosine = (F.col("dx") * ax + F.col("dy") * ay) / F.col("moved") / far
        toward = F.coalesce((n >= 4) & (F.col("now_speed") > cfg.toward_speed) & (F.col("moved") > 1e-6) & (far > 1.0) & (cosine > math.cos(math.radians(cfg.toward_angle_deg))), F.lit(False))
    k = k.withColumn("is_still", F.coalesce(F.col("now_speed") < cfg.still_speed, F.lit(False))).withColumn("is_toward", toward)
    k = k.drop("h", "from")
    # The timers see evaluated rows only: a warm-up leaves them as they are, so its rows are a group of their own.
    apart = [*keys, "evaluated"]
    k = sustained_since(sustained_since(k, "is_still", apart, "frame_no", "still_since"), "is_toward", apart, "frame_no", "toward_since")
    held = lambda since, s: F.coalesce((F.col("frame_no") - F.col(since)) / F.lit(fps) >= s, F.lit(False))
    status = F.when(~F.col("evaluated"), OK).when(held("still_since", cfg.still_time_s), STILL).when(held("toward_since", cfg.toward_time_s), TOWARD).otherwise(OK)
    return k.select(*keys[:2], "frame_no", status.alias("status"), "prone", "speed")


def behavior_events(timeline: DataFrame, fps: float, cfg: Behavior = Behavior()) -> DataFrame:
    """One event for each span of stillness or motion toward danger, numbered within its run."""
    measures = [F.avg("speed").alias("avg_speed"), (F.sum(F.col("prone").cast("int")) > F.count(F.lit(1)) / 2).alias("prone_majority"), F.count(F.lit(1)).alias("samples")]
    s = spans(timeline, "status", ["run_id", "tracklet_id"], "frame_no", measures, OK)
    still = F.col("status") == STILL
    category = F.when(still, CATEGORY[STILL]).otherwise(CATEGORY[TOWARD])
    duration = (F.col("frame_end") - F.col("frame_start") + 1) / F.lit(fps)
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("tracklet_id", "frame_start")) - 1
    return s.select(
        "run_id", F.format_string("%s-%06d", F.lower(category), seq).alias("event_id"), category.alias("category"), "tracklet_id", "frame_start", "frame_end",
        (F.col("frame_start") / F.lit(fps)).alias("t_start"), (F.col("frame_end") / F.lit(fps)).alias("t_end"), duration.alias("duration_s"),
        F.least(F.lit(1.0), duration / F.when(still, cfg.still_time_s).otherwise(cfg.toward_time_s) / 2 + 0.3).alias("confidence"),
        F.round("avg_speed", 4).alias("avg_speed"), "prone_majority", "samples",
    )
