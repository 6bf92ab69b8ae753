"""Hazard spans and the hold that precedes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .islands import spans

#: Defaults of the hazard hold.
MIN_AREA, HOLD_S = 0.004, 2.0


def hazard_events(frames: DataFrame, fps: float) -> DataFrame:
    """One event for each span of frames with a hazard of one kind, numbered by onset and kind within a stream."""
    state = frames.withColumn("state", F.when(F.col("present"), "present").otherwise("ok"))
    s = spans(state, "state", ["stream_id", "kind"], "frame_no", [F.avg("area").alias("area_mean"), F.max("area").alias("area_peak")])
    duration = (F.col("frame_end") - F.col("frame_start") + 1) / F.lit(fps)
    seq = F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_start", "kind")) - 1
    return s.select(
        "stream_id", F.format_string("hazard-%06d", seq).alias("event_id"), F.lit("HAZARD").alias("category"), "kind", "frame_start", "frame_end",
        (F.col("frame_start") / F.lit(fps)).alias("t_start"), ((F.col("frame_end") + 1) / F.lit(fps)).alias("t_end"),
        F.round(F.least(F.lit(1.0), F.col("area_mean") * 20 + duration / 4), 6).alias("confidence"), F.round("area_mean", 7).alias("area_mean"), F.round("area_peak", 7).alias("area_peak"),
    )


def hold_events(rows: DataFrame, keys: list[str], at: str, present: str, hold: float, keep: float) -> DataFrame:
    """A signal that must last for ``hold`` before it is told, and that is then kept until ``keep`` after its onset or, where it
    lasts longer, until it is away: the keys, event (onset or end), since (the onset) and at.

    Runs of presence and absence are islands. A run of presence is told at its first row that is late enough; what was told
    last ends in the first run of absence that lasts beyond its time. A later onset may take its place before.
    """
    by, of = Window.partitionBy(*keys).orderBy(at), Window.partitionBy(*keys).orderBy("__run")
    turned = F.coalesce(F.col(present) != F.lag(present).over(by), F.lit(True)).cast("int")
    runs = rows.select(*keys, F.col(at).alias("__at"), F.col(present).alias("__present"), F.sum(turned).over(by).alias("__run"))
    runs = runs.withColumn("__first", F.min("__at").over(Window.partitionBy(*keys, "__run")))
    late = F.min(F.when(F.col("__present") & (F.col("__at") - F.col("__first") >= hold), F.col("__at")))
    runs = runs.groupBy(*keys, "__run", "__present", "__first").agg(late.alias("__told"))
    since = F.last(F.when(F.col("__told").isNotNull(), F.col("__first")), ignorenulls=True).over(of)
    runs = runs.withColumn("__since", since).withColumn("__until", F.lead("__first").over(of))
    ends = F.greatest("__first", F.col("__since") + keep)
    over = runs.filter(~F.col("__present") & F.col("__since").isNotNull() & (F.col("__until").isNull() | (ends < F.col("__until"))))
    onset = runs.filter(F.col("__told").isNotNull()).select(*keys, F.lit("onset").alias("event"), F.col("__first").alias("since"), F.col("__told").alias("at"))
    return onset.unionByName(over.groupBy(*keys, F.col("__since").alias("since")).agg(F.min(ends).alias("at")).withColumn("event", F.lit("end")))


def held_hazards(frames: DataFrame, fps: float, min_area: float = MIN_AREA, hold_s: float = HOLD_S, parts: int | None = None) -> DataFrame:
    """stream_id, kind, frame_no, since: the onset (seconds) of the hazard reported at each frame, null for none.

    A blob of at least ``min_area`` must last ``hold_s``; a reported hazard is kept without one
    until 4 * hold_s after its onset. Each frame has what the last onset or end up to it says.
    ``parts``: how many tasks share the frames.
    """
    keys = ["stream_id", "kind"]
    rows = frames.select(*keys, "frame_no", (F.col("frame_no") / F.lit(fps)).alias("t"), (F.col("area") >= min_area).alias("large"))
    events = hold_events(rows, keys, "t", "large", hold_s, 4 * hold_s)
    said = F.struct(F.when(F.col("event") == "onset", F.col("since")).alias("since"))
    both = events.select(*keys, F.lit(None).cast("int").alias("frame_no"), F.col("at").alias("t"), said.alias("said"), F.lit(0).alias("part"))
    both = both.unionByName(rows.select(*keys, "frame_no", "t", F.lit(None).cast("struct<since:double>").alias("said"), F.lit(1).alias("part")))
    both = both.repartition(parts, "stream_id") if parts else both
    last = F.last("said", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("t", "part").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("since", last["since"]).filter("part = 1").select(*keys, "frame_no", "since")


def mean_danger(frames: DataFrame) -> DataFrame:
    """Each stream's mean danger point: over the frames that have one."""
    return frames.filter("present").groupBy("stream_id").agg(F.round(F.avg("x"), 6).alias("danger_x"), F.round(F.avg("y"), 6).alias("danger_y"))


def danger_by_segment(frames: DataFrame) -> DataFrame:
    """Each stream's mean danger point in each scene segment; frames without one count for nothing."""
    return frames.filter("present").groupBy("stream_id", "scene_segment").agg(F.avg("x").alias("danger_x"), F.avg("y").alias("danger_y"), F.count(F.lit(1)).alias("frames"))
