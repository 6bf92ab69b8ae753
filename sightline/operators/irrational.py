"""Irrational movement: five signals, their ensemble, and events."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .islands import spans, sustained_since

KEYS = ["run_id", "tracklet_id", "segment_run"]


@dataclass(frozen=True)
class Irrational:
    """The thresholds' defaults."""

    erratic_window_s: float = 10.0
    erratic_tortuosity: float = 3.0
    erratic_min_speed: float = 0.4
    erratic_circ_var: float = 0.6
    sprint_speed: float = 2.5
    sprint_time_s: float = 2.0
    sprint_multiple: float = 2.0
    counterflow_angle: float = 120.0
    counterflow_time_s: float = 3.0
    counterflow_neighbors: int = 3
    counterflow_radius_bh: float = 10.0
    counterflow_coherence: float = 0.7
    oscillation_window_s: float = 30.0
    oscillation_reversals: int = 3
    oscillation_excursion_bh: float = 1.5
    freeze_speed: float = 0.1
    freeze_time_s: float = 3.0
    bolt_speed: float = 2.0
    bolt_within_s: float = 2.0
    bolt_hold_s: float = 3.5
    score: float = 1.0
    sustain_s: float = 3.0


def erratic(k: DataFrame, fps: float, cfg: Irrational = Irrational()) -> DataFrame:
    """Rows whose recent path is tortuous or whose headings scatter: tortuosity, mean_speed, circ_var, span_s."""
    w = Window.partitionBy(*KEYS).orderBy("frame_no")
    recent = w.rangeBetween(-math.floor(cfg.erratic_window_s * fps + 1e-9), 0)
    first = F.row_number().over(w) == 1
    step = F.when(~first, F.col("dist") / F.col("mean_body")).otherwise(0.0)
    k = k.withColumn("step", step).withColumn("bodies", F.collect_list("body").over(recent))
    rad = F.radians("heading")
    k = k.withColumn("steps", F.sum("step").over(recent)).withColumn("n", F.count(F.lit(1)).over(recent)).withColumn("mean_speed", F.avg("speed").over(recent))
    start = F.first(F.struct("frame_no", "x", "y", "step")).over(recent)
    k = k.withColumn("start", start).withColumn("sin", F.sum(F.sin(rad)).over(recent)).withColumn("cos", F.sum(F.cos(rad)).over(recent)).withColumn("headings", F.count("heading").over(recent))
    # The step into the window's first row is not part of its path.
    net = G.distance(F.col("x") - F.col("start.x"), F.col("y") - F.col("start.y")) / F.greatest(G.upper_median(F.col("bodies")), F.lit(1.0))
    k = k.withColumn("tortuosity", (F.col("steps") - F.col("start.step")) / F.greatest(net, F.lit(1e-6)))
    k = k.withColumn("circ_var", F.when(F.col("headings") >= 3, 1 - G.distance(F.col("sin"), F.col("cos")) / F.col("headings")).otherwise(0.0))
    k = k.withColumn("span_s", (F.col("frame_no") - F.col("start.frame_no")) / F.lit(fps))
    fires = ((F.col("tortuosity") > cfg.erratic_tortuosity) & (F.col("mean_speed") > cfg.erratic_min_speed)) | (F.col("circ_var") > cfg.erratic_circ_var)
    out = k.filter((F.col("n") >= 4) & (F.col("span_s") >= cfg.erratic_window_s / 2) & fires)
    return out.select(*KEYS, "frame_no", "tortuosity", "mean_speed", "circ_var", "span_s")


def neighbours(k: DataFrame, radius_bh: float) -> DataFrame:
    """What each row's concurrent others of its run do: upper-median speed of all, and count, coherence
    and mean heading of those with a heading within the radius. Segments play no part."""
    me = k.select("run_id", "tracklet_id", "frame_no", "x", "y", "body")
    other = k.select("run_id", "frame_no", F.col("tracklet_id").alias("other_id"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("speed").alias("o_speed"), F.col("heading").alias("o_heading"))
    pairs = me.join(other, ["run_id", "frame_no"]).filter(F.col("tracklet_id") != F.col("other_id"))
    near = F.col("o_heading").isNotNull() & (G.distance(F.col("ox") - F.col("x"), F.col("oy") - F.col("y")) <= radius_bh * F.greatest("body", F.lit(1.0)))
    rad = F.radians("o_heading")
    g = pairs.groupBy("run_id", "tracklet_id", "frame_no").agg(
        G.upper_median(F.collect_list("o_speed")).alias("group_speed"), F.count(F.when(near, 1)).alias("near"),
        F.sum(F.when(near, F.sin(rad))).alias("sin"), F.sum(F.when(near, F.cos(rad))).alias("cos"),
    )
    g = g.withColumn("coherence", F.when(F.col("near") > 0, G.distance(F.col("sin"), F.col("cos")) / F.col("near")).otherwise(1.0))
    return g.withColumn("flow", F.when((F.abs("sin") >= 1e-9) | (F.abs("cos") >= 1e-9), G.heading(F.col("cos"), F.col("sin")))).drop("sin", "cos")


def sprint(k: DataFrame, fps: float, cfg: Irrational = Irrational(), around: DataFrame | None = None) -> DataFrame:
    """Rows at the end of a sustained run much faster than the others: speed, group_speed, duration_s."""
    around = neighbours(k, cfg.counterflow_radius_bh) if around is None else around
    j = k.join(around, ["run_id", "tracklet_id", "frame_no"], "left")
    fast = F.coalesce((F.col("speed") > cfg.sprint_speed) & (F.col("speed") > cfg.sprint_multiple * F.col("group_speed")), F.lit(False))
    s = sustained_since(j.withColumn("fast", fast), "fast", KEYS, "frame_no", "since")
    duration = (F.col("frame_no") - F.col("since")) / F.lit(fps)
    return s.filter(duration >= cfg.sprint_time_s).select(*KEYS, "frame_no", "speed", "group_speed", duration.alias("duration_s"))


def counterflow(k: DataFrame, fps: float, cfg: Irrational = Irrational(), around: DataFrame | None = None) -> DataFrame:
    """Rows at the end of a sustained walk against a coherent group: angle, flow, coherence, near, duration_s."""
    around = neighbours(k, cfg.counterflow_radius_bh) if around is None else around
    j = k.join(around, ["run_id", "tracklet_id", "frame_no"], "left").withColumn("angle", G.angle_between(F.col("heading"), F.col("flow")))
    against = (F.col("near") >= cfg.counterflow_neighbors) & (F.col("coherence") > cfg.counterflow_coherence) & (F.col("angle") > cfg.counterflow_angle)
    s = sustained_since(j.withColumn("against", F.coalesce(against, F.lit(False))), "against", KEYS, "frame_no", "since")
    duration = (F.col("frame_no") - F.col("since")) / F.lit(fps)
    return s.filter(duration >= cfg.counterflow_time_s).select(*KEYS, "frame_no", "angle", "flow", "coherence", "near", duration.alias("duration_s"))


def _turns(x, y, body, excursion: float) -> list[int]:
    """The row numbers at which a path turns back, in one direction after the other.

    A leg runs from the place of the last turn's far end to the first row that has come back from the leg's
    own far end by ``excursion`` body heights. Legs are searched in blocks of growing size.
    """
    import numpy as np

    found, origin, far, reach, at, size = [], 0, 0, 0.0, 1, 64
    while at < len(x):
        rows = slice(at, at + size)
        out = np.hypot(x[rows] - x[origin], y[rows] - y[origin]) / body[rows]
        before = np.maximum.accumulate(np.append(reach, out))
        further = out > before[:-1]
        ends = np.maximum.accumulate(np.where(further, np.arange(at, at + len(out)), far))
        back = np.hypot(x[rows] - x[ends], y[rows] - y[ends]) / body[rows]
        hits = np.flatnonzero(~further & (back >= excursion))
        if len(hits):
            origin, far = int(ends[hits[0]]), at + int(hits[0])
            reach, at, size = float(back[hits[0]]), far + 1, 64
            found.append(far)
        else:
            reach, far, at, size = float(before[-1]), int(ends[-1]), at + len(out), min(2 * size, 4096)
    return found


def oscillation(k: DataFrame, fps: float, cfg: Irrational = Irrational()) -> DataFrame:
    """Rows with enough reversals between two areas in the window: reversals.

    A track's turns follow one another, so they are found track by track; how many lie in the window before
    each row is a count over a range of frames.
    """

    def found(parts):
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(parts)
        x, y, body, place = (t[c].to_numpy() for c in ("x", "y", "body", "place"))
        starts, body, turned = np.flatnonzero(place == 1), np.maximum(body, 1.0), np.zeros(len(t), np.int32)
        for a, b in zip(starts, [*starts[1:], len(t)], strict=True):
            turned[a + np.array(_turns(x[a:b], y[a:b], body[a:b], cfg.oscillation_excursion_bh), int)] = 1
        return t.select([*KEYS, "frame_no"]).append_column("turned", pa.array(turned)).to_batches()

    def turns(batches):
        import numpy as np

        # Rows come track by track, in order; a track may go on in the next batch, so the last one waits.
        held = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("place").to_numpy() == 1)
            if len(starts):
                if held or starts[-1]:
                    yield from found([*held, batch.slice(0, starts[-1])])
                held = []
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from found(held)

    # The window deals tracks to tasks and sorts them, as the columns before it are; its number tells where one begins.
    places = F.row_number().over(Window.partitionBy(*KEYS).orderBy("frame_no"))
    columns = (*(F.col(c).cast("bigint").alias(c) for c in KEYS), F.col("frame_no").cast("int").alias("frame_no"), *(F.col(c).cast("double").alias(c) for c in ("x", "y", "body")), "place")
    rows = k.withColumn("place", places).select(*columns).mapInArrow(turns, "run_id bigint, tracklet_id bigint, segment_run bigint, frame_no int, turned int")
    window = Window.partitionBy(*KEYS).orderBy("frame_no").rangeBetween(-math.floor(cfg.oscillation_window_s * fps + 1e-9), 0)
    return rows.select(*KEYS, "frame_no", F.sum("turned").over(window).cast("int").alias("reversals")).filter(F.col("reversals") >= cfg.oscillation_reversals)


def freeze_bolt(k: DataFrame, fps: float, cfg: Irrational = Irrational()) -> DataFrame:
    """Rows held behind a freeze and a bolt soon after it: freeze_s, bolt_speed.

    A freeze is an island of still rows; the first fast row soon enough behind its end is its bolt, and the rows
    for some time from a bolt on are held by it.
    """
    order = Window.partitionBy(*KEYS).orderBy("frame_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    seconds = lambda frames: frames / F.lit(fps)
    still = F.coalesce(F.col("speed") < cfg.freeze_speed, F.lit(False))
    rows = k.select(*KEYS, "frame_no", "speed", still.alias("still")).withColumn("island", F.sum(F.when(F.col("still"), 0).otherwise(1)).over(so_far))
    begin = F.min(F.when(F.col("still"), F.col("frame_no"))).over(Window.partitionBy(*KEYS, "island"))
    rows = rows.withColumn("long", F.when(F.col("still") & (seconds(F.col("frame_no") - begin) >= cfg.freeze_time_s), F.struct(F.col("frame_no").alias("end"), seconds(F.col("frame_no") - begin).alias("freeze_s"))))
    rows = rows.withColumn("freeze", F.last("long", ignorenulls=True).over(so_far))
    fast = ~F.col("still") & (F.col("speed") > cfg.bolt_speed) & (seconds(F.col("frame_no") - F.col("freeze.end")) <= cfg.bolt_within_s)
    first = F.min(F.when(fast, F.col("frame_no"))).over(Window.partitionBy(*KEYS, "freeze.end"))
    bolt = F.when(fast & (F.col("frame_no") == first), F.struct(F.col("frame_no").alias("at"), F.col("freeze.freeze_s").alias("freeze_s"), F.col("speed").alias("bolt_speed")))
    rows = rows.withColumn("bolt", bolt).withColumn("bolt", F.last("bolt", ignorenulls=True).over(so_far))
    held = rows.filter(seconds(F.col("frame_no")) <= seconds(F.col("bolt.at")) + F.lit(cfg.bolt_hold_s))
    return held.select(*KEYS, "frame_no", "bolt.freeze_s", "bolt.bolt_speed")


#: The order of the signals in a summary, and their names there.
SUMMARY = [("counterflow", "counter-flow"), ("erratic", "erratic"), ("sprint", "panic-sprint"), ("oscillation", "oscillation"), ("freeze_bolt", "freeze-and-bolt")]


def ensemble(k: DataFrame, fps: float, cfg: Irrational = Irrational(), still: DataFrame | None = None) -> DataFrame:
    """Each row with the signals that fire, their score, and ``fired``: the score was reached for ``sustain_s``.

    ``still``: stillness events; their frames never fire, whatever the score's own state.
    """
    around = neighbours(k, cfg.counterflow_radius_bh)
    out = k.select(*KEYS, "frame_no")
    signals = {"counterflow": counterflow(k, fps, cfg, around), "erratic": erratic(k, fps, cfg), "sprint": sprint(k, fps, cfg, around), "oscillation": oscillation(k, fps, cfg), "freeze_bolt": freeze_bolt(k, fps, cfg)}
    for name, rows in signals.items():
        out = out.join(rows.select(*KEYS, "frame_no", F.lit(True).alias(name)), [*KEYS, "frame_no"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    out = out.withColumn("score", sum((F.col(n).cast("double") for n, _ in SUMMARY), F.lit(0.0))).withColumn("enough", F.col("score") >= cfg.score)
    out = sustained_since(out, "enough", KEYS, "frame_no", "since")
    out = out.withColumn("fired", F.coalesce((F.col("frame_no") - F.col("since")) / F.lit(fps) >= cfg.sustain_s, F.lit(False))).drop("since", "enough")
    if still is not None:
        held = still.select("run_id", "tracklet_id", F.explode(F.sequence("frame_start", "frame_end")).alias("frame_no"), F.lit(True).alias("held")).distinct()
        out = out.join(held, ["run_id", "tracklet_id", "frame_no"], "left").withColumn("fired", F.col("fired") & F.col("held").isNull()).drop("held")
    return out


def irrational_events(rows: DataFrame, fps: float, cfg: Irrational = Irrational(), persons: DataFrame | None = None) -> DataFrame:
    """One event for each span of fired rows of an ensemble; confidence grows with score and track quality.

    ``persons``: run_id, tracklet_id, person_id (see person_of_tracklet); events of these tracklets carry the person.
    """
    quality = rows.groupBy("run_id", "tracklet_id").agg(F.count(F.lit(1)).alias("rows"), (F.max("frame_no") - F.min("frame_no") + 1).alias("frames"))
    quality = quality.join(persons, ["run_id", "tracklet_id"], "left") if persons is not None else quality.withColumn("person_id", F.lit(None).cast("bigint"))
    # A track without a person counts 0.7 for stability.
    stable = F.when(F.col("person_id").isNotNull(), 1.0).otherwise(0.7)
    quality = quality.select("run_id", "tracklet_id", "person_id", ((F.least(F.lit(1.0), F.col("frames") / F.lit(fps) / 10) + F.col("rows") / F.col("frames") + stable) / 3).alias("quality"))
    state = rows.withColumn("state", F.when(F.col("fired"), "fired").otherwise("ok"))
    s = spans(state, "state", ["run_id", "tracklet_id"], "frame_no", [F.max("score").alias("top"), *(F.max(n).alias(n) for n, _ in SUMMARY)])
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("top") - cfg.score) / cfg.score))
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("tracklet_id", "frame_start")) - 1
    summary = F.concat_ws(" + ", *(F.when(F.col(n), label) for n, label in SUMMARY))
    return s.join(quality, ["run_id", "tracklet_id"]).select(
        "run_id", F.format_string("irrationell-%06d", seq).alias("event_id"), F.lit("IRRATIONELL").alias("category"), "tracklet_id", "frame_start", "frame_end",
        (F.col("frame_start") / F.lit(fps)).alias("t_start"), ((F.col("frame_end") + 1) / F.lit(fps)).alias("t_end"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 + 0.7 * margin * F.col("quality"))), 6).alias("confidence"), summary.alias("summary"), "person_id",
    )
