"""Streams over the sample events, run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import behavior as B
from ..operators import hazard as H
from ..operators import motion as MO
from ..sources import adapter as A
from ..sources.scratch import new_folder
from ..streaming import live, persons
from ..streaming.paced import PacedSource
from .registry import query
from .trajectory_queries import HOLD_EVENTS_SQL, WITH, status_sql

FPS = A.FPS


def _folder(spark) -> str:
    return new_folder(spark, "stream")


def _events(spark, sf_dir):
    schema = A.table(spark, sf_dir, "events").schema
    s = live.open_stream(spark, f"{sf_dir}/events.parquet*", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS from_ts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Hourly windows of a stream by type: the watermark closes all but the last hours, which a final row closes;
    rows that come behind the watermark are in no window."""
    root = _folder(spark)
    out = live.windowed_counts(_with_end(spark, sf_dir), "1 hour", "10 minutes", ["event_type"])
    done = live.run_to_end(out, f"{root}/out", f"{root}/state").filter("event_type <> 'end'")
    return done.select("event_type", F.date_format("from_ts", "yyyy-MM-dd HH:mm:ss").alias("from_ts"), "n", F.round("total", 4).alias("total"))


def _with_end(spark, sf_dir):
    """The events, in a first batch; then, in a second, a row far behind all others, so that every window closes, and
    rows that are late by then: those of all days but the last, under other names."""
    root = _folder(spark)
    e = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value")
    e.write.parquet(f"{root}/1")
    first = len(spark.read.schema(e.schema).parquet(f"{root}/1").inputFiles())
    newest = e.agg(F.max("ts").alias("newest"))
    row = lambda n, name: (F.lit(n).cast("bigint").alias("event_id"), "ts", F.lit(n).cast("bigint").alias("user_id"), F.lit(name).alias("event_type"), F.lit(0.0).alias("value"))
    # A batch takes ``first`` files. The end row comes once in each of as many, so that it fills its batch: rows that are late
    # count as such only in the batch after the one whose watermark they are behind.
    end = spark.range(0, first, 1, first).join(F.broadcast(newest)).withColumn("ts", F.col("newest") + F.expr("interval 10 days")).select(*row(-1, "end"))
    # One row is broadcast.
    late = e.join(F.broadcast(newest), F.col("ts") < F.col("newest") - F.expr("interval 1 day")).select(*row(-2, "late"))
    end.write.parquet(f"{root}/2")
    late.write.parquet(f"{root}/3")
    return live.open_stream(spark, f"{root}/*", e.schema, files_per_batch=first)


@query("""WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM b), g AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM g GROUP BY user_id""")
def stream_sessions(spark, sf_dir):
    root = _folder(spark)
    done = live.run_to_end(live.sessions(_with_end(spark, sf_dir), "2 hours", "10 minutes", "user_id"), f"{root}/out", f"{root}/state")
    return done.filter("user_id <> -1").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


@query("SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id) GROUP BY user_id")
def stream_conflation(spark, sf_dir):
    """The newest event of each user, kept by a sink while the events stream in by parts of a day."""
    root = _folder(spark)
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("order"), F.expr("hour(ts) div 6").alias("part"))
    e.repartition(4, "part").write.parquet(f"{root}-in")
    schema = spark.read.parquet(f"{root}-in").schema
    sink = live.NewestSink(f"{root}-out", "user_id", "order", every=3)
    return live.run_into(live.open_stream(spark, f"{root}-in", schema), sink, f"{root}-state").select("user_id", "event_id")


@query(f"""{WITH.replace(f'(frame_no // {A.SEGMENT_FRAMES})::INT AS scene_segment', '0 AS scene_segment')}, {status_sql(B.Behavior(), None)}
SELECT tracklet_id, min(frame_no) AS frame_no, min((frame_no - s0) / {FPS}) AS still_s FROM since WHERE is_still AND (frame_no - s0) / {FPS} >= {B.Behavior().still_time_s} GROUP BY run_id, tracklet_id, segment_run, si""")
def stream_still_alerts(spark, sf_dir):
    """Stillness alerts of a stream of tracklet rows."""
    root = _folder(spark)
    t = B.with_positions(A.tracklets(spark, sf_dir))
    rows = t.select("run_id", "tracklet_id", "frame_no", "x", "y", "body", F.timestamp_millis((F.col("frame_no") * 1000 / FPS).cast("bigint") + 86_400_000).alias("ts"))  # a watermark starts at 1970: no row may be there
    rows.write.parquet(f"{root}/in")
    # All files are one batch: a tracklet that is longer than others makes none of their rows late.
    stream = live.open_stream(spark, f"{root}/in", rows.schema, len(spark.read.schema(rows.schema).parquet(f"{root}/in").inputFiles()))
    return live.run_to_end(live.still_alerts(stream, FPS, by="run_id"), f"{root}/out", f"{root}/state")


def _as_stream(spark, rows, marker: dict, delay: str = "10 days"):
    """``rows`` (with ``ts``) as a stream of one batch, and one more of a single row that is ``delay`` behind the newest, so
    that the watermark passes all others and timers come due. ``marker``: what that row has beside its time."""
    root = _folder(spark)
    rows.write.parquet(f"{root}/1")
    rows = spark.read.schema(rows.schema).parquet(f"{root}/1")
    kinds = {f.name: f.dataType for f in rows.schema}
    marker = marker | {"ts_ms": 2**52}
    end = rows.agg((F.max("ts") + F.expr(f"interval {delay}")).alias("ts"))
    end.select(*[F.col(c) if c == "ts" else F.lit(marker.get(c)).cast(kinds[c]).alias(c) for c in rows.columns]).write.parquet(f"{root}/2")
    return live.open_stream(spark, f"{root}/*", rows.schema, len(rows.inputFiles())), root


def _ms(frame="frame_no"):
    """Milliseconds of a frame; a watermark starts at 1970, so no row may be there."""
    return (F.col(frame) * 1000 / FPS).cast("bigint") + 86_400_000


#: Frames after which the sample's tracks break off, and the diagonal of its picture.
TRACK_FRAMES, DIAGONAL = 20, 156.2


def looks(spark, sf_dir):
    """Detections of tracks that break off, each with its person's appearance."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("look"))
    n = e.count()
    t = B.with_positions(A.tracklets(spark, sf_dir)).withColumn("vec_id", F.col("tracklet_id") % n)
    track = F.col("tracklet_id") * 1000 + F.expr(f"frame_no div {TRACK_FRAMES}")
    # Every ninth detection is too small for an appearance.
    return t.join(e, "vec_id", "left").select(
        "run_id", "frame_no", track.cast("bigint").alias("track_id"), F.when(F.col("det_id") % 9 > 0, F.col("look")).alias("look"), "x", "y", F.lit(DIAGONAL).alias("diagonal"),
        _ms().alias("ts_ms"), F.timestamp_millis(_ms()).alias("ts"),
    )


@query(None)
def stream_persons(spark, sf_dir):
    """Person numbers given while the detections come: a gallery of appearances in each run's state."""
    stream, root = _as_stream(spark, looks(spark, sf_dir), {"run_id": -1, "frame_no": 0, "track_id": 0, "x": 0.0, "y": 0.0, "diagonal": 1.0})
    return live.run_to_end(persons.online_persons(stream, "1 hour"), f"{root}-out", f"{root}-state")


@query(None)
def stream_tracks(spark, sf_dir):
    """Starts and ends of the tracks of those persons: hand-over, scene cuts, silence."""
    seen = looks(spark, sf_dir).drop("look", "diagonal").join(stream_persons(spark, sf_dir).drop("counts"), ["run_id", "frame_no", "track_id"])
    seen = seen.select("run_id", "frame_no", F.lit(1).alias("kind"), "track_id", "person", "x", "y", "ts_ms", "ts")
    cuts = seen.filter(F.col("frame_no") % A.SEGMENT_FRAMES == 0).select("run_id", "frame_no", "ts_ms", "ts").distinct()
    cuts = cuts.select("run_id", "frame_no", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("track_id"), F.lit(0).alias("person"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "ts_ms", "ts")
    stream, root = _as_stream(spark, seen.unionByName(cuts), {"run_id": -1, "frame_no": 0, "kind": 0, "track_id": -1, "person": 0, "x": 0.0, "y": 0.0})
    return live.run_to_end(persons.live_tracks(stream, 1.5, "1 hour"), f"{root}-out", f"{root}-state")


HELD_SQL = f"""{HOLD_EVENTS_SQL}
SELECT stream_id || '/' || kind AS signal, event, (since * 1000)::BIGINT AS since_ms, (t * 1000)::BIGINT AS at_ms
FROM (SELECT *, 'onset' AS event FROM onsets UNION ALL BY NAME SELECT *, 'end' AS event FROM ends)"""


def signals(spark, sf_dir):
    """Hazards of the sample as signals."""
    h = A.hazard_frames(spark, sf_dir)
    return h.select("stream_id", "kind", F.concat_ws("/", "stream_id", "kind").alias("signal"), (F.col("area") >= H.MIN_AREA).alias("present"), _ms().alias("ts_ms"), F.timestamp_millis(_ms()).alias("ts"))


@query(HELD_SQL)
def stream_holds(spark, sf_dir):
    """Onsets and ends of hazards told by a stream; ends come from timers, also where no row comes any more."""
    # A video's signals share a state.
    rows = signals(spark, sf_dir).select(A.run_of("stream_id").alias("run_id"), "signal", "present", "ts_ms", "ts")
    stream, root = _as_stream(spark, rows, {"run_id": -1, "signal": "end", "present": False})
    out = live.run_to_end(persons.held_signals(stream, H.HOLD_S, 4 * H.HOLD_S, "1 hour", "run_id"), f"{root}-out", f"{root}-state")
    return _from_start(out)


@query(HELD_SQL)
def hold_spans(spark, sf_dir):
    """The same as a batch, by windows."""
    return _from_start(persons.held_spans(signals(spark, sf_dir), H.HOLD_S, 4 * H.HOLD_S, ("stream_id", "kind")))


def _from_start(events):
    return events.withColumn("since_ms", F.col("since_ms") - 86_400_000).withColumn("at_ms", F.col("at_ms") - 86_400_000)


#: Milliseconds that the sample's analyses take, for each number of its detections by 7.
LAG_MS = 400


@query(f"""WITH {A.TRACKLETS_SQL}, s AS (
  SELECT tracklet_id AS key, frame_no, det_id, (x0 + x1) / 2 AS x, y1 AS y, (det_id % 9 - 4)::DOUBLE AS dx, (det_id % 50 - 10)::DOUBLE AS dy FROM tracklets
), f AS (
  SELECT *, sum(CASE WHEN abs(dx) < 30 AND abs(dy) < 30 THEN dx ELSE 0 END) OVER w AS off_x, sum(CASE WHEN abs(dx) < 30 AND abs(dy) < 30 THEN dy ELSE 0 END) OVER w AS off_y
  FROM s WINDOW w AS (PARTITION BY key ORDER BY frame_no)
)
SELECT r.key, r.det_id AS result_id, r.frame_no AS taken, n.frame_no, r.x + n.off_x - r.off_x AS x, r.y + n.off_y - r.off_y AS y
FROM f r JOIN f n ON n.key = r.key AND n.frame_no = r.frame_no + (r.det_id % 7 * {LAG_MS}) // {int(1000 / FPS)}""")
def stream_results(spark, sf_dir):
    """Late results moved into the frame that is shown when they are ready: two streams, two watermarks."""
    t = A.tracklets(spark, sf_dir).select(
        F.col("tracklet_id").alias("key"), "frame_no", "det_id", ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("y"),
        (F.col("det_id") % 9 - 4).cast("double").alias("shift_x"), (F.col("det_id") % 50 - 10).cast("double").alias("shift_y"), F.timestamp_millis(_ms()).alias("ts"),
    )
    t = MO.offsets(t, ["key"], "frame_no", 30.0)
    frames, root = _as_stream(spark, t.select("key", "frame_no", "ts", "off_x", "off_y"), {"key": -1, "frame_no": 0})
    ready = F.timestamp_millis(_ms() + F.col("det_id") % 7 * LAG_MS)
    results, _ = _as_stream(spark, t.select("key", F.col("det_id").alias("result_id"), F.col("frame_no").alias("taken"), ready.alias("ts"), "x", "y", "off_x", "off_y"), {"key": -2})
    out = live.into_now(results.withColumnRenamed("ts", "ready"), frames, "1 hour", f"{int(1000 / FPS)} milliseconds")
    return live.run_to_end(out, f"{root}-out", f"{root}-state")


@query("""SELECT event_id, user_id, event_id + 1 AS frame_no, lap::INT AS lap, lap > 0 AND event_id = 2 AS looped
FROM events, (SELECT unnest(range(2)) AS lap) WHERE (event_id + 1) % 3 = 0""")
def stream_paced(spark, sf_dir):
    """The events as frames of 24 a second of which 8 are asked for, played twice."""
    root = _folder(spark)
    spark.dataSource.register(PacedSource)
    played = spark.readStream.format("paced").option("path", f"{sf_dir}/events.parquet").option("fps", 24).option("max_fps", 8).option("laps", 2).load()
    q = played.select("event_id", "user_id", "frame_no", "lap", "looped").writeStream.format("parquet").option("path", f"{root}-out").option("checkpointLocation", f"{root}-state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{root}-out")
