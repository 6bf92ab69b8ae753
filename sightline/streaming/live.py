"""Structured Streaming forms: conflation, windows with late data, and keyed state.

Event time is the rows' own timestamp; a watermark bounds how late a row may be. States
are kept by Spark's state store and time out with the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.behavior import Behavior


def open_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder (or glob) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, width: str, late: str, keys: list[str]) -> DataFrame:
    """Rows and sum of ``value`` by tumbling window; rows later than ``late`` are dropped."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("from_ts"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of each key that end after a pause of ``gap``."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("from_ts"), F.col("session_window.end").alias("to_ts"), "n")


def conflated(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row of each key in a micro-batch: a slow reader misses the older ones."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def still_alerts(rows: DataFrame, fps: float, cfg: Behavior = Behavior(), by: str = "tracklet_id") -> DataFrame:
    """Alerts when a tracklet has stood still for ``still_time_s``, from rows (tracklet_id, frame_no, x, y, body, ts).

    The state holds the recent positions and since when the tracklet stands; an alert is given once for
    each stand. State without rows ends with the watermark. ``by``: a column that each tracklet has one value of, such as its
    video; tracklets that share it share a state, so that many short ones don't cost a call each.
    """
    alert = "tracklet_id bigint, frame_no int, still_s double"
    # For each tracklet the positions of the window: frames, xs, ys, bodies; then since when it stands, and whether that was told.
    kept = "tracks array<bigint>, frames array<array<int>>, xs array<array<double>>, ys array<array<double>>, bodies array<array<double>>, since array<int>, told array<boolean>"

    def run(key: tuple, batches: Iterator, state: GroupState):
        import math
        from itertools import groupby

        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        tracks = {t: ([list(p) for p in window], since, told) for t, *window, since, told in zip(*state.get, strict=True)} if state.exists else {}
        out = []
        # A batch's rows of one tracklet may come in several parts.
        new = [r for part in batches for r in zip(*(part[c].tolist() for c in ("tracklet_id", "frame_no", "x", "y", "body")), strict=True)]
        new.sort(key=lambda r: r[:2])
        for track, mine in groupby(new, lambda r: r[0]):
            (frames, xs, ys, bodies), since, told = tracks.get(track, ([[], [], [], []], -1, False))
            for _, frame, x, y, body in mine:
                frames.append(int(frame)), xs.append(x), ys.append(y), bodies.append(max(body, 1.0))
                while (frames[-1] - frames[0]) / fps > cfg.window_s:
                    del frames[0], xs[0], ys[0], bodies[0]
                if (frames[-1] - frames[0]) / fps < cfg.min_history_s:
                    continue
                n = len(frames)
                m = n // 2 if (frames[-1] - frames[n // 2]) / fps >= 0.5 else 0
                dt = (frames[-1] - frames[m]) / fps
                speed = math.hypot(xs[-1] - xs[m], ys[-1] - ys[m]) / dt / max(sorted(bodies)[n // 2], 1.0) if n >= 4 and dt > 0 else 0.0
                if speed >= cfg.still_speed:
                    since, told = -1, False
                    continue
                since = frames[-1] if since < 0 else since
                if not told and (frames[-1] - since) / fps >= cfg.still_time_s:
                    told = True
                    out.append((track, frames[-1], (frames[-1] - since) / fps))
            tracks[track] = ([frames, xs, ys, bodies], since, told)
        state.update(tuple(list(c) for c in zip(*((t, *window, since, told) for t, (window, since, told) in tracks.items()), strict=True)))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + 3_600_000)
        yield pd.DataFrame(out, columns=["tracklet_id", "frame_no", "still_s"])

    return rows.withWatermark("ts", "1 hour").groupBy(by).applyInPandasWithState(run, alert, kept, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into Parquet files, and read these."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def into_now(results: DataFrame, frames: DataFrame, late: str, period: str) -> DataFrame:
    """Results of a slow analysis, moved to where things are when they are ready.

    ``results``: key, taken and off_x, off_y (the frame that was analysed and the camera's running offset then), ready
    (time), x, y. ``frames``: key, frame_no, ts, off_x, off_y. A result meets the frame that is shown when it is
    ready, for ``period``, and moves by the difference of the offsets. Both sides have a watermark: results and frames that
    come later than ``late`` are dropped (and counted in the query's progress), and neither side is kept for longer.
    """
    r = results.withWatermark("ready", late).withColumnsRenamed({"off_x": "was_x", "off_y": "was_y"}).withColumnRenamed("key", "of")
    f = frames.withWatermark("ts", late)
    met = r.join(f, (F.col("of") == F.col("key")) & (F.col("ready") >= F.col("ts")) & (F.col("ready") < F.col("ts") + F.expr(f"interval {period}")))
    return met.select("key", "result_id", "taken", "frame_no", (F.col("x") + F.col("off_x") - F.col("was_x")).alias("x"), (F.col("y") + F.col("off_y") - F.col("was_y")).alias("y"))


class NewestSink:
    """A sink for ``foreachBatch`` that keeps the newest row of each key; a batch that is replayed changes nothing.

    A batch writes the newest of its own rows under its number, over what a failed attempt may have left. Every
    ``every`` batches a new generation begins with the newest rows of the last one, and the one before that is deleted.
    """

    def __init__(self, path: str, key: str, order: str, every: int = 16):
        self.path, self.key, self.order, self.every = path.rstrip("/"), key, order, every

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        gen = batch_id // self.every
        if batch_id % self.every == 0 and gen:
            conflated(self._read(batch.sparkSession, gen - 1), self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/{gen}/start")
            self._delete(batch.sparkSession, f"{self.path}/{gen - 2}")
        conflated(batch, self.key, self.order).write.mode("overwrite").parquet(f"{self.path}/{gen}/batch-{batch_id}")

    def _read(self, spark: SparkSession, gen: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{gen}/*")

    def _delete(self, spark: SparkSession, path: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    def newest(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The newest row of each key after batch ``batch_id``."""
        return conflated(self._read(spark, batch_id // self.every), self.key, self.order)


def run_into(stream: DataFrame, sink: NewestSink, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into a sink, and read what it keeps."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sink.newest(stream.sparkSession, max(p["batchId"] for p in q.recentProgress))
