"""A sink that keeps the newest rows, a paced source, and late results: replays, restarts, watermarks."""

import time
import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sightline.streaming import live
from sightline.streaming.paced import PacedReader, PacedSource


def rows(spark, data):
    return spark.createDataFrame(data, "k int, at int, v string")


def test_replayed_batches_change_nothing(spark, tmp_path):
    sink = live.NewestSink(f"file://{tmp_path}/newest", "k", "at", every=2)
    batches = [[(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (1, 2, "x")], [(2, 0, "old"), (3, 5, "d")], [(3, 6, "e")], [(1, 9, "f")], [(4, 1, "g")]]
    want = {}
    for n, data in enumerate(batches):
        # The first attempt wrote other rows before it failed; then the batch comes twice.
        sink(rows(spark, [(7, 99, "never")]), n)
        sink(rows(spark, data), n)
        sink(rows(spark, data), n)
        for k, at, v in data:
            if k not in want or at > want[k][0]:
                want[k] = (at, v)
        assert {r.k: (r.at, r.v) for r in sink.newest(spark, n).collect()} == want
    kept = {p.name for p in (tmp_path / "newest").iterdir()}
    assert kept == {"1", "2"}  # older generations are deleted


def test_empty_batches_are_kept(spark, tmp_path):
    sink = live.NewestSink(f"file://{tmp_path}/newest", "k", "at")
    sink(rows(spark, []), 0)
    sink(rows(spark, [(1, 1, "a")]), 1)
    assert [r.v for r in sink.newest(spark, 1).collect()] == ["a"]


def recording(tmp_path, n=50, files=3):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(files):
        own = [j for j in range(n) if j * files // n == i]
        pq.write_table(pa.table({"x": pa.array(own, pa.int64())}), f"{folder}/{i}.parquet", row_group_size=7)
    return str(folder)


def play(spark, path, root, **options):
    spark.dataSource.register(PacedSource)
    reader = spark.readStream.format("paced").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(processingTime="200 milliseconds").start()


def test_every_third_frame_of_two_laps(spark, tmp_path):
    q = play(spark, recording(tmp_path), str(tmp_path), fps=24, max_fps=8, laps=2)
    q.processAllAvailable()
    q.stop()
    got = sorted((r.lap, r.frame_no, r.x, r.looped) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(lap, f, f - 1, lap == 1 and f == 3) for lap in range(2) for f in range(3, 51, 3)]


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    path, options = recording(tmp_path), dict(fps=5, max_fps=5, laps=2, started=time.time())
    q = play(spark, path, str(tmp_path), **options)
    while not any(p["numInputRows"] for p in q.recentProgress):
        time.sleep(0.2)
    q.stop()
    early = spark.read.parquet(f"{tmp_path}/out").count()
    q = play(spark, path, str(tmp_path), **options)
    time.sleep(max(0.0, options["started"] + 100 / 5 + 1 - time.time()))
    q.processAllAvailable()
    q.stop()
    assert early < 100
    assert sorted((r.lap, r.frame_no) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(lap, f) for lap in range(2) for f in range(1, 51)]


def test_slow_reader_misses_older_frames(spark, tmp_path):
    reader = PacedReader({"path": recording(tmp_path), "fps": "25", "laps": "3", "most": "60"}, spark.createDataFrame([], "x bigint, frame_no bigint, lap int, looped boolean").schema)
    parts = reader.partitions({"played": 10}, reader.latestOffset())
    assert [(p.lap, p.first, p.last) for p in parts] == [(1, 40, 50), (2, 0, 50)]
    assert reader.partitions({"played": 30}, {"played": 30}) == []
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 60


def test_results_behind_the_watermark_are_dropped_and_counted(spark, tmp_path):
    # A batch drops what is behind the watermark of the batch before it, so the late row comes last.
    root = f"{tmp_path}/{uuid.uuid4().hex}"
    at = lambda c: F.timestamp_millis(F.col(c) + 86_400_000)
    frame = lambda ids: spark.createDataFrame([(1, f, f * 500, float(f), -float(f)) for f in ids], "key int, frame_no int, ms bigint, off_x double, off_y double").select("key", "frame_no", at("ms").alias("ts"), "off_x", "off_y")
    result = lambda data: spark.createDataFrame([(1, i, f, r, 10.0, 10.0, float(f), -float(f)) for i, f, r in data], "key int, result_id int, taken int, ms bigint, x double, y double, off_x double, off_y double").select("key", "result_id", "taken", at("ms").alias("ready"), "x", "y", "off_x", "off_y")
    for n, ids in enumerate([range(10), range(10, 20), [10_000], [10_001], [10_002]]):
        frame(ids).coalesce(1).write.parquet(f"{root}/f/{n}")
    for n, data in enumerate([[(1, 0, 1200), (2, 3, 2999)], [(3, 12, 6000)], [(9, 10_000, 5_000_100)], [(8, 10_000, 5_000_600)], [(4, 1, 1000)]]):
        result(data).coalesce(1).write.parquet(f"{root}/r/{n}")
    frames, results = (live.open_stream(spark, f"{root}/{d}/*", spark.read.parquet(f"{root}/{d}/0").schema) for d in "fr")
    q = live.into_now(results, frames, "10 seconds", "500 milliseconds").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [(1, 1, 0, 2, 12.0, 8.0), (1, 2, 3, 5, 12.0, 8.0), (1, 3, 12, 12, 10.0, 10.0), (1, 8, 10_000, 10_001, 11.0, 9.0), (1, 9, 10_000, 10_000, 10.0, 10.0)]
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) == 1
