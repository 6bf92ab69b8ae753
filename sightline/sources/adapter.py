"""Detection, tracklet, hazard and review tables made of the sample tables by fixed arithmetic.

Each user of ``events`` is a tracklet: its events in time order are the frames, its value and the
number in its properties the position. RUN_USERS neighbouring users are one video, so a video stays as large as it
is while the table grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 2.0
RUN_USERS = 16
BOX_W, BOX_H = 30.0, 80.0
SEGMENT_FRAMES = 40
#: Events that a task takes of the tracklets: its memory is that of so many rows, however large the table.
TASK_EVENTS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str, name: str = "events", rows: int | None = None) -> int:
    """How many tasks share a table at so many rows each. Row counts stand in the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // (rows or TASK_EVENTS)))


def run_of(user: str) -> Column:
    """The video of a user."""
    return F.expr(f"{user} div {RUN_USERS}")


def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, tracklet_id, frame_no, det_id, cls, conf, x0, y0, x1, y1, scene_segment."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    # Small shuffled columns are many rows, so parts are counted in rows and not in bytes.
    e = e.repartition(parts(spark, sf_dir), "user_id")
    scale = (F.col("user_id") % 4) * F.lit(0.5)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = e.select(
        run_of("user_id").alias("run_id"),
        F.col("user_id").alias("tracklet_id"),
        (F.row_number().over(order) - 1).alias("frame_no"),
        F.col("event_id").alias("det_id"),
        F.col("event_type").alias("cls"),
        ((F.col("event_id") % 100) / F.lit(100.0)).alias("conf"),
        (F.col("value") * scale).alias("fx"),
        (k * scale).alias("fy"),
    )
    return rows.select(
        "run_id", "tracklet_id", "frame_no", "det_id", "cls", "conf",
        (F.col("fx") - BOX_W / 2).alias("x0"), (F.col("fy") - BOX_H).alias("y0"), (F.col("fx") + BOX_W / 2).alias("x1"), F.col("fy").alias("y1"),
        F.expr(f"frame_no div {SEGMENT_FRAMES}").cast("int").alias("scene_segment"),
    )


TRACKLETS_SQL = f"""
trk AS (
  SELECT user_id // {RUN_USERS} AS run_id, user_id AS tracklet_id,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_no,
         event_id AS det_id, event_type AS cls, (event_id % 100) / 100.0::DOUBLE AS conf,
         value * ((user_id % 4) * 0.5::DOUBLE) AS fx,
         (props->>'$.k')::DOUBLE * ((user_id % 4) * 0.5::DOUBLE) AS fy
  FROM events
), tracklets AS (
  SELECT run_id, tracklet_id, frame_no, det_id, cls, conf, fx - 15 AS x0, fy - 80 AS y0, fx + 15 AS x1, fy AS y1,
         (frame_no // {SEGMENT_FRAMES})::INT AS scene_segment
  FROM trk
)"""


def hazard_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, frame_no, kind, present, area: one row for each frame and kind of hazard."""
    t = tracklets(spark, sf_dir)
    k, x = F.col("det_id") % 7, F.col("det_id") % 11
    kinds = F.array(
        F.struct(F.lit("fire").alias("kind"), (k >= 3).alias("present"), (k / F.lit(1000.0)).alias("area")),
        F.struct(F.lit("smoke").alias("kind"), (x >= 4).alias("present"), (x / F.lit(500.0)).alias("area")),
    )
    return t.select(F.col("tracklet_id").alias("stream_id"), "frame_no", F.inline(kinds))


HAZARD_SQL = """
hazards AS (
  SELECT tracklet_id AS stream_id, frame_no, 'fire' AS kind, det_id % 7 >= 3 AS present, (det_id % 7) / 1000.0::DOUBLE AS area FROM tracklets
  UNION ALL
  SELECT tracklet_id, frame_no, 'smoke', det_id % 11 >= 4, (det_id % 11) / 500.0::DOUBLE FROM tracklets
)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, embedding_method, vec_id: vectors dealt to detections by number."""
    n = table(spark, sf_dir, "embeddings").count()
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("det_id"))
    return e.select("det_id", F.when(F.col("det_id") % 5 == 0, "hsv").otherwise("osnet").alias("embedding_method"), (F.col("det_id") % n).alias("vec_id"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def verdict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, annotation_id, event_key, state, note, action, target_id: an append-only log with tombstones."""
    d = table(spark, sf_dir, "labels")
    rows = d.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("a"), F.col("doc_id")).alias("annotation_id"),
        (F.col("doc_id") % 97).alias("event_key"),
        F.when(F.col("toxic") == 1, F.lit(None)).when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("state"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("note "), F.col("doc_id"))).alias("note"),
        F.when(F.col("doc_id") % 11 == 0, "delete").alias("action"),
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("a"), (F.col("doc_id") / 2).cast("bigint"))).alias("target_id"),
    )
    return rows


VERDICTS_SQL = """
log AS (
  SELECT doc_id AS seq, 'a' || doc_id AS annotation_id, doc_id % 97 AS event_key,
         CASE WHEN toxic = 1 THEN NULL WHEN quality = 1 THEN 'confirmed' ELSE 'rejected' END AS state,
         CASE WHEN doc_id % 3 = 0 THEN 'note ' || doc_id END AS note,
         CASE WHEN doc_id % 11 = 0 THEN 'delete' END AS action,
         CASE WHEN doc_id % 11 = 0 THEN 'a' || (doc_id // 2) END AS target_id
  FROM labels
)"""
