"""What a running picture shows: trails, totals, the camera's drift, and the record for each frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Points of a trail, seconds after which a person counts.
TRAIL, COUNTS_AFTER_S = 24, 2.0


def trails(points: DataFrame, keys: list[str], order: str, most: int = TRAIL) -> DataFrame:
    """Each row with the last ``most`` points up to it, oldest first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(most - 1), 0)
    return points.withColumn("trail", F.collect_list(F.struct("x", "y")).over(w))


def unique_totals(points: DataFrame, keys: list[str], fps: float, after_s: float = COUNTS_AFTER_S) -> DataFrame:
    """For each key how many tracks have been seen for ``after_s`` or longer, and how many at all."""
    life = points.groupBy(*keys, "tracklet_id").agg(((F.max("frame_no") - F.min("frame_no")) / F.lit(fps)).alias("life"))
    return life.groupBy(*keys).agg(F.count_if(F.col("life") >= after_s).alias("unique_count"), F.count(F.lit(1)).alias("seen"))


def signal_totals(fired: DataFrame, keys: list[str]) -> DataFrame:
    """For each frame with fired tracks: how many fire now, and how many different ones have so far.

    A track adds to the total at its first fired frame, so the total is a running sum of firsts.
    """
    now = fired.groupBy(*keys, "frame_no").agg(F.countDistinct("tracklet_id").alias("now"))
    firsts = fired.groupBy(*keys, "tracklet_id").agg(F.min("frame_no").alias("frame_no")).groupBy(*keys, "frame_no").agg(F.count(F.lit(1)).alias("new"))
    w = Window.partitionBy(*keys).orderBy("frame_no")
    return now.join(firsts, [*keys, "frame_no"], "left").withColumn("total", F.sum(F.coalesce("new", F.lit(0))).over(w)).drop("new")


def to_stable(points: DataFrame) -> DataFrame:
    """Screen positions without the camera's offset, and back: stable_x, stable_y, screen_x, screen_y."""
    out = points.withColumn("stable_x", F.col("x") - F.col("off_x")).withColumn("stable_y", F.col("y") - F.col("off_y"))
    return out.withColumn("screen_x", F.col("stable_x") + F.col("off_x")).withColumn("screen_y", F.col("stable_y") + F.col("off_y"))


def records(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON text for each frame: its persons by number, each with its class."""
    people = F.array_sort(F.collect_list(F.struct(F.col("tracklet_id").alias("id"), "cls")))
    return boxes.groupBy(*keys, "frame_no").agg(people.alias("persons")).select(*keys, "frame_no", F.to_json(F.struct(F.lit(1).alias("v"), "frame_no", "persons")).alias("record"))
