"""Append-only review logs: tombstones, latest rows, partial updates, and overlays on events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live(log: DataFrame) -> DataFrame:
    """Rows that no tombstone anywhere in the log names; tombstones are no rows."""
    gone = log.filter("action = 'delete'").select(F.col("target_id").alias("annotation_id")).distinct()
    return log.filter("action IS NULL OR action <> 'delete'").join(gone, "annotation_id", "left_anti")


def latest_by(log: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last row of each key, by the log's own order."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def carried(log: DataFrame, key: str, fields: dict[str, str], order: str = "seq") -> DataFrame:
    """Partial updates: each row with the last non-null value so far of each field, or its start value."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = log
    for name, start in fields.items():
        out = out.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit(start)))
    return out


def overlay(events: DataFrame, verdicts: DataFrame, on: str) -> DataFrame:
    """Events with the state and note of their latest verdict; without one, unreviewed."""
    v = verdicts.select(on, F.col("state").alias("review_state"), F.col("note").alias("review_note"))
    return events.join(v, on, "left").withColumn("review_state", F.coalesce("review_state", F.lit("unreviewed")))


def remap_persons(events: DataFrame, person_of: DataFrame) -> DataFrame:
    """Events whose person and tracklet are known get the person that the tracklet has now."""
    p = person_of.select("run_id", "tracklet_id", F.col("person_id").alias("now_id"))
    j = events.join(p, ["run_id", "tracklet_id"], "left")
    return j.withColumn("person_id", F.when(F.col("person_id").isNotNull() & F.col("now_id").isNotNull(), F.col("now_id")).otherwise(F.col("person_id"))).drop("now_id")


def replace_category(events: DataFrame, category: str, recomputed: DataFrame) -> DataFrame:
    """Events without one category, and its recomputed events instead."""
    return events.filter(F.col("category") != category).unionByName(recomputed, allowMissingColumns=True)
