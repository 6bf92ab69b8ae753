"""Matching by time: band joins, greedy one-to-one matching, nearest and interval lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_join(a: DataFrame, b: DataFrame, on: list[str], ta: str, tb: str, tol: float) -> DataFrame:
    """Pairs with equal ``on`` columns and |tb - ta| <= tol. Times are binned, and ``b`` looks into three
    bins, so the join is on equal keys."""
    if tol <= 0:
        return a.join(b.withColumn(ta, F.col(tb)), [*on, ta])
    left = a.withColumn("__bin", F.floor(F.col(ta) / tol))
    right = b.withColumn("__bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(tb) / tol) + d)))
    return left.join(right, [*on, "__bin"]).filter(F.abs(F.col(tb) - F.col(ta)) <= tol).drop("__bin")


def greedy_match(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one pairs of (a_id, b_id, delta, tb): the smallest delta first, then a_id, tb, b_id.

    Each group of ``keys`` (a run or category: a human's notes on one video) is settled in one task.
    """
    cols = [*keys, "a_id", "b_id", "delta", "tb"]

    def settle(pdf):
        left, right, keep = set(), set(), []
        pdf = pdf.sort_values(["delta", "a_id", "tb", "b_id"])
        for a, b in zip(pdf["a_id"], pdf["b_id"], strict=True):
            free = a not in left and b not in right
            keep.append(free)
            if free:
                left.add(a), right.add(b)
        return pdf[keep]

    c = candidates.select(*cols)
    return c.groupBy(*keys).applyInPandas(settle, c.schema)


def match_report(a: DataFrame, b: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Rows of ``a`` (keys, a_id, ta) and ``b`` (keys, b_id, tb) as bucket both, a_only or b_only."""
    pairs = greedy_match(band_join(a, b, keys, "ta", "tb", tol).withColumn("delta", F.abs(F.col("tb") - F.col("ta"))), keys)
    no_a, no_b = F.lit(None).cast(a.schema["a_id"].dataType).alias("a_id"), F.lit(None).cast(b.schema["b_id"].dataType).alias("b_id")
    no_delta = F.lit(None).cast("double").alias("delta")
    both = pairs.select(*keys, F.lit("both").alias("bucket"), "a_id", "b_id", "delta")
    a_only = a.join(pairs, [*keys, "a_id"], "left_anti").select(*keys, F.lit("a_only").alias("bucket"), "a_id", no_b, no_delta)
    b_only = b.join(pairs, [*keys, "b_id"], "left_anti").select(*keys, F.lit("b_only").alias("bucket"), no_a, "b_id", no_delta)
    return both.unionByName(a_only).unionByName(b_only)


def nearest_frame(frames: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """For each asked (on, ask_id, t): the frame whose t is nearest, the earlier of two equally near.

    Both sides are put in one order; the nearest is the last before or the first behind, so
    nothing is joined pair by pair.
    """
    f = frames.select(*on, F.col("t").alias("t"), F.struct(F.col("t"), F.col("frame_no")).alias("frame"), F.lit(None).cast("bigint").alias("ask_id"))
    q = asked.select(*on, "t", F.lit(None).cast(f.schema["frame"].dataType).alias("frame"), F.col("ask_id").cast("bigint"))
    w = Window.partitionBy(*on).orderBy("t", F.col("ask_id").isNotNull())
    u = f.unionByName(q).withColumn("before", F.last("frame", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "after", F.first("frame", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    )
    u = u.filter("ask_id IS NOT NULL")
    take_after = F.col("before").isNull() | (F.col("after.t") - F.col("t") < F.col("t") - F.col("before.t"))
    best = F.when(F.coalesce(take_after, F.lit(False)), F.col("after")).otherwise(F.col("before"))
    return u.select(*on, "ask_id", "t", best["frame_no"].alias("frame_no"))


def review_for(events: DataFrame, old: DataFrame) -> DataFrame:
    """Carry reviews forward: for each event the old event of its tracklet that overlaps it, else any; of
    these the one whose start is nearest, then the first."""
    j = events.join(old, ["run_id", "tracklet_id"])
    overlap = (F.col("t_start") <= F.col("old_end")) & (F.col("old_start") <= F.col("t_end"))
    rank = F.row_number().over(Window.partitionBy("run_id", "event_id").orderBy((~overlap).cast("int"), F.abs(F.col("old_start") - F.col("t_start")), "old_seq"))
    return j.withColumn("rank", rank).filter("rank = 1").select("run_id", "event_id", "old_id", "review_state")


def overlap_warnings(persons: DataFrame) -> DataFrame:
    """Pairs of persons of a run whose closed spans overlap."""
    a, b = persons.alias("a"), persons.alias("b")
    met = (F.col("a.person_id") < F.col("b.person_id")) & (F.col("a.first_seen") <= F.col("b.last_seen")) & (F.col("b.first_seen") <= F.col("a.last_seen"))
    return a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & met).select(F.col("a.run_id").alias("run_id"), F.col("a.person_id").alias("person_a"), F.col("b.person_id").alias("person_b"))


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of two configurations (key, value) whose values differ, nulls equal to null."""
    left, right = a.select("key", F.col("value").alias("value_a")), b.select("key", F.col("value").alias("value_b"))
    return left.join(right, "key", "full_outer").filter(~F.col("value_a").eqNullSafe(F.col("value_b")))
