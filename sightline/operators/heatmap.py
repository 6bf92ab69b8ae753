"""Dwell heatmaps and trajectory views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

GRID = 48


def raw_heatmap(tracklets: DataFrame, fps: float, width: float, height: float, grid_w: int = GRID) -> DataFrame:
    """Seconds of presence for each run and cell of the picture; feet outside fall into the edge cells."""
    grid_h = max(1, round(grid_w * height / width))
    cell = lambda v, size, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v / size * n).cast("int")))
    cells = tracklets.select("run_id", cell(G.foot_x(), width, grid_w).alias("gx"), cell(F.col("y1"), height, grid_h).alias("gy"))
    return cells.groupBy("run_id", "gx", "gy").agg((F.count(F.lit(1)) / F.lit(fps)).alias("seconds"))


def heatmap_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("run_id").agg(F.round(F.max("seconds"), 3).alias("max_s"), F.round(F.sum("seconds"), 3).alias("total_s"))


def scene_heatmap(tracklets: DataFrame, fps: float, grid_w: int = GRID) -> DataFrame:
    """Seconds of presence for each run, scene segment and cell: centre x and y, width and height of the cell, and
    the segment's bounds.

    Reads ``scene_x`` and ``scene_y``; rows without them have no place. Each segment's own extent, at least 1 wide
    and high, has ``grid_w`` columns and as many rows as make the cells about square.
    """
    p = tracklets.filter("scene_x IS NOT NULL AND scene_y IS NOT NULL").select("run_id", "scene_segment", F.col("scene_x").alias("x"), F.col("scene_y").alias("y"))
    extent = p.groupBy("run_id", "scene_segment").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    span_x, span_y = F.greatest(F.col("max_x") - F.col("min_x"), F.lit(1.0)), F.greatest(F.col("max_y") - F.col("min_y"), F.lit(1.0))
    # bround: halves to the even number.
    extent = extent.withColumn("rows", F.greatest(F.lit(1), F.bround(F.lit(float(grid_w)) * span_y / span_x).cast("int")))
    extent = extent.withColumn("width", span_x / grid_w).withColumn("height", span_y / F.col("rows"))
    j = p.join(extent, ["run_id", "scene_segment"])
    cell = lambda v, low, size, n: F.least(n - 1, F.floor((F.col(v) - F.col(low)) / F.col(size)).cast("int"))
    placed = j.withColumn("gx", cell("x", "min_x", "width", F.lit(grid_w))).withColumn("gy", cell("y", "min_y", "height", F.col("rows")))
    cells = placed.groupBy("run_id", "scene_segment", "gx", "gy", "min_x", "min_y", "max_x", "max_y", "width", "height").agg(F.count(F.lit(1)).alias("n"))
    at = lambda low, g, size: F.round(F.col(low) + (F.col(g) + 0.5) * F.col(size), 4)
    return cells.select(
        "run_id", "scene_segment", at("min_x", "gx", "width").alias("x"), at("min_y", "gy", "height").alias("y"), F.round("width", 4).alias("width"), F.round("height", 4).alias("height"),
        F.round(F.col("n") / F.lit(fps), 3).alias("seconds"), *(F.round(c, 4).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")),
    )


def downsample(tracklets: DataFrame, keys: list[str], max_points: int) -> DataFrame:
    """Every n-th point in (frame, tracklet) order, n as small as leaves at most max_points of each key."""
    w = Window.partitionBy(*keys)
    r = F.row_number().over(w.orderBy("frame_no", "tracklet_id")) - 1
    stride = F.ceil(F.count(F.lit(1)).over(w) / F.lit(max_points))
    return tracklets.withColumn("__r", r).withColumn("__n", stride).filter("__r % __n = 0").drop("__r", "__n")
