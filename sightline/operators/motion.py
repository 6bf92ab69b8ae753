"""Sequential filters over a stream's frames: transforms, averages, boxes, hysteresis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .islands import replay


def ema(df: DataFrame, keys: list[str], order: str, value: str, alpha: float, seeded: bool = True) -> DataFrame:
    """Exponential moving average of ``value``: ``alpha`` is the new value's weight; null values leave it as it is.

    ``seeded``: it starts with the first value, else with 0.
    """

    def step(s, row):
        v = row.v
        if v is not None and not math.isnan(v):
            s["m"] = v if s["m"] is None else (1 - alpha) * s["m"] + alpha * v
        return [s["m"]]

    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{order} {types[order]}", "ema double"])
    return replay(df.withColumn("v", F.col(value)), keys, order, lambda: {"m": None if seeded else 0.0}, step, schema, ["v"])


#: Fixed value: a shift of so much of the width, sideways or up and down, is a mistake.
MOST_SHIFT = 0.25


def offsets(df: DataFrame, keys: list[str], order: str, limit: float) -> DataFrame:
    """Running sums of camera shifts; a shift of ``limit`` or more is a mistake and counts 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sane = (F.abs("shift_x") < limit) & (F.abs("shift_y") < limit)
    return df.withColumn("off_x", F.sum(F.when(sane, F.col("shift_x")).otherwise(0.0)).over(w)).withColumn("off_y", F.sum(F.when(sane, F.col("shift_y")).otherwise(0.0)).over(w))


def hysteresis(df: DataFrame, keys: list[str], order: str, threshold: float) -> DataFrame:
    """A point that stays until the proposed one (px, py) is more than ``threshold`` away."""

    def step(s, row):
        if s["p"] is None or math.dist(s["p"], (row.px, row.py)) > threshold:
            s["p"] = (row.px, row.py)
        return list(s["p"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{order} {types[order]}", "x double", "y double"])
    return replay(df, keys, order, lambda: {"p": None}, step, schema, ["px", "py"])


#: The box filter's times (seconds) for place and size, its most speed (box sizes a second), its least size.
TAU_POS, TAU_SIZE, SLEW, LEAST_SIZE = 0.12, 0.18, 3.0, 8.0


def smooth_boxes(df: DataFrame, keys: list[str], order: str, fps: float, tau_pos: float = TAU_POS, tau_size: float = TAU_SIZE, slew: float = SLEW) -> DataFrame:
    """Boxes (cx, cy, w, h) smoothed by the time that passed, with a bound on speed in box sizes a second."""

    def step(s, row):
        t, box = getattr(row, order) / fps, [row.cx, row.cy, row.w, row.h]
        if s["box"] is None:
            s["box"] = box
        elif (dt := t - s["t"]) > 0:
            most = slew * max(s["box"][2], s["box"][3], LEAST_SIZE) * dt
            rate = [1 - math.exp(-dt / tau) for tau in (tau_pos, tau_pos, tau_size, tau_size)]
            s["box"] = [b + max(-most, min(most, a * (n - b))) for a, b, n in zip(rate, s["box"], box, strict=True)]
        s["t"] = t
        return list(s["box"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{order} {types[order]}", "sx double", "sy double", "sw double", "sh double"])
    return replay(df, keys, order, lambda: {"box": None, "t": None}, step, schema, [order, "cx", "cy", "w", "h"])


def scene_transforms(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Cumulative homographies of pairwise ones (``pairwise``: 9 numbers by rows, null: lost): segment, and the product.

    A frame without one begins a new segment at the identity.
    """

    def step(s, row):
        import numpy as np

        p = row.pairwise
        if s["m"] is None:
            s["m"] = np.eye(3)
        elif p is None or len(p) != 9:
            s["m"], s["segment"] = np.eye(3), s["segment"] + 1
        else:
            s["m"] = np.array(p, float).reshape(3, 3) @ s["m"]
        return [s["segment"], s["m"].ravel().tolist()]

    types = dict(df.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), f"{order} {types[order]}", "segment int", "to_scene array<double>"])
    return replay(df, keys, order, lambda: {"m": None, "segment": 0}, step, schema, ["pairwise"])


#: Fixed value: how far neighbouring tiles overlap.
OVERLAP = 0.15


def tile_grid(pictures: DataFrame, n: int, overlap: float = OVERLAP) -> DataFrame:
    """Each picture's (width, height) n x n equal tiles, spread evenly from edge to edge: tile_x, tile_y, x0, y0, x1, y1."""
    grid = pictures.withColumn("tile_y", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("tile_x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for side, at, lo, hi in ("width", "tile_x", "x0", "x1"), ("height", "tile_y", "y0", "y1"):
        size = F.bround(F.col(side) / F.lit(n - (n - 1) * overlap)).cast("int")
        grid = grid.withColumn(lo, F.bround(F.col(at) * (F.col(side) - size) / F.lit(float(max(n - 1, 1)))).cast("int"))
        grid = grid.withColumn(hi, F.least(F.col(side), F.col(lo) + size))
    return grid


def suppress(boxes: DataFrame, keys: list[str], iou: float = 0.5) -> DataFrame:
    """Non-maximum suppression in each group (a frame): boxes by falling score, then by id; one that overlaps a kept box by more than ``iou`` goes."""
    # A group's boxes are one list, which goes through a fold: no Python call for each of very many small groups.
    unknown = F.col("score").isNull() | F.isnan("score")
    row = F.struct(unknown.alias("unknown"), (-F.col("score")).alias("falling"), "box_id", F.struct(*boxes.columns).alias("row"))
    ordered = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("all"))
    area = lambda b: F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))
    total = lambda b: b["x0"] + b["y0"] + b["x1"] + b["y1"]

    def covers(a, b):
        w, h = (F.least(a[f"{c}1"], b[f"{c}1"]) - F.greatest(a[f"{c}0"], b[f"{c}0"]) for c in "xy")
        both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
        # A box without a place goes with any that is kept, and any goes with it.
        return F.isnan(total(a) + total(b)) | (total(a) + total(b)).isNull() | (both / F.greatest(area(a) + area(b) - both, F.lit(1e-9)) > iou)

    fold = F.aggregate("all", F.slice("all", 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: covers(k["row"], b["row"])), kept).otherwise(F.concat(kept, F.array(b))))
    return ordered.select(F.explode(fold).alias("b")).select("b.row.*")
