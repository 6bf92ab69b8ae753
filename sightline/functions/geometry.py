"""Positions, boxes and angles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def foot_x() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def body_height() -> Column:
    return F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))


def aspect() -> Column:
    return F.greatest((F.col("x1") - F.col("x0")) / body_height(), F.lit(0.0))


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def heading(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """The smaller angle between two headings, in [0, 180]."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d <= 180, d).otherwise(360 - d)


def upper_median(values: Column) -> Column:
    """The element behind the middle of a sorted array: of an even number of values, the larger of the two."""
    return F.array_sort(values)[(F.size(values) / 2).cast("int")]


def project(matrix: list[list[float]], x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a homography that is scaled to a last element of 1; null where the point is at infinity."""
    m = [[v / matrix[2][2] for v in row] for row in matrix]
    w = m[2][0] * x + m[2][1] * y + m[2][2]
    far = F.abs(w) < 1e-12
    px, py = m[0][0] * x + m[0][1] * y + m[0][2], m[1][0] * x + m[1][1] * y + m[1][2]
    return F.when(~far, px / w), F.when(~far, py / w)


def in_any_rect(x: Column, y: Column, rects: list[tuple[float, float, float, float]]) -> Column:
    """Whether a point is in one of the rectangles (x, y, w, h), edges included."""
    inside = F.lit(False)
    for rx, ry, rw, rh in rects:
        inside = inside | ((x >= rx) & (x <= rx + rw) & (y >= ry) & (y <= ry + rh))
    return inside


#: Names of the eight directions, from east by 45 degrees with y down.
DIRECTIONS = ["E", "SE", "S", "SW", "W", "NW", "N", "NE"]


def direction_name(dx: Column, dy: Column) -> Column:
    i = (F.pmod(F.degrees(F.atan2(dy, dx)) + 22.5, F.lit(360.0)) / 45).cast("int")
    return F.element_at(F.array(*map(F.lit, DIRECTIONS)), i + 1)


def clock(seconds: Column) -> Column:
    """[H:]MM:SS of whole seconds."""
    s = F.floor(seconds).cast("int")
    h, m = (s / 3600).cast("int"), ((s % 3600) / 60).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))
