"""Settings, identifiers and times as texts: checks and readable forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What switches read as on and off.
ON, OFF = ("1", "true", "on", "yes"), ("0", "false", "off", "no")
#: Frame rates outside this range are taken for broken headers.
LEAST_FPS, MOST_FPS, DEFAULT_FPS = 1.0, 120.0, 25.0
#: A crop smaller than this many pixels a side is ignored; a tracker remembers at least so many frames.
LEAST_CROP, LEAST_BUFFER, BUFFER_S = 32, 30, 8
HASHED_BYTES = 1_000_000


def flag(text: Column, default: bool) -> Column:
    """A switch; texts that are neither on nor off, and nulls, give the default."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*ON), F.lit(True)).when(t.isin(*OFF), F.lit(False)).otherwise(F.lit(default))


def usable_fps(fps: Column) -> Column:
    return F.when(fps.between(LEAST_FPS, MOST_FPS), fps).otherwise(F.lit(DEFAULT_FPS))


def track_buffer(fps: Column) -> Column:
    """Frames that a lost track is remembered for."""
    return F.greatest(F.lit(LEAST_BUFFER), (fps * BUFFER_S).cast("int"))


def content_hash(content: Column) -> Column:
    """The hash of a file's first bytes."""
    return F.sha2(F.substring(content, 1, HASHED_BYTES), 256)


def valid_id(text: Column, longest: int = 64) -> Column:
    return F.coalesce(F.rlike(text, F.lit(f"^[A-Za-z0-9_-]{{1,{longest}}}$")), F.lit(False))


def rect(text: Column, least: float = 0.05) -> Column:
    """``x,y,w,h`` in shares of the picture as a struct; null unless it lies in the picture and is large enough."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    x, y, w, h = (F.get(parts, F.lit(i)) for i in range(4))
    size = w.between(least, 1.0) & h.between(least, 1.0)
    inside = (x >= 0) & (x < 1) & (y >= 0) & (y < 1) & (x + w <= 1.0001) & (y + h <= 1.0001)
    return F.when((F.size(parts) == 4) & size & inside, F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))


def rects(text: Column, least: float = 0.01) -> Column:
    """The valid rectangles of a list with semicolons, in order; empty parts count for nothing."""
    parts = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")
    return F.filter(F.transform(parts, lambda p: rect(p, least)), lambda r: r.isNotNull())


def crop(width: Column, height: Column, x: float, y: float, w: float, h: float) -> Column:
    """The pixels x0, y0, x1, y1 that a crop leaves of a picture: the whole picture if the crop is too small."""
    x0, y0 = (F.lit(x) * width).cast("int"), (F.lit(y) * height).cast("int")
    x1, y1 = F.least(width, (F.lit(x + w) * width).cast("int")), F.least(height, (F.lit(y + h) * height).cast("int"))
    small = (x1 - x0 < LEAST_CROP) | (y1 - y0 < LEAST_CROP)
    whole = F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), width.cast("int").alias("x1"), height.cast("int").alias("y1"))
    return F.when(small, whole).otherwise(F.struct(x0.alias("x0"), y0.alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1")))


def clock_text(seconds: Column) -> Column:
    """``M:SS``, with hours ``H:MM:SS``; halves go to the even second, negative times to 0."""
    total = F.bround(F.greatest(seconds, F.lit(0.0))).cast("int")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def escaped(text: Column) -> Column:
    """Text that is safe in HTML."""
    for a, b in ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def frame_seed(seed: int, pass_name: str, frame_no: Column) -> Column:
    """A number of 64 bits for each frame that depends on nothing before it, as decimal(20,0)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:{pass_name}:"), frame_no.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
