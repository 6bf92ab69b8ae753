"""How the picture moved between two frames, from matched points of which many may be wrong; inverses of transforms.

A turn, scale and shift is one complex factor and one complex addend, so two matches make a hypothesis. A fixed number of seeded
hypotheses of each frame meet its points in a join, the one that most points agree with wins, and its points
are fitted by least squares, all as aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Pixels within which a point agrees; least points, agreeing points and their share; bounds of the change of area and
#: of the shift as a share of the picture; error at which the confidence is 0.
NEAR, LEAST_POINTS, LEAST_SHARE, LEAST_AREA, MOST_AREA, MOST_SHIFT, NO_CONFIDENCE = 3.0, 8, 0.35, 0.25, 4.0, 0.75, 6.0
TRIES, SEED = 48, 42


def _misses(s: str, t: str) -> Column:
    """How far a point's image is from its match."""
    x = F.col(f"{s}r") * F.col("px") - F.col(f"{s}i") * F.col("py") + F.col(f"{t}x") - F.col("cx")
    y = F.col(f"{s}i") * F.col("px") + F.col(f"{s}r") * F.col("py") + F.col(f"{t}y") - F.col("cy")
    return F.sqrt(x * x + y * y)


def pairwise_transforms(matches: DataFrame, keys: list[str], width: float, height: float, tries: int = TRIES, seed: int = SEED) -> DataFrame:
    """For each frame (the keys and frame_no) of ``matches`` (match_id, px, py before, cx, cy now): points, agreeing, confidence and
    ``pairwise``, 9 numbers by rows; null with confidence 0 if too few points agree or the change is not plausible.

    Matches with null or non-finite places take no part; frames without any have no row.
    """
    at, finite = [*keys, "frame_no"], F.lit(True)
    for c in ("px", "py", "cx", "cy"):
        finite = finite & F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) & ~F.isnan(c)
    listed = matches.filter(finite).groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("match_id", "px", "py", "cx", "cy"))).alias("all"))
    # A frame's matches are bounded by what a tracker follows.
    n, f = F.size("all"), F.col("frame_no").cast("bigint")
    a = F.pmod(F.col("h") * 40503 + f * 2531 + seed, F.greatest(n, F.lit(1)))
    b = F.pmod(a + 1 + F.pmod(F.col("h") * 30011 + f * 7919, F.greatest(n - 1, F.lit(1))), F.greatest(n, F.lit(1)))
    hyp = listed.filter(n >= LEAST_POINTS).withColumn("h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tries - 1).cast("bigint"))))
    hyp = hyp.select(*at, "h", F.col("all")[a.cast("int")].alias("a"), F.col("all")[b.cast("int")].alias("b"))
    dx, dy, ex, ey = (F.col(f"b.{c}") - F.col(f"a.{c}") for c in ("px", "py", "cx", "cy"))
    size = dx * dx + dy * dy
    hyp = hyp.filter(size > 0).withColumn("sr", F.try_divide(dx * ex + dy * ey, size)).withColumn("si", F.try_divide(dx * ey - dy * ex, size))
    hyp = hyp.select(*at, "h", "sr", "si", (F.col("a.cx") - F.col("sr") * F.col("a.px") + F.col("si") * F.col("a.py")).alias("tx"), (F.col("a.cy") - F.col("si") * F.col("a.px") - F.col("sr") * F.col("a.py")).alias("ty"))
    hyp = written(hyp, "hypotheses")  # or each use would write its arithmetic out again
    points = listed.select(*at, F.inline("all"))
    votes = hyp.join(points, at).filter(_misses("s", "t") <= NEAR).groupBy(*at, "h").agg(F.count(F.lit(1)).alias("agree"))
    best = votes.groupBy(*at).agg(F.max(F.struct("agree", (-F.col("h")).alias("h"))).alias("w")).select(*at, (-F.col("w.h")).alias("h"))
    own = points.join(hyp.join(best, [*at, "h"]), at).filter(_misses("s", "t") <= NEAR).select(*at, "px", "py", "cx", "cy")
    fit = own.groupBy(*at).agg(*[F.avg(c).alias(f"m{c}") for c in ("px", "py", "cx", "cy")])
    near = own.join(fit, at)
    p, q, u, v = (F.col(c) - F.col(f"m{c}") for c in ("px", "py", "cx", "cy"))
    sums = near.groupBy(*at).agg(F.sum(p * u + q * v).alias("re"), F.sum(p * v - q * u).alias("im"), F.sum(p * p + q * q).alias("size"), *[F.first(f"m{c}").alias(f"m{c}") for c in ("px", "py", "cx", "cy")])
    sums = sums.withColumn("fr", F.try_divide("re", "size")).withColumn("fi", F.try_divide("im", "size"))
    sums = sums.select(*at, "fr", "fi", (F.col("mcx") - F.col("fr") * F.col("mpx") + F.col("fi") * F.col("mpy")).alias("gx"), (F.col("mcy") - F.col("fi") * F.col("mpx") - F.col("fr") * F.col("mpy")).alias("gy"))
    errors = own.join(sums, at).groupBy(*at, "fr", "fi", "gx", "gy").agg(F.count(F.lit(1)).alias("agreeing"), F.median(_misses("f", "g")).alias("error"))
    out = listed.select(*at, n.alias("points")).join(errors, at, "left").withColumn("agreeing", F.coalesce("agreeing", F.lit(0).cast("bigint")))
    share, area = F.col("agreeing") / F.col("points"), F.col("fr") ** 2 + F.col("fi") ** 2
    fair = (F.col("agreeing") >= LEAST_POINTS) & (share >= LEAST_SHARE) & area.between(LEAST_AREA, MOST_AREA) & (F.abs("gx") <= MOST_SHIFT * width) & (F.abs("gy") <= MOST_SHIFT * height)
    fair = F.coalesce(fair, F.lit(False))
    matrix = F.array(F.col("fr"), -F.col("fi"), F.col("gx"), F.col("fi"), F.col("fr"), F.col("gy"), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    return out.select(*at, "points", "agreeing", F.when(fair, share * F.greatest(F.lit(0.0), 1 - F.col("error") / NO_CONFIDENCE)).otherwise(0.0).alias("confidence"), F.when(fair, matrix).alias("pairwise"))


def inverse(matrix: Column) -> Column:
    """The inverse of 9 numbers by rows; null where there is none."""
    m = [matrix[i] for i in range(9)]
    minor = lambda i, j, k, n: m[i] * m[j] - m[k] * m[n]
    cofactors = [minor(4, 8, 5, 7), minor(2, 7, 1, 8), minor(1, 5, 2, 4), minor(5, 6, 3, 8), minor(0, 8, 2, 6), minor(2, 3, 0, 5), minor(3, 7, 4, 6), minor(1, 6, 0, 7), minor(0, 4, 1, 3)]
    det = m[0] * cofactors[0] + m[1] * cofactors[3] + m[2] * cofactors[6]
    return F.when(F.abs(det) > 1e-12, F.array(*[F.try_divide(c, det) for c in cofactors]))
