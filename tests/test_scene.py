"""Transforms between frames: planted ones with two fifths of wrong matches, gates, inverses."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from sightline.operators import scene as S

MATCHES = "run int, frame_no int, match_id int, px double, py double, cx double, cy double"


def planted(frame, n, wrong, scale=1.0, turn=0.0, shift=(0.0, 0.0), seed=0):
    r, rows = random.Random(seed), []
    s = complex(scale * math.cos(turn), scale * math.sin(turn))
    for i in range(n):
        p = complex(r.uniform(0, 640), r.uniform(0, 480))
        c = complex(r.uniform(0, 640), r.uniform(0, 480)) if i < wrong * n else s * p + complex(*shift) + complex(r.gauss(0, 0.2), r.gauss(0, 0.2))
        rows.append((1, frame, i, p.real, p.imag, c.real, c.imag))
    return rows


def test_planted_transforms_are_found_among_wrong_matches(spark):
    cases = {1: (1.0, 0.0, (12.0, -7.0)), 2: (1.05, 0.03, (-30.0, 20.0)), 3: (0.9, -0.1, (80.0, 4.0))}
    rows = [x for f, (scale, turn, shift) in cases.items() for x in planted(f, 120, 0.4, scale, turn, shift, f)]
    rows += planted(4, 7, 0.0, seed=4)  # too few
    rows += planted(5, 60, 1.0, seed=5)  # all wrong
    rows += planted(6, 60, 0.0, 3.0, seed=6)  # too large a change
    rows += planted(7, 60, 0.0, shift=(500.0, 0.0), seed=7)  # too far
    rows += [(1, 8, i, 5.0, 5.0, 6.0, 6.0) for i in range(20)]  # one place
    rows += [(1, 1, 900, float("nan"), 0.0, 0.0, 0.0), (1, 1, 901, None, 0.0, 0.0, 0.0), (1, 9, 1, float("inf"), 0.0, 0.0, 0.0)]
    got = {r.frame_no: r for r in S.pairwise_transforms(spark.createDataFrame(rows, MATCHES), ["run"], 640.0, 480.0).collect()}
    assert set(got) == set(range(1, 9))
    for f, (scale, turn, shift) in cases.items():
        m = np.array(got[f].pairwise).reshape(3, 3)
        want = np.array([[scale * math.cos(turn), -scale * math.sin(turn), shift[0]], [scale * math.sin(turn), scale * math.cos(turn), shift[1]], [0, 0, 1]])
        assert np.abs(m - want)[:, :2].max() < 2e-3 and np.abs(m - want)[:2, 2].max() < 0.6
        assert 70 <= got[f].agreeing <= 76 and got[f].points == 120 and 0.5 < got[f].confidence < 0.64
    assert all(got[f].pairwise is None and got[f].confidence == 0 for f in (4, 5, 6, 7, 8))
    assert S.pairwise_transforms(spark.createDataFrame([], MATCHES), ["run"], 640.0, 480.0).count() == 0


def test_inverse_times_matrix_is_the_identity(spark):
    r = random.Random(1)
    rows = [([r.uniform(-2, 2) for _ in range(8)] + [1.0],) for _ in range(50)] + [([1.0, 2.0, 3.0, 2.0, 4.0, 6.0, 0.0, 0.0, 1.0],), (None,)]
    out = spark.createDataFrame(rows, "m array<double>").withColumn("i", S.inverse(F.col("m"))).collect()
    for x in out[:50]:
        assert np.allclose(np.array(x.i).reshape(3, 3) @ np.array(x.m).reshape(3, 3), np.eye(3), atol=1e-6)
    assert out[50].i is None and out[51].i is None
