"""Hard negatives against plain Python: small cells and blocks, ties, repeated rows, odd vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import negatives as N

COLUMNS = "vec_id bigint, embedding array<float>, label int, id string, score int, cell int, part int, search string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, la, "x", 1, 2, 3, "y", 4) for i, v, la in rows], COLUMNS)


def brute(rows, positives=5, negatives=10):
    fine = {}
    for i, v, la in rows:
        if i is not None and la is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[i, la, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  the shorter one ends in zeros
    out = []
    for a, label, v in fine:
        if a % 100:
            continue
        others = sorted((-dot(v, w), i, la) for i, la, w in fine if i != a)
        for p, i, _ in [x for x in others if x[2] == label][:positives]:
            near = [(s, j) for s, j, la in others if la != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(near, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(n, seed, d=6):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(d)] for _ in range(5)]
    return [(i, [r.gauss(c, 0.3) for c in centres[i % 5]], r.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("block", "leaf"), [(16_384, 128), (60, 8)])
def test_equals_brute_force(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N, "BLOCK_SEARCHES", 3)
    rows = clustered(700, 1)
    assert got(N.hard_negatives(table(spark, rows), F.col("id") % 100 == 0)) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    rows = clustered(90, 2)
    rows += [(100, None, 1), (200, [1.0] * 6, None), (300, [float("nan")] * 6, 1), (400, [1.0, None], 1), (500, [float("inf")] * 6, 2), (None, [1.0] * 6, 1)]
    rows += [(600, [0.0] * 6, 1), (700, [1e4] * 6, 1), (701, [1e4] * 6, 1), (702, [9e3] * 6, 2), (800, [1.0, 1.0], 3), (900, [], 3)]
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(80)]  # ties: one vector, two labels
    rows += [(1000, [0.5] * 6, 0)] * 3 + [(1100, [0.4] * 6, 0), (1100, [0.6] * 6, 1)]
    assert got(N.hard_negatives(table(spark, rows), F.col("id") % 100 == 0)) == brute(rows)


def test_large_numbers_are_exact():
    big = np.array([[3.0 * 2**40, 1.0], [2.0**40, 5.0]])
    assert N.dots(big, np.array([2.0**10, 1.0]), 2.0**53).tolist() == [3 * 2**50 + 1, 2**50 + 5]
    assert N.dots(big, np.array([2.0**50, 1.0]), 2.0**93).tolist() == [2**63 - 1] * 2


def test_empty_tables(spark):
    for rows in ([], [(100, None, 1)], [(100, [1.0], 1)], [(1, [1.0], 1), (2, [1.0], 2)]):
        assert N.hard_negatives(table(spark, rows), F.col("id") % 100 == 0).count() == 0


def test_walk_opens_few_leaves():
    """A search in clustered rows leaves most of the tree alone."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    centres = r.normal(0, 1, (40, 8))
    centres *= 3 / np.linalg.norm(centres, axis=1)[:, None]
    v = np.floor(256 * (np.repeat(centres, 200, axis=0) + r.normal(0, 0.1, (8000, 8))))
    space = N.Space(float((v**2).sum(1).max()), 8)
    rows = pa.table({"id": np.arange(8000), "label": np.arange(8000) % 3, "v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    block = N.Block(rows, space, leaf=128)
    score = v @ v[17]
    low, high = int(score.max() * 0.3), int(score.max() * 0.9)
    want = sorted((-int(s), i) for i, s in enumerate(score) if low <= s <= high and i % 3 != 17 % 3)[:10]
    assert block.best(v[17], 17, 17 % 3, False, low, high, 10) == [(i, -s) for s, i in want]
    assert block.opened < 4000
