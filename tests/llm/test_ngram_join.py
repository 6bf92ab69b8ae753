"""The n-gram join against plain Python: odd rows, ties, groups of copies, small cells; its R-trees by themselves."""

import random

import numpy as np
import pytest

from sightline.llm import ngram_join as J
from tests.llm.test_dedup import components, corpus

COLUMNS = "doc_id bigint, text string, class string, label int, token int, code string, groups int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3) for i, t in rows], COLUMNS)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.select("doc_id", "n_shingles", "component_id").collect())


ODD = [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "one"), (906, "a b c d e f " * 9), (907, "a b c d e f " * 400), (908, "x " * 60_000)]


@pytest.mark.parametrize(("width", "cell", "first"), [(4, 4096, 6), (5, 9, 1)])
def test_join_equals_brute_force(spark, monkeypatch, width, cell, first):
    monkeypatch.setattr(J, "CELL", cell)
    monkeypatch.setattr(J, "FIRST_TOKENS", first)
    monkeypatch.setattr(J, "FREQUENT_IN", 5)
    rows = [*corpus(width + 20), *ODD]
    assert got(J.jaccard_join(table(spark, rows), width)) == [x[:3] for x in components(rows, width)]


def test_threshold_is_exact(spark):
    """Sets of 10 with 8 in common of 12, and of 9 with 8 in common of 10: by single words."""
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:10])), (2, " ".join(words[2:12])), (11, " ".join(words[20:29])), (12, " ".join(words[21:30])), (13, " ".join(words[20:29] * 3))]
    assert got(J.jaccard_join(table(spark, rows), 1)) == [x[:3] for x in components(rows, 1)] == [(1, 10, 1), (2, 10, 2), (11, 9, 11), (12, 9, 11), (13, 9, 11)]


def test_join_of_repeated_rows_and_null_ids(spark):
    t = "these five words and some more of them"
    rows = [(3, t), (3, t), (None, t), (None, None), (7, t.upper()), (None, "alone as a text can be")]
    out = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.jaccard_join(table(spark, rows)).collect())
    assert out == sorted([("3", 4, "3")] * 2 + [("None", 4, "3"), ("None", 0, "None"), ("7", 4, "3"), ("None", 2, "None")])
    assert J.jaccard_join(table(spark, [])).count() == 0


def test_forest_finds_all_pairs_and_prunes():
    r = np.random.default_rng(2)
    centres = r.poisson(4, (38, J.GROUPS))
    counts = np.repeat(centres, 48, axis=0).astype(np.uint8)
    counts[np.arange(len(counts)), r.integers(0, J.GROUPS, len(counts))] += 1
    size, label = counts.sum(axis=1).astype(np.int64), np.arange(len(counts))
    cell = (label >= 912).astype(int)
    forest = J.Forest(cell, size, counts, label, 80)
    level, node = forest.roots()
    starts = {int(k): (node[level == k], node[level == k]) for k in np.unique(level)}
    found = {(int(x), int(y)) for a, b in forest.join(starts) for x, y in zip(a, b, strict=True)}
    common = np.minimum(counts[:, None].astype(int), counts[None]).sum(axis=2)
    ok = (180 * common >= 80 * (size[:, None] + size[None])) & (100 * size[:, None] >= 80 * size[None]) & (100 * size[None] >= 80 * size[:, None]) & (cell[:, None] == cell[None])
    want = {(int(x), int(y)) for x, y in zip(*np.nonzero(ok), strict=True) if x < y}
    assert {(min(p), max(p)) for p in found} == want and len(found) == len(want)
    assert forest.looked < 912 * 912 / 8
    # Pairs of one label are left alone.
    forest = J.Forest(cell, size, counts, label // 48, 80)
    assert not list(forest.join(starts))


def test_prefixes_share_a_token():
    """Whatever tokens are called frequent, two sets at the threshold share one of their first tokens."""
    r = random.Random(4)
    for _ in range(200):
        pool = r.sample(range(1 << 40), 60)
        a = set(r.sample(pool, r.randint(1, 30)))
        b = {x for x in a if r.random() < 0.95} | set(r.sample(pool, r.randint(0, 2)))
        known = np.array(sorted(r.sample(pool, 20)), np.uint64)
        frequent = (known, np.array(r.sample(range(20), 20)))
        x, y = (np.concatenate(J.first_tokens(np.array(sorted(s), np.uint64), frequent, 80)) for s in (a, b or {1}))
        if b and 100 * len(a & b) >= 80 * len(a | b):
            assert set(x.tolist()) & set(y.tolist())
