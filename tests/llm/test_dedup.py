"""Exact, line and near dedup against plain Python, with odd rows."""

import hashlib
import random

import pytest

from sightline.llm.exact_dedup import exact_dedup
from sightline.llm.line_dedup import LineRuns, drop_lines
from sightline.llm import near_dedup
from sightline.llm.near_dedup import keep_one, near_duplicates

DOCS = "doc_id bigint, text string, n_lines string, name string, label int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a" * 50_000), (5, "a" * 50_000), (6, "a" * 49_999), (7, "né\nüü"), (8, "né\nüü"), (9, "né\nüü "), (10, "🙂" * 5000), (11, "🙂" * 5000), (None, "né\nüü"), (None, None)]


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_dedup(spark, block):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs(spark, ODD), block_chars=block).collect()}
    groups = {}
    for i, t in ODD:
        groups.setdefault(t or "", []).append(i)
    want = set()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        want |= {(i, top, len(ids), i == top, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    assert got == want


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    got = exact_dedup(docs(spark, [(1, "x"), (1, "x"), (1, "x"), (0, "x")])).collect()
    assert sum(r.kept for r in got) == 1 and {r.group_size for r in got} == {4}
    assert exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_of_a_hot_block(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(1500)]
    got = exact_dedup(docs(spark, rows)).collect()
    assert sum(r.kept for r in got) == 501 and max(r.group_size for r in got) == 1000


def brute_lines(rows, least=10):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda s: low(s.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: 2**63 - 1 if i is None else i
    first = {}
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        for s in (t or "").split("\n"):
            if len(key(s)) >= least:
                first.setdefault(key(s), order(i))
    return sorted(
        (order(i), len(ls), len(ls) - len(kept), "\n".join(kept))
        for i, t in rows
        for ls in [(t or "").split("\n")]
        for kept in [[s for s in ls if len(key(s)) < least or first[key(s)] == order(i)]]
    )


@pytest.mark.parametrize("batches,fanout", [(1, 4), (3, 4), (7, 2)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"Line number {i} of the pool" for i in range(12)] + ["short", "", " ", "Äöü line with letters", "LINE NUMBER 3 of the pool\t"]
    rows = [*ODD, *((20 + i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)), (20, "Line number 1 of the pool\nmore of document twenty")]
    got = drop_lines(docs(spark, rows), batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "name", "label", "n_lines", "n_dropped"]
    assert sorted((2**63 - 1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute_lines(rows)
    assert drop_lines(docs(spark, [])).count() == 0


def test_runs_are_compacted_by_levels(spark):
    runs = LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(i, i, b) for i in range(b * 3, b * 3 + 5)], "h1 bigint, h2 bigint, first_doc bigint"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    rows = [r for run in runs.all() for r in run.collect()]
    assert len({r.h1 for r in rows}) == len(rows) == 17
    assert all(r.first_doc == min(4, max(0, (r.h1 - 2) // 3 if r.h1 > 4 else 0)) for r in rows)


def components(rows, width, percent=80):
    def sh(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])

    sets = {i: sh(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def corpus(seed, groups=12, size=6, big=70):
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(3000)]
    for g in range(groups):
        base = rng.choices(words, k=rng.randint(30, 120))
        for _ in range(big if g == 0 else size):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(spark, width):
    rows = [*corpus(width), (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  TWO"), (905, "one"), (906, "a b c d e f " * 9)]
    got = near_duplicates(docs(spark, rows), width=width)
    assert sorted(map(tuple, got.collect())) == components(rows, width)
    assert near_duplicates(docs(spark, []), width=width).count() == 0


def test_keep_one_of_each_group(spark):
    rows = [*corpus(9, groups=4), (900, None), (901, ""), (902, ""), (None, "some words that are alone here"), (0, corpus(9, groups=4)[0][1])]
    out = keep_one(docs(spark, rows), width=5)
    assert out.columns == ["doc_id", "text", "n_lines", "name", "label"]
    want = {i for i, _, _, kept in components(corpus(9, groups=4), 5) if kept} | {900, 901, 902, None}
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, want))


def test_nodes_that_stay_large_are_compared_in_full(spark, monkeypatch):
    # One level, one leader and blocks of a few classes: nearly all links lie between classes that aren't leaders.
    for name, value in dict(MAX_DEPTH=1, LEADERS=1, LEAF=2, BLOCK=5).items():
        monkeypatch.setattr(near_dedup, name, value, raising=False)
    # Chains of texts that only their neighbours are near: shares of a shingle are runs of several texts.
    rows = [(c * 60 + i, " ".join(f"c{c}w{j}" for j in range(10 * i, 10 * i + 100))) for c in range(2) for i in range(60)]
    want = components(rows, 4)
    assert {r[2] for r in want} == {0, 60}
    assert sorted(map(tuple, near_duplicates(docs(spark, rows), width=4).collect())) == want
