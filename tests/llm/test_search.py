"""Ranked search against plain Python, with odd rows, ties and small chunks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sightline.llm.lexical import Treaps, search, terms_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    d = [(i, terms(t)) for i, t in docs]
    n_docs, all_terms = sum(bool(t) for _, t in d), sum(len(t) for _, t in d)
    df = Counter(t for _, own in d for t in set(own))
    out = []
    for item, text in set(items):
        found = []
        for i, own in d:
            tf, score = Counter(own), 0
            m = 75 + 25 * len(own) * n_docs // all_terms if own else 0
            for t in terms(text):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


DOCS = "doc_id bigint, text string, score int, rank string, term string, item_id int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y", 7) for i, t in rows], DOCS)


def queries(spark, rows):
    return spark.createDataFrame([(i, t, 3) for i, t in rows], "item_id bigint, text string, doc_id int")


ODD = [(5, None), (6, ""), (7, " ,.;"), (8, "Cat " * 30_000), (None, "cat dog"), (9, "CAT_dog"), (9, "CAT_dog"), (10, "дом Ärger ärger 🙂x 12a"), (11, "cat"), (3, "cat"), (4, "cat\x00dog")]
ITEMS = [(1, "cat dog dog"), (1, "cat dog dog"), (1, "Ärger"), (2, None), (3, ""), (None, "ärger 🙂X"), (4, "unseen words"), (5, "CAT")]


def test_terms_are_the_pattern():
    for t in ["", "a-b_c", "Ünï cödé¬x", "x\x7fy", "A1b2 ９９", " a b"]:
        assert [t.decode() for t in terms_of(t)] == terms(t)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_equals_brute_force(spark, k):
    assert got(search(table(spark, ODD), queries(spark, ITEMS), k)) == brute(ODD, ITEMS, k)


def test_search_in_chunks_and_rounds(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, [1 / (1 + j) for j in range(60)], k=r.randint(0, 40)))) for i in range(900)]
    docs += [(1000 + i, "w3 w9 w9 w27") for i in range(200)]  # ties
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(12)]
    want = brute(docs, items, 20)
    assert got(search(table(spark, docs), queries(spark, items), 20, chunk_docs=64)) == want
    assert got(search(table(spark, docs), queries(spark, items), 20, query_chars=60)) == want


def test_search_of_empty_tables(spark):
    assert search(table(spark, []), queries(spark, ITEMS)).count() == 0
    assert search(table(spark, ODD), queries(spark, [])).count() == 0
    assert search(table(spark, [(1, None), (2, "")]), queries(spark, ITEMS)).count() == 0


def test_treaps_skip_documents():
    """Heap order and search order hold, and most documents are never scored."""
    r = np.random.default_rng(3)
    n_docs, n_terms = 4000, 8
    rows = np.array([(t, d, int(r.pareto(1) * 20) % 900_000 + 1) for t in range(n_terms) for d in np.flatnonzero(r.random(n_docs) < 0.3)])
    treaps = Treaps(n_terms, n_docs, rows[:, 0], rows[:, 1], rows[:, 2])
    last = len(rows)
    for side, sign in ((treaps.left, -1), (treaps.right, 1)):
        has = np.flatnonzero(side[:last] != last)
        assert (treaps.impact[side[has]] <= treaps.impact[has]).all()
        assert (sign * (treaps.doc[side[has]] - treaps.doc[has]) > 0).all()
    weights = r.integers(1, 50, n_terms)
    empty = np.zeros(0, np.int64)
    best, scored = treaps.search(np.arange(n_terms), weights, 20, (empty, empty), np.arange(n_docs))
    total = np.bincount(rows[:, 1], rows[:, 2] * weights[rows[:, 0]], n_docs).astype(int)
    want = sorted((-s, i) for i, s in enumerate(total.tolist()) if s)[:20]
    assert [(-s, i) for s, i in zip(*best, strict=True)] == want
    assert scored < n_docs / 4
