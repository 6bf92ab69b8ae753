"""Ranked search by inverted treaps.

Each task reads a run of documents, holds it in chunks of bounded size, and builds one treap for each
query term of a chunk: a binary tree in search order of doc_id and in heap order of impact, what the term
adds to the score of a document for each unit of its weight. A query walks the treaps of its terms at the same
time. Its frontier is a set of intervals of documents, each with the topmost node that every term
has in it; the sum of these nodes' weighted impacts bounds all scores in the interval, so intervals
that can't enter the best k are dropped with all their subtrees. Others are split at the document
of their heaviest node, which is scored. What a task has found so far bounds its later chunks too.

Only the best k of each task move. Corpus statistics (documents, terms, document frequencies)
are counted over all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pin, unpin

#: Characters of query texts that go to the tasks at once; more queries are searched in several rounds.
QUERY_CHARS = 4_000_000
#: Documents and postings of a chunk at most. A posting's number has 22 bits.
CHUNK_DOCS, CHUNK_POSTINGS = 32_768, 2_000_000
_POSITION = 22

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters, digits and characters beyond ASCII; A-Z in lower case."""
    return text.encode().translate(_TABLE).split() if text else []


class Treaps:
    """One treap for each term over numbered documents."""

    def __init__(self, n_terms: int, n_docs: int, terms, docs, impacts):
        """Postings sorted by term, then by document; impacts are whole numbers from 0 to 999,999."""
        import numpy as np

        n, self.n_docs = len(docs), n_docs
        self.doc, self.impact = np.append(docs, -1), np.append(impacts, 0)
        self.key = terms.astype(np.int64) * n_docs + docs
        self.root, self.left, self.right = np.full(n_terms, n), np.full(n + 1, n), np.full(n + 1, n)
        # Heap order of equal impacts is by a hash, which keeps the trees flat.
        mixed = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        rank = np.append((impacts.astype(np.int64) << 42) | (mixed.astype(np.int64) << _POSITION) | np.arange(n), 0)
        begin = np.searchsorted(terms, np.arange(n_terms))
        end = np.searchsorted(terms, np.arange(n_terms), side="right")
        some = np.flatnonzero(end > begin)
        # All trees grow level by level: the heaviest posting of each open range is its root.
        low, high, side, above = begin[some], end[some], self.root, some
        parts = [(low, high, side, above)]
        while parts:
            after = []
            for low, high, side, above in parts:
                if not len(low):
                    continue
                top = np.maximum.reduceat(rank, np.stack([low, high], axis=1).ravel())[::2] & ((1 << _POSITION) - 1)
                side[above] = top
                open_left, open_right = top > low, top + 1 < high
                after += [(low[open_left], top[open_left], self.left, top[open_left]), (top[open_right] + 1, high[open_right], self.right, top[open_right])]
            lefts, rights = after[::2], after[1::2]
            parts = [tuple(np.concatenate([p[i] for p in same]) if i != 2 else same[0][2] for i in range(4)) for same in (lefts, rights) if same]
            parts = [tuple(np.take(p[i], np.argsort(p[0], kind="stable")) if i != 2 else p[2] for i in range(4)) for p in parts if len(p[0])]

    def scores(self, terms, weights, docs):
        """The scores of ``docs``."""
        import numpy as np

        want = terms * self.n_docs + docs[:, None]
        at = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        return (np.where(self.key[at] == want, self.impact[at], 0) * weights).sum(axis=1)

    def search(self, terms, weights, k: int, best, ids) -> tuple:
        """The best k (scores, ids) of ``best`` and these documents, and how many documents were scored. ``ids``
        rise with the documents' numbers."""
        import numpy as np

        scored = 0
        low, high, nodes = np.array([0]), np.array([self.n_docs]), self.root[terms][None, :]
        while len(low):
            adds = self.impact[nodes] * weights
            bound = adds.sum(axis=1)
            may = bound > 0
            if len(best[0]) == k:
                may &= (bound > best[0][-1]) | ((bound == best[0][-1]) & (ids[low] < best[1][-1]))
            low, high, nodes, adds = low[may], high[may], nodes[may], adds[may]
            if not len(low):
                break
            at = self.doc[nodes[np.arange(len(low)), adds.argmax(axis=1)]]
            scored += len(at)
            found = self.scores(terms, weights, at)
            both, names = np.append(best[0], found), np.append(best[1], ids[at])
            first = np.lexsort((names, -both))[:k]
            best = both[first], names[first]
            low, high, nodes = np.append(low, at + 1), np.append(at, high), np.concatenate([nodes, nodes])
            some = low < high
            low, high, nodes = low[some], high[some], nodes[some]
            # Each term goes down to its topmost node inside the interval.
            while True:
                doc = self.doc[nodes]
                over, under = doc >= high[:, None], (doc < low[:, None]) & (doc >= 0)
                if not (over.any() or under.any()):
                    break
                nodes = np.where(over, self.left[nodes], np.where(under, self.right[nodes], nodes))
        return best, scored


def _postings(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document with repeats), and the numbers of the query terms it has, with how often."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        number = sent.value.get
        for batch in batches:
            n, found = [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text)
                n.append(len(words))
                counts = Counter(map(number, words))
                counts.pop(None, None)
                found.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([list(c) for c in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "often"],
            )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, often array<bigint>")


def _chunks(batches, most_docs: int, most_postings: int):
    """Numpy columns (doc ids with nulls as the largest, n, sizes, terms, often) of bounded runs of rows."""
    import numpy as np
    import pyarrow as pa

    held, docs, postings = [], 0, 0

    def joined(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        lists = [table.column(c).combine_chunks() for c in ("terms", "often")]
        ids = np.array(table.column("doc_id").fill_null(np.iinfo(np.int64).max))
        return ids, np.array(table.column("n")), np.diff(np.array(lists[0].offsets)), np.array(lists[0].flatten()), np.array(lists[1].flatten())

    for batch in batches:
        sizes = np.diff(np.array(batch.column(2).offsets))
        start = 0
        while start < len(sizes):
            room = np.searchsorted(np.cumsum(sizes[start:]), most_postings - postings, side="right")
            take = max(int(min(room, most_docs - docs)), int(not held))
            take = min(take, len(sizes) - start)
            if take:
                held.append(batch.slice(start, take))
                docs, postings, start = docs + take, postings + int(sizes[start : start + take].sum()), start + take
            if start < len(sizes):
                yield joined(held)
                held, docs, postings = [], 0, 0
    if held:
        yield joined(held)


def _ranked(postings: DataFrame, queries: list[tuple[int, list[int], list[int]]], n_terms: int, n_docs: int, all_terms: int, k: int, chunk_docs: int) -> DataFrame:
    """(key, doc_id, score) of the best k of each task. ``queries``: key, terms, weights."""
    sent = postings.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        best = {q[0]: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for q in sent.value}
        asked = [(key, np.array(t, np.int64), np.array(w, np.int64)) for key, t, w in sent.value]
        for ids, n, sizes, terms, often in _chunks(batches, chunk_docs, CHUNK_POSTINGS):
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            doc = np.repeat(place, sizes)
            m = 75 + 25 * np.repeat(n, sizes) * n_docs // max(1, all_terms)
            impact = 1_000_000_000 * often // (1000 * often + 12 * m)
            by = np.lexsort((doc, terms))
            treaps = Treaps(n_terms, len(ids), terms[by].astype(np.int64), doc[by], impact[by])
            for key, t, w in asked:
                best[key], _ = treaps.search(t, w, k, best[key], ids[order])
        rows = [(key, int(i), int(s)) for key, (scores, names) in best.items() for s, i in zip(scores, names, strict=True)]
        key, ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        last = np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), pa.array([None if i == last else i for i in ids], pa.int64()), pa.array(scores, pa.int64())], names=["key", "doc_id", "score"])

    return postings.select("doc_id", "n", "terms", "often").mapInArrow(run, "key int, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", query_chars: int = QUERY_CHARS, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """The k rows of ``docs`` with the highest scores over 0 for each row of ``queries``: query id, rank (from 1),
    doc id, score; equal scores by ascending doc id, null ids last.

    Null and empty texts have no terms: such documents count in no statistic and such queries have no
    rows. A row of ``docs`` is a document, repeated or not; repeated rows of ``queries`` (same id and text) are
    one query, and other texts under the same id are queries of their own. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("text")).distinct()
    asked = pin(asked.withColumn("long_key", F.monotonically_increasing_id()), "queries")
    size = asked.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    rounds, found = max(1, -(-size // query_chars)), []
    for r in range(rounds):
        rows = asked.filter(F.pmod(F.xxhash64("long_key"), F.lit(rounds)) == r).collect()
        words = [(row["long_key"], terms_of(row["text"])) for row in rows]
        number: dict[bytes, int] = {}
        for _, own in words:
            for t in own:
                number.setdefault(t, len(number))
        postings = pin(_postings(docs, number), "postings")
        total = postings.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        having = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 0)
        weighed = having.withColumn("w", F.floor(1000 * F.log((2 * F.lit(total["docs"]).cast("double") + 2) / (2 * F.col("df") + 1))).cast("bigint"))
        weight = {row["term"]: row["w"] for row in weighed.collect()}  # of this round's terms
        parts = []
        for key, (_, own) in enumerate(words):
            times: dict[int, int] = {}
            for t in own:
                times[number[t]] = times.get(number[t], 0) + 1
            some = {t: c * weight[t] for t, c in times.items() if weight.get(t, 0) > 0}
            if some:
                parts.append((key, list(some), list(some.values())))
        best = _ranked(postings, parts, len(number), total["docs"], total["terms"], k, chunk_docs)
        keys = docs.sparkSession.createDataFrame([(i, key) for i, (key, _) in enumerate(words)], "key int, long_key bigint")
        found.append(pin(best.join(F.broadcast(keys), "key").select("long_key", "doc_id", "score"), "best"))
        unpin(postings)
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    order = Window.partitionBy("long_key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(asked.select("long_key", F.col("item")), "long_key").select(F.col("item").alias(query_id), "rank", F.col("doc_id").alias(id_col), "score")
