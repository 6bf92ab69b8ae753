"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, in an inverted index.

Fitting takes a bounded sample of labelled rows. Its words, and word beginnings of 3 to 8
letters (which stand for all endings of a stem), that enough examples have are the terms. In departure from
plain TF-IDF each weighs its idf times its association with the label, for which rare insults count more than the words of a
topic; none is left out for being weakly associated. Each example is a unit vector over them. Blocks of alike
examples have the largest weight of each term; sums of these bound the similarities of a whole block, and blocks whose
bound doesn't reach the k-th similarity are skipped, so the k nearest are exact. Their labels vote with weights that fall with
the distance; the vote is calibrated on the examples themselves, each scored without itself.

The index is a few thousand vectors at any corpus size; texts are scored where they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks
from .quality import sample_labelled

#: Labelled rows that fitting reads at most.
MAX_EXAMPLES = 8_000
MIN_EXAMPLES_WITH_TERM = 3
#: What a term without any association with the label weighs, beside the association of the others (0 to 1).
LEAST_ASSOCIATION = 0.01
#: A term that one in so many examples has is in the matrix.
COMMON = 16
#: How far a similarity summed in single precision can be from the exact one, for each of a text's terms.
SLACK = 1.2e-7
#: Texts that meet the matrix at once.
BATCH = 256
#: Characters of texts whose words are looked up together.
CHARS = 1_000_000
K = 15
BLOCK = 64
STEMS = (3, 4, 5, 6, 7, 8)
_WORD, _ASCII_WORD = re.compile(r"[^\W\d_]+"), re.compile("[a-z]+")
_EPS = 1e-9


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def all_terms(text: str | None) -> set[str]:
    """Words and stems, as in fitting."""
    words = set(words_of(text))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


class BlockMaxIndex:
    """Exact k nearest unit vectors by cosine.

    Vectors that share their heaviest terms lie in one block. Terms that many examples have lie in a matrix for each
    block, with the largest weight of each term in each block; the others in lists of their examples. What a text's listed
    terms add up to is summed in each example; the largest of these sums of a block, and what the text's other terms can add
    up to there, bound all similarities of the block. The blocks with the highest bounds are scored first; of the others only
    those whose bound reaches the k-th similarity found by then, and all others are skipped. Texts are bounded and scored many
    at a time. Sums are in single precision; what may be among the k nearest is computed again in double precision.
    """

    def __init__(self, vectors: Iterable[tuple], block: int = BLOCK):
        # Joined some hundred at a time: thousands of small arrays at once would leave the memory in pieces.
        sizes, terms, exact, heads = [], [np.zeros(0, np.int32)], [np.zeros(0)], []
        vectors = iter(vectors)
        while part := list(islice(vectors, 256)):
            sizes += [len(v[0]) for v in part]
            terms.append(np.concatenate([v[0] for v in part]).astype(np.int32))
            exact.append(np.concatenate([v[1] for v in part]))
            heads += [tuple(np.asarray(v[0])[np.argsort(-np.asarray(v[1]), kind="stable")[:4]].tolist()) for v in part]
        self.block, self.n = block, len(sizes)
        self.begin = np.append(0, np.cumsum(np.array(sizes, np.int64)))
        self.terms = t = np.concatenate(terms)
        self.exact = np.concatenate(exact)
        del terms, exact
        #: Examples in their order in the blocks, and the place of each.
        self.order = np.array(sorted(range(self.n), key=heads.__getitem__), np.int64)
        self.place = place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        self.blocks = -(-self.n // block)
        at = place[np.repeat(np.arange(self.n), sizes)]
        having = np.bincount(t)
        common = np.flatnonzero((having > 0) & (having * COMMON >= self.n))
        self.row = np.full(len(having), -1, np.int32)
        self.row[common] = np.arange(len(common))
        dense = self.row[t] >= 0
        # A matrix (terms, examples) for each block, and the largest weight of each term and block.
        self.matrix = np.zeros((self.blocks, len(common), block), np.float32)
        self.matrix[at[dense] // block, self.row[t[dense]], at[dense] % block] = self.exact[dense]
        self.top = np.ascontiguousarray(self.matrix.max(axis=2, initial=0).T)
        rest = np.flatnonzero(~dense)
        rest = rest[np.lexsort((at[rest], t[rest]))]
        self.ids, self.weights = at[rest].astype(np.int32), self.exact[rest].astype(np.float32)
        #: Where the list of each term begins.
        self.first = np.append(0, np.cumsum(np.bincount(t[rest], minlength=len(having))))
        self.asked = np.zeros(len(having))
        #: Pairs of text and block that were scored, and that were skipped.
        self.scored = self.skipped = 0

    def vector(self, i: int) -> tuple:
        return self.terms[self.begin[i] : self.begin[i + 1]], self.exact[self.begin[i] : self.begin[i + 1]]

    def nearest(self, terms, weights, k: int = K, without: int = -1) -> list[tuple[int, float]]:
        """(example, similarity) of the k most similar with a similarity over 0; of equal ones the
        smaller number comes first."""
        return self.nearest_of([(terms, weights)], k, [without])[0]

    def nearest_of(self, vectors: list[tuple], k: int = K, without: list[int] | None = None) -> list[list[tuple[int, float]]]:
        """``nearest`` of many vectors; ``without`` has an example for each that it can't be near to."""
        if not self.n:
            return [[] for _ in vectors]
        out: list[list[tuple[int, float]]] = []
        seeds = min(self.blocks, 1 + -(-k // self.block))
        for start in range(0, len(vectors), BATCH):
            part, asked = [], vectors[start : start + BATCH]
            common = np.zeros((len(asked), self.matrix.shape[1]), np.float32)
            rough = np.zeros((len(asked), self.blocks, self.block), np.float32)
            for q, (terms, weights) in enumerate(asked):
                known = np.asarray(terms) < len(self.row)
                terms, weights = np.asarray(terms, np.int64)[known], np.asarray(weights, float)[known]
                row = self.row[terms]
                common[q, row[row >= 0]] = weights[row >= 0]
                # What the other terms add up to in each example.
                listed = terms[row < 0]
                size = self.first[listed + 1] - self.first[listed]
                entries = np.repeat(self.first[listed] - np.cumsum(size) + size, size) + np.arange(size.sum())
                w = np.repeat(weights[row < 0].astype(np.float32), size) * self.weights[entries]
                rough[q] = np.bincount(self.ids[entries], w, self.blocks * self.block).reshape(self.blocks, self.block)
                part.append((terms, weights))
            bounds = common @ self.top + rough.max(axis=2)
            sims = np.zeros(rough.shape, np.float32)
            likely = np.zeros(bounds.shape, bool)
            np.put_along_axis(likely, np.argpartition(-bounds, seeds - 1, axis=1)[:, :seeds], True, axis=1)
            self._score(sims, rough, likely, common)
            slack = np.array([2 * SLACK * (len(p[0]) + 8) for p in part], np.float32)
            flat = sims.reshape(len(asked), -1)
            hidden = [-1] * len(asked) if not without else without[start : start + BATCH]
            for q, h in enumerate(hidden):
                if h >= 0:
                    flat[q, self.place[h]] = 0
            # Only the blocks of the seeds have similarities as yet.
            kth = np.zeros(len(asked), np.float32)
            if flat.shape[1] >= k:
                own = np.take_along_axis(sims, np.nonzero(likely)[1].reshape(len(asked), seeds, 1), axis=1).reshape(len(asked), -1)
                kth = np.partition(own, -k, axis=1)[:, -k] if own.shape[1] >= k else kth
            more = ~likely & (bounds > 0) & (bounds >= (kth - 2 * slack)[:, None])
            self._score(sims, rough, more, common)
            self.scored, self.skipped = self.scored + int((likely | more).sum()), self.skipped + int((~(likely | more)).sum())
            for q, h in enumerate(hidden):
                if h >= 0:
                    flat[q, self.place[h]] = 0
                # The k-th of all is not under the seeds' k-th.
                may = np.flatnonzero((flat[q] >= kth[q] - slack[q]) & (flat[q] > 0))
                out.append(self._best(may, flat[q][may], *part[q], k))
        return out

    def _score(self, sims, rough, pairs, common) -> None:
        """Fill in the similarities of ``pairs`` of texts and blocks."""
        for b in np.flatnonzero(pairs.any(axis=0)).tolist():
            rows = np.flatnonzero(pairs[:, b])
            sims[rows, b] = rough[rows, b] + common[rows] @ self.matrix[b]

    def _best(self, may, s, terms, weights, k: int) -> list[tuple[int, float]]:
        """The k best by exact similarity, of the places ``may`` whose rough similarity ``s`` doesn't rule them out."""
        slack = 2 * SLACK * (len(terms) + 8)
        least = np.partition(s, -k)[-k] if len(s) >= k else 0.0
        may = np.sort(self.order[may[s >= least - slack]])
        self.asked[terms] = weights
        exact = np.array([self.asked[self.terms[a:b]] @ self.exact[a:b] for a, b in zip(self.begin[may].tolist(), self.begin[may + 1].tolist(), strict=True)])
        self.asked[terms] = 0
        exact = np.round(exact, 9)
        best = np.lexsort((may, -exact))[:k]
        return [(int(may[i]), float(exact[i])) for i in best if exact[i] > 0]


class Terms:
    """The numbers of the terms, and the terms of texts.

    Examples that have a word, or a longer stem of it, have its shorter stems too, so what a word
    stands for is a chain: its longest term and all terms that this begins with.
    """

    def __init__(self, terms: list[str]):
        import pyarrow as pa

        self.sent = zlib.compress("\n".join(terms).encode())
        stems = {t[:-1]: i for i, t in enumerate(terms) if t[-1:] == "*"}
        listed = lambda d: (pa.array(list(d), pa.string()), np.append(np.array(list(d.values()), np.int64), -1))
        #: Words, and stems by their length, with their numbers; behind these that of what is none of them.
        self.words = listed({t: i for i, t in enumerate(terms) if t[-1:] != "*"})
        self.stems = [(m, *listed({t: i for t, i in stems.items() if len(t) == m})) for m in STEMS]
        size = [len(t) - (t[-1:] == "*") for t in terms]
        parent = [stems.get(t[: min(n - 1, STEMS[-1])], -1) for t, n in zip(terms, size, strict=True)]
        up = np.array([*parent, -1], np.int32)
        chain = [np.arange(len(terms), dtype=np.int32)]
        for _ in STEMS:
            chain.append(up[chain[-1]])
        #: A row of terms for each term; the last row, for words without any, is empty.
        self.chain = np.full((len(terms) + 1, len(chain)), -1, np.int32)
        self.chain[:-1] = np.stack(chain, axis=1)

    def __getstate__(self):
        return self.sent

    def __setstate__(self, sent):
        text = zlib.decompress(sent).decode()
        self.__init__(text.split("\n") if text else [])

    def _longest(self, words) -> np.ndarray:
        """Of each of an Arrow array of words the longest term that it is or begins with; -1: none."""
        import pyarrow.compute as pc

        size, best = pc.utf8_length(words).to_numpy(zero_copy_only=False), np.full(len(words), -1, np.int64)
        found = lambda at, values, numbers: numbers[pc.fill_null(pc.index_in(at, value_set=values), -1).to_numpy(zero_copy_only=False)]
        left = np.arange(len(words))
        for m, values, numbers in self.stems:
            longer = size[left] > m
            own = left[longer]
            stem = found(pc.utf8_slice_codeunits(words.take(own), 0, m), values, numbers)
            best[own[stem >= 0]] = stem[stem >= 0]
            # A word whose stem is no term is none itself, nor are its longer stems.
            left = np.concatenate([left[~longer], own[stem >= 0]])
        whole = found(words.take(left), *self.words)
        best[left[whole >= 0]] = whole[whole >= 0]
        return best

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, how often each is in the text), by number."""
        return self.counts_of([text])[0]

    def counts_of(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``counts`` of many texts, CHARS together: each of their words is looked up once."""
        out = []
        for group in chunks.in_groups([t or "" for t in texts], CHARS):
            out += self._counts_of([texts[i] for i in group])
        return out

    def _counts_of(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        import pyarrow as pa

        words = [words_of(t) for t in texts]
        text = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        coded = pa.array([w for own in words for w in own], pa.string()).dictionary_encode()
        longest = self._longest(coded.dictionary)
        n = len(self.chain)
        rows, often = np.unique(text * n + (longest % n)[coded.indices.to_numpy()], return_counts=True)
        all_terms = self.chain[rows % n]
        has = all_terms >= 0
        # The terms of a text lie together, in order; a term that several words stand for comes several times.
        size = has.sum(axis=1)
        key = np.repeat(rows - rows % n, size) + all_terms[has]
        order = np.argsort(key, kind="stable")
        key, often = key[order], np.repeat(often, size)[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        often = (np.add.reduceat(often, starts) if len(key) else often).astype(np.int32)
        terms, ends = (key[starts] % n).astype(np.int32), np.searchsorted(key[starts], np.arange(len(texts) + 1) * n)
        return [(terms[a:b], often[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def packed(terms: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([np.diff(terms, prepend=0), counts]).astype(np.int32).tobytes())


def unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(b), np.int32)
    return np.cumsum(both[: len(both) // 2], dtype=np.int32), both[len(both) // 2 :]


class Neighbours:
    """The fitted model: terms, their weights, examples, and the calibration of the vote."""

    def __init__(self, terms: Terms, weights: list[float], examples: list[tuple[int, int, bytes]]):
        """``examples``: (id, label, packed terms and counts)."""
        self.terms, self.weight = terms, np.array(weights, float)
        self.examples = sorted(examples)
        self.ids, self.labels = [x[0] for x in self.examples], np.array([x[1] for x in self.examples], float)
        self.prior = float(self.labels.mean()) if self.ids else 0.5
        self.slope, self.shift = 1.0, 0.0
        self._index = self._sent = None

    @property
    def index(self) -> BlockMaxIndex:
        """Built where it is first used, in tasks: it is several times as large as the examples, and the driver has no need of it."""
        if self._index is None:
            self._index = BlockMaxIndex(self.unit(*unpacked(x[2])) for x in self.examples)
        return self._index

    def __getstate__(self):
        return self.__dict__ | {"_index": None, "_sent": None}

    def in_tasks(self, spark: SparkSession):
        """A function that gives a task this model. It is sent once, so a process builds one index, for the calibration as for all scores."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
        sent, slope, shift = self._sent, self.slope, self.shift

        def model() -> Neighbours:
            m = sent.value
            m.slope, m.shift = slope, shift
            return m

        return model

    def unit(self, terms: np.ndarray, counts: np.ndarray):
        w = self.weight[terms] * (1 + np.log(counts))
        return terms, w / np.sqrt(w @ w) if len(w) else w

    def _vote(self, near: list[tuple[int, float]]) -> float:
        """Log odds of the labels of the nearest, each weighing the inverse of its distance, with the
        prior as one more neighbour that is far away."""
        w = [(1 / (1.05 - s), self.labels[i]) for i, s in near]
        a = sum(x * y for x, y in w) + self.prior
        b = sum(x * (1 - y) for x, y in w) + 1 - self.prior
        return float(np.log((a + 0.02) / (b + 0.02)))

    def votes(self, examples: list[int]) -> list[float]:
        """The votes on ``examples``, each without itself."""
        return [self._vote(near) for near in self.index.nearest_of([self.index.vector(i) for i in examples], without=examples)]

    def calibrate(self, spark: SparkSession, most: int = 4_000) -> None:
        """Fit the logistic of the vote to examples, each scored without itself in a task. At most ``most`` of
        them, evenly spaced, are scored: part of fitting on a bounded sample."""
        step, model = max(1, len(self.examples) // most), self.in_tasks(spark)

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model().votes(batch.column(0).to_pylist()), pa.float64())], names=["id", "vote"])

        voted = sorted(tuple(r) for r in spark.range(0, len(self.examples), step).mapInArrow(run, "id bigint, vote double").collect()) if self.examples else []
        x, y = np.array([v for _, v in voted]), np.array([self.labels[i] for i, _ in voted])
        if len(y) < 10 or y.min() == y.max():
            return
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps, with a weak pull of the slope to 1
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -35, 35)))
            g = np.array([((p - y) * x).sum() + (a - 1), (p - y).sum()])
            h = p * (1 - p)
            m = np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
            step_ab = np.linalg.solve(m, g)
            a, b = a - step_ab[0], b - step_ab[1]
            if abs(step_ab).max() < 1e-9:
                break
        if a > 0:
            self.slope, self.shift = float(a), float(b)

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Of each text the calibrated score, and the evidence: (id, similarity) of the nearest examples."""
        out = []
        for at in range(0, len(texts), BATCH):
            for near in self.index.nearest_of([self.unit(*c) for c in self.terms.counts_of(texts[at : at + BATCH])]):
                p = 1 / (1 + np.exp(-np.clip(self.slope * self._vote(near) + self.shift, -35, 35)))
                out.append((float(p), [(self.ids[i], s) for i, s in near]))
        return out


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_examples: int = MAX_EXAMPLES) -> Neighbours:
    """Fit to at most ``max_examples`` labelled rows of ``docs``, which bound the terms too. Without
    any, every score is 0.5."""

    def terms_of(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([sorted(all_terms(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["id", "label", "terms"]
            )

    sample = sample_labelled(docs, labels, label_col, max_examples)
    by_label = sample.mapInArrow(terms_of, "id bigint, label int, terms array<string>")
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    n = n0 + n1
    table = (
        by_label.select("label", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b"))
        .filter(F.col("a") + F.col("b") >= MIN_EXAMPLES_WITH_TERM)
        .toArrow()
        .sort_by("term")
    )
    a, b = (table.column(c).to_numpy() for c in "ab")
    # The correlation of having the term with the label; it does not grow with the number of labels.
    phi = np.abs(a * (n0 - b) - b * (n1 - a)) / np.sqrt(max(1, n1) * max(1, n0) * (a + b) * np.maximum(n - a - b, 1))
    terms, weights = table.column("term").to_pylist(), (np.log((1 + n) / (1 + a + b)) + 1) * (LEAST_ASSOCIATION + phi)
    known = Terms(terms)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            counts = sent.value.counts_of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([packed(*c) for c in counts], pa.binary())], names=["id", "label", "counts"]
            )

    rows = sample.mapInArrow(vectors, "id bigint, label int, counts binary").collect()
    model = Neighbours(known, weights, [(r["id"], r["label"], bytes(r["counts"])) for r in rows])
    model.calibrate(docs.sparkSession)
    return model


def score(docs: DataFrame, model: Neighbours, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, score, predicted (1 if score >= threshold), and the
    evidence: ``near_ids`` and ``near_similarities`` of the nearest examples, best first.

    A text without any of the terms, such as a null or empty one, has no evidence and scores what
    the calibration gives the prior. Only the text is read; rows are independent.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = model.in_tasks(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        m = sent()
        for batch in batches:
            found = m.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([p for p, _ in found], pa.float64()),
                    pa.array([int(p >= threshold) for p, _ in found], pa.int32()),
                    pa.array([[i for i, _ in near] for _, near in found], pa.list_(pa.int64())),
                    pa.array([[s for _, s in near] for _, near in found], pa.list_(pa.float64())),
                ],
                names=[id_col, "score", "predicted", "near_ids", "near_similarities"],
            )

    schema = f"`{id_col}` {kind}, score double, predicted int, near_ids array<bigint>, near_similarities array<double>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Neighbours, threshold: float = 0.3, text_col: str = "text", keep_without_evidence: bool = False) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay.

    With ``keep_without_evidence`` a row stays, whatever it scores, if no example is near to it: so
    all rows stay if there are no labels.
    """
    at, sent = docs.columns.index(text_col), model.in_tasks(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([p < threshold or (keep_without_evidence and not near) for p, near in sent().score(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
