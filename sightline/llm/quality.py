"""Text quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

A text is a sparse vector over 2**bits hashed features: its words and marks, pairs of neighbours,
and how many words are all capitals or repeat the one before; counts are divided by the root
of the number of tokens, so texts of any length are on one scale. Training fits a bounded sample of
labelled rows, in shards of bounded size whose weights are averaged; a score is a sparse dot
product through the logistic function. The weights are 2**bits numbers at any corpus size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Rows that training reads at most, those with the smallest hash of their id.
MAX_EXAMPLES = 12_000
SHARD_ROWS = 3_000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.002, 0.002, 4
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


class Hasher:
    """Feature numbers of texts; one for each worker. Token hashes are remembered, up to a bound."""

    def __init__(self, bits: int):
        import numpy as np
        import xxhash

        self.np, self.bits, self.digest, self.seen = np, bits, xxhash.xxh3_64_intdigest, {}

    def _codes(self, words: list[str]):
        np, seen = self.np, self.seen
        if len(seen) > 400_000:
            seen.clear()
        out = list(map(seen.get, words))
        if None in out:
            for i, c in enumerate(out):
                if c is None:
                    w = words[i]
                    # The lowest bit says: a word of capitals.
                    out[i] = seen[w] = (self.digest(w.lower()) & ~1) | (len(w) > 1 and w.isupper())
        return np.array(out, np.uint64)

    def features(self, text: str | None):
        """(feature numbers, weights), in parallel; a number may come more than once."""
        np = self.np
        words = _TOKEN.findall(text or "")
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0)
        code, shift = self._codes(words), np.uint64(64 - self.bits)
        one, mix = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
        caps, word = int((code & one).sum()), code & ~one
        same = int((word[1:] == word[:-1]).sum() + (word[2:] == word[:-2]).sum())
        pairs = (word[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + word[1:]) * mix
        last = (1 << self.bits) - 1
        number = np.concatenate([(word * mix) >> shift, pairs >> shift, np.array([last, last - 1, last - 2], np.uint64)]).astype(np.int64)
        weight = np.full(len(number), n**-0.5)
        # What the counts of capitals, repeats and all tokens weigh: shares of the text.
        weight[-3:] = 4 * caps / n, 4 * same / n, 1.0
        return number, weight


_hashers: dict[int, Hasher] = {}


def hasher(bits: int) -> Hasher:
    if bits not in _hashers:
        _hashers[bits] = Hasher(bits)
    return _hashers[bits]


def ftrl(examples: list[tuple], bits: int, epochs: int = EPOCHS):
    """Weights after ``epochs`` passes of per-coordinate follow-the-regularised-leader updates.

    ``examples``: (feature numbers, weights, label), in the order of training.
    """
    import numpy as np

    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def at(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    short = []
    for number, weight, label in examples:
        i, where = np.unique(number, return_inverse=True)
        short.append((i, np.bincount(where, weight, len(i)) if len(i) else np.zeros(0), label))
    for _ in range(epochs):
        for i, x, label in short:
            w = at(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return at(np.arange(1 << bits)).astype(np.float32)


def sample_labelled(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled ids with the smallest hashes of the id.

    Null ids and labels are left out; of several labels of an id the largest holds. The ids
    are sent to the scan of the texts, which therefore does not shuffle: ``rows`` bounds them.
    """
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "__id").select(F.col("__id").alias("id"), "text", "label")


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_examples: int = MAX_EXAMPLES, bits: int = BITS):
    """Fit the weights to labelled rows of ``docs``. Without any, all weights are 0 and every score is 0.5."""
    import numpy as np

    sample = sample_labelled(docs, labels, label_col, max_examples)
    # Up to 4 shards of at least SHARD_ROWS rows; max_examples bounds a shard too.
    n = labels.filter(F.col(label_col).isNotNull()).limit(max_examples).count()
    shards = max(1, min(4, n // SHARD_ROWS))

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["order", "id"])
        make = hasher(bits)
        w = ftrl([(*make.features(t), y) for t, y in zip(pdf["text"], pdf["label"], strict=True)], bits)
        return pd.DataFrame({"weights": [w.tobytes()]})

    dealt = sample.withColumn("order", F.xxhash64(F.lit(7), "id")).withColumn("shard", F.pmod("order", F.lit(shards)))
    found = dealt.groupBy("shard").applyInPandas(fit, "weights binary").collect()
    return np.mean([np.frombuffer(r["weights"], np.float32) for r in found], axis=0) if found else np.zeros(1 << bits, np.float32)


def score(docs: DataFrame, weights, threshold: float = 0.3, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, score, predicted (1 if score >= threshold).

    Null and empty texts score 0.5. Only the text is read; rows are independent.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, make = sent.value, hasher(bits)
        for batch in batches:
            total = []
            for t in batch.column(1).to_pylist():
                number, weight = make.features(t)
                total.append(float(w[number] @ weight))
            p = 1 / (1 + np.exp(-np.clip(np.array(total, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def held_out(remainder: int, modulus: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))
