"""Benchmark passages in training texts, found by spaced seeds and verified with substitutions.

A seed is a mask over neighbouring tokens that looks at some positions and ignores the others,
so a substituted word at an ignored place does not hide a passage. The hashes of all
benchmark seeds go to the tasks in blocks of bounded size; each task joins its texts' seeds
with them. Around a hit, text and item are laid side by side on the hit's diagonal, and
the stretch with the most equal tokens, at least 80 % of its length, is the overlap.

With these masks every overlap of at least MIN_MATCH equal tokens, at least 80 % of its length,
is found for lengths up to 20 (tested exhaustively), and longer ones have such parts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 1: the token counts; 0: it is ignored.
MASKS = ("11111", "110111", "1101101")
MIN_MATCH = 10
MIN_ITEM = 5
#: Benchmark tokens in one block; bounds what is sent to each executor (about 60 bytes a token).
BLOCK_TOKENS = 1_000_000
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class SeedIndex:
    """The seeds of one block of benchmark items."""

    def __init__(self, items: list[tuple]):
        import numpy as np

        self.np = np
        split = [(i, w) for i, t in items if len(w := tokens(t)) >= MIN_ITEM]
        self.code: dict[str, int] = {}
        self.items = [(i, np.array([self.code.setdefault(x, len(self.code) + 1) for x in w], np.int64)) for i, w in split]
        self.factor = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(max(map(len, MASKS)))], np.uint64)
        self.tables = []
        for mask in MASKS:
            at = [k for k, c in enumerate(mask) if c == "1"]
            rows = [(self._hash(w, np.arange(len(w) - len(mask) + 1), at), n) for n, (_, w) in enumerate(self.items) if len(w) >= len(mask)]
            if not rows:
                continue
            seeds = np.concatenate([h for h, _ in rows])
            item = np.concatenate([np.full(len(h), n) for h, n in rows])
            place = np.concatenate([np.arange(len(h)) for h, _ in rows])
            order = np.argsort(seeds, kind="stable")
            self.tables.append((len(mask), at, seeds[order], item[order], place[order]))

    def _hash(self, codes, starts, at):
        out = self.np.zeros(len(starts), self.np.uint64)
        for k in at:
            out += (codes[starts + k].astype(self.np.uint64) + self.np.uint64(1)) * self.factor[k]
        return out ^ (out >> self.np.uint64(29))

    def _stretch(self, equal) -> tuple[int, int]:
        """The stretch with the most equal tokens of those in which they are at least 80 %, the shortest of such."""
        np = self.np
        hits, total = np.concatenate([[0], np.cumsum(equal)]), np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
        # For a place to end at, the best start is the first whose sum is no higher.
        lowest = np.minimum.accumulate(total)
        starts = np.searchsorted(-lowest, -total)
        gain = hits - hits[starts]
        best = int(gain.max())
        end = int(np.flatnonzero(gain == best)[0])
        start = int(starts[end])
        while start < end and not equal[start]:
            start += 1
        return start, end

    def overlaps(self, text: str | None) -> list[tuple]:
        """For each item that ``text`` holds a part of: (item id, equal tokens, overlap's length, its
        first token in the text, its first token in the item), the best of its diagonals."""
        np = self.np
        words = tokens(text)
        if len(words) < MIN_ITEM or not self.items:
            return []
        codes = np.fromiter(map(self.code.get, words, [0] * len(words)), np.int64, len(words))
        known, found = codes != 0, set()
        for span, at, seeds, item, place in self.tables:
            n = len(codes) - span + 1
            if n <= 0:
                continue
            may = known[at[0] : at[0] + n].copy()
            for k in at[1:]:
                may &= known[k : k + n]
            starts = np.flatnonzero(may)
            if not len(starts):
                continue
            h = self._hash(codes, starts, at)
            low, high = np.searchsorted(seeds, h), np.searchsorted(seeds, h, "right")
            for s, a, b in zip(starts[high > low], low[high > low], high[high > low], strict=True):
                for j in range(a, b):
                    found.add((int(item[j]), int(s - place[j])))
        best: dict[int, tuple] = {}
        for n, offset in found:
            w = self.items[n][1]
            a, b = max(0, -offset), min(len(w), len(codes) - offset)
            equal = codes[offset + a : offset + b] == w[a:b]
            start, end = self._stretch(equal)
            matched = int(equal[start:end].sum())
            if matched >= min(MIN_MATCH, len(w)):
                new = (matched, -(end - start), -(offset + a + start), -(a + start))
                best[n] = max(best.get(n, new), new)
        return [(self.items[n][0], m, -size, -at, -place) for n, (m, size, at, place) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS):
    """Lists of (item, text), each of about ``block_tokens`` tokens: a block at a time is on the driver."""
    items = benchmark.select(F.col(item_col), F.col(text_col)).filter(F.col(text_col).isNotNull()).dropDuplicates()
    size = items.select(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // (block_tokens * 6)))
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == k)
        yield sorted(map(tuple, part.collect()), key=repr)


def _per_text(docs: DataFrame, items: list[tuple], text_at: int, make, schema):
    spark = docs.sparkSession
    sent, held = spark.sparkContext.broadcast(items), {}

    def run(batches):
        if "index" not in held:
            held["index"] = SeedIndex(sent.value)
        for batch in batches:
            yield make(batch, [held["index"].overlaps(t) for t in batch.column(text_at).to_pylist()])

    return docs.mapInArrow(run, schema)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each pair of a document and a benchmark item that overlap: id, item, n_equal,
    n_overlap, doc_token, item_token (where the overlap starts in each, in tokens).

    Tokens are runs of letters, digits and underscores in lower case. An overlap has at least
    MIN_MATCH equal tokens (a shorter item: all of its tokens), and they are at least 80 % of
    it. Null and empty texts and items of fewer than MIN_ITEM tokens have none; repeated items
    count once, and each repeated document has rows of its own. Other columns are ignored.
    """
    import pyarrow as pa

    doc_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {doc_type}, `{item_col}` {item_type}, n_equal int, n_overlap int, doc_token int, item_token int"
    arrow_item = pa.string() if item_type == "string" else pa.int64() if item_type == "bigint" else pa.int32()

    def make(batch, found):
        rows = [(i, *x) for i, xs in enumerate(found) for x in xs]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [None, arrow_item, *[pa.int32()] * 4]
        arrays = [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], types[1:], strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=[id_col, item_col, "n_equal", "n_overlap", "doc_token", "item_token"])

    out = None
    for items in item_blocks(benchmark, item_col, item_text_col):
        part = _per_text(docs.select(id_col, text_col), items, 1, make, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item; all columns stay. See find_overlaps."""
    import pyarrow as pa

    def make(batch, found):
        return batch.filter(pa.array([not x for x in found], pa.bool_()))

    for items in item_blocks(benchmark, item_col, item_text_col):
        docs = _per_text(docs, items, docs.columns.index(text_col), make, docs.schema)
    return docs
