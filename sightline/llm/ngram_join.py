"""N-gram Jaccard join by R-trees of count vectors.

A document's set is its distinct shingles of ``width`` words; equal sets are one class, and classes are joined.
The tokens (shingles) are hashed into GROUPS groups, and a class is the point of its counts by group: two classes have
at most the sum of the smaller counts in common, so points whose bound is under the threshold are no link.

Points meet in cells. Under one order of all tokens, rare ones first, a class of n tokens is in the cells of its first
n - ceil(t * n) + 1; two classes at the threshold t or above share one of these, so no link is lost. A cell's
points lie in an R-tree: nodes of up to FAN children with the largest count of each group, the range of sizes
and whether all have one component. Pairs of nodes go down together while the bound allows a link between
different components; pairs of points that are left pass finer counts if they are long, and are then verified on their
full sets.

Components only are asked for, so this runs in two parts. The first looks in the cells of a class's first tokens,
within leaves only, for its most promising partner of another component, a few times over: it gathers groups of copies at
the price of a pair for each class. The second joins all cells in full, but for pairs of one component, and for those
which can't reach the threshold with what their sets have from the cell's token on: if that token is the first they
share they are no link, and otherwise they meet in an earlier cell.
A cell with many points is dealt in parts, each two of which meet in a task of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dedup import Shingler, _relabelled
from .shared import LAST_ID, pin, unpin

GROUPS = 64
#: Groups of the second part's points; of sets of more tokens than LONG there are finer points, by which they meet one another.
MANY, LONG, FINE = 256, 1_500, 2_048
FAN = 24
#: Points of a cell's part (in the mean; they are dealt by hash).
CELL = 4_096
#: Of how many documents about the frequent tokens are counted, in how many of them such a token is, and how many are
#: known at most. They only order the tokens; no token is left out.
SAMPLE_DOCS, FREQUENT_IN, MOST_FREQUENT = 20_000, 10, 100_000
#: Tokens of a class that the first part looks at, and how often at most.
FIRST_TOKENS, ROUNDS = 6, 3
#: Pairs of nodes or points that are looked at together.
SLICE = 60_000
#: Words of 64 bits that say which texts are read again.
BITMAP = 1 << 20


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("code"), F.col(text_col).alias("text"))


def frequent_tokens(base: DataFrame, width: int):
    """(tokens in order of value, their ranks by frequency) of a sample of about SAMPLE_DOCS documents."""
    n = base.count()

    def run(batches):
        import pyarrow as pa

        make = Shingler(width)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(make.shingles(t).view(np.int64))], names=["token"])

    share = max(1, n // SAMPLE_DOCS)
    some = base.filter(F.pmod(F.xxhash64("doc_id", "code"), F.lit(share)) == 0).select("text")
    counts = some.mapInArrow(run, "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT_IN)
    found = counts.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toArrow()
    tokens, often = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, often))] = np.arange(len(tokens))
    by = np.argsort(tokens)
    return tokens[by], rank[by]


def first_tokens(shingles, frequent, percent: int):
    """(rare, frequent): the first n - ceil(t * n) + 1 of the sorted ``shingles``; rare ones come first, by value, then the
    others by frequency."""
    tokens, rank = frequent
    n = len(shingles) - -(-percent * len(shingles) // 100) + 1
    at = np.minimum(np.searchsorted(tokens, shingles), max(0, len(tokens) - 1))
    known = tokens[at] == shingles if len(tokens) else np.zeros(len(shingles), bool)
    rare, often = shingles[~known][:n], shingles[known]
    often = often[np.argsort(rank[at[known]])] if len(often) else often
    return rare, often[: n - len(rare)]


def count_vector(shingles, groups: int = GROUPS):
    """How many tokens each group has; 255 stands for all larger counts too."""
    return np.minimum(255, np.bincount((shingles >> np.uint64(20)) % np.uint64(groups), minlength=groups)).astype(np.uint8)


def _signed(base: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, code, n_shingles, set_a, set_b (128 bits of the set), groups, many and fine (counts), rare and often (the first tokens)."""
    sent = base.sparkSession.sparkContext.broadcast(frequent_tokens(base, width))

    def run(batches):
        import hashlib

        import pyarrow as pa

        make, frequent = Shingler(width), sent.value
        for batch in batches:
            n, a, b, groups, many, fine, rare, often = [], [], [], [], [], [], [], []
            for t in batch.column(2).to_pylist():
                s = make.shingles(t)
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(s)), a.append(d[0]), b.append(d[1]), groups.append(count_vector(s).tobytes())
                many.append(count_vector(s, MANY).tobytes())
                fine.append(count_vector(s, FINE).tobytes() if len(s) > LONG else None)
                x, y = first_tokens(s, frequent, percent) if len(s) else (s, s)
                rare.append(x.view(np.int64)), often.append(y.view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(groups, pa.binary()), pa.array(many, pa.binary()), pa.array(fine, pa.binary()), pa.array(rare, longs), pa.array(often, longs)],
                names=["doc_id", "code", "n_shingles", "set_a", "set_b", "groups", "many", "fine", "rare", "often"],
            )

    return base.mapInArrow(run, "doc_id bigint, code bigint, n_shingles bigint, set_a bigint, set_b bigint, groups binary, many binary, fine binary, rare array<bigint>, often array<bigint>")


def _shared(tokens: DataFrame) -> DataFrame:
    """The rows whose token another row has too. Tasks read the rows in order of token and hold none but the last."""
    schema = tokens.schema

    def run(batches):
        import pyarrow as pa

        held, same = None, False  # the last row, and whether the one before has its token
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            t = np.array(batch.column(0))
            next_ = t[1:] == t[:-1]
            keep = np.append(same, next_) | np.append(next_, False)
            held, same = batch.slice(len(t) - 1), bool(next_[-1]) if len(next_) else same
            yield batch.slice(0, len(t) - 1).filter(pa.array(keep[:-1]))
        if held is not None and same:
            yield held

    return tokens.repartition("token").sortWithinPartitions("token").mapInArrow(run, schema)


def _runs(batches, most: int, whole: bool):
    """Tables of about ``most`` rows of an ordered stream. ``whole``: all rows of a key (columns key, i, j) come together."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            table = pa.Table.from_batches(held)
            cut = table.num_rows
            if whole:
                keys = np.stack([table.column(c).to_numpy() for c in ("token", "i", "j")], axis=1)
                new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
                cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """R-trees over the points of many cells. Level 0 has the points; a node of a higher level has up to FAN
    neighbours of the level below, and never those of two cells."""

    def __init__(self, cell, size, counts, label, percent: int, room=None):
        """``cell``: non-decreasing; a cell's neighbouring points should be alike. ``room``: how many tokens a set has from the
        cell's token on."""
        self.percent = percent
        full = (counts == 255).any(axis=1)  # no bound
        self.levels = [dict(cell=cell, high=counts, full=full, least=size, most=size, low=label, top=label, room=size if room is None else room, first=None)]
        while True:
            x = self.levels[-1]
            new = np.append(True, x["cell"][1:] != x["cell"][:-1])
            start = np.flatnonzero(new)
            if len(start) == len(new) and len(self.levels) > 1:
                break
            at = np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))
            first = np.flatnonzero(at % FAN == 0)
            self.levels.append(
                dict(
                    cell=x["cell"][first], first=np.append(first, len(new)), high=np.maximum.reduceat(x["high"], first), full=np.logical_or.reduceat(x["full"], first), least=np.minimum.reduceat(x["least"], first),
                    most=np.maximum.reduceat(x["most"], first), low=np.minimum.reduceat(x["low"], first), top=np.maximum.reduceat(x["top"], first), room=np.maximum.reduceat(x["room"], first),
                )
            )
        self.looked = 0

    def may_link(self, level: int, a, b):
        """Which pairs of nodes can hold a link between two labels."""
        x, p = self.levels[level], self.percent
        ok = (100 * x["most"][a] >= p * x["least"][b]) & (100 * x["most"][b] >= p * x["least"][a])
        ok &= (x["low"][a] != x["top"][a]) | (x["low"][b] != x["top"][b]) | (x["low"][a] != x["low"][b])
        ok &= (100 + p) * np.minimum(x["room"][a], x["room"][b]) >= p * (x["least"][a] + x["least"][b])
        at = np.flatnonzero(ok)
        self.looked += len(at)
        ok[at] = (100 + p) * self.common(level, a[at], b[at]) >= p * (x["least"][a[at]] + x["least"][b[at]])
        return ok

    def common(self, level: int, a, b):
        """The most that points of two nodes can have in common."""
        x = self.levels[level]
        parts = [np.minimum(x["high"][a[i : i + SLICE]], x["high"][b[i : i + SLICE]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), SLICE)]
        found = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return np.where(x["full"][a] | x["full"][b], np.minimum(x["most"][a], x["most"][b]), found)

    def _below(self, level: int, a, b):
        """All pairs of children of the pairs of nodes; of a node and itself each pair once."""
        first = self.levels[level]["first"]
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        many = na * nb
        of = np.repeat(np.arange(len(a)), many)
        at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        c, d = first[a[of]] + at // nb[of], first[b[of]] + at % nb[of]
        keep = (a[of] != b[of]) | (c < d if level == 1 else c <= d)
        return c[keep], d[keep]

    def join(self, starts):
        """Pairs of points (a, b) that can be links between two labels, in slices. ``starts``: of each level above 0, pairs of
        nodes to begin with."""
        todo = [(level, a, b) for level, (a, b) in starts.items()]
        while todo:
            level, a, b = todo.pop()
            ok = self.may_link(level, a, b)
            a, b = a[ok], b[ok]
            if level == 0:
                if len(a):
                    yield a, b
                continue
            step = max(1, SLICE // (FAN * FAN))
            for i in range(0, len(a), step):
                todo.append((level - 1, *self._below(level, a[i : i + step], b[i : i + step])))

    def roots(self):
        """(level, node) of each cell's root, cells in order."""
        cells = self.levels[-1]["cell"]
        level, node = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
        for k in range(len(self.levels) - 1, 0, -1):
            at = np.searchsorted(self.levels[k]["cell"], cells)
            alone = np.searchsorted(self.levels[k]["cell"], cells, side="right") - at == 1
            level[alone], node[alone] = k, at[alone]
        return level, node


def _arranged(table, cell, by_label: bool):
    """The columns of a table by cell, size and a projection of the counts: alike points are neighbours. ``by_label``: after
    the label, so that most nodes have one."""
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    size, label, name = (table.column(c).to_numpy() for c in ("n_shingles", "label", "class"))
    line = counts @ np.random.default_rng(5).normal(size=counts.shape[1]).astype(np.float32)
    by = np.lexsort((line, size, label if by_label else size, cell))
    room = size - table.column("at").to_numpy() if "at" in table.column_names else size
    return cell[by], size[by], counts[by], label[by], name[by], room[by]


def _numbered(*keys):
    """A number for each different row of ``keys``, which lie in order."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _promising(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b), a > b: for each class a partner of another label that most likely is a link, of those in a leaf or first in its cell."""

    def run(batches):
        import pyarrow as pa

        for table in _runs(batches, 50_000, whole=False):
            cell = _numbered(table.column("token").to_numpy())
            cell, size, counts, label, name, _ = _arranged(table, cell, False)
            forest = Forest(cell, size, counts, label, percent)
            leaves = np.arange(len(forest.levels[1]["cell"]))
            found = [(a, b, forest.common(0, a, b) / (size[a] + size[b])) for a, b in forest.join({1: (leaves, leaves)})]
            start = np.searchsorted(cell, cell)
            other = np.flatnonzero(start != np.arange(len(cell)))
            ok = forest.may_link(0, other, start[other])
            found.append((other[ok], start[other][ok], forest.common(0, other[ok], start[other][ok]) / (size[other[ok]] + size[start[other][ok]])))
            a, b, how = (np.concatenate(x) for x in zip(*found, strict=True))
            ends, partners, how = name[np.append(a, b)], name[np.append(b, a)], np.append(how, how)
            by = np.lexsort((partners, -how, ends))
            first = by[np.append(True, ends[by][1:] != ends[by][:-1])] if len(by) else by
            yield pa.RecordBatch.from_arrays([pa.array(ends[first]), pa.array(partners[first]), pa.array(how[first], pa.float64())], names=["a", "b", "how"])

    # Where a partition is split, a pair may be missed; the second round finds it.
    dealt = rows.hint("rebalance", "token").sortWithinPartitions("token")
    best = dealt.mapInArrow(run, "a bigint, b bigint, how double").groupBy("a").agg(F.max_by("b", F.struct("how", "b")).alias("b"))
    return best.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _joined(rows: DataFrame, percent: int, most: int) -> DataFrame:
    """(a, b), a > b: all pairs of different labels that share a cell and that the bounds allow. ``rows``: token, at, i, j, side,
    class, n_shingles, counts, label; ``most``: of them about so many are in memory; if i and j differ, points of side 0 meet those of side 1 only."""

    def run(batches):
        import pyarrow as pa

        for table in _runs(batches, most, whole=True):
            i, j, side = (table.column(c).to_numpy() for c in ("i", "j", "side"))
            cell = _numbered(table.column("token").to_numpy(), i, j, side)
            key = _numbered(table.column("token").to_numpy(), i, j)
            of_cell = np.append(True, cell[1:] != cell[:-1])
            alone, work = (i == j)[of_cell], key[of_cell]
            cell, size, counts, label, name, room = _arranged(table, cell, True)
            forest = Forest(cell, size, counts, label, percent, room)
            level, node = forest.roots()
            starts = {}
            two = np.flatnonzero((work[1:] == work[:-1]))
            left, right = np.append(np.flatnonzero(alone), two), np.append(np.flatnonzero(alone), two + 1)
            # A pair of trees begins where the lower one has its root.
            at = np.minimum(level[left], level[right])
            for k in np.unique(at):
                l_, r_ = left[at == k], right[at == k]
                begin = lambda t: (np.searchsorted(forest.levels[k]["cell"], t), np.searchsorted(forest.levels[k]["cell"], t, side="right"))  # noqa: E731, B023
                (a0, a1), (b0, b1) = begin(l_), begin(r_)
                na, nb = a1 - a0, b1 - b0
                of = np.repeat(np.arange(len(l_)), na * nb)
                n = np.arange(len(of)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
                starts[int(k)] = (a0[of] + n // nb[of], b0[of] + n % nb[of])
            for a, b in forest.join(starts):
                both = np.unique(np.stack([np.maximum(name[a], name[b]), np.minimum(name[a], name[b])], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    dealt = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "side")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that the finer counts of long sets allow."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            both = [i for i, (x, y) in enumerate(zip(batch.column(4).is_valid().to_pylist(), batch.column(5).is_valid().to_pylist(), strict=True)) if x and y]
            keep = np.ones(batch.num_rows, bool)
            for i in range(0, len(both), 4096):
                at = pa.array(both[i : i + 4096], pa.int64())
                x, y = (np.frombuffer(b"".join(batch.column(c).take(at).to_pylist()), np.uint8).reshape(-1, FINE) for c in (4, 5))
                n = np.array(batch.column(2).take(at)) + np.array(batch.column(3).take(at))
                full = (x == 255).any(axis=1) | (y == 255).any(axis=1)
                keep[both[i : i + 4096]] = full | ((100 + percent) * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= percent * n)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    of = lambda c: classes.select(F.col("class").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("fine").alias(f"fine{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "finea", "fineb").mapInArrow(run, "a bigint, b bigint")


def _texts(base: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """class, text: a text of each class in ``pairs``. A bitmap of fixed size says which rows move."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    where = pin(classes.join(ids, "class").select("class", "doc_id", "code"), "where")
    h = F.pmod(F.xxhash64("doc_id", "code"), F.lit(BITMAP * 64)).alias("at")
    bits = where.select(h).groupBy(F.expr("CAST(at DIV 64 AS INT)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
    words = bits.toArrow()
    bitmap = np.zeros(BITMAP, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    sent = base.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def run(batches):
        import pyarrow as pa

        bits = sent.value
        for batch in batches:
            at = np.array(batch.column(3))
            hit = (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool))).select(["doc_id", "code", "text"])

    read = base.select("doc_id", "code", "text", h).mapInArrow(run, "doc_id bigint, code bigint, text string")
    out = pin(read.join(where, ["doc_id", "code"]).dropDuplicates(["class"]).select("class", "text"), "texts")
    unpin(where)
    return out


def _verified(pairs: DataFrame, base: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (a, b) among ``pairs``, by the full sets of their texts. Texts move, as they pack better than hashes."""
    pairs = pin(_alike(pairs, classes, percent), "alike")
    if pairs.isEmpty():
        return pairs
    texts = _texts(base, classes, pairs)

    def run(batches):
        import pyarrow as pa

        make, last, own = Shingler(width), None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if a != last:
                    last, own = a, make.shingles(x)
                other = make.shingles(y)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: texts.select(F.col("class").alias(c), F.col("text").alias(f"text{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "texta", "textb")
    out = pin(both.mapInArrow(run, "a bigint, b bigint"), "links")
    unpin(texts, pairs)
    return out


def _labelled(cells: DataFrame, labels: DataFrame | None) -> DataFrame:
    """token, class, at, and the label of the class; a class without links is its own."""
    if labels is None:
        return cells.select("token", "class", "at", F.col("class").alias("label"))
    return cells.select("token", "class", "at").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def join_classes(classes: DataFrame, base: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(class, label) of the classes with links; None: there are none."""
    rare = classes.select("class", F.posexplode("rare").alias("at", "token"))
    often = classes.select("class", F.size("rare").alias("n"), F.posexplode("often").alias("at", "token")).withColumn("at", F.col("at") + F.col("n"))
    cells = pin(_shared(rare.select("token", "class", "at")).unionByName(often.select("token", "class", "at")), "cells")
    points = lambda c: classes.select("class", "n_shingles", F.col(c).alias("counts"))
    labels = None
    for _ in range(ROUNDS):
        first = _labelled(cells.filter(F.col("at") < FIRST_TOKENS), labels)
        if labels is not None:
            mixed = first.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
            first = first.join(mixed, "token", "left_semi")
        pairs = pin(_promising(first.drop("at").join(points("groups"), "class"), percent), "pairs")
        links = _verified(pairs, base, classes, width, percent)
        more = not links.isEmpty()
        labels = _relabelled(labels, links) if more else labels
        unpin(pairs, links)
        if not more:
            break
    # Cells with more than one component, their points dealt in parts.
    own = pin(_labelled(cells, labels), "labelled")
    mixed = own.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    mixed = mixed.select("token", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    rows = own.join(mixed, "token").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j"))))
    rows = rows.withColumn("with", meets).select("token", "class", "at", "label", "with.i", "with.j", (F.col("part") != F.col("with.i")).cast("int").alias("side"))
    # A set that is a little longer than LONG meets the shorter ones as one of them.
    short = rows.join(points("many").filter(F.col("n_shingles") * percent <= LONG * 100), "class")
    long = rows.join(points("fine").filter(F.col("n_shingles") > LONG), "class")
    pairs = pin(_joined(short, percent, 50_000).unionByName(_joined(long, percent, 10_000)).distinct(), "pairs")
    links = _verified(pairs, base, classes, width, percent)
    labels = labels if links.isEmpty() else _relabelled(labels, links)
    unpin(own, cells, pairs, links)
    return labels


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id.

    Words are split at ASCII white space, A-Z in lower case. Documents whose sets have 100 * common >= percent *
    all are linked, and component_id is the smallest id that links lead to. A text of fewer words than
    ``width`` is one shingle; a null or empty text, or one without words, has none and is linked with nothing. Repeated
    rows each have a row; null ids order behind all others. Other columns are ignored.
    """
    base = _keyed(docs, id_col, text_col)
    signed = pin(_signed(base, width, percent), "signed")
    some = signed.filter(F.col("n_shingles") > 0)
    groups = some.groupBy("n_shingles", "set_a", "set_b").agg(F.min(F.struct("doc_id", "code")).alias("first"), *[F.first(c).alias(c) for c in ("groups", "many", "fine", "rare", "often")])
    columns = ("class", "n_shingles", "set_a", "set_b", "first.doc_id", "first.code", "groups", "many", "fine", "rare", "often")
    classes = pin(groups.withColumn("class", F.monotonically_increasing_id()).select(*columns), "classes")
    labels = join_classes(classes, base, width, percent)
    named = classes.select("class", "n_shingles", "set_a", "set_b", F.col("doc_id").alias("first"))
    named = named.withColumn("label", F.col("class")) if labels is None else named.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    named = pin(named, "named")
    tops = named.groupBy("label").agg(F.min("first").alias("component_id"))
    placed = named.join(tops, "label").select("n_shingles", "set_a", "set_b", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(placed, ["n_shingles", "set_a", "set_b"], "left")
    null_last = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id")).select(null_last("doc_id").alias(id_col), "n_shingles", null_last("component_id").alias("component_id"))
