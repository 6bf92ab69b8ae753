"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, the root of (largest norm squared - own norm squared), all rows lie on a sphere,
and the squared distance of an anchor (its own component is 0) to a row is a constant of the anchor less
twice their inner product. So the best scores are the nearest rows, and a window of scores is an annulus.

The upper levels of one vantage-point tree are fitted to a bounded sample and deal all rows to cells;
a cell with many rows is cut into blocks of bounded size. A block's distances to the vantage points
above it bound how near its rows can be to an anchor. Each anchor first visits the block with the nearest
bound, then those blocks only that can still hold one of its k rows. In a block, a vantage-point tree is walked
nearest first inside the annulus until k rows that qualify have come. Scores are whole numbers, and
bounds give way by more than the rounding of distances, so results are exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pin, unpin

#: Rows that the upper levels of the tree are fitted to at most, and cells that they make at most.
SAMPLE_ROWS, MOST_CELLS = 4_096, 256
#: Rows of a block, and searches that meet it in one task, at most (in the mean; they are dealt by hash).
BLOCK_ROWS, BLOCK_SEARCHES = 16_384, 4_096
LEAF_ROWS = 512
#: Whole numbers up to here are exact in double precision.
_EXACT = 1 << 53


def _matrix(lists, width: int):
    """Rows of an Arrow list column as a matrix; short vectors end in zeros."""
    sizes = np.diff(np.array(lists.offsets))
    flat = np.array(lists.flatten(), dtype=np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def dots(rows, v, most: float):
    """Exact inner products of whole-number vectors, as 64-bit integers; beyond these they are clipped. ``most``: a bound of
    the sums of their absolute products."""
    if most >= _EXACT:
        exact = [sum(int(a) * int(b) for a, b in zip(r, v, strict=True)) for r in rows]
        return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in exact], np.int64)
    return (rows @ v).astype(np.int64)


class VantageTree:
    """A vantage-point tree over rows; the vectors of leaves lie side by side."""

    def __init__(self, vectors, extra, leaf: int = LEAF_ROWS, seed: int = 7):
        """``extra``: the augmenting component of each row."""
        self.order = np.arange(len(vectors))
        self.begin, self.end, self.child, self.point, self.split = [], [], [], [], []
        rng = np.random.default_rng(seed)
        self.vectors, self.extra = vectors, extra
        todo = [(0, len(vectors))]
        self._node(*todo[0])
        at = 0
        while at < len(self.begin):  # nodes number themselves; children are appended behind
            a, b = self.begin[at], self.end[at]
            if b - a > leaf:
                rows = self.order[a:b]
                # Of some rows the one whose distances to some others differ most.
                seen = rng.choice(rows, min(64, len(rows)), replace=False)
                point = max(seen[:6].tolist(), key=lambda p: self._distances(seen, vectors[p], extra[p]).std())
                d = self._distances(rows, vectors[point], extra[point])
                half = len(rows) // 2
                by = np.argpartition(d, half)
                self.order[a:b] = rows[by]
                inner, outer = d[by[:half]], d[by[half:]]
                self.point[at], self.child[at] = point, len(self.begin)
                self.split[at] = (inner.min(), inner.max(), outer.min(), outer.max())
                self._node(a, a + half)
                self._node(a + half, b)
            at += 1
        self.inner = [i for i, c in enumerate(self.child) if c >= 0]
        self.points = vectors[[self.point[i] for i in self.inner]]
        self.point_extra = extra[[self.point[i] for i in self.inner]]
        self.place = {n: j for j, n in enumerate(self.inner)}

    def _node(self, a: int, b: int) -> None:
        self.begin.append(a), self.end.append(b), self.child.append(-1), self.point.append(-1), self.split.append(None)

    def _distances(self, rows, v, e):
        d = self.vectors[rows] - v
        return np.sqrt(np.einsum("ij,ij->i", d, d) + (self.extra[rows] - e) ** 2)

    def nearest(self, v, least: float, most: float, slack: float):
        """Leaves as (lower bound of the distance, begin, end), nearest first, with only those that meet
        the annulus from ``least`` to ``most``; the caller stops when it has enough."""
        d = self.points - v
        to = np.sqrt(np.einsum("ij,ij->i", d, d) + self.point_extra**2)
        heap = [(least, 0, math.inf)]
        while heap:
            low, node, high = heapq.heappop(heap)
            child = self.child[node]
            if child < 0:
                yield low, self.begin[node], self.end[node]
                continue
            t = to[self.place[node]]
            a, b, c, e = self.split[node]
            for n, near, far in ((child, a, b), (child + 1, c, e)):
                lo, hi = max(low, t - far - slack, near - t - slack), min(high, t + far + slack)
                if lo <= most and hi >= least:
                    heapq.heappush(heap, (lo, n, hi))


class TopTree:
    """The upper levels: deals rows to cells and bounds the distances of anchors to them."""

    def __init__(self, vectors, extra, cells: int):
        leaf = max(8, math.ceil(len(vectors) / max(1, cells)))
        tree = VantageTree(vectors, extra, leaf)
        self.points, self.point_extra = tree.points, tree.point_extra
        self.child = [-1 if c < 0 else c for c in tree.child]
        self.place = tree.place
        # A row goes to the nearer part by the middle between both.
        self.middle = [None if s is None else (s[1] + s[2]) / 2 for s in tree.split]
        self.paths: dict[int, list[tuple[int, int]]] = {0: []}
        for n, c in enumerate(self.child):
            if c >= 0:
                self.paths[c] = self.paths[c + 1] = [*self.paths[n], self.place[n]]
        self.depth = max((len(p) for n, p in self.paths.items() if self.child[n] < 0), default=0)

    def distances(self, vectors, extra):
        """To each vantage point."""
        square = (vectors**2).sum(1)[:, None] + (self.points**2).sum(1) - 2 * vectors @ self.points.T
        return np.sqrt(np.maximum(0, square + (extra[:, None] - self.point_extra) ** 2))

    def cells(self, to):
        node = np.zeros(len(to), np.int64)
        open_ = np.arange(len(to)) if self.child[0] >= 0 else np.zeros(0, np.int64)
        place = np.array([self.place.get(n, -1) for n in range(len(self.child))])
        middle, child = np.array([m or 0.0 for m in self.middle]), np.array(self.child)
        while len(open_):
            at = node[open_]
            node[open_] = child[at] + (to[open_, place[at]] > middle[at])
            open_ = open_[child[node[open_]] >= 0]
        return node


def prepared(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """id, label and v, the vector of ``floor(scale * x)``: of rows with an id, a label and a vector without null, NaN
    or infinite components. Rows that repeat all of these count once."""
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x.cast("double")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return rows.filter(fine & finite).select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), whole.alias("v")).distinct()


class Space:
    """What bounds distances: the upper levels of the tree, and of each cell the least and the largest distance of its
    rows to the vantage points above it (at most MOST_CELLS cells)."""

    def __init__(self, square: float, width: int):
        """``square``: the largest norm squared."""
        self.square, self.width, self.slack = square, width, 1e-6 * (1 + math.sqrt(square))
        self.top, self.limits, self.parts = None, {}, {}

    def augment(self, vectors):
        return np.sqrt(np.maximum(0, self.square - (vectors**2).sum(1)))

    def bounds(self, vectors):
        """(cells, nearest, farthest): bounds of the distance of each anchor (row) to each cell (column)."""
        to, cells = self.top.distances(vectors, np.zeros(len(vectors))), sorted(self.limits)
        near, far = np.zeros((len(to), len(cells))), np.full((len(to), len(cells)), np.inf)
        for j, c in enumerate(cells):
            for p, (lo, hi) in zip(self.top.paths[c], self.limits[c], strict=True):
                near[:, j] = np.maximum(near[:, j], np.maximum(to[:, p] - hi, lo - to[:, p]) - self.slack)
                far[:, j] = np.minimum(far[:, j], to[:, p] + hi + self.slack)
        return np.array(cells, np.int64), near, far

    def annulus(self, vectors, low, high):
        """The distances that scores from ``low`` to ``high`` (Arrow columns; null: unbounded) have."""
        both = (vectors**2).sum(1) + self.square
        edge = lambda c, open_: np.where(np.array(c.is_null()), open_, np.sqrt(np.maximum(0, both - 2 * np.array(c.fill_null(0), dtype=np.float64))))
        return edge(high, 0.0), edge(low, np.inf)


class Index:
    """All rows in cells: id, label, v, cell."""

    def __init__(self, rows: DataFrame):
        spark, rows = rows.sparkSession, pin(rows, "vectors")
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("square"), F.max(F.size("v")).alias("width")).first()
        self.space = space = Space(size["square"] or 0.0, size["width"] or 0)
        sample = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE_ROWS).toArrow()
        vectors = _matrix(sample.column("v").combine_chunks(), space.width)
        space.top = TopTree(vectors, space.augment(vectors), min(MOST_CELLS, -(-size["n"] // BLOCK_ROWS)))
        sent = spark.sparkContext.broadcast(space)

        def deal(batches):
            import pyarrow as pa

            s = sent.value
            for batch in batches:
                v = _matrix(batch.column(2), s.width)
                to = s.top.distances(v, s.augment(v))
                cells = s.top.cells(to)
                path = [to[i, s.top.paths[c]] for i, c in enumerate(cells.tolist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array(path, pa.list_(pa.float64()))], names=["id", "label", "v", "cell", "path"])

        dealt = pin(rows.mapInArrow(deal, "id bigint, label bigint, v array<double>, cell int, path array<double>"), "dealt")
        limits = [f(F.col("path")[i]).alias(f"{name}{i}") for i in range(space.top.depth) for name, f in (("lo", F.min), ("hi", F.max))]
        for r in dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *limits).collect():
            space.limits[r["cell"]] = [(r[f"lo{i}"], r[f"hi{i}"]) for i in range(len(space.top.paths[r["cell"]]))]
            space.parts[r["cell"]] = -(-r["n"] // BLOCK_ROWS)
        unpin(rows)
        self.rows = dealt.drop("path")


_SEARCH = "search bigint, id bigint, label bigint, v array<double>, same boolean, low bigint, high bigint"
_FOUND = "search bigint, found bigint, score bigint"
_COLUMNS = ("search", "id", "label", "v", "same", "low", "high")


def _visit(index: Index, searches: DataFrame, k: int, kth: DataFrame | None, first: bool) -> DataFrame:
    """(search, found, score): the k best of each block that a search visits. On the ``first`` visit this is the
    cell with the nearest bound; then all others that can beat ``kth`` (search, least), the k-th score so far."""
    space, sent = index.space, searches.sparkSession.sparkContext.broadcast(index.space)
    asked = searches.select(*_COLUMNS, F.lit(None).cast("bigint").alias("least")) if kth is None else searches.join(kth, "search", "left").select(*_COLUMNS, "least")

    def route(batches):
        import pyarrow as pa

        s = sent.value
        for batch in batches:
            v = _matrix(batch.column(3), s.width)
            cells, near, far = s.bounds(v)
            inner, outer = s.annulus(v, batch.column(5), batch.column(6))
            near = np.maximum(near, inner[:, None])
            meets = (near <= outer[:, None] + s.slack) & (far >= inner[:, None] - s.slack)
            nearest = np.zeros_like(meets)
            nearest[np.arange(len(v)), np.where(meets, near, np.inf).argmin(axis=1)] = True
            if first:
                meets &= nearest
            else:
                _, reach = s.annulus(v, batch.column(7), batch.column(6))
                meets &= ~nearest & (near <= reach[:, None] + s.slack)
            i, j = np.nonzero(meets)
            many = np.array([s.parts[c] for c in cells.tolist()])[j]
            part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            rows = pa.array(np.repeat(i, many))
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in batch.columns], pa.array(np.repeat(cells[j], many), pa.int32()), pa.array(part, pa.int32())], names=[*_COLUMNS, "least", "cell", "part"])

    routed = asked.mapInArrow(route, f"{_SEARCH}, least bigint, cell int, part int")
    routed = pin(routed, "routed")
    # A block with many searches is met in shares, each with a copy of the block.
    load = routed.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SEARCHES).cast("int").alias("shares"))
    routed = routed.join(load, ["cell", "part"]).withColumn("share", F.pmod(F.xxhash64("search"), F.col("shares")).cast("int"))
    parts = F.create_map(*[F.lit(x) for c, p in space.parts.items() for x in (c, p)])[F.col("cell")]
    split = F.pmod(F.xxhash64("id", "v"), parts).cast("int")
    rows = index.rows.withColumn("part", split).join(load, ["cell", "part"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def walk(key, left, right):
        import pyarrow as pa

        out = ([], [], [])
        if left.num_rows and right.num_rows:
            block = Block(left, sent.value)
            v = _matrix(right.column("v").combine_chunks(), sent.value.width)
            columns = [right.column(c).to_pylist() for c in ("search", "id", "label", "same", "low", "high", "least")]
            last, seen = None, {}
            for i in np.lexsort((columns[3], columns[1])).tolist():
                search, own, label, same, low, high, least = (c[i] for c in columns)
                if (now := (own, label, same, v[i].tobytes())) != last:
                    last, seen = now, {}
                for found, score in block.best(v[i], own, label, same, max((x for x in (low, least) if x is not None), default=None), high, k, seen):
                    out[0].append(search), out[1].append(found), out[2].append(score)
        return pa.table([pa.array(np.array(c, np.int64)) for c in out], names=["search", "found", "score"])

    keys = ["cell", "part", "share"]
    return rows.groupBy(*keys).cogroup(routed.select(*keys, *_COLUMNS, "least").groupBy(*keys)).applyInArrow(walk, _FOUND)


class Block:
    """A bounded share of the rows with its own tree."""

    def __init__(self, table, space: Space, leaf: int = LEAF_ROWS):
        v = _matrix(table.column("v").combine_chunks(), space.width)
        self.tree, self.square, self.slack = VantageTree(v, space.augment(v), leaf), space.square, space.slack
        order = self.tree.order
        self.v = v[order]
        self.ids, self.labels = np.array(table.column("id"))[order], np.array(table.column("label"))[order]
        self.opened = 0

    def best(self, v, own: int, label: int, same: bool, low: int | None, high: int | None, k: int, seen: dict | None = None) -> list[tuple[int, int]]:
        """The k best (id, score) with scores from ``low`` to ``high``, of the ``same`` or another label. ``seen`` keeps leaves'
        scores for the next window of the same anchor and kind."""
        seen = {} if seen is None else seen
        both = (v @ v) + self.square
        edge = lambda s: math.sqrt(max(0.0, both - 2 * s))
        least = max(0.0, edge(high) - self.slack) if high is not None else 0.0
        most = edge(low) + self.slack if low is not None else math.inf
        kept = np.zeros((0, 3), np.int64)
        for bound, a, b in self.tree.nearest(v, least, most, self.slack):
            if len(kept) == k and bound > edge(-int(kept[-1, 0])) + self.slack:
                break
            self.opened += b - a
            if a not in seen:
                # No inner product is larger than the largest norm squared. Only rows of the right labels are kept.
                rows = a + np.flatnonzero(((self.labels[a:b] == label) == same) & (self.ids[a:b] != own))
                seen[a] = rows, dots(self.v[a:b], v, self.square)[rows - a]
            rows, score = seen[a]
            floor = low if len(kept) < k else -int(kept[-1, 0])
            fits = score >= floor if floor is not None else np.ones(len(rows), bool)
            if high is not None:
                fits &= score <= high
            at = np.flatnonzero(fits)
            if len(at) > 4 * k:  # ties with the k-th stay
                at = at[score[at] >= np.partition(score[at], -k)[-k]]
            if len(at):
                new = np.stack([-score[at], self.ids[rows[at]], self.labels[rows[at]]], axis=1)
                both_kept = np.concatenate([kept, new])
                kept = both_kept[np.lexsort((both_kept[:, 2], both_kept[:, 1], both_kept[:, 0]))[:k]]
        return [(int(i), -int(s)) for s, i, _ in kept]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("search").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def annulus_search(index: Index, searches: DataFrame, k: int) -> DataFrame:
    """(search, found, score, rank): of each search the k rows of the index with the highest scores from ``low`` to
    ``high`` (null: unbounded), of the same label or of others, but for rows of the search's own id."""
    near = pin(_visit(index, searches, k, None, True), "near")
    kth = near.withColumn("rank", F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), "found"))).filter(F.col("rank") == k).select("search", F.col("score").alias("least"))
    return _best(near.unionByName(_visit(index, searches, k, kth, False)), k)


def hard_negatives(
    rows: DataFrame, anchors, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, its best rows of other labels whose score is
    from ``window[0]`` to ``window[1]`` percent of that of the positive: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    ``anchors``: a condition on the column ``id``. Scores are inner products of ``floor(scale * x)``; equal ones come in
    order of id. Rows without id, label or vector, or with a null or non-finite component, take no part; rows that
    repeat id, label and vector count once, and other rows with an anchor's id are none of its partners. A
    short vector counts as ending in zeros. Other columns are ignored.
    """
    index = Index(prepared(rows, id_col, vector_col, label_col, scale))
    if not index.space.parts:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    asked = index.rows.filter(anchors).withColumn("search", F.monotonically_increasing_id())
    none = F.lit(None).cast("bigint")
    asked = pin(asked.select("search", "id", "label", "v", F.lit(True).alias("same"), none.alias("low"), none.alias("high")), "anchors")
    near = pin(annulus_search(index, asked, positives), "positives")
    pairs = asked.select(F.col("search").alias("anchor"), F.col("id"), "label", "v").join(near.select(F.col("search").alias("anchor"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "anchor")
    # low percent of the score <= 100 * negative <= high percent of it, in whole numbers.
    down = lambda x: F.expr(f"positive_score * {x} div 100 - CAST(positive_score * {x} % 100 < 0 AS INT)")
    pairs = pairs.withColumn("high", down(window[1])).withColumn("low", -F.expr(f"(-positive_score) * {window[0]} div 100 - CAST((-positive_score) * {window[0]} % 100 < 0 AS INT)")).filter(F.col("low") <= F.col("high"))
    windows = pin(pairs.withColumn("search", F.monotonically_increasing_id()).withColumn("same", F.lit(False)), "windows")
    found = annulus_search(index, windows.select(*_COLUMNS), negatives)
    out = windows.select("search", F.col("id").alias("anchor_id"), "positive_id", "positive_score").join(found, "search")
    return out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
