"""Near duplicates by a chosen-path similarity join over minwise tokens.

A document's set is its distinct shingles of ``width`` words. Equal sets become one class, and
only classes are joined. A tree starts with all classes at its root. A node is split by one or two
chosen coordinates of the minwise signature: classes with equal minwise tokens share a child, so
that a pair at the threshold survives a level with one child or more. Nodes with one class are
dropped. Nodes of up to LEAF classes are compared exhaustively; larger ones compare LEADERS
leaders with all their classes and are split further, up to MAX_DEPTH levels. Those that are still large
then and not yet one component are compared exhaustively too, block by block. Independent trees are
repeated in two waves to reach the recall.

Only connected components are asked for, so a node whose classes already share a component is
left, and pairs within a component are not compared: a group of thousands of near copies costs a
few comparisons for each of them, not all pairs. Before all, each class is compared with one class of each of
its first nodes, which gathers most copies. Of the candidates of a level each class's most
similar one is confirmed first; at a wave's end, those others that still join two components.

Candidates are pairs of numbers; a sketch of SIGNATURE bytes rejects those below the threshold by
four standard deviations, and all others are confirmed on the full shingle sets, which lie
bucketed so that only the pairs move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LAST_ID, buckets_of, pin, pin_bucketed, unpin

SIGNATURE = 64
#: Trees of the first wave, and of the second, which looks at what is still apart.
WAVES = (range(0, 2), range(2, 8))
LEAF = 24
LEADERS = 16
MAX_DEPTH = 4
BLOCK = 256
PERCENT = 80
SEED = 20_240_601


class Shingler:
    """Shingle hashes of texts; one for each task."""

    def __init__(self, width: int):
        import numpy as np
        import xxhash

        self.np, self.width, self.digest, self.seen = np, width, xxhash.xxh3_64_intdigest, {}  # seen: bounded below
        rng = np.random.default_rng(SEED)
        self.a = (rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint64).astype(np.uint32)
        self.mix = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]

    def shingles(self, text: str | None):
        """The sorted distinct 64-bit hashes of the shingles: words split at ASCII white space, A-Z in
        lower case; all words as one shingle if they are fewer than the width."""
        np = self.np
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        if len(seen) > 100_000:
            seen.clear()
        codes = list(map(seen.get, words))
        if None in codes:
            for i, c in enumerate(codes):
                if c is None:
                    codes[i] = seen[words[i]] = self.digest(words[i])
        code = np.array(codes, np.uint64)
        n = len(code) - self.width + 1
        if n < 1:
            out = np.array([self.digest(b" ".join(words) + b"\n")], np.uint64)
        else:
            out = np.zeros(n, np.uint64)
            for k, m in enumerate(self.mix):
                out += (code[k : k + n] ^ (code[k : k + n] >> np.uint64(31))) * m
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(29)
        return np.unique(out)

    def signature(self, shingles):
        """SIGNATURE minwise tokens."""
        np = self.np
        low = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
        for s in range(0, len(low), 4096):
            part = low[s : s + 4096, None] * self.a + self.b
            part ^= part >> np.uint32(15)
            part *= np.uint32(0x2C1B3C6D)
            np.minimum(out, part.min(axis=0), out=out)
        return out.view(np.int32)


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, code (hash of the text), n_shingles, set_a, set_b (128 bits of the set), sig."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        make = Shingler(width)
        for batch in batches:
            n, a, b, sig = [], [], [], []
            for t in batch.column(2).to_pylist():
                s = make.shingles(t)
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                n.append(len(s)), a.append(d[0]), b.append(d[1])
                sig.append(make.signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
                names=["doc_id", "code", "n_shingles", "set_a", "set_b", "sig"],
            )

    return docs.mapInArrow(run, "doc_id bigint, code bigint, n_shingles bigint, set_a bigint, set_b bigint, sig array<int>")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, code and the sorted shingles of the text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        make = Shingler(width)
        for batch in batches:
            sets = [make.shingles(t).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "code", "shingles"])

    return docs.select("doc_id", "code", "text").mapInArrow(run, "doc_id bigint, code bigint, shingles array<bigint>")


def _chosen(tree_or_node: Column, depth: int) -> Column:
    """The coordinates that split a node. A root has one in three cases of four and else two, 1.25 = 1 / 0.8 on
    average; later levels have two in half the cases, so that pairs at the threshold don't die out on the way."""
    h = F.xxhash64(F.lit(SEED), F.lit(depth), tree_or_node)
    first = F.pmod(h, F.lit(SIGNATURE)).cast("int")
    second = F.pmod(F.shiftright(h, 16), F.lit(SIGNATURE)).cast("int")
    two = F.pmod(F.shiftright(h, 32), F.lit(4)) < (1 if depth == 0 else 2)
    return F.when(two & (first != second), F.array(first, second)).otherwise(F.array(first))


def _children(rows: DataFrame, depth: int) -> DataFrame:
    """(node, class) with sig -> rows of the next level."""
    picked = rows.withColumn("pick", F.explode(_chosen(F.col("node"), depth)))
    child = F.xxhash64("node", "pick", F.col("sig")[F.col("pick")])
    return picked.select(child.alias("node"), "class").distinct() if depth else picked.select(child.alias("node"), "class")


def _alike(a: Column, b: Column) -> Column:
    """How many minwise tokens two signatures share."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b): rows (class, label), label the smallest class of each.

    Large stars and small stars by turns until nothing changes. A hub's rows meet its minimum in
    a join of two tables that are read from files, which can split them.
    """
    edges = pin(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pin(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        # A node that is no star's centre now has few neighbours, all smaller.
        low = F.min("v").over(Window.partitionBy("u"))
        near = large.withColumn("m", low)
        stars = near.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, edges = edges, pin(stars.select("e.u", "e.v").filter("u <> v").distinct(), "stars")
        unpin(before, least)
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            return edges.select(F.col("u").alias("class"), F.col("v").alias("label"))
        mark = now


def _relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(class, label) of all linked classes, after new links between classes."""
    if labels is None:
        found = pin(components(links), "labels")
        return found.unionByName(found.select(F.col("label").alias("class"), "label").distinct())
    # Only the labels' graph is looked at: a component is one node of it.
    of = lambda c: F.coalesce(F.col(f"l{c}"), F.col(c)).alias(c)
    ends = links.join(labels.select(F.col("class").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("class").alias("b"), F.col("label").alias("lb")), "b", "left")
    moved = pin(components(ends.select(of("a"), of("b"))), "moved")
    moved = moved.select(F.col("class").alias("label"), F.col("label").alias("now"))
    old = labels.join(moved, "label", "left").select("class", F.coalesce("now", "label").alias("label"))
    new = moved.select(F.col("label").alias("class"), F.col("now").alias("label")).unionByName(moved.select(F.col("now").alias("class"), F.col("now").alias("label")))
    return pin(old.unionByName(new).distinct(), "labels")


def _partners(all_of: str, x: Column, apart, percent: int) -> Column:
    """Of the list ``all_of`` of classes those that ``apart`` lets meet ``x`` and whose sizes and sketches don't rule them out
    (with how ``alike`` they are). They are weeded out inside the list, so no row is made of the others."""
    near = lambda y: apart(y) & (100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"]))
    told = F.transform(F.filter(all_of, near), lambda y: F.struct(*(y[c].alias(c) for c in ("class", "size", "doc_id", "code")), _alike(x["sketch"], y["sketch"]).alias("alike")))
    return F.filter(told, lambda p: p["alike"] >= _least(percent))


MEMBER = ("class", "label", "size", "sketch", "doc_id", "code")


def _paired(lists: DataFrame, x: Column, apart, percent: int) -> DataFrame:
    """``x`` and its partners in the column ``all``: pairs (u, v, alike)."""
    side = lambda r: F.struct(*(r[c].alias(c) for c in ("class", "size", "doc_id", "code")))
    return lists.select(side(x).alias("u"), F.explode(_partners("all", x, apart, percent)).alias("y")).select("u", side(F.col("y")).alias("v"), "y.alike")


def _leaf_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """The likely pairs of different labels of the nodes with up to LEAF classes."""
    # At most LEAF classes in a list.
    listed = mixed.filter(F.col("n") <= LEAF).groupBy("node").agg(F.collect_list(F.struct(*MEMBER)).alias("all"))
    x = F.col("x")
    return _paired(listed.select("all", F.explode("all").alias("x")), x, lambda y: (y["class"] < x["class"]) & (y["label"] != x["label"]), percent)


def _leader_pairs(mixed: DataFrame, depth: int, percent: int) -> DataFrame:
    """Likely pairs of different labels between the classes of the larger nodes and the node's leaders.

    Each of LEADERS hashes names the class with the smallest value of its label: minima that tasks
    aggregate before they shuffle, however large the node.
    """
    large = mixed.filter(F.col("n") > LEAF).select("node", *MEMBER)
    least = [F.min(F.struct(F.xxhash64(F.lit(depth * LEADERS + i), "label").alias("h"), *MEMBER)).alias(f"l{i}") for i in range(LEADERS)]
    named = large.groupBy("node").agg(*least)
    leaders = pin(named.select("node", F.array_distinct(F.array(*[F.struct(*(F.col(f"l{i}.{c}").alias(c) for c in MEMBER)) for i in range(LEADERS)])).alias("all")), "leaders")
    x = F.struct(*MEMBER)
    return _paired(large.join(leaders, "node"), x, lambda y: y["label"] != x["label"], percent)


def _block_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """All likely pairs of different labels of nodes of any size: a node's classes are dealt to blocks of about BLOCK, and
    each two of its blocks meet in a task of their own."""
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = mixed.withColumn("own", F.pmod(F.xxhash64(F.lit(SEED), "class"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    cells = dealt.groupBy("node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list(F.struct(*MEMBER, "own")).alias("all"))
    x = F.col("x")
    return _paired(
        cells.select("lo", "hi", "all", F.explode("all").alias("x")), x,
        lambda y: (y["class"] < x["class"]) & (y["label"] != x["label"]) & ((F.col("lo") == F.col("hi")) | (y["own"] != x["own"])), percent,
    )


def _first_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Each class of a node with one other, the one with the smallest hash, where likely: minima that tasks aggregate before they shuffle."""
    first = mixed.groupBy("node").agg(F.min(F.struct(F.xxhash64(F.lit(SEED), "label").alias("h"), *MEMBER)).alias("f"))
    x = F.struct(*MEMBER)
    return _paired(mixed.join(first, "node").withColumn("all", F.array("f")), x, lambda y: y["class"] != x["class"], percent)


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the size, sketch and text of their class."""
    return rows.join(classes.select("class", F.col("n_shingles").alias("size"), "sketch", "doc_id", "code"), "class")


def _mixed(rows: DataFrame, labels: DataFrame | None, classes: DataFrame) -> DataFrame:
    """The rows (node, class) of the nodes that have more than one label, with MEMBER and the node's number of classes n."""
    label = rows.withColumn("label", F.col("class")) if labels is None else rows.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    labelled = pin(label.select("node", "class", "label"), "labelled")
    sizes = labelled.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter(F.col("lo") != F.col("hi"))
    mixed = pin(_members(labelled.join(sizes.select("node", "n"), "node"), classes), "mixed")
    unpin(labelled)
    return mixed


def _least(percent: int) -> int:
    """Shared minwise tokens that a pair at the threshold has at least, but for four standard deviations."""
    s = percent / 100
    return int(SIGNATURE * (s - 4 * (s * (1 - s) / SIGNATURE) ** 0.5))


def _likely(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of classes a > b, with how alike these are, their sizes and where their texts are."""
    ends = pairs.select("alike", F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    of = lambda r, c: (F.col(f"{r}.class").alias(c), F.col(f"{r}.size").alias(f"n{c}"), F.col(f"{r}.doc_id").alias(f"id{c}"), F.col(f"{r}.code").alias(f"code{c}"))
    return ends.select(*of("x", "a"), *of("y", "b"), "alike").dropDuplicates(["a", "b"])


def _confirmed(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    of = lambda c: sets.select(F.col("doc_id").alias(f"id{c}"), F.col("code").alias(f"code{c}"), F.col("shingles").alias(f"x{c}"))
    both = likely.join(of("b"), ["idb", "codeb"]).join(of("a"), ["ida", "codea"])
    common = F.size(F.array_intersect("xa", "xb")).cast("bigint")
    return both.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b").distinct()


def _best(likely: DataFrame) -> DataFrame:
    """The pairs that are the most similar one of a class."""
    ways = likely.select("alike", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(likely.select("alike", F.col("b").alias("src"), F.col("a").alias("dst")))
    best = ways.groupBy("src").agg(F.max(F.struct("alike", "dst")).alias("best"))
    return best.select(F.greatest("src", "best.dst").alias("a"), F.least("src", "best.dst").alias("b")).distinct()


def _linked(likely: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame | None:
    """The labels after the links among ``likely`` pairs."""
    links = pin(_confirmed(likely, sets, percent), "links")
    if not links.isEmpty():
        labels = _relabelled(labels, links)
    unpin(links)
    return labels


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs of different components."""
    if labels is not None:
        for c in "ab":
            pairs = pairs.join(labels.select(F.col("class").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
        pairs = pairs.filter("la <> lb").drop("la", "lb")
    return pairs


def _roots(classes: DataFrame, trees) -> DataFrame:
    """(node, class) of the first level of ``trees``."""
    return _children(classes.select("class", "sig", F.explode(F.array(*[F.xxhash64(F.lit(SEED), F.lit(t)) for t in trees])).alias("node")), 0)


def link_classes(classes: DataFrame, sets_of, percent: int = PERCENT) -> DataFrame:
    """(class, label) of the classes that are linked with others.

    ``classes``: class, n_shingles, sig, sketch, and doc_id and code of its text. ``sets_of(ids)``: doc_id, code
    and full sorted shingle set, for the classes of ``ids``.
    """
    spark, labels = classes.sparkSession, None
    # No class can meet a partner but where it shares a node of a first level.
    first = _roots(classes, [t for wave in WAVES for t in wave])
    shared = first.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    ids = pin(first.join(shared, "node").select("class").distinct(), "met")
    if ids.isEmpty():
        return spark.createDataFrame([], "class bigint, label bigint")
    sets = sets_of(ids)
    # Groups of copies are gathered first, at a pair for each class and node: all pairs of a node are looked at only where
    # it still has more than one component.
    roots = _roots(classes, WAVES[0])
    several = roots.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    firsts = _members(roots.join(several, "node", "left_semi").withColumn("label", F.col("class")), classes)
    likely = pin(_likely(_first_pairs(firsts, percent)), "likely")
    best = pin(likely.join(_best(likely), ["a", "b"]), "best")
    labels = _linked(best, labels, sets, percent)
    unpin(likely, best)
    large = []
    for trees in WAVES:
        rows, others, done = _roots(classes, trees), [], []
        for depth in range(1, MAX_DEPTH + 1):
            mixed = _mixed(rows, labels, classes)
            if mixed.isEmpty():
                break
            likely = pin(_likely(_leaf_pairs(mixed, percent).unionByName(_leader_pairs(mixed, depth, percent))), "likely")
            # Each class's most similar one first: most others then lie within a component.
            best = pin(likely.join(_best(likely), ["a", "b"]), "best")
            labels = _linked(best, labels, sets, percent)
            others.append(likely.join(best.select("a", "b"), ["a", "b"], "left_anti"))
            done += [mixed, likely, best]
            rows = mixed.filter(F.col("n") > LEAF).select("node", "class")
            if depth < MAX_DEPTH:
                # Large nodes go on, split by their next coordinates.
                rows = _children(rows.join(classes.select("class", "sig"), "class"), depth)
                continue
            large.append(pin(rows, "large"))
        if others:
            rest = pin(_apart(reduce(DataFrame.unionByName, others).dropDuplicates(["a", "b"]), labels), "rest")
            labels = _linked(rest, labels, sets, percent)
            unpin(rest, *done)
    if large:
        # Nodes that are large after all levels and still have several components are compared in full.
        left = _mixed(reduce(DataFrame.unionByName, large), labels, classes)
        likely = pin(_likely(_block_pairs(left, percent)), "likely")
        best = pin(likely.join(_best(likely), ["a", "b"]), "best")
        labels = _linked(best, labels, sets, percent)
        rest = pin(_apart(likely.join(best.select("a", "b"), ["a", "b"], "left_anti"), labels), "rest")
        labels = _linked(rest, labels, sets, percent)
        unpin(left, likely, best, rest, *large)
    unpin(ids, sets)
    return labels if labels is not None else spark.createDataFrame([], "class bigint, label bigint")


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, signed, placed): the rows with their keys, with their signatures, and the classes with their labels."""
    base = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("code"), F.col(text_col).alias("text"))
    signed = pin(_signed(base, width), "signed")
    some = signed.filter(F.col("n_shingles") > 0)
    # A class is one 128-bit set; its smallest row stands for it. Classes get numbers, which hold once they are written.
    least = F.min(F.struct("doc_id", "code"))
    groups = some.groupBy("n_shingles", "set_a", "set_b").agg(least.alias("first"), F.first("sig").alias("sig"))
    named = pin(groups.withColumn("class", F.monotonically_increasing_id()), "named")
    columns = ("class", "n_shingles", "set_a", "set_b", F.col("first.doc_id").alias("doc_id"), F.col("first.code").alias("code"), "sig")
    # The lowest byte of each minwise token.
    sketch = F.transform("sig", lambda x: F.shiftright(F.shiftleft(x, 24), 24).cast("tinyint"))
    spark = docs.sparkSession
    classes = pin_bucketed(named.select(*columns, sketch.alias("sketch")).repartition(buckets_of(spark), "class"), "classes", "class")
    unpin(named)

    def sets_of(ids: DataFrame) -> DataFrame:
        where = classes.join(ids, "class", "left_semi").select("doc_id", "code")
        texts = base.join(where, ["doc_id", "code"])
        if _repeats(signed):
            texts = texts.dropDuplicates(["doc_id", "code"])
        # Dealt by doc_id and code already, as the buckets are.
        return pin_bucketed(_full_sets(texts, width), "sets", "doc_id", "code")

    labels = link_classes(classes, sets_of, percent)
    placed = classes.select("class", "n_shingles", "set_a", "set_b", F.struct("doc_id", "code").alias("first")).join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    placed = pin(placed, "placed")
    unpin(classes)
    return base, signed, placed


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Documents whose shingle sets have 100 * common >= percent * all are linked; component_id is the
    smallest id that can be reached. Candidates come from random trees, and those whose sketches lie more than four
    standard deviations below the threshold (about 3 in 100,000 links at it) are not confirmed. A null or empty text, or one without words, has no
    shingles and is linked with nothing. Each row is ``kept`` if its id is its component's, so
    rows that share the smallest id are kept alike; null ids order behind all others. Other
    columns are ignored.
    """
    _, signed, placed = _grouped(docs, width, percent, id_col, text_col)
    tops = pin(placed.groupBy("label").agg(F.min("first.doc_id").alias("component_id")), "tops")
    named = pin(placed.join(tops, "label").select("n_shingles", "set_a", "set_b", "component_id"), "named")
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["n_shingles", "set_a", "set_b"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    null_last = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(null_last("doc_id").alias(id_col), "n_shingles", null_last("component_id").alias("component_id"), (F.col("component_id") == F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one of the smallest id; all columns stay.

    Rows without words stay. Of repeated rows (same id and text) one stays. See near_duplicates.
    """
    base, signed, placed = _grouped(docs, width, percent, id_col, text_col)
    first = placed.groupBy("label").agg(F.min("first").alias("first"))
    first = pin(first.select(F.col("first.doc_id").alias("__id"), F.col("first.code").alias("__code")), "first")
    words = F.coalesce(F.rlike(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("bigint")).withColumn("__code", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    kept = keyed.filter(words).join(first, ["__id", "__code"], "left_semi")
    if _repeats(signed):
        kept = kept.dropDuplicates(["__id", "__code"])
    return kept.unionByName(keyed.filter(~words)).drop("__id", "__code")


def _repeats(base: DataFrame) -> bool:
    """Whether an id and text come more than once."""
    return not base.groupBy("doc_id", "code").count().filter(F.col("count") > 1).isEmpty()
