"""Repeated lines, found with levelled sorted runs of line hashes.

Documents come in batches of ascending id. Each batch reduces its lines to one row for each
key (its 128-bit hash and the smallest document that holds it), merge-joins that against the
runs of earlier batches, and adds the keys that no run has as a run of its own, sorted by
hash. When a level holds ``fanout`` runs they are merged into one run of the next level, so a
later batch reads a number of runs that grows with the logarithm of the batches.

A line is dropped if its key's first document is a smaller one than its own. The texts
move once, to meet the positions of their dropped lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LAST_ID, new_folder, pin

#: Stripped at both ends of a line: space and U+0009 to U+000D.
STRIP = " \t\n\u000b\f\r"
MIN_KEY_CHARS = 10
BATCHES = 4
FANOUT = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case, other letters as they are."""
    return F.translate(F.trim(line, F.lit(STRIP)), UPPER, LOWER)


class LineRuns:
    """Runs of (h1, h2, first_doc), each sorted by hash; level k has fewer than ``fanout`` runs.

    A run is a Parquet folder in the shared storage, so a lost executor costs a read.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.schema = "h1 bigint, h2 bigint, first_doc bigint"

    def _write(self, df: DataFrame) -> DataFrame:
        path = new_folder(self.spark, "line-run")
        df.select("h1", "h2", "first_doc").sortWithinPartitions("h1", "h2").write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, firsts: DataFrame) -> None:
        """Add the keys of a batch (h1, h2, first_doc) that no run has; merge full levels."""
        fresh = reduce(lambda left, run: left.hint("merge").join(run, ["h1", "h2"], "left_anti"), self.all(), firsts)
        run, k = self._write(fresh), 0
        while True:
            self.levels[k].append(run)
            if len(self.levels[k]) < self.fanout:
                return
            # Runs are disjoint: merging them is a union, sorted anew.
            merged = reduce(DataFrame.unionByName, self.levels[k]).repartition("h1")
            self.levels[k], k = [], k + 1
            if k == len(self.levels):
                self.levels.append([])
            run = self._write(merged)


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """Upper ends of the batches' id ranges."""
    if batches < 2:
        return []
    found = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"]
    return sorted(set(found or []))


def drop_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS, batches: int = BATCHES, fanout: int = FANOUT, counts: bool = True
) -> DataFrame:
    """``docs`` with the text less its repeated lines, plus n_lines and n_dropped.

    A null or empty text has one empty line and comes back as an empty text. A key of at least
    ``min_chars`` code points in two or more documents stays only in the smallest id that has
    it, with all its repeats there. Rows that share an id are one document. A null id orders
    behind all others; rows with null ids are one document. Other columns pass through; columns
    named n_lines or n_dropped are replaced. Without ``counts`` no column is added or replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped") if counts else docs
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("bigint").alias("doc_id"), text.alias("text"))
    lines = (
        base.select("doc_id", F.xxhash64("text").alias("text_code"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter(F.length("key") >= min_chars)
        # The literal comes first: it seeds the second hash, so the two are independent.
        .select("doc_id", "text_code", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    lines = pin(lines, "line-hashes")  # split and hashed once; the batches and the last join read it
    runs, cuts = LineRuns(spark, fanout), _cuts(base, batches)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = lines
        if low is not None:
            part = part.filter(F.col("doc_id") > low)
        if high is not None:
            part = part.filter(F.col("doc_id") <= high)
        runs.add(part.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc")))
    firsts = reduce(DataFrame.unionByName, runs.all())
    # Both sides are exchanged by hash; a key that a third of all lines have can be split there.
    dropped = (
        lines.join(firsts.hint("merge"), ["h1", "h2"])
        .filter(F.col("first_doc") < F.col("doc_id"))
        .groupBy("doc_id", "text_code")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    named = docs.withColumn("__id", F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("bigint")).withColumn("__code", F.xxhash64(text))
    found = named.join(
        dropped.select(F.col("doc_id").alias("__id"), F.col("text_code").alias("__code"), F.col("gone").alias("__gone")), ["__id", "__code"], "left"
    )
    found = found.withColumn("__lines", F.split(text, "\n", -1)).withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    # The lines between one dropped position and the next, slice by slice.
    ends = F.concat(F.col("__gone"), F.array(F.size("__lines")))
    kept = F.flatten(
        F.transform(
            ends,
            lambda end, i: F.slice(
                F.col("__lines"),
                F.when(i == 0, F.lit(1)).otherwise(F.element_at("__gone", F.greatest(i, F.lit(1))) + 2),
                end - F.when(i == 0, F.lit(0)).otherwise(F.element_at("__gone", F.greatest(i, F.lit(1))) + 1),
            ),
        )
    )
    return found.select(
        *(F.when(F.size("__gone") == 0, text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns),
        *((F.size("__lines").cast("bigint").alias("n_lines"), F.size("__gone").cast("bigint").alias("n_dropped")) if counts else ()),
    )
