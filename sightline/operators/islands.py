"""Gaps and islands, sustained conditions, and sequential replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def island_of(changed: Column, keys: list[str], order: str) -> Column:
    """A number for each run of rows, one higher at each row where ``changed`` holds."""
    return F.sum(changed.cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def value_changed(col: str, keys: list[str], order: str) -> Column:
    before = F.lag(col).over(Window.partitionBy(*keys).orderBy(order))
    return F.coalesce(F.col(col) != before, F.lit(False))


def sustained_since(df: DataFrame, condition: str, keys: list[str], order: str, name: str) -> DataFrame:
    """Add ``name``: where the condition holds, the order value at which its current run of rows began."""
    island = f"__{name}"
    out = df.withColumn(island, island_of(~F.col(condition), keys, order))
    first = F.min(F.when(F.col(condition), F.col(order))).over(Window.partitionBy(*keys, island))
    return out.withColumn(name, F.when(F.col(condition), first)).drop(island)


def spans(df: DataFrame, status: str, keys: list[str], order: str, aggregates: list[Column], idle: str = "ok") -> DataFrame:
    """One row for each run of equal ``status`` other than ``idle``: frame_start, frame_end and the aggregates.

    A run ends one frame before the next run's first row, even across missing frames; the last
    run of a key ends with its last row.
    """
    numbered = df.withColumn("__island", island_of(value_changed(status, keys, order), keys, order))
    runs = numbered.groupBy(*keys, "__island").agg(F.first(status).alias(status), F.min(order).alias("frame_start"), F.max(order).alias("last_row"), *aggregates)
    following = F.lead("frame_start").over(Window.partitionBy(*keys).orderBy("__island"))
    return runs.withColumn("frame_end", F.coalesce(following - 1, F.col("last_row"))).filter(F.col(status) != idle).drop("__island", "last_row")


def replay(df: DataFrame, keys: list[str], order: str, start: Callable, step: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Feed each key's rows in order to ``step(state, row) -> list of output values``.

    For state machines whose next state depends on the last; a key's rows are in one task, keys
    are spread. ``start()`` makes a fresh state; output rows have the keys, ``order`` and the values.
    """

    def run(pdf):
        import pandas as pd

        pdf, state = pdf.sort_values(order), start()
        head = pdf[[*keys, order]].reset_index(drop=True)
        made = [step(state, row) for row in pdf[columns].itertuples(index=False, name="Row")]
        names = [c.split()[0] for c in schema.split(", ")][len(keys) + 1 :]
        return pd.concat([head, pd.DataFrame(made, columns=names)], axis=1)

    return df.select(*dict.fromkeys([*keys, order, *columns])).groupBy(*keys).applyInPandas(run, schema)
