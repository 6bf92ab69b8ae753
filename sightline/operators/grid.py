"""Blobs and ways out on grids of cells: connected components by runs of neighbouring rows, and open rays to the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: A ray looks at every second cell; it is a way out with more than 5 looks of which more than 65 % are open.
STEP, LEAST_LOOKS, LEAST_OPEN = 2, 5, 0.65
#: Names of the directions, in their order, as steps in x and y.
WAYS = {"vänster": (-1, 0), "höger": (1, 0), "uppåt": (0, -1), "nedåt": (0, 1)}


def components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells (keys, gx, gy) with ``blob``: a name for each set of cells that touch at sides or corners.

    Cells of a row that follow one another are one run, named by its first cell. Runs of neighbouring rows that touch are
    links; each takes the least name it can see, over and over, and names of names are looked up between, until none changes.
    """
    order = Window.partitionBy(*keys, "gy").orderBy("gx")
    cells = cells.select(*keys, "gx", "gy").distinct()
    cells = cells.withColumn("start", F.when(F.coalesce(F.col("gx") - F.lag("gx").over(order), F.lit(2)) > 1, F.col("gx")))
    cells = written(cells.withColumn("start", F.last("start", ignorenulls=True).over(order)), "cells")
    runs = cells.groupBy(*keys, "gy", "start").agg(F.max("gx").alias("end")).withColumn("run", F.struct("gy", "start"))
    below = runs.select(*keys, (F.col("gy") - 1).alias("gy"), F.col("start").alias("from"), F.col("end").alias("to"), F.col("run").alias("other"))
    touch = runs.join(below, [*keys, "gy"]).filter((F.col("start") <= F.col("to") + 1) & (F.col("from") <= F.col("end") + 1))
    links = written(touch.select(*keys, "run", "other").unionByName(touch.select(*keys, F.col("other").alias("run"), F.col("run").alias("other"))), "links")
    named = written(runs.select(*keys, "run", F.col("run").alias("blob")), "names")
    while True:
        seen = links.join(named.select(*keys, F.col("run").alias("other"), F.col("blob").alias("seen")), [*keys, "other"]).groupBy(*keys, "run").agg(F.min("seen").alias("seen"))
        near = named.join(seen, [*keys, "run"], "left").select(*keys, "run", F.least("blob", F.coalesce("seen", "blob")).alias("to"), F.col("blob").alias("old"))
        far = named.select(*keys, F.col("run").alias("to"), F.col("blob").alias("far"))
        now = written(near.join(far, [*keys, "to"], "left").select(*keys, "run", F.least("to", F.coalesce("far", "to")).alias("blob"), "old"), "names")
        named = now.drop("old")
        if now.filter(F.col("blob") != F.col("old")).isEmpty():
            break
    return cells.withColumn("run", F.struct("gy", "start")).join(named, [*keys, "run"]).select(*keys, "gx", "gy", "blob")


def largest_blobs(cells: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """Each key's blob of the most cells, the one with the first cell (by rows) of equally large ones: its centre and its area as
    shares of the grid."""
    size = components(cells, keys).groupBy(*keys, "blob").agg(F.count(F.lit(1)).alias("cells"), F.avg("gx").alias("x"), F.avg("gy").alias("y"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("cells"), "blob"))
    top = size.withColumn("__n", first).filter("__n = 1")
    return top.select(*keys, "cells", (F.col("x") / width).alias("x"), (F.col("y") / height).alias("y"), (F.col("cells") / F.lit(width * height)).alias("area"))


def ways_out(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Full grids (keys, gx, gy, open) with ``ways``: the directions in which a cell reaches the edge over mostly open ground.

    What a ray sees is a running count over every second cell of a row or column, seen from the edge.
    """
    out, found = grid, []
    for name, (dx, dy) in WAYS.items():
        along, across = ("gx", "gy") if dx else ("gy", "gx")
        order = F.col(along) if dx + dy < 0 else F.desc(along)
        w = Window.partitionBy(*keys, across, F.col(along) % STEP).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        looks, free = F.count(F.lit(1)).over(w), F.sum(F.col("open").cast("int")).over(w)
        out = out.withColumn(f"__{len(found)}", (looks > LEAST_LOOKS) & (free / looks > LEAST_OPEN))
        found.append(F.when(F.col(f"__{len(found)}"), F.lit(name)))
    return out.withColumn("ways", F.array_compact(F.array(*found))).drop(*[f"__{i}" for i in range(len(found))])
