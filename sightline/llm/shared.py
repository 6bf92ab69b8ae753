"""Helpers that several corpus operators use: shared storage and stable row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A null doc_id orders behind every other one.
LAST_ID = 2**63 - 1


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, as in tests on one machine, a temporary folder is made
    once and named in the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="sightline-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def pin(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here, and a lost
    executor costs one read of a file."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pinned_at = path
    return out


def buckets_of(spark: SparkSession) -> int:
    """How many buckets a table of this run has: as many as a shuffle has partitions, which follow the cluster's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def pin_bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by ``keys``: joins and groups on them read it
    without an exchange. Deal ``df`` by the keys first, or each task writes a file for each bucket."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    table = "sightline_" + path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.bucketBy(buckets_of(spark), *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._pinned_at, out._pinned_as = path, table
    return out


def unpin(*tables: DataFrame | None) -> None:
    """Delete pinned tables that nothing will read again; their readers' results must be written."""
    for df in tables:
        path = getattr(df, "_pinned_at", None)
        if path:
            spark = df.sparkSession
            if getattr(df, "_pinned_as", None):
                spark.sql(f"DROP TABLE IF EXISTS {df._pinned_as}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            df._pinned_at = None
