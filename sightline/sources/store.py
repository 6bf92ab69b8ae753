"""The pass store: tables of runs as partitioned Parquet, with provenance lookups and resumption."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PASSES = ("p1_detect", "p2_track", "p3_identity", "p5_events")


class PassStore:
    """Tables under one folder, partitioned by run and pass; rewriting a pass replaces its partition."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, run_id: str, pass_name: str, append: bool = False) -> None:
        out = df.withColumn("run_id", F.lit(run_id)).withColumn("pass", F.lit(pass_name))
        writer = out.write.partitionBy("run_id", "pass").mode("append" if append else "overwrite")
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path(table))

    def read(self, table: str, schema: str, run_id: str | None = None, pass_name: str | None = None) -> DataFrame:
        """Rows of a table; an absent table has none."""
        try:
            df = self.spark.read.schema(schema + ", run_id string, pass string").parquet(self.path(table))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            df = self.spark.createDataFrame([], schema + ", run_id string, pass string")
        if run_id is not None:
            df = df.filter(F.col("run_id") == run_id)
        return df if pass_name is None else df.filter(F.col("pass") == pass_name)


def last_or_minus_one(df: DataFrame, col: str) -> DataFrame:
    """The largest value of a column, -1 without rows: where a resumed pass goes on."""
    return df.agg(F.coalesce(F.max(col), F.lit(-1)).alias(f"last_{col}"))


def split_orphans(detections: DataFrame, last_frame: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to the last whole frame, and the rows behind it that a resumed pass discards."""
    return detections.filter(F.col("frame_no") <= last_frame), detections.filter(F.col("frame_no") > last_frame)


def config_hash(config_json: Column) -> Column:
    """16 hexadecimal digits of the canonical text's SHA-256."""
    return F.substring(F.sha2(config_json, 256), 1, 16)


def latest_matching(runs: DataFrame, **wanted) -> DataFrame:
    """The newest run whose columns equal ``wanted``, nulls equal to null; the smallest run_id of equally new ones."""
    match = F.lit(True)
    for k, v in wanted.items():
        match = match & F.col(k).eqNullSafe(F.lit(v))
    return runs.filter(match).orderBy(F.desc("created_at"), "run_id").limit(1)


def complete(required: list[str]) -> Column:
    """Whether all required passes of a run (a map of pass to status) are complete."""
    return F.forall(F.array(*map(F.lit, required)), lambda p: F.coalesce(F.col("passes")[p] == "complete", F.lit(False)))


def resume_refusals(runs: DataFrame, run_id: str, provenance: dict) -> DataFrame:
    """The provenance fields of a run that differ from the current ones; resuming needs none."""
    now = [F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("stored"), F.lit(v).cast("string").alias("current")) for k, v in provenance.items()]
    return runs.filter(F.col("run_id") == run_id).select(F.inline(F.array(*now))).filter(~F.col("stored").eqNullSafe(F.col("current")))


def pass_states(log: DataFrame) -> DataFrame:
    """The state of each run's passes after a log of steps (run_id, pass, seq, step, frame_no, message).

    start: running, at the frame that an earlier start reached; progress: partial; complete and error end a pass.
    Steps before a pass's first start count for nothing. Gives status, last_frame (-1 without progress) and error.
    """
    w = Window.partitionBy("run_id", "pass").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    started = log.withColumn("__on", F.max((F.col("step") == "start").cast("int")).over(w)).filter("__on = 1")
    status = F.create_map(*(F.lit(x) for pair in (("start", "running"), ("progress", "partial"), ("complete", "complete"), ("error", "error")) for x in pair))[F.col("step")]
    latest = F.max_by(F.struct(status.alias("status"), F.when(F.col("step") == "error", F.col("message")).alias("error")), "seq")
    frame = F.coalesce(F.max_by("frame_no", F.when(F.col("step") == "progress", F.col("seq"))), F.lit(-1))
    return started.groupBy("run_id", "pass").agg(latest.alias("s"), frame.alias("last_frame")).select("run_id", "pass", "s.status", "last_frame", "s.error")


def run_list(manifests: DataFrame, schema: str) -> DataFrame:
    """Runs from texts of JSON (``manifest``), numbered from the newest; texts that can't be read are left out."""
    read = manifests.select(F.from_json("manifest", schema, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    return read.filter("run_id IS NOT NULL AND created_at IS NOT NULL")


def pass_stats(runs: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Numbers of passes (``stats``: a map of pass to a map of name to number), null where a pass or name is absent."""
    get = {name: F.try_element_at(F.try_element_at("stats", F.lit(path.split(".")[0])), F.lit(path.split(".")[1])) for name, path in wanted.items()}
    return runs.select("run_id", *(c.alias(name) for name, c in get.items()))
