"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # do not send a Python stack trace to the JVM with every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # documents and pages are wide: bound Arrow batches by bytes, not only by rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app_name: str = "rankfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; every setting can be overridden."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only on a local master."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):   # local-cluster has executors of its own
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="rankfold-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the application's part of the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Save ``df`` as a Parquet table in the shared folder and read it back.

    A written table (unlike a row checkpoint) keeps column pruning and filter
    pushdown for the steps that follow, and outlives lost executors.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_saved_stages(spark: SparkSession) -> None:
    """Removes what this application saved in the shared folder; results read from it must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bound_arrow_batches(spark: SparkSession, most_rows: int = 1000, most_bytes: str = "8m") -> None:
    """Lowers the session's bounds of Arrow batches to these, for steps that send whole texts to Python workers.

    A batch stands in the executor's memory beside its heap and once more in the worker.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(rows, "10000"))
    spark.conf.set(rows, str(most_rows if now <= 0 else min(now, most_rows)))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most_bytes)


def spread(scan: DataFrame) -> DataFrame:
    """Spreads a small file scan over all cores before CPU-heavy parsing.

    Only for frames read straight from files (no shuffle of their own).  The
    number of input splits is known without running anything; with at least one
    per core, as for any large input, the frame is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
