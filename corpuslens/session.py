"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators rely on; all can be set on a running session.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
}


def pin(spark: SparkSession) -> SparkSession:
    """Sets what the results depend on, and leaves sizing to the caller."""
    for key, value in PINNED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


#: Setting under which an execution's shuffle files go when it ends; without it they wait for a collection of the driver's garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a batch that Spark hands to Python, and their setting; its own 64 MB are held by the JVM and the worker of every task.
BATCH, BATCH_SETTING = "2m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches of the session, unless it has a bound of its own; stays set, as frames run when the caller asks for their rows."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    return pin(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpuslens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; only a local master may fall back on a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/corpuslens-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/corpuslens/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, its size is known, no executor's loss hurts, and the shuffle files that the write has made are removed."""
    path, conf = scratch_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, None)
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(SHUFFLE_CLEANUP)
        else:
            conf.set(SHUFFLE_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the files of a staged df that nothing will read again; does nothing where the driver has no JVM at hand."""
    path, context = getattr(df, "staged_at", None), getattr(df.sparkSession, "_jsc", None)
    if path and context is not None:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context.hadoopConfiguration()).delete(place, True)
