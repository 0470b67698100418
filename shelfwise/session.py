"""Session helpers: a tuned local session, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str | int = "*", app: str = "shelfwise", memory: str = "12g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cores = "8" if cpus == "*" else str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A temporary folder is used only when the setting is absent and the master
    is local; on a cluster the missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_root(spark.sparkContext.applicationId)


@cache
def _local_root(_app: str) -> str:
    return tempfile.mkdtemp(prefix="shelfwise-")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/shelfwise/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "cut", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    The result has no lineage beyond the files, so loops stay short and a lost
    executor costs only its own tasks. A file holds at most ``rows_per_file``
    rows, if given: one file is read by one task.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, tag: str = "small") -> DataFrame:
    """Write a table that is expected to be small, so its size is a fact.

    The planner reads the size from the files: below the broadcast threshold a
    join with a large table needs no shuffle of the large side, above it the
    join stays a sort-merge join. Nothing is forced.
    """
    return materialize(df, tag)


def release(df: DataFrame) -> None:
    """Delete the scratch table that ``df`` reads, once nothing reads it again."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if "/shelfwise/" in folder.toString():
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        folder.getFileSystem(conf).delete(folder, True)
