"""Tables between steps of a plan, kept in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in plain local mode, where it is unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file:" + tempfile.mkdtemp(prefix="trustweave-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, whose files go when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/trustweave-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)  # only what is there can be marked
    files.deleteOnExit(target)
    return path


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that is run here go when it ends, not when the driver happens to collect its garbage."""
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, held)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, and survives a lost executor.

    The files go when the driver's JVM ends, or by :func:`dropped`.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/rows"
    with shuffles_freed(spark):
        df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`stored` has returned and that no later step reads."""
    for df in tables:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
