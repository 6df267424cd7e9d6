"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of a write when it ends, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder.  Where neither is set, a local session (whose driver and
    executors are one process) gets a temporary one; any other session is refused."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if not (known := context._jsc.sc().getCheckpointDir()).isDefined():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What queries made and run inside have shuffled goes when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read back; what was shuffled for it is removed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that no plan reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            at = jvm.org.apache.hadoop.fs.Path(file).getParent()
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
