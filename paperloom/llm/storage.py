"""Cutting lineage through tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Removes the shuffle files of a write when it ends, rather than when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Places that a key's rows are dealt to where the table joined to them is too large to broadcast.
SALTS = 16

_OPEN: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.
    Where neither is set, a local session uses a temporary one and any other is refused: its executors would write apart."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="paperloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and the
    rows survive the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._paperloom_path = path
    if _OPEN:
        _OPEN[-1].append(back)
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialise` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_paperloom_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scope() -> Iterator[None]:
    """On leaving, delete the tables that :func:`materialise` made inside, but for the last one: those behind a lazy result
    can go once that result is written."""
    _OPEN.append([])
    try:
        yield
    finally:
        made = _OPEN.pop()
        if _OPEN and made:
            _OPEN[-1].append(made[-1])
        discard(*made[:-1])


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch, so that Python workers hold few long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], few: bool, by: list[Column], how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``table`` of their ``keys``, so that no key is one task's: ``few`` rows (a checked number) are
    broadcast; of more, each is dealt to SALTS places, and so are ``rows``, by a hash of ``by``."""
    if few:
        return rows.join(F.broadcast(table), keys, how)
    salt = unused("salt", [*rows.columns, *table.columns])
    salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.hash(*by), F.lit(SALTS))).join(salted, [*keys, salt], how).drop(salt)


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer by as many underscores as it takes to differ from all ``columns``, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
