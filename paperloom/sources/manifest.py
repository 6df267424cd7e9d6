"""Incremental runs over files: what is new, changed or gone by a manifest of content hashes, rejects with their reason from the
pass that reads the rest, and runs that count only once they are committed.

A store has folders ``rows/run=<k>/ok=<bool>`` (pages and rejects, written together), ``seen/run=<k>`` (the manifest) and an empty
file ``commits/<k>`` for each finished run.  A run that was killed has none: the next one takes its number and overwrites what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

FILE = "path string, size long, modified timestamp"


def scan(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """(path, size, modified) of the files below ``root``, without reading them; files of no bytes aren't listed by Spark's readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def runs(spark: SparkSession, store: str) -> list[int]:
    """The numbers of the committed runs."""
    at, system = _file(spark, f"{store}/commits")
    return sorted(int(f.getPath().getName()) for f in system.listStatus(at)) if system.exists(at) else []


def _read(spark: SparkSession, store: str, folder: str, schema: str) -> DataFrame:
    """The committed runs' rows in ``folder``, with their run."""
    out = None
    for k in runs(spark, store):
        at, system = _file(spark, f"{store}/{folder}/run={k}")
        if system.exists(at):
            part = spark.read.schema(schema).parquet(f"{store}/{folder}/run={k}").withColumn("run", F.lit(k))
            out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"{schema}, run int") if out is None else out


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(path, size, modified, sha, gone, run): what the last committed run that met a path says of it."""
    seen = _read(spark, store, "seen", f"{FILE}, sha string, gone boolean")
    last = Window.partitionBy("path").orderBy(F.desc("run"))
    return seen.withColumn("place", F.row_number().over(last)).filter("place = 1").drop("place")


def changes(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, size, modified, kind): ``files`` against a manifest by size and time: new, changed, same or vanished."""
    before = known.filter("not gone").select("path", F.col("size").alias("old_size"), F.col("modified").alias("old_modified"))
    met = files.join(before, "path", "full")
    same = (F.col("size") == F.col("old_size")) & (F.col("modified") == F.col("old_modified"))
    kind = F.when(F.col("size").isNull(), "vanished").when(F.col("old_size").isNull(), "new").when(same, "same").otherwise("changed")
    return met.select("path", "size", "modified", kind.alias("kind"))


def json_page(schema: str) -> Callable[[DataFrame], DataFrame]:
    """A parser of one JSON object a file: adds ``page`` and ``reason``, null where the file parses."""

    def parse(texts: DataFrame) -> DataFrame:
        read = texts.withColumn("read", F.from_json("text", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
        bad = F.when(F.trim("text") == "", "empty").when(F.col("read").isNull() | F.col("read._bad").isNotNull(), "no JSON object of this schema")
        return read.withColumn("reason", bad).withColumn("page", F.when(bad.isNull(), F.col("read").dropFields("_bad"))).drop("read")

    return parse


def ingest(spark: SparkSession, root: str, store: str, parse: Callable[[DataFrame], DataFrame], name: str = "*") -> dict[str, int]:
    """One run: parse the files below ``root`` that are new or whose content changed, and commit; returns how many were ``read``,
    ``rejected``, ``touched`` (newer, but the same content) and ``vanished``."""
    k = (runs(spark, store) or [-1])[-1] + 1
    known = manifest(spark, store)
    found = changes(scan(spark, root, name), known).filter("kind <> 'same'").collect()  # paths alone, as Spark's own file listing holds them
    paths, lost = [r.path for r in found if r.kind != "vanished"], [(r.path,) for r in found if r.kind == "vanished"]
    seen = spark.createDataFrame(lost, "path string").select("path", F.lit(0).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("sha"), F.lit(True).alias("gone"))
    counts = {"read": 0, "rejected": 0, "touched": 0, "vanished": len(lost)}
    if paths:
        files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha"), F.col("content").cast("string").alias("text"))
        old = known.filter("not gone").select("path", F.col("sha").alias("old_sha"))
        met = files.join(old, "path", "left").withColumn("touched", F.coalesce(F.col("sha") == F.col("old_sha"), F.lit(False))).drop("old_sha")
        touched = met["touched"]
        rows = parse(met).withColumn("ok", F.col("reason").isNull())
        rows = rows.select("path", "size", "modified", "sha", "touched", F.when(~touched, F.col("page")).alias("page"), "reason", F.when(~touched & ~F.col("ok"), F.col("text")).alias("text"), "ok")
        told = Observation()
        one = lambda condition: F.coalesce(F.count_if(condition), F.lit(0))
        told_rows = rows.observe(told, one(~F.col("touched") & F.col("ok")).alias("read"), one(~F.col("touched") & ~F.col("ok")).alias("rejected"), one(F.col("touched")).alias("touched"))
        told_rows.write.mode("overwrite").partitionBy("ok").parquet(f"{store}/rows/run={k}")
        counts |= {c: told.get[c] for c in ("read", "rejected", "touched")}
        back = spark.read.parquet(f"{store}/rows/run={k}")
        seen = seen.unionByName(back.select("path", "size", "modified", "sha", F.lit(False).alias("gone")))
    seen.write.mode("overwrite").parquet(f"{store}/seen/run={k}")
    at, system = _file(spark, f"{store}/commits/{k}")
    system.mkdirs(at.getParent())
    system.create(at, False).close()
    return counts


def _latest(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """Of each path that isn't gone the row of the run that last parsed it."""
    rows = _read(spark, store, "rows", f"path string, size long, modified timestamp, sha string, touched boolean, page struct<{schema}>, reason string, text string, ok boolean")
    last = Window.partitionBy("path").orderBy(F.desc("run"))
    parsed = rows.filter("not touched").withColumn("place", F.row_number().over(last)).filter("place = 1")
    return parsed.join(manifest(spark, store).filter("not gone").select("path"), "path", "left_semi")


def pages(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """``path`` and the columns of ``schema`` ("name: type, ...", as in a struct) of all readable files of the committed runs."""
    return _latest(spark, store, schema).filter("ok").select("path", "page.*")


def rejects(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """(path, reason, text) of the files that don't parse."""
    return _latest(spark, store, schema).filter("not ok").select("path", "reason", "text")
