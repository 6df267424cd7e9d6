"""Incremental ingestion: new page files are turned into blocks once each."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.alto import extract_blocks
from ..sources.pages import path_fields


def ingest_pages(spark: SparkSession, root: str, out: str, checkpoint: str) -> None:
    """Process the page files below ``root`` that no run with this checkpoint has seen, and stop."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(root)
    pages = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml")).withColumn("p", path_fields(F.col("path"))).select("path", "xml", "p.*")
    query = extract_blocks(pages).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
