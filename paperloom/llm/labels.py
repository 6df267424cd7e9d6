"""Deterministic splits and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % parts


def learning_sample(labels: DataFrame, label: str, parts: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled rows of either class outside the held-out part, by a hash of the id."""
    usable = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(remainder("doc_id", parts) != held_out)
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    by_hash = lambda y: usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return by_hash(0).unionByName(by_hash(1))
