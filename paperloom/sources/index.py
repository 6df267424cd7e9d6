"""An inverted index on disk: postings by term with delta-coded places, and counts of the terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scripts import sliced, small_batches

#: Tasks that one bucket's rows are dealt to, so that a term of many blocks is no one task's.
SPREAD = 8


def deltas(places: Column) -> Column:
    """The first of ascending numbers and then the steps to the next."""
    return F.transform(places, lambda x, i: x - F.coalesce(F.get(places, i - 1), F.lit(0)))


def undeltas(steps: Column) -> Column:
    """Ascending numbers from :func:`deltas`."""
    return F.transform(steps, lambda x, i: F.aggregate(F.slice(steps, 1, i + 1), F.lit(0), lambda a, b: a + b))


def postings_of(blocks: DataFrame, tokens: Column, keys: Sequence[str] = ("link", "block_idx")) -> DataFrame:
    """(term, keys, n, steps): a row for each term of a block; ``steps`` are its places, delta-coded.  Null tokens have none.

    A block's row is taken apart where it is, without a shuffle; rows that share their keys, which a count of keys finds, are one block."""
    repeated = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(c).alias(f"__{c}") for c in keys])
    if repeated.isEmpty():
        return _postings_in_rows(blocks, tokens, keys)
    same = [blocks[c].eqNullSafe(repeated[f"__{c}"]) for c in keys]
    single = _postings_in_rows(blocks.join(repeated, same, "left_anti"), tokens, keys)
    return single.unionByName(_merged_postings(blocks.join(repeated, same, "left_semi"), tokens, keys))


def _postings_in_rows(blocks: DataFrame, tokens: Column, keys: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lists = batch.column("__tokens")
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            row, place = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            coded = pc.list_flatten(lists).dictionary_encode()
            code = pc.fill_null(coded.indices, -1).to_numpy()
            order = np.lexsort((place, code, row))
            order = order[code[order] >= 0]
            row, place, code = row[order], place[order], code[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
            at = np.flatnonzero(first)
            ends = np.append(at, len(row))
            steps = np.where(first, place, place - np.roll(place, 1)).astype(np.int32)
            columns = [coded.dictionary.take(pa.array(code[at])), *(batch.column(c).take(pa.array(row[at])) for c in keys)]
            columns += [pa.array(np.diff(ends).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(steps))]
            yield pa.record_batch(columns, ["term", *keys, "n", "steps"])

    types = dict(blocks.dtypes)
    rows = small_batches(blocks).select(*keys, tokens.alias("__tokens"))
    return rows.mapInArrow(run, ", ".join(["term string", *(f"`{c}` {types[c]}" for c in keys), "n int, steps array<int>"]))


def _merged_postings(blocks: DataFrame, tokens: Column, keys: Sequence[str]) -> DataFrame:
    rows = blocks.select(*keys, F.posexplode(tokens).alias("place", "term")).filter("term is not null")
    held = rows.groupBy("term", *keys).agg(F.array_sort(F.collect_list("place")).alias("places"))  # places in one block
    return held.select("term", *keys, F.size("places").alias("n"), deltas(F.col("places")).alias("steps"))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Write ``postings`` below ``path`` as ``postings`` (folders by bucket, files sorted by term) and ``terms`` (term, blocks, n)."""
    dealt = postings.withColumn("bucket", _bucket(F.col("term"), buckets))
    keys = [c for c in postings.columns if c not in ("term", "n", "steps")]
    spread = dealt.repartition(buckets * SPREAD, "bucket", F.pmod(F.xxhash64(*keys), F.lit(SPREAD)))
    spread.sortWithinPartitions("bucket", "term", *keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = postings.sparkSession.read.schema(dealt.schema).parquet(f"{path}/postings")
    counted = stored.groupBy("term").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("n")).withColumn("bucket", _bucket(F.col("term"), buckets))
    counted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    postings.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def look_up(spark: SparkSession, path: str, terms: Sequence[str], table: str = "postings") -> DataFrame:
    """The rows of ``terms``: only their buckets' folders are read, and of their files the parts whose statistics fit."""
    buckets = spark.read.parquet(f"{path}/about").first()["buckets"]
    asked = spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"), buckets).alias("b")).distinct()
    found = spark.read.parquet(f"{path}/{table}").filter(F.col("bucket").isin([r.b for r in asked.collect()]) & F.col("term").isin(list(terms)))
    return found.drop("bucket")


def save_index_table(postings: DataFrame, name: str, buckets: int = 64) -> None:
    """``postings`` as a catalog table bucketed by term: a join by term with a table bucketed alike moves neither."""
    keys = [c for c in postings.columns if c not in ("term", "n", "steps")]
    spread = postings.repartition(buckets, F.pmod(F.hash("term"), F.lit(buckets)), F.pmod(F.xxhash64(*keys), F.lit(SPREAD)))
    spread.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(name)
