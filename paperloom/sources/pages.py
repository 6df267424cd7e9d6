"""Sources and sinks: page files, gold pairs, dictionaries, incremental runs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .answers import repaired

BLOCK = "array<struct<id:string,height:string,width:string,hpos:string,vpos:string,text:string>>"
PAGE = f"lccn string, date string, year string, month string, day string, edition string, sequence string, link string, text_blocks_raw {BLOCK}, text_blocks_cleaned {BLOCK}"
GOLD = PAGE + ", gpt_fixed array<struct<raw_text:string,gpt_fixed_conservative:string,gpt_fixed_best_guess:string>>"
SITE = "https://chroniclingamerica.loc.gov/lccn"


def path_fields(path: Column) -> Column:
    """Struct of the page keys in a path that ends <lccn>/<year>/<month>/<day>/<edition>/<sequence>/<file>."""
    parts = F.split(path, "/")
    names = ("lccn", "year", "month", "day", "edition", "sequence")
    at = {n: F.try_element_at(parts, F.lit(k - 7)) for k, n in enumerate(names)}
    date = F.concat_ws("-", at["year"], at["month"], at["day"])
    link = F.concat(F.lit(f"{SITE}/"), at["lccn"], F.lit("/"), date, F.lit("/"), at["edition"], F.lit("/"), at["sequence"], F.lit("/"))
    return F.struct(*[at[n].alias(n) for n in names], date.alias("date"), link.alias("link"))


def read_xml_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, xml) and the page keys of all page files below ``root``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").option("wholetext", True).text(root)
    return files.select(F.input_file_name().alias("path"), F.col("value").alias("xml")).withColumn("p", path_fields(F.col("path"))).select("path", "xml", "p.*")


def read_json_pages(spark: SparkSession, root: str, schema: str = PAGE, name: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """Readable pages, and the paths of files that don't parse."""
    read = spark.read.schema(schema + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).option("pathGlobFilter", name)
    # a plan may not read the rejects' column alone: rejects keep the page's columns in a struct that no optimiser drops
    rows = read.json(root).withColumn("path", F.input_file_name())
    page = [c for c in rows.columns if c not in ("_bad", "path")]
    seen = rows.withColumn("read", F.struct(*page)).filter("_bad is not null").select("path", "_bad", F.md5(F.to_json("read")).alias("read"))
    return rows.filter("_bad is null").drop("_bad"), seen.filter("read is not null").select("path", "_bad")


def gold_pairs(pages: DataFrame) -> DataFrame:
    """(pair_id, raw_text, gold_text) of pages with gold corrections; incomplete elements are skipped."""
    rows = pages.select("link", F.posexplode("gpt_fixed").alias("k", "g"))
    return rows.select(F.concat_ws("#", "link", "k").alias("pair_id"), F.col("g.raw_text").alias("raw_text"), F.col("g.gpt_fixed_conservative").alias("gold_text")).filter("raw_text is not null and gold_text is not null")


def correction_request(blocks: DataFrame) -> DataFrame:
    """(link, request): the JSON list that asks for a page's corrections, in block order."""
    ordered = F.array_sort(F.collect_list(F.struct("block_idx", "text")))  # a page's blocks
    return blocks.groupBy("link").agg(F.to_json(F.transform(ordered, lambda b: F.struct(b["text"].alias("raw_text")))).alias("request"))


def correction_answer(answer: Column) -> Column:
    """The corrections in an answer; a missing key is null.  An answer that is no JSON as it stands is repaired as
    :func:`answers.repaired` says; null where no list is found."""
    parse = lambda x: F.from_json(x, "array<struct<raw_text:string,gpt_fixed_conservative:string,gpt_fixed_best_guess:string>>", {"mode": "PERMISSIVE"})

    @F.pandas_udf("string")
    def mended(broken: pd.Series) -> pd.Series:
        return pd.Series([repaired(x) for x in broken], dtype=object)

    return F.coalesce(parse(answer), parse(mended(F.when(parse(answer).isNull(), answer))))


def inspected_pairs(pages: DataFrame, first: int = 20, longer_than: int = 100) -> DataFrame:
    """(link, k, raw_text, gpt_fixed_best_guess, gpt_fixed_conservative) of the long ones among each page's first corrections."""
    rows = pages.select("link", F.posexplode(F.slice("gpt_fixed", 1, first)).alias("k", "g"))
    return rows.filter(F.length("g.raw_text") > longer_than).select("link", "k", "g.raw_text", "g.gpt_fixed_best_guess", "g.gpt_fixed_conservative")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, count) from lines of a word, a tab and a count."""
    return spark.read.csv(path, sep="\t", schema="word string, count bigint")


def write_dictionary(counts: DataFrame, path: str, least: int = 10) -> None:
    counts.filter(F.col("count") >= least).select("word", "count").write.mode("overwrite").csv(path, sep="\t")


def read_word_list(spark: SparkSession, path: str, more: Sequence[str] = ()) -> DataFrame:
    """Distinct first fields of a text file's lines, and the words in ``more``."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("word")).filter("word <> ''")
    if more:
        words = words.unionByName(spark.createDataFrame([(w,) for w in more], "word string"))
    return words.distinct()


def unprocessed(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Files that no earlier run has handled."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def coverage(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """(n_files, n_done, coverage)."""
    marked = files.select(key).distinct().join(done.select(key).distinct().withColumn("d", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("n_files"), F.count("d").alias("n_done")).withColumn("coverage", F.try_divide("n_done", "n_files"))


def download_plan(batches: DataFrame, site: str = SITE) -> DataFrame:
    """One command line per distinct batch."""
    return batches.select("batch").distinct().select("batch", F.format_string(f"wget {site}/%s.tar.bz2 && tar -xjf %s.tar.bz2", "batch", "batch").alias("command"))


def draw(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows in the order of a hash of the key: the same ones each time."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


def draw_again(df: DataFrame, share: float, seed: int) -> DataFrame:
    """A sample with replacement."""
    return df.sample(withReplacement=True, fraction=share, seed=seed)


def draw_with_replacement(df: DataFrame, key: str, n: int, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """Exactly ``n`` rows (none of an empty table) by independent draws that may repeat a row: the same ones however the table is
    partitioned.  Rows are numbered in two levels, buckets of a hash of the key and places within one, so that nothing is sorted
    as a whole; rows that repeat a key, also a null one, are rows of their own."""
    salted = df.withColumn("__bucket", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)))
    sizes = salted.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    bases = sizes.select("__bucket", before.alias("__base"))  # a row a bucket
    others = [F.to_json(F.struct(*[c for c in df.columns if c != key]))] if len(df.columns) > 1 else []
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(F.xxhash64(key, F.lit(seed + 1)), key, *others)) - 1
    placed = salted.withColumn("__inside", inside).join(F.broadcast(bases), "__bucket").withColumn("__place", F.col("__base") + F.col("__inside"))
    total = df.count()
    part = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    drawn = df.sparkSession.range(n if total else 0).select(F.floor(part * total).alias("__place")).groupBy("__place").agg(F.count(F.lit(1)).cast("int").alias("__times"))
    return placed.join(drawn, "__place").withColumn("__time", F.explode(F.sequence(F.lit(1), "__times"))).select(*df.columns)


def write_blocks(blocks: DataFrame, path: str, by: Sequence[str] = ("lccn", "year")) -> None:
    blocks.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_json_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)
