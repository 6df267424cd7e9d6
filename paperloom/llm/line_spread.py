"""Line deduplication by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash merges by aggregation; lines whose estimate lies near the
threshold get an exact distinct count.  Lines that enough sites share are boilerplate and go, except from
texts without any other line: those are copies of one document, which near-duplicate removal handles as a
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: Sites that make a line boilerplate; log2 of a sketch's registers.
SITES, LOG_REGISTERS = 6, 10
BLANKS = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _hash(line: Column) -> Column:
    """Of the line without white space at its ends; null where it has no word."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def widespread_lines(rows: DataFrame, sites: int = SITES) -> DataFrame:
    """``line`` hashes of ``rows`` (site, line) that stand on at least ``sites`` sites."""
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("site"), LOG_REGISTERS)).alias("about"))
    error = max(1, round(5 * 1.04 / 2 ** (LOG_REGISTERS / 2) * sites))
    spread = materialise(spread.filter(F.col("about") >= sites - error), "spread")
    near = spread.filter(F.col("about") <= sites + error).select("line")
    exact = rows.join(near, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= sites)
    return materialise(spread.filter(F.col("about") > sites + error).select("line").unionByName(exact.select("line")), "wide")


def remove_widespread(docs: DataFrame, carry: list[str], sites: int = SITES, most: float | None = None, site: str = "source") -> DataFrame:
    """For each row of ``docs``: struct ``doc`` (columns in ``carry``), ``cleaned`` text, ``n_lines`` (with a word), ``n_wide``
    and ``n_removed`` lines.

    Null texts stay null and empty ones empty, with no lines; a null site counts as one site; texts whose lines
    with a word are all widespread stay whole, or, with ``most``, those of which more than that part of the
    characters is; repeated rows are treated alike, as decisions go by text; an empty table gives an empty result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.struct(*carry).alias("doc"), F.col("text").alias("t"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"))
    exploded = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\x03")).alias("site"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), F.explode(F.array_distinct(F.transform(_lines(text), _hash))).alias("line")).filter("line is not null")
    wide = widespread_lines(exploded.select("site", "line"), sites)
    held = exploded.join(wide, "line").groupBy("k1", "k2").agg(F.collect_set("line").alias("wide"))  # lines of one text
    held = materialise(held, "held")
    joined = keyed.join(held, ["k1", "k2"], "left").withColumn("wide", F.coalesce("wide", F.array().cast("array<bigint>")))
    none = F.array().cast("array<string>")
    # each line with its hash, once; only texts that hold a widespread line are taken apart
    marked = F.transform(_lines(F.col("t")), lambda x: F.struct(x.alias("x"), F.coalesce(F.array_contains("wide", _hash(x)), F.lit(False)).alias("w")))
    parts = joined.withColumn("parts", F.when(F.size("wide") > 0, marked))
    size = lambda keep: F.aggregate(F.filter("parts", keep), F.lit(0), lambda a, p: a + F.length(p["x"]))
    judged = parts.withColumn("n_wide", F.when(F.col("parts").isNull(), 0).otherwise(F.size(F.filter("parts", lambda p: p["w"]))).cast("long"))
    lines = F.size(F.filter(F.coalesce(_lines(F.col("t")), none), lambda x: F.trim(x, F.lit(BLANKS)) != "")).cast("long")
    rest = F.col("n_wide") < lines if most is None else size(lambda p: p["w"]) <= most * size(lambda p: F.lit(True))
    judged = judged.withColumn("goes", (F.col("n_wide") > 0) & rest)
    cleaned = F.when(F.col("goes"), F.array_join(F.transform(F.filter(F.coalesce("parts", F.array().cast("array<struct<x:string,w:boolean>>")), lambda p: ~p["w"]), lambda p: p["x"]), "\n")).otherwise(F.col("t"))
    return judged.select("doc", cleaned.alias("cleaned"), lines.alias("n_lines"), "n_wide", F.when(F.col("goes"), F.col("n_wide")).otherwise(0).cast("long").alias("n_removed"))
