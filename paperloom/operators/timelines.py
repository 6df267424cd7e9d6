"""Roll-ups of mentions by page, year and title."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_sums(blocks: DataFrame, families: Sequence[str]) -> DataFrame:
    """Per page: each family's count over the blocks relevant to it, tokens, year, title, ratios and flags."""
    sums = [F.sum(F.when(F.col(f"relevant_{n}"), F.col(f"{n}_count")).otherwise(0)).alias(f"{n}_count") for n in families]
    pages = blocks.groupBy("link").agg(F.min("year").alias("year"), F.min("title").alias("title"), F.sum("doc_length").alias("doc_length"), *sums)
    for n in families:
        pages = pages.withColumn(f"{n}_ratio", F.try_divide(f"{n}_count", "doc_length")).withColumn(f"contains_{n}", F.col(f"{n}_count") > 0)
    return pages


def with_combined(pages: DataFrame, families: Sequence[str], name: str) -> DataFrame:
    """Add ``<name>_count``, ``<name>_ratio`` and ``contains_<name>`` of several families together."""
    total = F.lit(0).cast("long")
    for n in families:
        total = total + F.col(f"{n}_count")
    pages = pages.withColumn(f"{name}_count", total)
    return pages.withColumn(f"{name}_ratio", F.try_divide(f"{name}_count", "doc_length")).withColumn(f"contains_{name}", F.col(f"{name}_count") > 0)


def by_year_and_title(pages: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Sums by year and title; rows without a title don't count."""
    return pages.filter("title is not null and year is not null").groupBy("year", "title").agg(*[F.sum(m).alias(m) for m in measures])


def by_title(pages: DataFrame, measures: Sequence[str]) -> DataFrame:
    return pages.filter("title is not null").groupBy("title").agg(*[F.sum(m).alias(m) for m in measures])


def grand_total(pages: DataFrame, measures: Sequence[str]) -> DataFrame:
    return pages.filter("title is not null").agg(*[F.sum(m).alias(m) for m in measures])


def all_totals(pages: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Year and title, title, and grand totals in one pass: grouping sets."""
    rows = pages.filter("title is not null and year is not null")
    sets = [[F.col("year"), F.col("title")], [F.col("title")], []]
    return rows.groupingSets(sets, F.col("year"), F.col("title")).agg(*[F.sum(m).alias(m) for m in measures])


def issue_summary(pages: DataFrame) -> DataFrame:
    """Per title: pages, issues (distinct dates), pages per issue, tokens."""
    out = pages.filter("title is not null").groupBy("title").agg(F.count("date").alias("pages"), F.countDistinct("date").alias("issues"), F.sum("total_tokens").alias("tokens"))
    return out.withColumn("pages_per_issue", F.try_divide("pages", "issues"))


def decade(year):
    return (F.floor(year / 10) * 10).cast("int")


def filled_series(sums: DataFrame, measures: Sequence[str]) -> DataFrame:
    """A row for each title and each year between its first and last, zero where nothing was counted."""
    span = sums.groupBy("title").agg(F.min("year").alias("a"), F.max("year").alias("b")).select("title", F.explode(F.sequence("a", "b")).alias("year"))
    return span.join(sums, ["title", "year"], "left").select("title", "year", *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])
