"""Mentions of term families: postings, page counts, block counts, context windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import listed, token_texts, windows

Families = Mapping[str, Sequence[str]]


def lower_tokens(text: Column) -> Column:
    return F.transform(token_texts(text), F.lower)


def all_terms(families: Families) -> list[str]:
    return sorted({t for terms in families.values() for t in terms})


def postings(blocks: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """(word, block_idx, link), one row for each mention."""
    hits = F.filter(lower_tokens(F.col(text)), lambda t: listed(t, terms))
    return blocks.select(F.explode(hits).alias("word"), "block_idx", "link")


def mention_count(text: Column, terms: Sequence[str]) -> Column:
    return F.size(F.filter(lower_tokens(text), lambda t: listed(t, terms))).cast("long")


def with_counts(blocks: DataFrame, families: Families, text: str = "text") -> DataFrame:
    """Add ``<family>_count`` and ``doc_length`` (tokens)."""
    out = blocks.withColumn("__tokens", lower_tokens(F.col(text)))
    for name, terms in families.items():
        out = out.withColumn(f"{name}_count", F.size(F.filter("__tokens", lambda t: listed(t, terms))).cast("long"))  # noqa: B023
    return out.withColumn("doc_length", F.size("__tokens").cast("long")).drop("__tokens")


def page_counts(blocks: DataFrame, families: Families, keys: Sequence[str] = ("link",), text: str = "text") -> DataFrame:
    """Per page: ``total_tokens``, mentions by family, flags and relative frequencies."""
    counted = with_counts(blocks, families, text)
    sums = [F.sum(f"{n}_count").alias(f"{n}_count") for n in families]
    pages = counted.groupBy(*keys).agg(F.sum("doc_length").alias("total_tokens"), *sums)
    for n in families:
        pages = pages.withColumn(f"contains_{n}", F.col(f"{n}_count") > 0).withColumn(f"{n}_freq", F.try_divide(f"{n}_count", "total_tokens"))
    return pages


def target_pages(pages: DataFrame, families: Families) -> DataFrame:
    """Pages with a mention of any family."""
    return pages.filter(sum((F.col(f"{n}_count") for n in families), F.lit(0)) > 0)


def with_titles(pages: DataFrame, titles: DataFrame, key: str = "lccn") -> DataFrame:
    """Left join of the titles (key, title); unknown ones stay null."""
    return pages.join(titles, key, "left")


def context_windows(text: Column, terms: Sequence[str], before: int) -> Column:
    """Array of token windows around each mention; they may overlap."""
    return windows(token_texts(text), lambda t: listed(F.lower(t), terms), before)


def context(text: Column, terms: Sequence[str], before: int) -> Column:
    """The windows one behind the other as one token array; empty without a mention."""
    return F.flatten(context_windows(text, terms, before))


def zip_blocks(pages: DataFrame, raw: str = "text_blocks_raw", cleaned: str = "text_blocks_cleaned") -> DataFrame:
    """One row per block of pages that hold raw and cleaned blocks in parallel arrays of structs."""
    keys = [c for c in pages.columns if c not in (raw, cleaned)]
    zipped = F.arrays_zip(F.col(raw).alias("raw"), F.col(cleaned).alias("cleaned"))
    rows = pages.select(*keys, F.posexplode(zipped).alias("block_idx", "b"))
    return rows.select(*keys, "block_idx", F.col("b.raw.text").alias("text_raw"), F.col("b.cleaned.text").alias("text_cleaned"), *[F.col(f"b.raw.{c}").alias(c if c != "id" else "text_id") for c in ("id", "height", "width", "hpos", "vpos")])
