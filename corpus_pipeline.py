"""From raw documents to packed training sequences: quality rules, line deduplication, near-duplicate
removal, source mixing, packing.  Each stage takes what its predecessor kept.

In all stages a null text counts as an empty one, null ids, languages and sources are values of their own,
repeated rows are rows, columns besides those named pass through whatever their names, and an empty table
gives an empty one.  What a stage does with ties is said with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.line_spread import remove_widespread
from paperloom.llm.mixing import mix
from paperloom.llm.ngram_join import representatives
from paperloom.llm.packing import pack_documents
from paperloom.llm.queries import tokenizer_path
from paperloom.llm.robust_rules import quality_rules
from paperloom.llm.storage import discard, materialise, scope


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the robust distance reject: empty texts go; equal texts of a source share their verdict."""
    return quality_rules(docs, docs.columns, recount=True).filter("kept").select("doc.*")


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines; ``n_chars`` follows the text.  A text with no other lines stays whole."""
    cleaned = remove_widespread(docs, docs.columns)
    text = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return cleaned.select(*[text[c].alias(c) if c in text else F.col("doc")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five words, similarity of 0.8 or more.  Of repeated
    rows one stays; of different texts with that id the one with the smallest hash; texts without words stay all."""
    return representatives(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture holds it: once at least, twice where its source is small.  Equal rows of a source
    are dealt in the order of their copies' draw."""
    mixed = mix(docs, docs.columns, max_repetition=2.0)
    return mixed.select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; an empty text is its end token."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", dedupe_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: Tokenisation has no SQL form; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's rows are written and read again, and its tables deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scope():
            docs = materialise(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
