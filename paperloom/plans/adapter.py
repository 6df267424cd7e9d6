"""The test tables in the shape of this engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import chunks, token_texts, word_tokens
from ..sources.shared import written

FAMILIES = {"first": ("que", "para", "mente", "ment"), "second": ("with", "from"), "third": ("nicht", "keit", "sich")}
STOP_WORDS = ("the", "and", "of", "in", "to", "de", "la", "que", "die", "der", "und", "et", "le", "en", "is", "was", "el", "los")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a text block: four of them make a page, a page has a year and a title."""
    page = F.expr("doc_id div 4")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    keyed = docs.withColumn("page", page).withColumn("year", (1890 + F.col("page") % 40).cast("long"))
    return keyed.select(
        F.col("doc_id").alias("block_id"), F.concat(F.lit("p"), F.col("page").cast("string")).alias("link"), (F.col("doc_id") % 4).alias("block_idx"),
        "year", F.concat(F.lit("src"), (F.col("page") % 20).cast("string")).alias("title"),
        F.format_string("%04d-%02d-01", F.col("year"), 1 + F.col("page") % 12).alias("date"), "text", F.col("doc_id").cast("string").alias("text_id"),
    )


BLOCKS = """blocks AS (SELECT doc_id AS block_id, 'p' || (doc_id // 4) AS link, doc_id % 4 AS block_idx, 1890 + (doc_id // 4) % 40 AS year,
  'src' || ((doc_id // 4) % 20) AS title, printf('%04d-%02d-01', 1890 + (doc_id // 4) % 40, 1 + (doc_id // 4) % 12) AS date, text, CAST(doc_id AS VARCHAR) AS text_id FROM documents)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as irrelevance labels, some of them under a second word type."""
    read = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.concat(F.lit("p"), F.expr("doc_id div 4").cast("string")).alias("link"), F.col("doc_id").cast("string").alias("text_id"), (1 - F.col("quality")).cast("long").alias("label"), F.when(F.col("doc_id") % 2 == 0, "first").otherwise("second").alias("word_type"))
    return read.unionByName(read.filter("label = 1").withColumn("word_type", F.lit("third")))


LABELS = """labels0 AS (SELECT 'p' || (doc_id // 4) AS link, CAST(doc_id AS VARCHAR) AS text_id, CAST(1 - quality AS BIGINT) AS label, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS word_type FROM labels),
marks AS (SELECT * FROM labels0 UNION ALL SELECT link, text_id, label, 'third' FROM labels0 WHERE label = 1)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n): lower-cased words of all documents."""
    return blocks(spark, sf_dir).select(F.explode(word_tokens(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def tokens_and_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(token) of all documents, once each, and :func:`words`: both from their chunks, which are counted in one pass over the texts."""
    counted = blocks(spark, sf_dir).select(F.explode(chunks(F.col("text"))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted, "chunks")
    found = counted.select(F.explode(word_tokens(F.lower("chunk"))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.select(F.explode(token_texts(F.col("chunk"))).alias("token")).distinct(), written(found, "words")


WORDS = """words AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(text), '([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+)', 1), lambda w: length(w) >= 3)) AS word FROM documents) GROUP BY word)"""


def misread(word):
    """A word as a scanner might misread it."""
    return F.replace(F.replace(word, F.lit("th"), F.lit("tb")), F.lit("o"), F.lit("0"))


def repaired(word):
    """What a simple repair makes of it."""
    return F.replace(word, F.lit("0"), F.lit("o"))


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct word as gold text with its misread and repaired forms."""
    return words(spark, sf_dir).select(F.col("word").alias("pair_id"), misread(F.col("word")).alias("raw_text"), F.col("word").alias("gold_text"), repaired(misread(F.col("word"))).alias("fixed_text"), "n")


PAIRS = WORDS + """, pairs AS (SELECT word AS pair_id, replace(replace(word, 'th', 'tb'), 'o', '0') AS raw_text, word AS gold_text, replace(replace(word, 'th', 'tb'), '0', 'o') AS fixed_text, n FROM words)"""


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct line as gold text, likewise."""
    lines = blocks(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("gold_text")).filter("gold_text <> ''").distinct()
    return lines.select(F.md5(F.col("gold_text").cast("binary")).alias("pair_id"), misread(F.col("gold_text")).alias("raw_text"), "gold_text", repaired(misread(F.col("gold_text"))).alias("fixed_text"))
