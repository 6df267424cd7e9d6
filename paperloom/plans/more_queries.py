"""Queries for whole miners and evaluations, gold pairs, answers, word clouds and series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.tokens import is_word
from ..operators import mining, quality, relevance, tagging, terms, timelines
from ..operators.scripts import small_batches
from ..sources import index
from ..sources import pages as sources
from ..sources.shared import shared_folder
from ..operators import alto, mentions
from .adapter import BLOCKS, PAIRS, STOP_WORDS, WORDS, blocks, line_pairs, word_pairs, words
from .analysis_queries import JUDGED, MERGED, OPCODES, SPLIT, TIMELINE, TOTALS, judged, lexicon, page_table, passage_rows
from .queries import MEASURES, RX, SPREAD, TERMS, TOKENS, distinct_tokens, query, quoted


@query(f"WITH {SPREAD} SELECT token, regexp_matches(token, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]') AS is_word FROM distinct_tokens")
def tok5_is_word(spark, d):
    return distinct_tokens(spark, d).select("token", is_word(F.col("token")).alias("is_word"))


@query(f"WITH {JUDGED} SELECT block_id, word_type FROM j WHERE round(score, 6) > 0.5 AND round(score, 6) < 0.8")
def clf4_uncertain(spark, d):
    return relevance.uncertain(judged(spark, d).withColumn("score", F.round("score", 6))).select("block_id", "word_type")


def cloud(spark, d):
    return terms.word_cloud(passage_rows(spark, d), ["block_id", "hit"], lexicon(spark, d), STOP_WORDS, ("with",))


@query(f"WITH {SPLIT} SELECT word, n FROM split WHERE pos IS NULL")
def wcl12_ignored_words(spark, d):
    return cloud(spark, d).ignored


@query(f"WITH {SPLIT} SELECT word, n, pos FROM split WHERE pos IS NOT NULL")
def wcl12_dictionary_words(spark, d):
    return cloud(spark, d).words


@query(f"WITH {MERGED}, top AS (SELECT term, n FROM merged ORDER BY n DESC, term LIMIT 100) SELECT term, n, round(n / (SELECT max(n) FROM top), 6) AS weight FROM top")
def wcl14_weighted_top100(spark, d):
    from .analysis_queries import merged

    return terms.weighted_terms(merged(spark, d)).withColumn("weight", F.round("weight", 6))


def gold_pages(spark, d):
    """Pages whose blocks came back unchanged or in capitals."""
    answer = F.struct(F.col("text").alias("raw_text"), F.upper("text").alias("gpt_fixed_best_guess"), F.col("text").alias("gpt_fixed_conservative"))
    ordered = F.array_sort(F.collect_list(F.struct("block_idx", answer.alias("a"))))
    return blocks(spark, d).groupBy("link").agg(F.transform(ordered, lambda x: x["a"]).alias("gpt_fixed"))


@query(f"WITH {BLOCKS} SELECT link, block_idx AS k, md5(text) AS raw_md5 FROM blocks WHERE block_idx < 3 AND length(text) > 100")
def glu5_inspected_pairs(spark, d):
    return sources.inspected_pairs(gold_pages(spark, d), first=3).select("link", F.col("k").cast("long").alias("k"), F.md5(F.col("raw_text").cast("binary")).alias("raw_md5"))


@query(f"WITH {BLOCKS} SELECT link, count(*) AS n_blocks, md5(string_agg(text, '|' ORDER BY block_idx)) AS texts_md5 FROM blocks GROUP BY link")
def glu6_requests(spark, d):
    """The requests, read back."""
    asked = F.from_json("request", "array<struct<raw_text:string>>")
    texts = F.transform(asked, lambda x: x["raw_text"])
    return sources.correction_request(blocks(spark, d)).select("link", F.size(texts).cast("long").alias("n_blocks"), F.md5(F.array_join(texts, "|").cast("binary")).alias("texts_md5"))


@query(f"WITH {BLOCKS} SELECT block_id, CASE block_id % 4 WHEN 3 THEN 1 ELSE 2 END AS n, md5(text) AS first_md5 FROM blocks")
def glu7_tolerant_answers(spark, d):
    """Answers as they stand, fenced, with a comma too many, and cut off within the second of two objects."""
    text = F.to_json(F.struct(F.col("text").alias("raw_text")))
    whole = F.concat(F.lit("["), text, F.lit(', {"raw_text": "b"}]'))
    kinds = [whole, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```")), F.concat(F.lit("["), text, F.lit(', {"raw_text": "b"},\n]')), F.concat(F.lit("["), text, F.lit(', {"raw_te'))]
    answer = sources.correction_answer(F.get(F.array(*kinds), F.col("block_id") % 4))
    return small_batches(blocks(spark, d)).select("block_id", F.size(answer).alias("n"), F.md5(F.get(answer, F.lit(0))["raw_text"].cast("binary")).alias("first_md5"))


@query(f"WITH {TIMELINE}, sums AS (SELECT year, title, {TOTALS} FROM pg GROUP BY year, title), span AS (SELECT title, unnest(range(min(year), max(year) + 1)) AS year FROM sums GROUP BY title) SELECT title, year, {', '.join(f'coalesce({m}, 0) AS {m}' for m in MEASURES)} FROM span LEFT JOIN sums USING (title, year)")
def agg8_filled_series(spark, d):
    return timelines.filled_series(timelines.by_year_and_title(page_table(spark, d), MEASURES), MEASURES)


@query(f"WITH {TIMELINE} SELECT count(DISTINCT (title, link)) AS pages, CAST(sum(doc_length) AS BIGINT) AS tokens FROM pg WHERE title IS NOT NULL")
def agg10_totals(spark, d):
    pages = page_table(spark, d).select("title", F.col("link").alias("date"), F.col("doc_length").alias("total_tokens"))
    return timelines.issue_summary(pages).agg(F.sum("issues").alias("pages"), F.sum("tokens").alias("tokens"))


@query(f"WITH {PAIRS} SELECT pair_id, round(levenshtein(raw_text, gold_text) / length(gold_text), 6) AS cer_raw, round(levenshtein(fixed_text, gold_text) / length(gold_text), 6) AS cer_fixed, CAST(raw_text <> gold_text AS INTEGER)::DOUBLE AS wer_raw, CAST(fixed_text <> gold_text AS INTEGER)::DOUBLE AS wer_fixed, CASE WHEN raw_text = gold_text AND fixed_text <> raw_text THEN 1 ELSE 0 END::BIGINT AS damage_count FROM pairs")
def eva6_evaluate(spark, d):
    """All metrics of single words, where word rates are 0 or 1."""
    out = quality.evaluate(word_pairs(spark, d))
    return out.select("pair_id", F.round("cer_raw", 6).alias("cer_raw"), F.round("cer_fixed", 6).alias("cer_fixed"), "wer_raw", "wer_fixed", "damage_count")


@query(f"WITH {OPCODES} SELECT array_to_string(raw_span, ' ') AS raw, array_to_string(fixed_span, ' ') AS fixed, count(*) AS count, CASE WHEN len(raw_span) = 1 THEN 'word' ELSE 'phrase' END AS kind FROM ops WHERE NOT same AND len(raw_span) <= 5 GROUP BY ALL")
def min7_miner(spark, d):
    """Phrases and words of one alignment, counted."""
    phrases, words = mining.mine(line_pairs(spark, d), by_place=True)
    named = phrases.select(F.array_join("raw_span", " ").alias("raw"), F.array_join("fixed_span", " ").alias("fixed"), "count", F.lit("phrase").alias("kind"))
    return named.unionByName(words.select("raw", "fixed", "count", F.lit("word").alias("kind")))


#: Log-likelihood of a period behind each word, and sentences that end where no abbreviation stands.
ABBREVIATED = TOKENS + f""", gaps AS (SELECT *, regexp_extract_all(text, '{RX}', 2) AS ws FROM toks),
follow AS (SELECT unnest(l) AS word, unnest(ws) AS s, unnest(list_append(l[2:], NULL)) AS ahead FROM gaps WHERE len(l) > 0),
seen AS (SELECT word, count(*) AS n, count(*) FILTER (s = '' AND ahead = '.') AS before FROM follow GROUP BY word),
rate AS (SELECT sum(n) FILTER (word = '.')::DOUBLE / sum(n)::DOUBLE AS p FROM seen),
rated AS (SELECT word, n, before, length(replace(word, '.', '')) AS k, length(word) - length(replace(word, '.', '')) + 1 AS inside,
  before * ln(p) + (n - before) * ln(1 - p) - before * ln(0.99) - (n - before) * ln(1 - 0.99) AS worse FROM seen, rate WHERE before > 0 AND regexp_full_match(word, '[\\p{{L}}.]*\\p{{L}}')),
short AS (SELECT word, n, before, -2 * worse * exp(-k) * inside * pow(k::DOUBLE, -(n - before)::DOUBLE) AS score FROM rated WHERE -2 * worse * exp(-k) * inside * pow(k::DOUBLE, -(n - before)::DOUBLE) >= 0.3),
list_ AS (SELECT coalesce(list(word), []) AS known FROM short),
ends AS (SELECT g.*, list_filter(range(1, len(t) + 1), lambda i: t[i] IN ('!', '?') OR (t[i] = '.' AND NOT (i > 1 AND ws[i - 1] = '' AND list_contains(known, l[i - 1])))) AS e FROM gaps g, list_)"""


def abbreviated_words(spark, d):
    """The words alone: short ones, as the score falls by e with every letter."""
    return [r.word for r in tagging.abbreviations(blocks(spark, d)).select("word").collect()]


@query(f"WITH {ABBREVIATED} SELECT word, n, before, round(score, 6) AS score FROM short")
def wcl3_abbreviations(spark, d):
    return tagging.abbreviations(blocks(spark, d)).withColumn("score", F.round("score", 6))


@query(f"WITH {ABBREVIATED} SELECT block_id, len(e) AS sentences, coalesce(list_sum(e), 0)::BIGINT AS places FROM ends")
def wcl3_sentence_ends(spark, d):
    """How many sentences end in each block, and the sum of their places."""
    ends = tagging.sentence_ends(F.col("text"), abbreviated_words(spark, d))
    return blocks(spark, d).select("block_id", F.size(ends).cast("long").alias("sentences"), F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x).alias("places"))


def corpus_tagger(spark, d):
    found = abbreviated_words(spark, d)
    return tagging.train_tagger(blocks(spark, d), lexicon(spark, d), found), found


@query()
def wcl3_tags(spark, d):
    """How often each word of all blocks has each tag on the best paths."""
    tagger, found = corpus_tagger(spark, d)
    return tagging.tag_counts(blocks(spark, d), tagger, found)


@query(f"""WITH {ABBREVIATED}, hits AS (SELECT block_id, t, e, unnest(list_filter(range(1, len(t) + 1), lambda i: l[i] IN {quoted(TERMS)})) AS i FROM ends),
sent AS (SELECT block_id, t, i - 1 AS hit, coalesce(list_max(list_filter(e, lambda x: x < i)), 0) AS a, coalesce(list_min(list_filter(e, lambda x: x >= i)), len(t)) AS b, greatest(0, i - 11) AS lo, least(len(t), i + 9) AS hi FROM hits)
SELECT block_id, CAST(hit AS BIGINT) AS hit, array_to_string(CASE WHEN b - a > hi - lo THEN t[lo + 1:hi] ELSE t[a + 1:b] END, ' ') AS passage FROM sent""")
def wcl4_sentence_passages(spark, d):
    found = terms.passages(blocks(spark, d), TERMS, ["block_id"], abbreviated=abbreviated_words(spark, d))
    return found.select("block_id", F.col("hit").cast("long").alias("hit"), F.array_join("words", " ").alias("passage"))


@query()
def wcl6_tagged_split(spark, d):
    """Words of the passages by the tag of their best path."""
    tagger, found = corpus_tagger(spark, d)
    rows = terms.passages(blocks(spark, d), TERMS, ["block_id"], abbreviated=found).select(F.array_join("words", " ").alias("text"))
    return tagging.tag_counts(rows, tagger, found)


@query(f"""WITH {BLOCKS}, plain AS (SELECT block_id, translate(text, chr(92) || '"[]{{}}:', '') AS text FROM blocks),
said AS (SELECT block_id, CASE WHEN block_id % 3 = 1 THEN replace(replace(text, ' the ', ' "the" '), ' de ', ' "de" ') ELSE text END AS text FROM plain)
SELECT block_id, 2::BIGINT AS n, md5(text) AS first_md5 FROM said""")
def glu7_repaired_answers(spark, d):
    """Answers behind a note with brackets, with quotes and line breaks within strings, and in single quotes without a comma between objects."""
    plain = F.translate("text", '\\"[]{}:', "")
    quoted_words = F.replace(F.replace(plain, F.lit(" the "), F.lit(' "the" ')), F.lit(" de "), F.lit(' "de" '))
    second = F.lit('{"raw_text": "b"}]')
    kinds = [
        F.concat(F.lit("Note [1]: see {below}\n["), F.to_json(F.struct(plain.alias("raw_text"))), F.lit(", "), second, F.lit(" [end]")),
        F.concat(F.lit('[{"raw_text": "'), quoted_words, F.lit('", "gpt_fixed_best_guess": None}, '), second),
        F.concat(F.lit("```[{raw_text: "), F.to_json(F.array(plain)).substr(F.lit(2), F.length(F.to_json(F.array(plain))) - 2), F.lit(" }  "), second),
    ]
    answer = sources.correction_answer(F.get(F.array(*kinds), F.col("block_id") % 3))
    return small_batches(blocks(spark, d)).select("block_id", F.size(answer).cast("long").alias("n"), F.md5(F.get(answer, F.lit(0))["raw_text"].cast("binary")).alias("first_md5"))


def new_path(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {TOKENS}, every AS (SELECT link, block_idx, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS place FROM toks)
SELECT term, link, block_idx, count(*) AS n, array_to_string(list(place ORDER BY place), ',') AS places FROM every WHERE term IN {quoted(TERMS)} GROUP BY ALL""")
def idx2_stored_index(spark, d):
    """All blocks' postings written as an index, and the families' terms looked up in it."""
    path = new_path(spark, "index")
    index.write_index(index.postings_of(blocks(spark, d), mentions.lower_tokens(F.col("text"))), path, buckets=16)
    found = index.look_up(spark, path, TERMS)
    return found.select("term", "link", "block_idx", F.col("n").cast("long").alias("n"), F.array_join(index.undeltas(F.col("steps")).cast("array<string>"), ",").alias("places"))


@query("""WITH v AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN n_chars || '.9' WHEN 2 THEN '-' || n_chars || '.5' WHEN 3 THEN CAST(n_chars AS VARCHAR) END AS v FROM documents)
SELECT doc_id, coalesce(CAST(trunc(CAST(v AS DOUBLE)) AS BIGINT), 0) AS value FROM v""")
def alt2_document_attr(spark, d):
    """Attributes as pages have them, whole, broken, negative and missing, from all documents."""
    size = F.col("n_chars").cast("string")
    value = F.when(F.col("doc_id") % 4 == 1, F.concat(size, F.lit(".9"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("-"), size, F.lit(".5"))).when(F.col("doc_id") % 4 == 3, size)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", alto.int_attr(value).cast("long").alias("value"))


@query(f"""WITH {PAIRS}, r AS (SELECT *, levenshtein(raw_text, gold_text) / length(gold_text) AS a, levenshtein(fixed_text, gold_text) / length(gold_text) AS b FROM pairs)
SELECT pair_id, round(a, 6) AS cer_raw, round(b, 6) AS cer_fixed, round(a - b, 6) AS cer_improvement_abs, round(CASE WHEN a > 0 THEN (a - b) / a ELSE 0 END, 6) AS cer_improvement_pct,
(raw_text <> gold_text)::INT::DOUBLE AS wer_raw, (fixed_text <> gold_text)::INT::DOUBLE AS wer_fixed,
CASE WHEN fixed_text = raw_text OR (raw_text <> gold_text AND fixed_text = gold_text) THEN 1.0 ELSE 0.0 END::DOUBLE AS edit_precision, CASE WHEN raw_text = gold_text OR fixed_text = gold_text THEN 1.0 ELSE 0.0 END::DOUBLE AS edit_recall,
(raw_text = gold_text AND fixed_text <> raw_text)::INT::DOUBLE AS damage_rate, (raw_text = gold_text AND fixed_text <> raw_text)::BIGINT AS damage_count, (raw_text = gold_text)::BIGINT AS clean_token_count FROM r""")
def eva6_record(spark, d):
    """The whole record of each word."""
    out = quality.evaluate(word_pairs(spark, d))
    rounded = ("cer_raw", "cer_fixed", "cer_improvement_abs", "cer_improvement_pct")
    return out.select("pair_id", *[F.round(c, 6).alias(c) for c in rounded], *[c for c in out.columns if c not in (*rounded, "pair_id")])


@query(r"""WITH sides AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[\s\x{85}\p{Z}]+'), lambda w: w <> '') AS g FROM benchmark),
told AS (SELECT item_id, g, flatten(list_transform(g, lambda w: CASE WHEN length(w) % 3 = 0 THEN [] WHEN contains(w, 'th') THEN [w, w] ELSE [w] END)) AS r FROM sides),
coded AS (SELECT item_id, len(g) AS n, list_distinct(list_concat(g, r)) AS known, g, r FROM told)
SELECT item_id, round(levenshtein(array_to_string(list_transform(r, lambda w: chr(32 + list_position(known, w)::INT)), ''), array_to_string(list_transform(g, lambda w: chr(32 + list_position(known, w)::INT)), '')) / n, 6) AS wer FROM coded""")
def eva2_uneven_wer(spark, d):
    """Word errors of benchmark texts of which words are dropped and doubled."""
    w = quality.words(F.col("text"))
    again = F.flatten(F.transform(w, lambda x: F.when(F.length(x) % 3 == 0, F.array().cast("array<string>")).when(F.contains(x, F.lit("th")), F.array(x, x)).otherwise(F.array(x))))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text", F.array_join(again, " ").alias("raw"))
    return items.select("item_id", F.round(quality.wer(F.col("raw"), F.col("text")), 6).alias("wer"))


@query()
def snk5_draw_again(spark, d):
    """As many draws as there are blocks, rows repeating."""
    rows = blocks(spark, d).select("block_id", "link")
    return sources.draw_with_replacement(rows, "block_id", rows.count())


@query(f"WITH {BLOCKS} SELECT block_id, link, md5(text) AS text_md5 FROM blocks")
def snk1_json_file(spark, d):
    """All blocks written as JSON and read back."""
    path, rows = new_path(spark, "json"), blocks(spark, d).select("block_id", "link", "text")
    sources.write_json_pages(rows, path)
    return spark.read.schema(rows.schema).json(path).select("block_id", "link", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {WORDS} SELECT word, n AS count FROM words WHERE n >= 10")
def snk2_dictionary_file(spark, d):
    """The dictionary of frequent words, written and read back."""
    path = new_path(spark, "dictionary")
    sources.write_dictionary(words(spark, d).withColumnRenamed("n", "count"), path)
    return sources.read_dictionary(spark, path)


@query(f"WITH {WORDS} SELECT word FROM words WHERE n >= 10 UNION SELECT 'zzz'")
def src8_word_list_file(spark, d):
    """Words from the first fields of a text file's lines, and one more."""
    path = new_path(spark, "words")
    words(spark, d).filter("n >= 10").select(F.concat_ws(" ", F.col("word"), F.col("n").cast("string"))).write.text(path)
    return sources.read_word_list(spark, path, ["zzz"])


@query(f"WITH {TIMELINE} SELECT link, first_count + second_count AS both_count, round((first_count + second_count) / nullif(doc_length, 0), 6) AS both_ratio, first_count + second_count > 0 AS contains_both FROM pg")
def agg3_combined_ratio(spark, d):
    out = timelines.with_combined(page_table(spark, d), ["first", "second"], "both")
    return out.select("link", "both_count", F.round("both_ratio", 6).alias("both_ratio"), "contains_both")
