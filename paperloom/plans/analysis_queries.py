"""Queries for dictionaries, spelling, correction, evaluation, timelines, relevance and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import analysis_terms, analysis_tokens, token_texts
from ..operators import correct, dictionary, mentions, mining, quality, relevance, spelling, terms, timelines
from ..sources import pages as sources
from ..sources.shared import written
from .adapter import BLOCKS, FAMILIES, LABELS, PAIRS, STOP_WORDS, WORDS, blocks, labels, line_pairs, misread, tokens_and_words, word_pairs, words
from .queries import COUNTED, KNOWN, MEASURES, PAGES, RX, SPREAD, SUSPECT, TERMS, TITLE, TOKENS, UPPER, counted, query, quoted

# timelines

RELEVANT = COUNTED + ", rel AS (SELECT *, " + ", ".join(f"{n}_count > 1 AS relevant_{n}" for n in FAMILIES) + " FROM counted)"
SUMS = ", ".join(f"CAST(sum(CASE WHEN relevant_{n} THEN {n}_count ELSE 0 END) AS BIGINT) AS {n}_count" for n in FAMILIES)
TIMELINE = RELEVANT + f", pg AS (SELECT link, min(year) AS year, min(title) AS title, CAST(sum(doc_length) AS BIGINT) AS doc_length, {SUMS} FROM rel GROUP BY link)"
TOTALS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES)


def page_table(spark, d):
    rel = counted(spark, d)
    for n in FAMILIES:
        rel = rel.withColumn(f"relevant_{n}", F.col(f"{n}_count") > 1)
    return timelines.page_sums(rel, list(FAMILIES))


@query(f"WITH {TIMELINE} SELECT link, year, title, doc_length, {', '.join(MEASURES)} FROM pg")
def agg1_page_conditional_sums(spark, d):
    return page_table(spark, d).select("link", "year", "title", "doc_length", *MEASURES)


@query(f"WITH {TIMELINE} SELECT link, {', '.join(f'round({n}_count / nullif(doc_length, 0), 6) AS {n}_ratio, {n}_count > 0 AS contains_{n}' for n in FAMILIES)} FROM pg")
def agg3_page_ratios(spark, d):
    return page_table(spark, d).select("link", *[c for n in FAMILIES for c in (F.round(f"{n}_ratio", 6).alias(f"{n}_ratio"), f"contains_{n}")])


@query(f"WITH {TIMELINE} SELECT year, title, {TOTALS} FROM pg GROUP BY year, title")
def agg4_year_title_mentions(spark, d):
    return timelines.by_year_and_title(page_table(spark, d), MEASURES)


@query(f"WITH {TIMELINE} SELECT title, {TOTALS} FROM pg GROUP BY title")
def agg5_title_totals(spark, d):
    return timelines.by_title(page_table(spark, d), MEASURES)


@query(f"WITH {TIMELINE} SELECT {TOTALS} FROM pg")
def agg6_grand_total(spark, d):
    return timelines.grand_total(page_table(spark, d), MEASURES)


@query(f"WITH {TIMELINE} SELECT year, title, {TOTALS} FROM pg GROUP BY GROUPING SETS ((year, title), (title), ())")
def agg456_grouping_sets(spark, d):
    return timelines.all_totals(page_table(spark, d), MEASURES)


@query(f"WITH {COUNTED}, issue AS (SELECT title, date, doc_length AS total_tokens FROM counted) SELECT title, count(date) AS pages, count(DISTINCT date) AS issues, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(count(date) / count(DISTINCT date), 6) AS pages_per_issue FROM issue GROUP BY title")
def agg9_issue_summary(spark, d):
    return timelines.issue_summary(counted(spark, d).withColumnRenamed("doc_length", "total_tokens")).withColumn("pages_per_issue", F.round("pages_per_issue", 6))


@query(f"WITH {BLOCKS} SELECT block_id, CAST(year // 10 * 10 AS BIGINT) AS decade FROM blocks")
def agg11_decade(spark, d):
    return blocks(spark, d).select("block_id", timelines.decade(F.col("year")).cast("long").alias("decade"))


# dictionary


@query(f"WITH {BLOCKS}, {WORDS} SELECT word, CAST(n AS BIGINT) AS plain_count FROM (SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(lower(text), '([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+)', 1), lambda w: length(w) >= 3)) AS word FROM blocks WHERE length(text) > 20) GROUP BY word)")
def dic1_raw_plain_counts(spark, d):
    return dictionary.word_counts(blocks(spark, d)).filter("plain_count > 0").select("word", "plain_count")


def halves(spark, d):
    """Word counts of blocks on even and on odd places, as the two sides of a merge."""
    found = blocks(spark, d).select("block_idx", F.explode(F.array_distinct(mentions.lower_tokens(F.col("text")))).alias("word"))
    side = lambda k: found.filter(F.col("block_idx") % 2 == k).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return side(0), side(1)


HALVES = TOKENS + ", f AS (SELECT block_idx, unnest(list_distinct(l)) AS word FROM toks), c AS (SELECT word, count(*) AS n FROM f WHERE block_idx % 2 = 0 GROUP BY word), p AS (SELECT word, count(*) AS n FROM f WHERE block_idx % 2 = 1 GROUP BY word)"


@query(f"WITH {HALVES} SELECT coalesce(c.word, p.word) AS word, CAST(least(coalesce(c.n, 0), 50) + least(5 * coalesce(p.n, 0), 500) + 2 * least(coalesce(c.n, 0), coalesce(p.n, 0)) AS BIGINT) AS count FROM c FULL JOIN p ON c.word = p.word")
def dic3_merge_counts(spark, d):
    return dictionary.merge_counts(*halves(spark, d))


ZIPF = WORDS + ", zipf AS (SELECT word, round(log10(n * 1e9 / (SELECT sum(n) FROM words)), 2) AS zipf FROM words)"


@query(f"WITH {ZIPF} SELECT word, round(zipf, 2) AS zipf FROM zipf WHERE zipf >= 4.0")
def dic4_top_priors(spark, d):
    return dictionary.top_priors(dictionary.corpus_zipf(words(spark, d)), 4.0, None)


@query(f"WITH {ZIPF} SELECT word, CAST(greatest(1, floor(pow(10, zipf - 4))) AS BIGINT) AS count FROM zipf WHERE word NOT IN (SELECT word FROM words WHERE n >= 10)")
def dic5_prior_antijoin(spark, d):
    w = words(spark, d)
    return dictionary.absent_priors(dictionary.corpus_zipf(w), w.filter("n >= 10"))


@query(f"WITH {HALVES}, {ZIPF} SELECT DISTINCT word FROM (SELECT word FROM p WHERE n >= 10 AND length(word) >= 3 AND regexp_full_match(word, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+') UNION ALL SELECT word FROM c WHERE n >= 50 AND length(word) >= 3 AND regexp_full_match(word, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+') UNION ALL SELECT word FROM zipf WHERE zipf >= 4.5)")
def dic6_vocab(spark, d):
    c, p = halves(spark, d)
    return dictionary.vocabulary(c, p, dictionary.top_priors(dictionary.corpus_zipf(words(spark, d)), 4.5, None))


@query(f"WITH {ZIPF} SELECT word, zipf FROM zipf")
def dic7_zipf(spark, d):
    return dictionary.corpus_zipf(words(spark, d))


@query(f"WITH {WORDS} SELECT word, n AS count FROM words WHERE n >= 10")
def snk2_dictionary_sink(spark, d):
    return dictionary.sink_rows(words(spark, d).withColumnRenamed("n", "count"))


# spelling


@query(f"WITH {PAIRS} SELECT pair_id, CAST(levenshtein(raw_text, gold_text) AS BIGINT) AS distance FROM pairs")
def spl1_levenshtein(spark, d):
    return word_pairs(spark, d).select("pair_id", F.levenshtein("raw_text", "gold_text").cast("long").alias("distance"))


#: DuckDB counts edits of bytes, so that other letters stand for one capital each there.
PLAIN = "translate({x}, 'áéíóúüñäößçèêàâîôûëïœùò', 'ABCDEFGHIJKLMNOPQRSTUVW')"
LEVENSHTEIN = f"levenshtein({PLAIN.format(x='term')}, {PLAIN.format(x='word')})"
LOOKUP = KNOWN + f""", sus AS MATERIALIZED (SELECT DISTINCT lower(regexp_extract(token, '(?s)^([^\\p{{L}}\\p{{N}}]*)(.*?)([^\\p{{L}}\\p{{N}}]*)$', 2)) AS term FROM judged WHERE {SUSPECT.format(x='token')}),
dict AS MATERIALIZED (SELECT word, n, length(word) AS len FROM words WHERE n >= 10),
reach AS MATERIALIZED (SELECT term, length(term) + unnest([-2, -1, 0, 1, 2]) AS len FROM sus WHERE term <> ''),
near AS (SELECT * FROM (SELECT term, word AS candidate, n AS count, {LEVENSHTEIN} AS distance FROM reach JOIN dict USING (len)) WHERE distance <= 2),
tier AS (SELECT * FROM (SELECT *, min(distance) OVER (PARTITION BY term) AS least FROM near) WHERE distance = least)"""


def lookups(spark, d):
    """Suspect terms, the dictionary, and all words."""
    t, every = tokens_and_words(spark, d)
    vocabulary = every.filter("n >= 10")
    known = vocabulary.select("word", F.lit(True).alias("known"))
    from ..functions.tokens import affix, is_suspect

    suspects = t.join(known, F.lower(t.token) == F.col("word"), "left").filter(is_suspect(F.col("token"), F.coalesce("known", F.lit(False)))).select(F.lower(affix(F.col("token"), 2)).alias("term")).filter("term <> ''").distinct()
    return suspects, vocabulary.withColumnRenamed("n", "count"), every


@query(f"WITH {LOOKUP} SELECT term, candidate, count, CAST(distance AS BIGINT) AS distance FROM tier")
def spl2_candidates(spark, d):
    return spelling.candidates(*lookups(spark, d)[:2]).withColumn("distance", F.col("distance").cast("long"))


@query()
def spl2_transposed(spark, d):
    """The same where letters that change places count as one edit."""
    return spelling.candidates(*lookups(spark, d)[:2], transpose=True).withColumn("distance", F.col("distance").cast("long"))


WEIRD = """(CASE WHEN length({x}) = 0 THEN 5.0 ELSE
  CASE WHEN length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) / length({x}) < 0.6 THEN (0.6 - length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) / length({x})) * 6.0 ELSE 0 END
  + CASE WHEN regexp_matches({x}, '\\p{{Nd}}') THEN 1.5 ELSE 0 END
  + least(2.0, 0.5 * length(regexp_replace({x}, '[\\p{{L}}\\p{{N}}\\-]', '', 'g'))) + CASE WHEN length({x}) >= 20 THEN 1.0 ELSE 0 END END)"""


@query(f"WITH {TOKENS}, s AS (SELECT DISTINCT unnest(t) AS token FROM toks) SELECT token, round({WEIRD.format(x='token')}, 6) AS penalty FROM s")
def spl3_weirdness(spark, d):
    t = blocks(spark, d).select(F.explode(token_texts(F.col("text"))).alias("token")).distinct()
    return t.select("token", F.round(spelling.weirdness(F.col("token")), 6).alias("penalty"))


CONFUSIONS = (("tb", "th"), ("0", "o"))
#: Bonus of the pairs in order, from the distances before, between and after them.
BONUS = """bonus AS (SELECT *, levenshtein(raw_text, gold_text) AS d0, levenshtein(replace(raw_text, 'tb', 'th'), gold_text) AS d1, levenshtein(replace(raw_text, '0', 'o'), gold_text) AS d2 FROM pairs),
bonus2 AS (SELECT *, CASE WHEN contains(raw_text, 'tb') AND d1 < d0 THEN d1 ELSE d0 END AS base1, CASE WHEN contains(raw_text, 'tb') AND d1 < d0 THEN least(1.0, (d0 - d1) / greatest(1, d0)) ELSE 0 END AS b1 FROM bonus),
bonus3 AS (SELECT *, 0.8 * (b1 + CASE WHEN contains(raw_text, '0') AND d2 < base1 THEN least(1.0, (base1 - d2) / greatest(1, base1)) ELSE 0 END) AS bonus FROM bonus2)"""


@query(f"WITH {PAIRS}, {BONUS} SELECT pair_id, round(bonus, 6) AS bonus FROM bonus3")
def spl4_confusion(spark, d):
    return word_pairs(spark, d).select("pair_id", F.round(spelling.confusion_bonus(F.col("raw_text"), F.col("gold_text"), CONFUSIONS), 6).alias("bonus"))


@query(f"WITH {PAIRS}, {BONUS} SELECT pair_id, round(1.2 * 4.0 - d0 + 0.15 * log10(n + 1) + bonus - {WEIRD.format(x='gold_text')}, 6) AS score FROM bonus3")
def spl5_score(spark, d):
    s = spelling.score(F.col("raw_text"), F.col("gold_text"), F.lit(4.0), F.levenshtein("raw_text", "gold_text"), F.col("n"), CONFUSIONS)
    return word_pairs(spark, d).select("pair_id", F.round(s["score"], 6).alias("score"))


BEST = LOOKUP.replace("near AS (", "near AS MATERIALIZED (").replace("tier AS (", "tier AS MATERIALIZED (") + ", zipf AS MATERIALIZED (SELECT word, round(log10(n * 1e9 / (SELECT sum(n) FROM words)), 2) AS zipf FROM words)" + f""",
scored AS (SELECT term, candidate, count, 1.2 * coalesce(z.zipf, 0) - distance + 0.15 * log10(count + 1) - {WEIRD.format(x='candidate')} AS score FROM tier LEFT JOIN zipf z ON z.word = candidate),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, count DESC, candidate) AS place FROM scored) WHERE place = 1),
chosen AS (SELECT term, candidate, score AS best_score, 1.2 * coalesce(z.zipf, 0) - {WEIRD.format(x='term')} AS own_score FROM best LEFT JOIN zipf z ON z.word = term)"""


@query(f"WITH {BEST} SELECT term, CASE WHEN best_score - own_score < 0.8 THEN term ELSE candidate END AS chosen, round(best_score, 4) AS best_score, round(own_score, 4) AS own_score FROM chosen")
def spl6_best_candidate(spark, d):
    suspects, vocabulary, every = lookups(spark, d)
    best = spelling.best_candidates(spelling.candidates(suspects, vocabulary), dictionary.corpus_zipf(every), (), 0.8)
    return best.select("term", "chosen", F.round("best_score", 4).alias("best_score"), F.round("own_score", 4).alias("own_score"))


# mining, correction


def mined(spark, d):
    """Counts of misread and gold words, as if aligned one to one."""
    pairs = word_pairs(spark, d).filter("raw_text <> gold_text").select(F.col("raw_text").alias("raw"), F.col("gold_text").alias("fixed"), F.col("n").alias("count"))
    from pyspark.sql import Window

    return pairs.withColumn("total", F.sum("count").over(Window.partitionBy("raw")))


MINED = PAIRS + ", mined AS (SELECT raw_text AS raw, gold_text AS fixed, n AS count, sum(n) OVER (PARTITION BY raw_text) AS total FROM pairs WHERE raw_text <> gold_text)"


@query(f"WITH {MINED} SELECT raw, fixed, count FROM mined WHERE count >= 2 AND count / total >= 0.9")
def min5_word_precision(spark, d):
    return mining.precise_words(mined(spark, d)).select("raw", "fixed", "count")


@query(f"WITH {MINED} SELECT raw, fixed, count FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY count DESC, fixed) AS place FROM mined) WHERE place = 1")
def min6_word_map(spark, d):
    return mining.word_map(mined(spark, d))


PHRASES = TOKENS + ", two AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: [t[i], t[i + 1]])) AS span FROM toks WHERE len(t) > 1), phrases AS (SELECT span, count(*) AS count FROM two GROUP BY span HAVING count(*) >= 2)"


def phrases(spark, d):
    """Pairs of neighbouring tokens, counted as one text each: tokens hold no blanks, and a text is a smaller row than an array."""
    every = blocks(spark, d).select(token_texts(F.col("text")).alias("x"))
    ahead = F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))).alias("y")
    both = every.select(F.explode(F.arrays_zip("x", ahead)).alias("p"))  # of a text with all its tokens beside each, Spark once held all rows
    rows = both.select(F.concat("p.x", F.lit(" "), "p.y").alias("pair")).filter("pair is not null")
    counted = mining.frequent_phrases(rows.groupBy("pair").agg(F.count(F.lit(1)).alias("count")))
    return counted.select(F.split("pair", " ").alias("raw_span"), "count", F.array(F.replace("pair", F.lit(" "), F.lit(""))).alias("fixed_span"))


def phrase_index(spark, d):
    """The index of :func:`phrases`, which are written first: what was shuffled to count them is gone when their keys are."""
    return mining.patch_index(written(phrases(spark, d), "phrases"))


@query(f"WITH {PHRASES} SELECT array_to_string(span, ' ') AS phrase, count FROM phrases")
def min4_phrase_patches(spark, d):
    return phrases(spark, d).select(F.array_join("raw_span", " ").alias("phrase"), "count")


NORMED = "list_transform(span, lambda x: lower(regexp_replace(x, '^[,.;:!?]+|[,.;:!?]+$', '', 'g')))"


@query(f"WITH {PHRASES} SELECT array_to_string({NORMED}, '_') AS key, min(count) AS count FROM phrases GROUP BY 1")
def min8_patch_index(spark, d):
    return mining.patch_index(phrases(spark, d)).select(F.array_join("raw_norm", "_").alias("key"), "count")


#: Misread lines have the tokens of their gold text in the same order, so that opcodes are runs of equal and of different places.
OPCODES = BLOCKS + f""", golds AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS gold FROM blocks),
sides AS (SELECT md5(gold) AS pair_id, regexp_extract_all(gold, '{RX}', 1) AS g, regexp_extract_all(replace(replace(gold, 'th', 'tb'), 'o', '0'), '{RX}', 1) AS r FROM golds WHERE gold <> ''),
places AS (SELECT pair_id, unnest(g) AS x, unnest(r) AS y, generate_subscripts(g, 1) AS i FROM sides),
told AS (SELECT *, lower(x) = lower(y) AS same FROM places),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY pair_id, same ORDER BY i) AS run FROM told),
ops AS (SELECT pair_id, same, run, list(y ORDER BY i) AS raw_span, list(x ORDER BY i) AS fixed_span FROM runs GROUP BY ALL)"""


@query(f"WITH {OPCODES} SELECT CASE WHEN same THEN 'equal' ELSE 'replace' END AS tag, count(*) AS n FROM ops GROUP BY 1")
def min1_opcodes(spark, d):
    return mining.opcodes(line_pairs(spark, d), by_place=True).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {OPCODES}, one AS (SELECT raw_span[1] AS raw, fixed_span[1] AS fixed, count(*) AS count FROM ops WHERE NOT same AND len(raw_span) = 1 GROUP BY ALL) SELECT raw, fixed, count, CAST(sum(count) OVER (PARTITION BY raw) AS BIGINT) AS total FROM one")
def min2_mined_words(spark, d):
    return mining.word_counts(mining.opcodes(line_pairs(spark, d), ("replace",), by_place=True, sizes=(1, 1)))


@query(f"WITH {OPCODES} SELECT array_to_string(raw_span, ' ') AS raw, array_to_string(fixed_span, ' ') AS fixed, count(*) AS count FROM ops WHERE NOT same AND len(raw_span) BETWEEN 2 AND 5 GROUP BY ALL")
def min3_phrase_mining(spark, d):
    found = mining.phrase_counts(mining.opcodes(line_pairs(spark, d), ("replace",), by_place=True, sizes=(2, 5)))
    return found.select(F.array_join("raw_span", " ").alias("raw"), F.array_join("fixed_span", " ").alias("fixed"), "count")


#: Pairs of tokens are replaced from left to right: of places in a row that all begin a known pair, every other one.
APPLIED = PHRASES + f""", win AS (SELECT key, fix FROM (SELECT {NORMED} AS key, array_to_string(span, '') AS fix, row_number() OVER (PARTITION BY {NORMED} ORDER BY count, array_to_string(span, chr(1)) DESC) AS place FROM phrases) WHERE place = 1),
lists AS (SELECT block_id, regexp_extract(text, '^(\\s*)', 1) AS head, text, t, regexp_extract_all(text, '{RX}', 2) AS ws FROM toks),
every AS (SELECT block_id, unnest(t) AS x, unnest(ws) AS w, generate_subscripts(t, 1) AS i FROM lists),
ahead AS (SELECT *, lead(x) OVER (PARTITION BY block_id ORDER BY i) AS y, lead(w) OVER (PARTITION BY block_id ORDER BY i) AS v FROM every),
met AS (SELECT a.*, win.fix FROM (SELECT *, CASE WHEN y IS NOT NULL THEN {NORMED.replace("span", "[x, y]")} END AS key FROM ahead) a LEFT JOIN win USING (key)),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY block_id, fix IS NOT NULL ORDER BY i) AS run FROM met),
picked AS (SELECT *, fix IS NOT NULL AND row_number() OVER (PARTITION BY block_id, fix IS NOT NULL, run ORDER BY i) % 2 = 1 AS here FROM runs),
written AS (SELECT *, lag(here, 1, false) OVER (PARTITION BY block_id ORDER BY i) AS gone FROM picked),
parts AS (SELECT block_id, string_agg(CASE WHEN here THEN fix || v ELSE x || w END, '' ORDER BY i) FILTER (NOT gone) AS body FROM written GROUP BY block_id)"""


@query(f"WITH {APPLIED} SELECT block_id, md5(head || coalesce(body, '')) AS text_md5 FROM lists LEFT JOIN parts USING (block_id)")
def fix1_phrase_apply(spark, d):
    out = correct.apply_phrases(blocks(spark, d).select("block_id", "text"), phrase_index(spark, d), lengths=(2,))
    return out.select("block_id", F.md5(F.col("text_patched").cast("binary")).alias("text_md5"))


#: Mined phrases of 2 to 5 tokens; of places that begin one the longest counts, and islands of overlapping ones are walked from their start.
REWRITTEN = OPCODES + f""", freq AS (SELECT raw_span AS span, fixed_span, count(*) AS count FROM ops WHERE NOT same AND len(raw_span) BETWEEN 2 AND 5 GROUP BY ALL HAVING count(*) >= 2),
keyed AS (SELECT array_to_string({NORMED}, chr(1)) AS key, array_to_string(fixed_span, ' ') AS fix, row_number() OVER (PARTITION BY {NORMED} ORDER BY count, array_to_string(span, chr(1)) DESC, array_to_string(fixed_span, chr(1)) DESC) AS place FROM freq),
rt AS (SELECT block_id, raw, regexp_extract_all(raw, '{RX}', 1) AS t, regexp_extract_all(raw, '{RX}', 2) AS ws FROM (SELECT block_id, replace(replace(text, 'th', 'tb'), 'o', '0') AS raw FROM blocks)),
nt AS (SELECT block_id, {NORMED.replace("span", "t")} AS t FROM rt),
spans AS (SELECT block_id, i, n, array_to_string(t[i:i + n - 1], chr(1)) AS key FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM (SELECT *, unnest([2, 3, 4, 5]) AS n FROM nt))),
best AS (SELECT block_id, i, max(n) AS n, arg_max(fix, n) AS fix FROM spans JOIN keyed USING (key) WHERE place = 1 GROUP BY block_id, i),
islands AS (SELECT *, sum(CASE WHEN before >= i THEN 0 ELSE 1 END) OVER (PARTITION BY block_id ORDER BY i) AS island FROM (SELECT *, max(i + n - 1) OVER (PARTITION BY block_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY block_id, island ORDER BY i) AS k FROM islands),
walk(block_id, island, k, free, taken) AS (
  SELECT block_id, island, k, i + n, true FROM ranked WHERE k = 1
  UNION ALL
  SELECT m.block_id, m.island, m.k, CASE WHEN m.i >= w.free THEN m.i + m.n ELSE w.free END, m.i >= w.free FROM walk w JOIN ranked m ON m.block_id = w.block_id AND m.island = w.island AND m.k = w.k + 1),
taken AS (SELECT r.block_id, r.i, r.n, r.fix FROM ranked r JOIN walk w USING (block_id, island, k) WHERE w.taken),
inner_ AS (SELECT block_id, i AS begun, unnest(range(i, i + n)) AS i, fix FROM taken),
every AS (SELECT block_id, unnest(t) AS x, unnest(ws) AS w, generate_subscripts(t, 1) AS i FROM rt),
lasts AS (SELECT block_id, begun, max(i) AS i FROM inner_ GROUP BY block_id, begun),
pieces AS (SELECT e.block_id, e.i, CASE WHEN n.begun IS NULL THEN e.x || e.w ELSE CASE WHEN n.begun = e.i THEN n.fix ELSE '' END || CASE WHEN l.i IS NOT NULL THEN e.w ELSE '' END END AS piece
  FROM every e LEFT JOIN inner_ n ON n.block_id = e.block_id AND n.i = e.i LEFT JOIN lasts l ON l.block_id = e.block_id AND l.i = e.i),
bodies AS (SELECT block_id, string_agg(piece, '' ORDER BY i) AS body FROM pieces GROUP BY block_id)"""


def mined_index(spark, d):
    return mining.patch_index(mining.frequent_phrases(mining.phrase_counts(mining.opcodes(line_pairs(spark, d), ("replace",), by_place=True, sizes=(2, 5)))))


@query(f"WITH RECURSIVE {REWRITTEN} SELECT block_id, md5(regexp_extract(raw, '^(\\s*)', 1) || coalesce(body, '')) AS text_md5 FROM rt LEFT JOIN bodies USING (block_id)")
def fix1_mined_phrases(spark, d):
    """Misread texts with all phrases of 2 to 5 tokens that their lines' alignment with the gold text gives."""
    misread_blocks = blocks(spark, d).withColumn("text", misread(F.col("text")))
    return correct.apply_phrases(misread_blocks, mined_index(spark, d)).select("block_id", F.md5(F.col("text_patched").cast("binary")).alias("text_md5"))


@query(f"WITH {MINED}, m AS (SELECT raw, fixed FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY count DESC, fixed) AS place FROM mined) WHERE place = 1) SELECT raw AS token, fixed FROM m WHERE length(raw) > 2 AND lower(raw) <> lower(fixed)")
def fix2_word_map(spark, d):
    mapping = mining.word_map(mined(spark, d))
    return correct.word_map_tokens(mapping.select(F.col("raw").alias("token")), mapping).select("token", "fixed")


AFFIX = "regexp_extract(token, '(?s)^([^\\p{{L}}\\p{{N}}]*)(.*?)([^\\p{{L}}\\p{{N}}]*)$', {k})"


@query(f"""WITH {BEST}, picked AS (SELECT term, CASE WHEN best_score - own_score < 0.8 THEN term ELSE candidate END AS pick FROM chosen),
odd AS (SELECT DISTINCT token, {AFFIX.format(k=1)} AS head, {AFFIX.format(k=2)} AS core, {AFFIX.format(k=3)} AS tail FROM judged WHERE {SUSPECT.format(x='token')})
SELECT token, head || CASE WHEN {TITLE.format(x='core')} THEN upper(pick[1]) || pick[2:] WHEN {UPPER.format(x='core')} THEN upper(pick) ELSE pick END || tail AS fixed
FROM odd JOIN picked ON lower(core) = term WHERE pick <> term""")
def fix3_spell_pass(spark, d):
    t, every = tokens_and_words(spark, d)
    vocabulary = every.filter("n >= 10")
    return correct.spelled_tokens(t, vocabulary, vocabulary.withColumnRenamed("n", "count"), dictionary.corpus_zipf(every), (), 0.8)


#: The tokens of the patched texts take the place of those of the texts in the look-up of spellings.
WHOLE = APPLIED + f""", patched AS MATERIALIZED (SELECT block_id, head || coalesce(body, '') AS text FROM lists LEFT JOIN parts USING (block_id)),
seen AS MATERIALIZED (SELECT block_id, unnest(regexp_extract_all(text, '{RX}', 1)) AS token, unnest(regexp_extract_all(text, '{RX}', 2)) AS w, generate_subscripts(regexp_extract_all(text, '{RX}', 1), 1) AS i FROM patched),
distinct_tokens AS (SELECT DISTINCT token FROM seen)""" + BEST[len(SPREAD) :] + f""", picked_words AS (SELECT term, CASE WHEN best_score - own_score < 0.8 THEN term ELSE candidate END AS pick FROM chosen),
odd AS (SELECT DISTINCT token, {AFFIX.format(k=1)} AS head, {AFFIX.format(k=2)} AS core, {AFFIX.format(k=3)} AS tail FROM judged WHERE {SUSPECT.format(x='token')}),
fixes AS (SELECT token, head || CASE WHEN {TITLE.format(x='core')} THEN upper(pick[1]) || pick[2:] WHEN {UPPER.format(x='core')} THEN upper(pick) ELSE pick END || tail AS fixed FROM odd JOIN picked_words ON lower(core) = term WHERE pick <> term),
bodies AS (SELECT block_id, string_agg(coalesce(fixed, token) || w, '' ORDER BY i) AS body FROM seen LEFT JOIN fixes USING (token) GROUP BY block_id)"""


@query(f"WITH {WHOLE} SELECT block_id, md5(regexp_extract(text, '^(\\s*)', 1) || coalesce(bodies.body, '')) AS text_md5 FROM patched LEFT JOIN bodies USING (block_id)")
def fix4_full_fix(spark, d):
    every = written(words(spark, d), "words")
    vocabulary = every.filter("n >= 10")
    index = phrase_index(spark, d)
    texts = blocks(spark, d).select("block_id", "text")
    out = correct.fix_text(texts, "block_id", index, vocabulary, vocabulary.withColumnRenamed("n", "count"), dictionary.corpus_zipf(every), least_gain=0.8, out="text", lengths=(2,))
    return out.select("block_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# evaluation


@query(f"WITH {PAIRS} SELECT pair_id, round(levenshtein(raw_text, gold_text) / length(gold_text), 6) AS cer_raw, round(levenshtein(fixed_text, gold_text) / length(gold_text), 6) AS cer_fixed FROM pairs")
def eva1_cer(spark, d):
    raw, gold, fixed = (F.col(c) for c in ("raw_text", "gold_text", "fixed_text"))
    return word_pairs(spark, d).select("pair_id", F.round(quality.cer(raw, gold), 6).alias("cer_raw"), F.round(quality.cer(fixed, gold), 6).alias("cer_fixed"))


@query(f"WITH {PAIRS}, r AS (SELECT pair_id, levenshtein(raw_text, gold_text) / length(gold_text) AS a, levenshtein(fixed_text, gold_text) / length(gold_text) AS b FROM pairs) SELECT pair_id, round(a - b, 6) AS absolute, round(CASE WHEN a > 0 THEN (a - b) / a ELSE 0 END, 6) AS relative FROM r")
def eva3_improvement(spark, d):
    raw, gold, fixed = (F.col(c) for c in ("raw_text", "gold_text", "fixed_text"))
    better = quality.improvement(quality.cer(raw, gold), quality.cer(fixed, gold))
    return word_pairs(spark, d).select("pair_id", F.round(better["absolute"], 6).alias("absolute"), F.round(better["relative"], 6).alias("relative"))


@query(f"WITH {PAIRS}, r AS (SELECT levenshtein(raw_text, gold_text) / length(gold_text) AS v FROM pairs) SELECT CAST(least(floor(v / 0.1), 9) AS BIGINT) AS bin, count(*) AS n FROM r WHERE v BETWEEN 0 AND 1 GROUP BY 1")
def eva7_histogram(spark, d):
    rates = word_pairs(spark, d).select(quality.cer(F.col("raw_text"), F.col("gold_text")).alias("v"))
    return quality.histogram(rates, "v", 0.0, 1.0, 10)


#: Misread lines have as many words as their gold text, in the same order.
LINES = BLOCKS + r""", golds AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS gold FROM blocks),
lined AS (SELECT md5(gold) AS pair_id, list_filter(regexp_split_to_array(gold, '[\s\x{85}\p{Z}]+'), lambda w: w <> '') AS g,
  list_transform(g, lambda w: replace(replace(w, 'th', 'tb'), 'o', '0')) AS r, list_transform(r, lambda w: replace(w, '0', 'o')) AS f FROM golds WHERE gold <> '')"""


@query(f"WITH {LINES} SELECT pair_id, CASE WHEN len(g) = 0 THEN 0.0 ELSE round(len(list_filter(range(1, len(g) + 1), lambda i: g[i] <> r[i])) / len(g), 6) END AS wer FROM lined")
def eva2_wer(spark, d):
    return line_pairs(spark, d).select("pair_id", F.round(quality.wer(F.col("raw_text"), F.col("gold_text")), 6).alias("wer"))


def many(condition: str) -> str:
    return f"len(list_filter(range(1, len(g) + 1), lambda i: {condition}))"


@query(f"""WITH {LINES}, c AS (SELECT pair_id, {many("g[i] <> r[i]")} AS need, {many("f[i] <> r[i]")} AS done, {many("f[i] <> r[i] AND f[i] = g[i]")} AS hit FROM lined)
SELECT pair_id, CASE WHEN done = 0 THEN 1.0 ELSE hit / done END AS edit_precision, CASE WHEN need = 0 THEN 1.0 ELSE hit / need END AS edit_recall FROM c""")
def eva4_edit_pr(spark, d):
    return quality.edit_scores(line_pairs(spark, d))


@query(f"""WITH {LINES}, c AS (SELECT pair_id, {many("g[i] = r[i]")} AS clean, {many("g[i] = r[i] AND f[i] <> r[i]")} AS bad FROM lined)
SELECT pair_id, CASE WHEN clean = 0 THEN 0.0 ELSE bad / clean END AS damage_rate, CAST(bad AS BIGINT) AS damage_count, CAST(clean AS BIGINT) AS clean_token_count FROM c""")
def eva5_damage(spark, d):
    return quality.damage(line_pairs(spark, d), by_place=True)


# relevance


@query(f"WITH {BLOCKS}, {LABELS} SELECT block_id, word_type, label FROM blocks JOIN marks USING (link, text_id)")
def clf6_label_join(spark, d):
    return relevance.label_join(blocks(spark, d), labels(spark, d)).select("block_id", "word_type", "label")


@query(f"WITH {BLOCKS}, {LABELS} SELECT block_id FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.link = b.link AND m.text_id = b.text_id)")
def clf5_label_queue(spark, d):
    return relevance.label_queue(blocks(spark, d), labels(spark, d)).select("block_id")


@query(f"WITH {COUNTED} SELECT block_id FROM counted WHERE first_count > 0")
def clf1_family_blocks(spark, d):
    return counted(spark, d).filter("first_count > 0").select("block_id")


@query(f"WITH {TOKENS}, g AS (SELECT block_id, unnest(list_distinct(l)) AS term FROM toks) SELECT term, count(*) AS df FROM g GROUP BY term HAVING count(*) >= 5")
def clf2_vocabulary(spark, d):
    rows = blocks(spark, d).select("block_id", mentions.lower_tokens(F.col("text")).alias("tokens"))
    return relevance.document_frequencies(rows, "block_id", "tokens", 5)


@query(f"WITH {TOKENS}, g AS (SELECT block_id, unnest(list_distinct(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])))) AS term FROM toks) SELECT term, count(*) AS df FROM g GROUP BY term HAVING count(*) >= 5")
def clf2_pair_vocabulary(spark, d):
    rows = blocks(spark, d).select("block_id", mentions.lower_tokens(F.col("text")).alias("tokens"))
    return relevance.document_frequencies(rows.select("block_id", relevance.with_pairs(F.col("tokens")).alias("terms")), "block_id", "terms", 5)


@query(f"WITH {TOKENS} SELECT block_id FROM toks WHERE len(list_filter(range(1, len(t) + 1), lambda i: l[i] IN {quoted(TERMS)} AND list_contains(l[greatest(1, i - 20):least(len(t), i + 19)], 'the'))) > 0")
def clf3_candidates(spark, d):
    return blocks(spark, d).filter(F.array_contains(F.transform(mentions.context(F.col("text"), TERMS, 20), F.lower), "the")).select("block_id")


@query(f"WITH {TOKENS}, g AS (SELECT block_id, unnest(l) AS term FROM toks), c AS (SELECT block_id, term, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2) SELECT block_id, term, tf, round(tf * ln(((SELECT count(*) FROM blocks) + 1.0) / (df + 1)), 6) AS tfidf FROM c JOIN f USING (term)")
def clf7_tfidf(spark, d):
    rows = blocks(spark, d).select("block_id", mentions.lower_tokens(F.col("text")).alias("tokens"))
    return relevance.tf_idf(rows, "block_id", "tokens").withColumn("tfidf", F.round("tfidf", 6))


JUDGED = COUNTED + ", " + LABELS + ", m AS (SELECT DISTINCT link, text_id, word_type, label FROM marks), j AS (SELECT c.*, m.word_type, m.label, (block_id % 10) / 10.0 AS score FROM counted c LEFT JOIN m USING (link, text_id)), r AS (SELECT *, " + ", ".join(f"CASE WHEN label IS NOT NULL THEN label = 0 ELSE {n}_count > 0 AND score < 0.5 END AS relevant_{n}" for n in FAMILIES) + " FROM j)"


def judged(spark, d):
    rows = relevance.with_labels(counted(spark, d), labels(spark, d)).withColumn("score", (F.col("block_id") % 10) / 10.0)
    for n in FAMILIES:
        rows = rows.withColumn(f"relevant_{n}", relevance.relevant(F.col("label"), F.col(f"{n}_count"), F.col("score")))
    return rows


@query(f"WITH {JUDGED} SELECT block_id, word_type, label FROM j")
def clf13_label_fanout(spark, d):
    return judged(spark, d).select("block_id", "word_type", "label")


@query(f"WITH {JUDGED} SELECT block_id, word_type, {', '.join(f'relevant_{n}' for n in FAMILIES)} FROM r")
def clf14_relevance_rule(spark, d):
    return judged(spark, d).select("block_id", "word_type", *[f"relevant_{n}" for n in FAMILIES])


@query(f"WITH {JUDGED} SELECT block_id, word_type FROM r WHERE relevant_first OR relevant_second OR third_count > 0")
def clf15_is_relevant(spark, d):
    return judged(spark, d).filter("relevant_first or relevant_second or third_count > 0").select("block_id", "word_type")


@query(f"WITH {JUDGED} SELECT {', '.join(f'count(*) FILTER (relevant_{n}) AS {n}_blocks' for n in FAMILIES)} FROM r")
def clf16_bool_sums(spark, d):
    return judged(spark, d).agg(*[F.count_if(F.col(f"relevant_{n}")).alias(f"{n}_blocks") for n in FAMILIES])


@query(f"WITH {BLOCKS}, {LABELS} SELECT block_id, md5(left(text, 500)) AS start_md5 FROM blocks JOIN labels0 USING (link, text_id) WHERE label = 1")
def clf17_removed_texts(spark, d):
    rows = relevance.label_join(blocks(spark, d), labels(spark, d).filter("word_type <> 'third'")).filter("label = 1")
    return rows.select("block_id", F.md5(F.substring("text", 1, 500).cast("binary")).alias("start_md5"))


@query(f"WITH {JUDGED} SELECT CAST(least(floor(score / 0.1), 9) AS BIGINT) AS bin, count(*) AS n FROM (SELECT round(score, 6) AS score FROM j) GROUP BY 1")
def clf18_score_histogram(spark, d):
    return quality.histogram(judged(spark, d).withColumn("score", F.round("score", 6)), "score", 0.0, 1.0, 10)


MODELLED = ("first", "second")


def with_features(rows, *kept):
    """Analysis tokens of the texts and of a context for each of the two families that have models."""
    text = F.col("text")
    near = [analysis_terms(mentions.context(text, FAMILIES[f], 20), STOP_WORDS).alias(f"context_{f}") for f in MODELLED]
    return rows.select(*kept, analysis_tokens(text, STOP_WORDS).alias("tokens"), *near)


def training_rows(spark, d):
    """All labelled blocks; only their texts are taken apart."""
    marks = labels(spark, d).filter(F.col("word_type").isin(*MODELLED) & F.col("label").isin(0, 1))
    return with_features(relevance.label_join(blocks(spark, d), marks).repartition("block_id"), "block_id", "label", "word_type")


def family_models(spark, d):
    return relevance.family_machines(training_rows(spark, d), {f: f"context_{f}" for f in MODELLED})


@query()
def clf9_platt(spark, d):
    """Labelled blocks by the machine and sigmoid of the fold that left them out."""
    return family_models(spark, d)[1]


@query()
def clf10_cv_metrics(spark, d):
    return relevance.cross_validate(training_rows(spark, d))


@query(f"""WITH {COUNTED}, {LABELS}, s AS (SELECT word_type, label, 1 - first_count / (first_count + 2.0) AS score FROM counted JOIN marks USING (link, text_id)),
n AS (SELECT *, count(*) FILTER (label = 0) OVER (PARTITION BY word_type ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) FILTER (label = 0) OVER (PARTITION BY word_type, score) AS level FROM s),
c AS (SELECT word_type, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n, count(*) FILTER (label = 1 AND score > 0.5) AS hit, count(*) FILTER (label = 0 AND score > 0.5) AS wrong, sum(upto - level / 2) FILTER (label = 1) AS wins FROM n GROUP BY word_type)
SELECT word_type, round((hit + n - wrong) / (p + n), 6) AS accuracy, round(coalesce(hit / nullif(hit + wrong, 0), 0), 6) AS precision, round(coalesce(hit / nullif(p, 0), 0), 6) AS recall,
round(coalesce(2 * hit / nullif(hit + wrong + p, 0), 0), 6) AS f1, round(wins / nullif(p * n, 0), 6) AS roc_auc FROM c""")
def clf10_rank_metrics(spark, d):
    """How well the absence of mentions alone tells irrelevant blocks."""
    rows = relevance.label_join(counted(spark, d), labels(spark, d)).withColumn("score", 1 - F.col("first_count") / (F.col("first_count") + 2.0))
    out = relevance.rank_metrics(rows, by="word_type")
    return out.select("word_type", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@query()
def clf11_family_models(spark, d):
    """The machines of each family: every term's idf and its weight in each fold."""
    out = None
    for family, model in family_models(spark, d)[0].items():
        table = model.machines.table(spark).withColumn("word_type", F.lit(family))
        out = table if out is None else out.unionByName(table)
    return out.select("word_type", "part", "term", "idf", "weights")


@query()
def clf12_scores(spark, d):
    """All blocks by the model of each family."""
    joint, _ = relevance.joint_machines(training_rows(spark, d), {f: f"context_{f}" for f in MODELLED})
    return joint.score(with_features(blocks(spark, d), "block_id"), [f"score_{f}" for f in MODELLED], ["block_id"])


# passages and terms


def passage_rows(spark, d):
    return terms.passages(blocks(spark, d), TERMS, ["block_id"])


DICT = "(SELECT word, CASE WHEN n >= 100 THEN 'NOUN' ELSE 'ADJ' END AS pos FROM words WHERE n >= 10)"
PASSAGES = TOKENS + f""", ends AS (SELECT *, list_filter(range(1, len(t) + 1), lambda i: t[i] IN ('.', '!', '?')) AS e FROM toks),
hits AS (SELECT block_id, t, e, unnest(list_filter(range(1, len(t) + 1), lambda i: l[i] IN {quoted(TERMS)})) AS i FROM ends),
sent AS (SELECT block_id, t, i - 1 AS hit, coalesce(list_max(list_filter(e, lambda x: x < i)), 0) AS a, coalesce(list_min(list_filter(e, lambda x: x >= i)), len(t)) AS b, greatest(0, i - 11) AS lo, least(len(t), i + 9) AS hi FROM hits),
passages AS (SELECT block_id, hit, CASE WHEN b - a > hi - lo THEN t[lo + 1:hi] ELSE t[a + 1:b] END AS w FROM sent)"""


@query(f"WITH {PASSAGES} SELECT block_id, CAST(hit AS BIGINT) AS hit, array_to_string(w, ' ') AS passage FROM passages")
def wcl4_passages(spark, d):
    return passage_rows(spark, d).select("block_id", F.col("hit").cast("long").alias("hit"), F.array_join("words", " ").alias("passage"))


def lexicon(spark, d):
    return words(spark, d).filter("n >= 10").select("word", F.when(F.col("n") >= 100, "NOUN").otherwise("ADJ").alias("pos"))


SPLIT = PASSAGES + ", " + WORDS + f", d AS {DICT}, s AS (SELECT lower(x) AS word FROM (SELECT unnest(w) AS x FROM passages)), split AS (SELECT s.word, count(*) AS n, any_value(d.pos) AS pos FROM s LEFT JOIN d USING (word) WHERE length(s.word) > 2 AND s.word NOT IN ('with') GROUP BY s.word)"


@query(f"WITH {SPLIT} SELECT word, n, pos, pos IS NOT NULL AS known FROM split")
def wcl6_dictionary_split(spark, d):
    return terms.dictionary_split(passage_rows(spark, d), lexicon(spark, d), ("with",))


FILTERED = PASSAGES + ", " + WORDS + f""", d AS {DICT}, s AS (SELECT block_id, hit, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM passages),
kept AS (SELECT block_id, hit, list(x ORDER BY k) AS w FROM s JOIN d ON lower(x) = d.word WHERE lower(x) NOT IN {quoted(STOP_WORDS)} GROUP BY block_id, hit),
grams AS (SELECT unnest(list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM kept WHERE len(w) > 3)"""


def grams(spark, d):
    return terms.passage_ngrams(terms.filtered_words(passage_rows(spark, d), ["block_id", "hit"], lexicon(spark, d), STOP_WORDS))


@query(f"WITH {FILTERED} SELECT gram, count(*) AS n FROM grams GROUP BY gram")
def wcl8_filtered_ngrams(spark, d):
    return grams(spark, d).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FILTERED} SELECT gram AS term, count(*) AS n FROM grams GROUP BY gram HAVING count(*) > 1")
def wcl9_ngram_counts(spark, d):
    return terms.ngram_counts(grams(spark, d))


UNI = f"SELECT word AS term, CAST(n AS BIGINT) AS n FROM split WHERE pos IN ('NOUN', 'ADJ') AND word NOT IN {quoted(STOP_WORDS)} AND length(word) > 1"


@query(f"WITH {SPLIT} {UNI}")
def wcl10_unigram_counts(spark, d):
    return terms.unigram_counts(terms.dictionary_split(passage_rows(spark, d), lexicon(spark, d), ("with",)), STOP_WORDS)


MERGED = FILTERED + ", split0 AS (SELECT lower(x) AS word FROM s), split AS (SELECT a.word, count(*) AS n, any_value(d.pos) AS pos FROM split0 a LEFT JOIN d USING (word) WHERE length(a.word) > 2 AND a.word NOT IN ('with') GROUP BY a.word), u AS (" + UNI + "), g AS (SELECT gram AS term, count(*) AS n FROM grams GROUP BY gram HAVING count(*) > 1), merged AS (SELECT coalesce(u.term, g.term) AS term, coalesce(g.n, u.n) AS n FROM u FULL JOIN g ON u.term = g.term WHERE coalesce(u.term, g.term) NOT IN ('from', 'nicht'))"


def merged(spark, d):
    unigrams = terms.unigram_counts(terms.dictionary_split(passage_rows(spark, d), lexicon(spark, d), ("with",)), STOP_WORDS)
    return terms.merge_terms(unigrams, terms.ngram_counts(grams(spark, d)), spark.createDataFrame([("from",), ("nicht",)], "term string"))


@query(f"WITH {MERGED} SELECT term, n FROM merged")
def wcl11_merge_exclude(spark, d):
    return merged(spark, d)


@query(f"WITH {MERGED} SELECT term, n FROM merged ORDER BY n DESC, term LIMIT 100")
def wcl13_top100(spark, d):
    return terms.top_terms(merged(spark, d))


@query(f"WITH {TOKENS}, x AS (SELECT unnest(l) AS term FROM toks) SELECT term, count(*) AS n FROM x WHERE term NOT IN {quoted(STOP_WORDS)} AND term NOT IN {quoted(FAMILIES['first'])} AND length(term) >= 2 AND instr('.,;:!?()[]{{}}\"''`~@#$%^&*+=-_<>|\\', term) = 0 GROUP BY term")
def wcl1_term_frequencies(spark, d):
    return terms.term_frequencies(blocks(spark, d), "text", STOP_WORDS, FAMILIES["first"])


@query(f"WITH {COUNTED} SELECT block_id FROM counted WHERE first_count > 0 OR third_count > 0")
def wcl2_select(spark, d):
    return counted(spark, d).filter("first_count > 0 or third_count > 0").select("block_id")


# sources


@query(f"WITH {BLOCKS} SELECT block_id, date, 'https://chroniclingamerica.loc.gov/lccn/' || title || '/' || date || '/ed-1/seq-' || block_idx || '/' AS link FROM blocks")
def src5_path_fields(spark, d):
    path = F.concat_ws("/", F.lit("data"), "title", F.replace("date", F.lit("-"), F.lit("/")), F.lit("ed-1"), F.concat(F.lit("seq-"), "block_idx"), F.lit("ocr.xml"))
    p = sources.path_fields(path)
    return blocks(spark, d).select("block_id", p["date"].alias("date"), p["link"].alias("link"))


@query(f"WITH {BLOCKS}, {LABELS} SELECT text_id FROM blocks WHERE text_id NOT IN (SELECT text_id FROM marks)")
def src6_incremental_antijoin(spark, d):
    return sources.unprocessed(blocks(spark, d).select("text_id"), labels(spark, d), "text_id")


@query("SELECT DISTINCT source AS batch, 'wget https://chroniclingamerica.loc.gov/lccn/' || source || '.tar.bz2 && tar -xjf ' || source || '.tar.bz2' AS command FROM documents")
def src11_download_plan(spark, d):
    return sources.download_plan(spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("batch")))


@query(f"WITH {BLOCKS}, {LABELS} SELECT count(*) AS n_files, count(*) FILTER (text_id IN (SELECT text_id FROM marks)) AS n_done, round(count(*) FILTER (text_id IN (SELECT text_id FROM marks)) / count(*), 6) AS coverage FROM blocks")
def glu4_coverage(spark, d):
    return sources.coverage(blocks(spark, d), labels(spark, d), "text_id").withColumn("coverage", F.round("coverage", 6))
