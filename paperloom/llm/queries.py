"""Queries over the test tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .storage import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a machine trained on the labels that aren't held out."""
    from .toxicity import score, train

    docs = documents(spark, sf_dir)
    return score(docs, train(docs, tables(spark, sf_dir, "labels")))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more."""
    from .ngram_join import similarity_classes

    return similarity_classes(documents(spark, sf_dir), words=4, percent=85)


def op3_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, with weak candidates where complementary parts lie beside them."""
    from .secrets import secret_report

    return secret_report(documents(spark, sf_dir))


def op4_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a mixture of the sources, none passed over more than twice, holds each document."""
    from pyspark.sql import functions as F

    from .mixing import mix

    mixed = mix(documents(spark, sf_dir), ["doc_id", "source"], max_repetition=2.0)
    return mixed.select("doc.doc_id", "doc.source", "n_tokens", F.round("weight", 6).alias("weight"), F.col("copies").cast("long").alias("copies"))


OP4_SQL = """
WITH RECURSIVE rows_ AS (
  SELECT doc_id, source, coalesce(source, chr(3)) AS src,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_tokens,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw
  FROM documents),
totals AS (SELECT src, sum(n_tokens) AS tokens, count(*) AS n_rows FROM rows_ GROUP BY src),
shares AS (SELECT src, tokens, n_rows, tokens / (SELECT sum(tokens) FROM totals)::DOUBLE AS p FROM totals),
ends AS (SELECT min(p) FILTER (p > 0) AS least, max(p) AS top FROM shares),
halves(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT k + 1, CASE WHEN pow(least / top, (low + high) / 2 - 1) > 2.0 THEN (low + high) / 2 ELSE low END,
         CASE WHEN pow(least / top, (low + high) / 2 - 1) > 2.0 THEN high ELSE (low + high) / 2 END
  FROM halves, ends WHERE k < 50),
fitted AS (SELECT high AS a FROM halves WHERE k = 50),
quotas AS (
  SELECT src, tokens, n_rows, CASE WHEN p > 0 THEN pow(p, a) / (SELECT sum(pow(p, a)) FROM shares, fitted WHERE p > 0) ELSE 0 END AS weight,
         CASE WHEN p > 0 THEN floor(tokens * round(pow(p / top, a - 1), 6))::BIGINT ELSE 0 END AS quota
  FROM shares, ends, fitted),
split AS (
  SELECT src, n_rows, weight, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest
  FROM quotas),
dealt AS (
  SELECT r.*, s.weight, s.passes, s.rest,
         CASE WHEN s.rest > 0 THEN CAST('0x' || substr(draw, 1, 8) AS BIGINT) % CAST(ceil(s.n_rows / 1000.0) AS BIGINT) ELSE 0 END AS block
  FROM rows_ r JOIN split s USING (src)),
blocks AS (
  SELECT src, block, any_value(rest) AS rest, sum(n_tokens) AS block_tokens FROM dealt WHERE rest > 0 GROUP BY src, block),
along AS (
  SELECT src, block, block_tokens, rest,
         sum(block_tokens) OVER (PARTITION BY src ORDER BY md5('mix:' || src || ':' || CAST(block AS VARCHAR)), block ROWS UNBOUNDED PRECEDING) - block_tokens AS before
  FROM blocks),
marked AS (
  SELECT d.*, b.before, b.before + b.block_tokens <= d.rest AS whole, b.before < d.rest AS begun,
         sum(n_tokens) OVER (PARTITION BY d.src, d.block ORDER BY d.draw ROWS UNBOUNDED PRECEDING) AS inside
  FROM dealt d LEFT JOIN along b ON d.src = b.src AND d.block = b.block)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, round(weight, 6) AS weight,
       CAST(passes + CASE WHEN rest = 0 OR NOT begun THEN 0 WHEN whole THEN 1 WHEN before + inside <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM marked
"""


def op5_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand on six or more sources; as in its SQL, texts that are mostly such lines stay whole."""
    from pyspark.sql import functions as F

    from .line_spread import remove_widespread

    cleaned = remove_widespread(documents(spark, sf_dir), ["doc_id"], most=0.5)
    return cleaned.select("doc.doc_id", "n_lines", "n_wide", "n_removed", F.length("cleaned").cast("long").alias("n_chars"), F.md5(F.col("cleaned").cast("binary")).alias("text_md5"))


OP5_SQL = """
WITH parts AS (
  SELECT doc_id, source, text, coalesce(string_split(text, chr(10)), []) AS xs FROM documents),
lines AS (
  SELECT DISTINCT coalesce(source, chr(3)) AS site, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT source, unnest(xs) AS x FROM parts)),
wide AS (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(*) >= 6),
tagged AS (
  SELECT row_number() OVER () AS r, doc_id, text, xs FROM parts),
exploded AS (
  SELECT r, unnest(xs) AS x, generate_subscripts(xs, 1) AS k FROM tagged),
judged AS (
  SELECT e.r, e.k, e.x, w.line IS NOT NULL AS w, trim(e.x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' AS worded
  FROM exploded e LEFT JOIN wide w ON trim(e.x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = w.line),
summed AS (
  SELECT r, count(*) FILTER (worded) AS n_lines, count(*) FILTER (w) AS n_wide,
         coalesce(sum(length(x)) FILTER (w), 0) AS wide_chars, sum(length(x)) AS chars,
         coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (NOT w), '') AS rest
  FROM judged GROUP BY r),
final AS (
  SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_wide, 0) AS n_wide,
         coalesce(n_wide > 0 AND wide_chars <= 0.5 * chars, false) AS goes, text, rest
  FROM tagged t LEFT JOIN summed s USING (r))
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_wide AS BIGINT) AS n_wide, CAST(CASE WHEN goes THEN n_wide ELSE 0 END AS BIGINT) AS n_removed,
       CAST(length(CASE WHEN goes THEN rest ELSE text END) AS BIGINT) AS n_chars, md5(CASE WHEN goes THEN rest ELSE text END) AS text_md5
FROM final
"""


#: Fixed values of the URL contract.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op6_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL: fixed rules, else rules mined from the labels of the pages' ids (quality 0 is bad)."""
    from pyspark.sql import functions as F

    from .url_rules import Rule, judge

    labels = tables(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(tables(spark, sf_dir, "pages").select("page_id", "url"), labels, [Rule(*r) for r in URL_RULES])


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' bytes stored in MPEG frames and read back."""
    from .mpeg_audio import audio_report

    return audio_report(documents(spark, sf_dir))


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by an additive model with pairs, trained on the labels that aren't held out."""
    from .gam_quality import quality

    return quality(documents(spark, sf_dir), tables(spark, sf_dir, "labels"))


def op9_robust_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word, symbol and repetition counts of all documents, the base rules and the robust outlier verdict."""
    from .robust_rules import quality_rules

    judged = quality_rules(documents(spark, sf_dir), ["doc_id"])
    counts = [f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc.doc_id", *counts, "base_failed", "kept", "away")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed best-fit-decreasing into sequences of 1024 tokens."""
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words in windows of 13 that a document with a smaller id holds."""
    from pyspark.sql import functions as F

    from .substring_index import remove_repeats

    cleaned = remove_repeats(documents(spark, sf_dir), ["doc_id"])
    return cleaned.select("doc.doc_id", "n_words", "n_removed", F.sha2(F.col("cleaned").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, id, k, array_to_string(w[k:k + 12], ' ') AS win FROM (SELECT r, id, w, unnest(range(1, len(w) - 11)) AS k FROM texts)),
least AS (SELECT win, min(id) AS first FROM windows GROUP BY win HAVING min(id) < max(id)),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 13)) AS k FROM windows JOIN least USING (win) WHERE first < id),
placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM texts),
kept AS (SELECT p.r, string_agg(word, ' ' ORDER BY p.k) AS said, count(*) AS n FROM placed p ANTI JOIN gone g ON p.r = g.r AND p.k = g.k GROUP BY p.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of all for each benchmark item."""
    from .ranked_search import ranked_search

    return ranked_search(documents(spark, sf_dir), tables(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
asked AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
item_terms AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM asked) GROUP BY ALL),
totals AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM texts),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM texts) WHERE term IN (SELECT term FROM item_terms) GROUP BY r, term),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM counts, totals GROUP BY term, n_docs),
sized AS (SELECT r, doc_id, 100 - 25 + (25 * len(t) * n_docs) // n_terms AS m FROM texts, totals WHERE len(t) > 0),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM item_terms JOIN counts USING (term) JOIN weighed USING (term) JOIN sized USING (r) GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after the contract's damage: faults, the cheapest repair's edits and a hash of its turns."""
    from .turn_repair import damage, edits, report

    return report(edits(damage(tables(spark, sf_dir, "conversations"))))


OP13_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS named
  FROM conversations),
drawn AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(named) + 1), lambda i: ascii(substr(named, i, 1))::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END))) % 20 AS kind
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS again
  FROM drawn WHERE kind <> 0),
numbered_ AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth FROM damaged),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS k,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM numbered_),
judged AS (
  SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM placed),
priced AS (
  SELECT conv, k, initial = 's' AND stays AS as_s, stays,
         CASE WHEN initial = 'u' THEN 0 ELSE 2 END + extra AS cu, CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END AS lu,
         CASE WHEN initial = 'a' THEN 0 ELSE 2 END + extra AS ca, CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END AS la, extra
  FROM (SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM judged)),
walk(conv, k, o, s, u, a) AS (
  SELECT DISTINCT conv, 0::BIGINT, {'c': 0, 'e': ''}, {'c': 1000000, 'e': ''}, {'c': 1000000, 'e': ''}, {'c': 1000000, 'e': ''} FROM priced
  UNION ALL
  SELECT w.conv, w.k + 1, {'c': o.c + 3, 'e': o.e || 'D'},
         list_sort([{'c': s.c + 3, 'e': s.e || 'D'}, {'c': CASE WHEN as_s THEN o.c + extra ELSE 1000000 END, 'e': o.e || 'K'}])[1],
         list_sort(list_concat([{'c': u.c + 3, 'e': u.e || 'D'}], CASE WHEN stays THEN [{'c': o.c + cu, 'e': o.e || lu}, {'c': s.c + cu, 'e': s.e || lu}, {'c': a.c + cu, 'e': a.e || lu}, {'c': u.c + 2 + cu, 'e': u.e || 'I' || lu}] ELSE [] END))[1],
         list_sort(list_concat([{'c': a.c + 3, 'e': a.e || 'D'}], CASE WHEN stays THEN [{'c': u.c + ca, 'e': u.e || la}, {'c': o.c + 2 + ca, 'e': o.e || 'I' || la}, {'c': s.c + 2 + ca, 'e': s.e || 'I' || la}, {'c': a.c + 2 + ca, 'e': a.e || 'I' || la}] ELSE [] END))[1]
  FROM walk w JOIN priced p ON p.conv = w.conv AND p.k = w.k + 1),
ended AS (
  SELECT conv, list_sort([o, a, {'c': u.c + 2, 'e': u.e || 'I'}, {'c': s.c + 4, 'e': s.e || 'II'}])[1] AS best
  FROM walk JOIN (SELECT conv, max(k) AS k FROM priced GROUP BY conv) USING (conv, k)),
letters AS (SELECT conv, best.e AS audit, unnest(range(1, length(best.e) + 1)) AS p FROM ended),
numbered AS (
  SELECT conv, p, substr(audit, p, 1) AS letter, length(replace(left(audit, p), 'I', '')) AS k, length(replace(left(audit, p), 'D', '')) AS j
  FROM letters),
stayed AS (
  SELECT n.conv, p, letter, n.j, r.role, r.text, bool_or(letter = 'K' AND n.j = 1 AND r.initial = 's') OVER (PARTITION BY n.conv) AS led
  FROM numbered n LEFT JOIN judged r ON r.conv = n.conv AND r.k = n.k WHERE letter <> 'D'),
written AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
  FROM stayed GROUP BY conv),
counted AS (
  SELECT conv, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (ahead IS NOT NULL AND ahead || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv ORDER BY k) AS ahead FROM judged) GROUP BY conv)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended USING (conv) LEFT JOIN written USING (conv)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_subsequence_toxicity": op1_subsequence_toxicity,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_secret_linking": op3_secret_linking,
        "op4_temperature_mixing": op4_temperature_mixing,
        "op5_line_site_spread": op5_line_site_spread,
        "op6_association_url_filter": op6_association_url_filter,
        "op7_mpeg_audio": op7_mpeg_audio,
        "op8_additive_quality": op8_additive_quality,
        "op9_robust_quality_rules": op9_robust_quality_rules,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_ranked_search": op12_ranked_search,
        "op13_conversation_repair": op13_conversation_repair,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_temperature_mixing": OP4_SQL,
        "op5_line_site_spread": OP5_SQL,
        "op11_substring_dedup": OP11_SQL,
        "op12_ranked_search": OP12_SQL,
        "op13_conversation_repair": OP13_SQL,
    }
