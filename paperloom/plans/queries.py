"""Queries over the test tables, one or more per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..operators import alto, correct, mentions
from ..operators.scripts import small_batches
from .adapter import BLOCKS, FAMILIES, STOP_WORDS, WORDS, blocks, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "agg4_year_title_mentions"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def quoted(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


RX = r"([\p{L}\p{N}](?:[^\s]*[\p{L}\p{N}])?|[^\s\p{L}\p{N}])(\s*)"
TOKENS = BLOCKS + f", toks AS (SELECT *, regexp_extract_all(text, '{RX}', 1) AS t, list_transform(regexp_extract_all(text, '{RX}', 1), lambda x: lower(x)) AS l FROM blocks)"
COUNTS = ", ".join(f"CAST(len(list_filter(l, lambda x: x IN {quoted(w)})) AS BIGINT) AS {n}_count" for n, w in FAMILIES.items())
COUNTED = TOKENS + f", counted AS (SELECT block_id, link, block_idx, year, title, date, text_id, {COUNTS}, CAST(len(t) AS BIGINT) AS doc_length FROM toks)"
TERMS = mentions.all_terms(FAMILIES)
MEASURES = [f"{n}_count" for n in FAMILIES]
SPREAD = TOKENS + ", spread AS (SELECT block_id, unnest(t) AS token FROM toks), distinct_tokens AS (SELECT DISTINCT token FROM spread)"


def distinct_tokens(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select(F.explode(K.token_texts(F.col("text"))).alias("token")).distinct()


def counted(spark: SparkSession, d: str) -> DataFrame:
    return mentions.with_counts(blocks(spark, d), FAMILIES)


# text

STEPS = {
    "txt2_nbsp": (T.plain_spaces, "translate({x}, chr(160) || chr(8199) || chr(8239), '   ')"),
    "txt3_hyphen_linebreak": (T.join_broken_words, "regexp_replace({x}, '([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{{2,}})-\\s*\\n\\s*([A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{{2,}})', '\\1\\2', 'g')"),
    "txt4_trim_line_ends": (T.trim_line_ends, "regexp_replace({x}, '[ \\t]*\\n[ \\t]*', chr(10), 'g')"),
    "txt6_multi_punct": (T.single_marks, "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, ',{{2,}}', ',', 'g'), ';{{2,}}', ';', 'g'), ':{{2,}}', ':', 'g'), '!{{2,}}', '!', 'g'), '[?]{{2,}}', '?', 'g')"),
    "txt7_multi_dot": (T.ellipses, "regexp_replace({x}, '\\.{{4,}}', '...', 'g')"),
    "txt8_multi_dash": (T.long_dashes, "regexp_replace({x}, '[-\\x{{2010}}-\\x{{2014}}]{{3,}}', '—', 'g')"),
    "txt9_multi_underscore": (T.single_underscores, "regexp_replace({x}, '_{{3,}}', '_', 'g')"),
    "txt10_multi_space": (T.single_spaces, "regexp_replace({x}, '[ \\t]+', ' ', 'g')"),
    "txt11_13_punct_spacing": (T.close_up, "regexp_replace(regexp_replace(regexp_replace({x}, '\\s+([,;:.!?])', '\\1', 'g'), '([(\\[{{])\\s+', '\\1', 'g'), '\\s+([)\\]}}])', '\\1', 'g')"),
    "txt14_strip": (T.strip, "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"),
    "txt15_lower": (F.lower, "lower({x})"),
}
#: Lines that hold what the documents lack.
ODD = ("Guer-\n ra,,  hola !!!! ( x ) ....... ----- ____", "a b c", "  [ y ] ;; ?? ", "uno -\n dos", "Tres--- cuatro___ cinco....")
ODD_SQL = "(VALUES " + ", ".join("(" + str(-1 - k) + ", '" + x.replace("\n", "' || chr(10) || '") + "')" for k, x in enumerate(ODD)) + ") o(doc_id, text)"


def odd_texts(spark: SparkSession, d: str) -> DataFrame:
    """All documents and the lines in ODD."""
    odd = spark.createDataFrame([(-1 - k, x) for k, x in enumerate(ODD)], "doc_id long, text string")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").unionByName(odd)


ODD_ROWS = f"rows_ AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {ODD_SQL})"


def _register_steps() -> None:
    for name, (step, sql) in STEPS.items():
        QUERIES[name] = lambda spark, d, step=step: odd_texts(spark, d).select("doc_id", F.md5(step(F.col("text")).cast("binary")).alias("text_md5"))
        SQL[name] = f"WITH {ODD_ROWS} SELECT doc_id, md5({sql.format(x='text')}) AS text_md5 FROM rows_"
    chain = "text"
    for name in ("txt2_nbsp", "txt3_hyphen_linebreak", "txt4_trim_line_ends"):
        chain = STEPS[name][1].format(x=chain)
    chain = f"replace({chain}, chr(10), ' ')"
    for name in ("txt6_multi_punct", "txt7_multi_dot", "txt8_multi_dash", "txt9_multi_underscore", "txt10_multi_space", "txt11_13_punct_spacing", "txt14_strip"):
        chain = STEPS[name][1].format(x=chain)
    QUERIES["txt_preclean_full"] = lambda spark, d: odd_texts(spark, d).select("doc_id", F.md5(T.preclean(F.col("text")).cast("binary")).alias("text_md5"))
    SQL["txt_preclean_full"] = f"WITH {ODD_ROWS} SELECT doc_id, md5({chain}) AS text_md5 FROM rows_"


_register_steps()


@query(f"WITH {ODD_ROWS} SELECT doc_id, md5(nfc_normalize(text)) AS text_md5 FROM rows_")
def txt1_nfc(spark, d):
    return small_batches(odd_texts(spark, d)).select("doc_id", F.md5(T.nfc(F.col("text")).cast("binary")).alias("text_md5"))


@query(f"WITH {ODD_ROWS} SELECT doc_id, md5(replace(replace(replace(text, '(jibar', 'gibar'), chr(10), ' '), '-', '')) AS text_md5 FROM rows_")
def txt16_literal_replaces(spark, d):
    text = F.col("text")
    for a, b in (("(jibar", "gibar"), ("\n", " "), ("-", "")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return odd_texts(spark, d).select("doc_id", F.md5(text.cast("binary")).alias("text_md5"))


@query(f"WITH {BLOCKS} SELECT block_id, CAST(length(text) AS BIGINT) AS n_chars FROM blocks WHERE length(text) > 20")
def txt18_min_length(spark, d):
    return blocks(spark, d).filter(F.length("text") > 20).select("block_id", F.length("text").cast("long").alias("n_chars"))


# tokens


@query(f"WITH {WORDS} SELECT word, n FROM words")
def tok1_word_counts(spark, d):
    return words(spark, d)


@query(f"WITH {TOKENS} SELECT block_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM toks")
def tok2_token_counts(spark, d):
    t = K.token_texts(F.col("text"))
    return blocks(spark, d).select("block_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


@query(f"WITH {BLOCKS} SELECT block_id, true AS lossless FROM blocks")
def tok3_lossless(spark, d):
    return blocks(spark, d).select("block_id", (correct.rebuilt(F.col("text"), K.tokens(F.col("text"))) == F.col("text")).alias("lossless"))


MARKS = "'.,;:!?()[]{}\"''`~@#$%^&*+=-_<>|\\'"


@query(f"WITH {TOKENS}, kept AS (SELECT block_id, list_filter(l, lambda x: x NOT IN {quoted(STOP_WORDS)} AND instr({MARKS}, x) = 0 AND regexp_full_match(x, '\\p{{L}}+') AND length(x) > 1) AS a FROM toks) SELECT block_id, CAST(len(a) AS BIGINT) AS n_kept, md5(array_to_string(a, ' ')) AS kept_md5 FROM kept")
def tok4_analysis_tokens(spark, d):
    a = K.analysis_tokens(F.col("text"), STOP_WORDS)
    return blocks(spark, d).select("block_id", F.size(a).cast("long").alias("n_kept"), F.md5(F.array_join(a, " ").cast("binary")).alias("kept_md5"))


@query(f"WITH {SPREAD} SELECT token, regexp_matches(token, '\\p{{L}}') AS has_letter, round(length(regexp_replace(token, '[^\\p{{L}}]', '', 'g')) / length(token), 6) AS ratio FROM distinct_tokens")
def tok6_alpha_ratio(spark, d):
    return distinct_tokens(spark, d).select("token", F.col("token").rlike(r"\p{L}").alias("has_letter"), F.round(K.alpha_ratio(F.col("token")), 6).alias("ratio"))


AFFIX = r"(?s)^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$"


@query(f"WITH {SPREAD} SELECT '(' || token || '),' AS token, regexp_extract('(' || token || '),', '{AFFIX}', 1) AS head, regexp_extract('(' || token || '),', '{AFFIX}', 2) AS core, regexp_extract('(' || token || '),', '{AFFIX}', 3) AS tail FROM distinct_tokens")
def tok7_strip_affixes(spark, d):
    t = F.concat(F.lit("("), "token", F.lit("),"))
    return distinct_tokens(spark, d).select(t.alias("token"), *[K.affix(t, k).alias(n) for k, n in enumerate(("head", "core", "tail"), 1)])


@query(f"WITH {SPREAD} SELECT ',' || token || '.' AS token, lower(regexp_replace(',' || token || '.', '^[,.;:!?]+|[,.;:!?]+$', '', 'g')) AS normed FROM distinct_tokens")
def tok8_norm_token(spark, d):
    t = F.concat(F.lit(","), "token", F.lit("."))
    return distinct_tokens(spark, d).select(t.alias("token"), K.norm_token(t).alias("normed"))


UPPER = r"(regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '\p{{Ll}}'))"
PROTECTED = "(regexp_full_match({x}, '[^\\p{{L}}\\p{{N}}]*') OR regexp_full_match({x}, '[+-]?[0-9]+([.,/][0-9]+)*') OR length({x}) <= 2 OR (" + UPPER + " AND length({x}) <= 4))"
# a title: no lower-case letter at the start of a run of letters, no capital within one
TITLE = r"(regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '(^|[^\p{{L}}])\p{{Ll}}|\p{{L}}\p{{Lu}}'))"


@query(f"WITH {SPREAD} SELECT token, {PROTECTED.format(x='token')} AS protected FROM distinct_tokens")
def tok9_protected(spark, d):
    return distinct_tokens(spark, d).select("token", K.is_protected(F.col("token")).alias("protected"))


SUSPECT = f"""CASE WHEN {PROTECTED} OR length({{x}}) < 3 THEN false
  WHEN regexp_matches({{x}}, '\\p{{{{Lu}}}}') AND regexp_matches({{x}}, '\\p{{{{Ll}}}}') AND NOT {TITLE} AND NOT regexp_full_match({{x}}, '\\p{{{{Lu}}}}[^\\p{{{{Lu}}}}]*') THEN true
  WHEN NOT regexp_matches({{x}}, '\\p{{{{L}}}}') THEN false
  WHEN length(regexp_replace({{x}}, '[^\\p{{{{L}}}}]', '', 'g')) / length({{x}}) < 0.6 THEN true
  WHEN known THEN false
  WHEN regexp_matches({{x}}, '\\p{{{{Nd}}}}') THEN true
  WHEN regexp_matches({{x}}, '(?s)^.+[._,:;|/\\\\~].+$') THEN true
  ELSE length({{x}}) >= 15 END"""
KNOWN = SPREAD + ", " + WORDS + ", judged AS (SELECT token, coalesce(w.n >= 10, false) AS known FROM distinct_tokens t LEFT JOIN words w ON lower(t.token) = w.word)"


@query(f"WITH {KNOWN} SELECT token, {SUSPECT.format(x='token')} AS suspect FROM judged")
def tok10_suspects(spark, d):
    known = words(spark, d).select("word", (F.col("n") >= 10).alias("known"))
    t = distinct_tokens(spark, d)
    return t.join(known, F.lower(t.token) == F.col("word"), "left").select("token", K.is_suspect(F.col("token"), F.coalesce("known", F.lit(False))).alias("suspect"))


@query(f"WITH {SPREAD} SELECT token, {UPPER.format(x='token')} AS upper_case, {TITLE.format(x='token')} AS title_case FROM distinct_tokens")
def tok11_casing(spark, d):
    return distinct_tokens(spark, d).select("token", K.is_upper(F.col("token")).alias("upper_case"), K.is_title(F.col("token")).alias("title_case"))


@query(f"WITH {TOKENS}, kept AS (SELECT list_filter(l, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS w FROM toks), grams AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM kept WHERE len(w) > 1) SELECT gram, count(*) AS n FROM grams GROUP BY gram")
def tok12_ngrams(spark, d):
    kept = F.filter(mentions.lower_tokens(F.col("text")), lambda x: x.rlike(r"[\p{L}\p{N}]"))
    return blocks(spark, d).select(F.explode(K.ngrams(kept, 2)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOKENS}, lines AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM blocks), w AS (SELECT line, list_transform(regexp_extract_all(line, '{RX}', 1), lambda x: lower(x)) AS l FROM lines) SELECT md5(line) AS line_md5, len(list_filter(l, lambda x: x NOT IN {quoted(STOP_WORDS)})) = 0 AS all_stop FROM w")
def tok13_all_stop_words(spark, d):
    lines = blocks(spark, d).select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return lines.select(F.md5(F.col("line").cast("binary")).alias("line_md5"), K.all_stop_words(mentions.lower_tokens(F.col("line")), STOP_WORDS).alias("all_stop"))


# page XML

CASES = (("null", None), ("12.9", "12.9"), ("-1.5", "-1.5"), ("7", "7"))


@query("SELECT * FROM (VALUES ('null', 0), ('12.9', 12), ('-1.5', -1), ('7', 7)) v(name, value)")
def alt2_int_attr(spark, d):
    return spark.createDataFrame(CASES, "name string, v string").select("name", alto.int_attr(F.col("v")).cast("long").alias("value"))


#: Lines of ``hy`` (block_id, ls) with those that end in a hyphen joined to the next.
FOLD = """fold(block_id, ls, k, out, held, open) AS (
  SELECT block_id, ls, 1, []::VARCHAR[], NULL::VARCHAR, true FROM hy
  UNION ALL
  SELECT block_id, ls, k + 1,
    CASE WHEN held IS NULL OR (open AND held LIKE '%-' AND regexp_matches(ls[k], '^\\p{L}')) THEN out ELSE list_append(out, held) END,
    CASE WHEN held IS NOT NULL AND open AND held LIKE '%-' AND regexp_matches(ls[k], '^\\p{L}') THEN left(held, -1) || ls[k] ELSE ls[k] END,
    NOT (held IS NOT NULL AND open AND held LIKE '%-' AND regexp_matches(ls[k], '^\\p{L}'))
  FROM fold WHERE k <= len(ls)),
joined AS (SELECT block_id, len(ls) AS n_lines, CASE WHEN held IS NULL THEN out ELSE list_append(out, held) END AS ls FROM fold WHERE k = len(ls) + 1)"""


@query(f"""WITH RECURSIVE {BLOCKS}, hy AS (SELECT block_id, list_filter(list_transform(string_split(replace(text, 'en' || chr(10), 'en-' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM blocks),
{FOLD}
SELECT block_id, md5(array_to_string(ls, chr(10))) AS text_md5 FROM joined""")
def alt7_dehyphenate(spark, d):
    broken = F.replace("text", F.lit("en\n"), F.lit("en-\n"))
    lines = F.filter(F.transform(F.split(broken, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return blocks(spark, d).select("block_id", F.md5(F.array_join(alto.dehyphenate(lines), "\n").cast("binary")).alias("text_md5"))


def xml_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as page XML: a block per document, a line per line, broken at its last space."""
    escaped = F.replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    lines = F.transform(F.split(escaped, "\n"), lambda x, i: F.concat(F.lit('<TextLine VPOS="'), (i * 10).cast("string"), F.lit('" HPOS="5"><String CONTENT="'), x, F.lit('"/></TextLine>')))
    block = F.concat(F.lit('<TextBlock ID="B1" HPOS="1" VPOS="2" WIDTH="3">'), F.array_join(lines, ""), F.lit("</TextBlock>"))
    page = F.concat(F.lit('<alto xmlns="http://www.loc.gov/standards/alto/ns-v2#"><Layout>'), block, F.lit("</Layout></alto>"))
    return blocks(spark, d).select("block_id", page.alias("xml"))


#: Line texts as page XML gives them back: tabs in attributes are spaces, white space at the ends goes, empty lines go.
STRIPPED = r"regexp_replace(translate(x, chr(9) || chr(13), '  '), '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g')"
XML_LINES = f"hy AS (SELECT block_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIPPED}), lambda x: x <> '') AS ls FROM blocks)"


@query(f"WITH RECURSIVE {BLOCKS}, {XML_LINES}, {FOLD} SELECT block_id, 'B1' AS id, length(array_to_string(ls, chr(10))) AS n_chars, md5(array_to_string(ls, chr(10))) AS text_md5 FROM joined")
def src2_alto_blocks(spark, d):
    return alto.extract_blocks(xml_pages(spark, d)).select("block_id", "id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH RECURSIVE {BLOCKS}, {XML_LINES}, {FOLD} SELECT block_id, CAST(n_lines AS BIGINT) AS n_lines, length(array_to_string(ls, ' ')) AS n_chars FROM joined")
def alt5_8_block_text(spark, d):
    parsed = alto.parse_pages(xml_pages(spark, d))
    return parsed.select("block_id", F.size(alto.ordered_lines(F.col("lines"))).cast("long").alias("n_lines"), F.length(alto.block_text(F.col("lines"), " ")).cast("long").alias("n_chars"))


def shuffled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as page XML with a nested block whose lines stand last to first and are words and spaces, and a second block
    whose word is parted by a hyphen without content."""
    escaped = F.replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    words = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.lit('<String CONTENT="'), w, F.lit('"/>'))), "<SP/>")
    line = lambda x, i: F.concat(F.lit('<TextLine HPOS="5" VPOS="'), (i * 10).cast("string"), F.lit('.5">'), words(x), F.lit("</TextLine>"))
    lines = F.reverse(F.transform(F.split(escaped, "\n"), line))
    first = F.concat(F.lit('<ComposedBlock><TextBlock ID="B1" HPOS="1">'), F.array_join(lines, ""), F.lit("</TextBlock></ComposedBlock>"))
    second = '<TextBlock ID="B2"><TextLine VPOS="1" HPOS="9"><String CONTENT="ing"/></TextLine><TextLine VPOS="1" HPOS="2"><String CONTENT="end"/><HYP/></TextLine></TextBlock>'
    page = F.concat(F.lit('<alto xmlns="http://www.loc.gov/standards/alto/ns-v2#"><Layout>'), first, F.lit(second + "</Layout></alto>"))
    return blocks(spark, d).select("block_id", F.lit("p").alias("id"), page.alias("xml"))


@query(f"WITH RECURSIVE {BLOCKS}, {XML_LINES}, {FOLD} SELECT block_id, 'p' AS page_id, 0 AS block_idx, 'B1' AS id, md5(array_to_string(ls, chr(10))) AS text_md5 FROM joined UNION ALL SELECT block_id, 'p', 1, 'B2', md5('ending') FROM blocks")
def alt9_page_order(spark, d):
    return alto.extract_blocks(shuffled_pages(spark, d)).select("block_id", "page_id", "block_idx", "id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


# mentions


@query(f"WITH {TOKENS} SELECT word, block_idx, link FROM (SELECT unnest(list_filter(l, lambda x: x IN {quoted(TERMS)})) AS word, block_idx, link FROM toks)")
def idx2_postings(spark, d):
    return mentions.postings(blocks(spark, d), TERMS)


@query(f"WITH {COUNTED} SELECT link, CAST(sum(doc_length) AS BIGINT) AS total_tokens FROM counted GROUP BY link")
def idx3_page_tokens(spark, d):
    return mentions.page_counts(blocks(spark, d), FAMILIES).select("link", "total_tokens")


PAGE_SUMS = ", ".join(f"CAST(sum({n}_count) AS BIGINT) AS {n}_count" for n in FAMILIES)
PAGES = COUNTED + f", pages_ AS (SELECT link, CAST(sum(doc_length) AS BIGINT) AS total_tokens, {PAGE_SUMS} FROM counted GROUP BY link)"


@query(f"WITH {PAGES} SELECT link, {', '.join(MEASURES)} FROM pages_")
def idx6_page_family_counts(spark, d):
    return mentions.page_counts(blocks(spark, d), FAMILIES).select("link", *MEASURES)


@query(f"WITH {PAGES} SELECT link, {', '.join(f'{n}_count > 0 AS contains_{n}' for n in FAMILIES)} FROM pages_")
def idx7_contains(spark, d):
    return mentions.page_counts(blocks(spark, d), FAMILIES).select("link", *[f"contains_{n}" for n in FAMILIES])


@query(f"WITH {PAGES} SELECT link, {', '.join(f'round({n}_count / nullif(total_tokens, 0), 6) AS {n}_freq' for n in FAMILIES)} FROM pages_")
def idx8_page_freqs(spark, d):
    return mentions.page_counts(blocks(spark, d), FAMILIES).select("link", *[F.round(f"{n}_freq", 6).alias(f"{n}_freq") for n in FAMILIES])


@query(f"WITH {PAGES} SELECT link FROM pages_ WHERE {' + '.join(MEASURES)} > 0")
def idx9_target_pages(spark, d):
    return mentions.target_pages(mentions.page_counts(blocks(spark, d), FAMILIES), FAMILIES).select("link")


@query(f"WITH {BLOCKS}, names AS (SELECT * FROM (VALUES ('src0', 'Zero'), ('src1', 'One'), ('src2', 'Two')) v(title, name)) SELECT block_id, name FROM blocks LEFT JOIN names USING (title)")
def idx5_title_lookup(spark, d):
    names = spark.createDataFrame([("src0", "Zero"), ("src1", "One"), ("src2", "Two")], "title string, name string")
    return mentions.with_titles(blocks(spark, d), names, "title").select("block_id", "name")


@query(f"WITH {BLOCKS} SELECT link, CAST(row_number() OVER (PARTITION BY link ORDER BY block_id) - 1 AS BIGINT) AS block_idx, text_id, md5(text) AS raw_md5, md5(lower(text)) AS cleaned_md5 FROM blocks")
def kwc1_zip_explode(spark, d):
    part = F.struct(F.col("text_id").alias("id"), *[F.lit(None).cast("string").alias(c) for c in ("height", "width", "hpos", "vpos")], F.col("text"))
    pages = blocks(spark, d).groupBy("link").agg(F.transform(F.array_sort(F.collect_list(F.struct("block_id", part.alias("p")))), lambda x: x["p"]).alias("text_blocks_raw"))
    pages = pages.withColumn("text_blocks_cleaned", F.transform("text_blocks_raw", lambda x: x.withField("text", F.lower(x["text"]))))
    md5 = lambda c: F.md5(F.col(c).cast("binary"))
    return mentions.zip_blocks(pages).select("link", F.col("block_idx").cast("long").alias("block_idx"), "text_id", md5("text_raw").alias("raw_md5"), md5("text_cleaned").alias("cleaned_md5"))


@query(f"WITH {COUNTED} SELECT block_id, {', '.join(MEASURES)} FROM counted")
def kwc3_block_counts(spark, d):
    return counted(spark, d).select("block_id", *MEASURES)


WINDOW = f"list_transform(list_filter(range(1, len(t) + 1), lambda i: l[i] IN {quoted(TERMS)}), lambda i: t[greatest(1, i - 10):least(len(t), i + 9)])"


@query(f"WITH {TOKENS} SELECT block_id, md5(array_to_string(list_transform({WINDOW}, lambda w: array_to_string(w, ' ')), '|')) AS windows_md5 FROM toks")
def kwc4_context_windows(spark, d):
    w = F.transform(mentions.context_windows(F.col("text"), TERMS, 10), lambda x: F.array_join(x, " "))
    return blocks(spark, d).select("block_id", F.md5(F.array_join(w, "|").cast("binary")).alias("windows_md5"))


@query(f"WITH {TOKENS}, c AS (SELECT block_id, flatten({WINDOW}) AS w FROM toks) SELECT block_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS context_md5 FROM c")
def kwc5_context_concat(spark, d):
    rows = blocks(spark, d).select("block_id", mentions.context(F.col("text"), TERMS, 10).alias("w"))
    return rows.select("block_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ").cast("binary")).alias("context_md5"))


@query(f"WITH {COUNTED} SELECT block_id, doc_length FROM counted")
def kwc6_doc_length(spark, d):
    return counted(spark, d).select("block_id", "doc_length")
