"""Odd rows, whole miners, models kept on disk, answers that are no JSON."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions.tokens import is_word
from paperloom.operators import alto, correct, mining, quality, relevance, terms
from paperloom.sources import pages as sources


def values(spark, column, rows, schema):
    return [r.v for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_repeated_and_null_keys_are_corrected(spark):
    rows = spark.createDataFrame([(1, "tbe cat tbe"), (1, "tbe cat tbe"), (1, "a d0g"), (None, "tbe"), (2, "plain")], "id long, text string")
    mapping = spark.createDataFrame([("tbe", "the"), ("tbe", "tie"), ("d0g", "dog")], "token string, fixed string")
    out = correct.replace_tokens(rows, mapping, "id", "text", "out")
    assert out.columns == ["id", "text", "out"]
    assert sorted(((r.id, r.out) for r in out.collect()), key=str) == sorted([(1, "the cat the"), (1, "the cat the"), (1, "a dog"), (None, "the"), (2, "plain")], key=str)


def test_page_columns_named_like_a_blocks(spark):
    page = '<alto xmlns="http://www.loc.gov/standards/alto/ns-v2#"><TextBlock ID="B"><TextLine><String CONTENT="x"/></TextLine></TextBlock></alto>'
    out = alto.extract_blocks(spark.createDataFrame([(7, "w", page), (8, "v", "<broken"), (9, None, None)], "id long, width string, xml string")).collect()
    assert [(r.page_id, r.page_width, r.id, r.text) for r in out] == [(7, "w", "B", "x")]


def test_word_errors_of_many_distinct_words(spark):
    words = [f"w{k}" for k in range(46_000)]
    pairs = [(" ".join(words), "w5 x w45999"), ("a b c", "a c"), ("a", "")]
    assert values(spark, quality.wer(F.col("a"), F.col("b")), pairs, "a string, b string") == pytest.approx([(46_000 - 2) / 3, 0.5, 0.0])


def test_answers_are_repaired(spark):
    ok = '[{"raw_text": "a"}, {"raw_text": "b"}]'
    texts = [ok, f"Sure:\n```json\n{ok}\n```", '[{"raw_text": "a"},]', '[{"raw_text": "a"}, {"raw_te', "[]", "no list", None, "["]
    parsed = sources.correction_answer(F.col("t"))
    assert values(spark, F.transform(parsed, lambda x: x["raw_text"]), [(t,) for t in texts], "t string") == [["a", "b"], ["a", "b"], ["a"], ["a"], [], None, None, []]


def test_long_first_pairs(spark):
    pages = spark.createDataFrame([("p", [("x" * n, None, None) for n in (101, 100, 150)])], "link string, gpt_fixed array<struct<raw_text:string,gpt_fixed_conservative:string,gpt_fixed_best_guess:string>>")
    assert [r.k for r in sources.inspected_pairs(pages, first=2).collect()] == [0]


def test_miner_counts_both(spark):
    pairs = [(1, "tbe cat sat 0n it", "the cat sat on it"), (2, "tbe dog", "the dog"), (3, "one tw0 thr3e", "one two three"), (4, None, "x")]
    phrases, words = mining.mine(spark.createDataFrame(pairs, "pair_id long, raw_text string, gold_text string"))
    assert {(r.raw, r.fixed, r["count"]) for r in words.collect()} == {("tbe", "the", 2), ("0n", "on", 1)}
    assert [(r.raw_span, r.fixed_span) for r in phrases.collect()] == [(["tw0", "thr3e"], ["two", "three"])]


def test_is_word(spark):
    assert values(spark, is_word(F.col("t")), [("12a",), ("ñ",), ("12.-",), ("",), (None,)], "t string") == [True, True, False, False, False]


def test_folds_are_even_by_label(spark):
    rows = spark.createDataFrame([(k, k % 3 == 0, "x") for k in range(100)] + [(None, None, "x")], "id long, label boolean, fold string")
    out = relevance.fold(rows.drop("fold"), "label", "id", 5, buckets=7)
    counts = {(r.label, r.fold): r["count"] for r in out.groupBy("label", "fold").count().collect()}
    assert all(counts[label, k] in sizes for label, sizes in ((True, (6, 7)), (False, (13, 14))) for k in range(5)) and sum(counts.values()) == 101


def test_family_models_are_kept(spark, tmp_path):
    rows = [(k, ["good" if k % 2 else "bad", "the"], ["w", "x"], ["y", "z"], k % 2, "ab"[k % 4 // 2]) for k in range(40)]
    data = spark.createDataFrame(rows, "block_id long, tokens array<string>, context array<string>, context_b array<string>, label long, word_type string")
    more = data.drop("label", "word_type").unionByName(spark.createDataFrame([(99, [], [], [])], data.drop("label", "word_type").schema))
    models, scored = relevance.family_scores(data, more, ["a", "b"], folds=2, steps=5)
    assert scored.columns == [*more.columns, "score_a", "score_b"] and scored.count() == 41
    label = {r[0]: r[4] for r in rows}
    got = {r.block_id: (r.score_a, r.score_b) for r in scored.collect()}
    assert all((s > 0.5) == bool(label[k]) for k, pair in got.items() if k != 99 for s in pair)
    models["a"].save(str(tmp_path / "m"))
    again = relevance.CalibratedSVM.load(str(tmp_path / "m")).score(more).collect()
    assert {r.block_id: r.score for r in again} == pytest.approx({k: a for k, (a, _) in got.items()})
    assert relevance.uncertain(scored, "score_a", 0.0, 1.0).count() == 41


def test_word_cloud_tables(spark):
    found = spark.createDataFrame([(1, ["Rain", "fell", "on", "green", "hills", "xyz"]), (2, ["rain", "fell", "on", "green", "hills"])], "id int, words array<string>")
    dictionary = spark.createDataFrame([("rain", "NOUN"), ("fell", "VERB"), ("green", "ADJ"), ("hills", "NOUN"), ("on", "ADP")], "word string, pos string")
    cloud = terms.word_cloud(found, ["id"], dictionary, ["on"], ["hills"])
    assert {(r.term, r.n) for r in cloud.frequencies.collect()} == {("rain", 2), ("green", 2)}
    assert cloud.sequences.count() == 0 and [(r.word, r.n) for r in cloud.ignored.collect()] == [("xyz", 1)]
    assert {(r.term, r.weight) for r in terms.weighted_terms(spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "term string, n long"), 2).collect()} == {("a", 1.0), ("b", 0.5)}


def test_entry_queries_have_matching_sql_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
