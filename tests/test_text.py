import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions import tokens as K
from paperloom.operators import alto, correct, dictionary, mentions, mining, quality, relevance, spelling, terms, timelines
from paperloom.sources import pages as sources


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("Guer-\n ra,,  hola !!!! ( x ) ....... ----- ____", "Guerra, hola! (x)... — _"), ("", ""), (None, ""), ("a b c d", "a b c d"), ("[ a ] ;;", "[a];")],
)
def test_preclean(spark, raw, clean):
    assert one(spark, T.preclean(F.col("t")), t=raw) == clean


def test_preclean_composes(spark):
    assert one(spark, T.preclean(F.col("t"), compose=True), t="café") == "café"


def test_tokens(spark):
    assert one(spark, K.word_tokens(F.col("t")), t="El jíbaro, año 1898") == ["jíbaro", "año"]
    assert [one(spark, K.affix(F.col("t"), k), t="(jib4r),") for k in (1, 2, 3)] == ["(", "jib4r", "),"]
    assert [one(spark, K.affix(F.col("t"), k), t="---") for k in (1, 2, 3)] == ["---", "", ""]
    assert one(spark, K.norm_token(F.col("t")), t=",Hola.") == "hola"
    assert one(spark, K.ngrams(K.token_texts(F.col("t")), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, K.ngrams(K.token_texts(F.col("t")), 2), t="a") == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1.,-ñ «»|\n\t", max_size=30), min_size=1, max_size=20))
def test_tokeniser_is_lossless(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.filter(correct.rebuilt(F.col("t"), K.tokens(F.col("t"))) != F.col("t")).count() == 0


def test_suspects(spark):
    words = {"spSundatUmÍDa": True, "c4sa": True, "a.b": True, "otorrinolaringo": True, "casa": False, "Casa": False, "a1": False, "ABC": False, "xyzzy": False}
    rows = spark.createDataFrame([(w,) for w in words], "t string")
    assert {r[0]: r[1] for r in rows.select("t", K.is_suspect(F.col("t"), F.lower("t") == "casa")).collect()} == words


def test_alto(spark):
    xml = (
        '<alto xmlns="http://www.loc.gov/standards/alto/ns-v2#"><TextBlock ID="a" HPOS="1"><TextLine VPOS="20" HPOS="1"><String CONTENT="ra y"/></TextLine>'
        '<TextLine VPOS="10.9" HPOS="1"><String CONTENT="Guer"/><HYP/></TextLine><TextLine VPOS="30"><String CONTENT="El"/><SP/><String CONTENT="x"/><SP/></TextLine></TextBlock></alto>'
    )
    out = alto.extract_blocks(spark.createDataFrame([("p", xml), ("bad", "<a>"), ("none", None)], "path string, xml string")).collect()
    assert [(r.path, r.block_idx, r.id, r.hpos, r.vpos, r.text) for r in out] == [("p", 0, "a", "1", None, "Guerra y\nEl x")]


def test_dehyphenation_is_pairwise(spark):
    lines = F.array(*map(F.lit, ["Guer-", "ra y", "a-", "b-", "c", "x-", "9"]))
    assert one(spark, alto.dehyphenate(lines)) == ["Guerra y", "ab-", "c", "x-", "9"]
    assert one(spark, alto.dehyphenate(F.array().cast("array<string>"))) == []


def test_mining(spark):
    words = spark.createDataFrame([("a", "x", 9, 10), ("a", "y", 1, 10), ("b", "x", 8, 10), ("b", "y", 2, 10)], "raw string, fixed string, count long, total long")
    assert [(r.raw, r.fixed, r.rate) for r in mining.precise_words(words).collect()] == [("a", "x", 0.9)]
    phrases = spark.createDataFrame([(["Foo,", "bar"], ["A"], 5), (["foo", "bar."], ["B"], 2)], "raw_span array<string>, fixed_span array<string>, count long")
    assert [(r.raw_norm, r.fixed_span) for r in mining.patch_index(phrases).collect()] == [(["foo", "bar"], ["B"])]
    pairs = spark.createDataFrame([("1", "de la ca sa grande", "de la casa grande"), ("2", "uno dos", "uno DOS")], "pair_id string, raw_text string, gold_text string")
    ops = mining.opcodes(pairs)
    assert mining.word_counts(ops).count() == 0
    assert [(r.raw_span, r.fixed_span) for r in mining.phrase_counts(ops).collect()] == [(["ca", "sa"], ["casa"])]


def test_phrase_patches(spark):
    index = spark.createDataFrame([(["ca", "sa"], ["casa"]), (["x"], [])], "raw_norm array<string>, fixed_span array<string>")
    rows = spark.createDataFrame([("de la ca sa, grande",), (" x y",), (None,), ("",)], "text string")
    assert [r.text_patched for r in correct.apply_phrases(rows, index).collect()] == ["de la casa, grande", "  y", None, ""]


def test_phrase_patches_without_a_bound(spark):
    many = spark.range(1_000_001).select(F.array(F.lit("q"), F.col("id").cast("string")).alias("raw_norm"), F.array(F.lit("Q")).alias("fixed_span"))
    longer = spark.createDataFrame([(["a", "b", "c"], ["abc"]), (["a", "b"], ["ab"])], many.schema)
    rows = spark.createDataFrame([("q 1000000, q x A b c",), ("a b. q 7",), ("a",)] * 2, "text string")
    assert sorted(r.text_patched for r in correct.apply_phrases(rows, many.unionByName(longer)).collect()) == sorted(["Q, q x abc", "ab. Q", "a"] * 2)


def test_dictionary(spark):
    side = lambda rows: spark.createDataFrame(rows, "word string, n long")
    merged = dictionary.merge_counts(side([("a", 60), ("b", 7), ("d", 200)]), side([("a", 30), ("c", 3), ("d", 200)]))
    assert {r.word: r["count"] for r in merged.collect()} == {"a": 260, "b": 7, "c": 15, "d": 950}
    priors = spark.createDataFrame([("u", 2.0), ("v", 5.0), ("w", 6.0), ("a", 7.0)], "word string, zipf double")
    assert {r.word: r["count"] for r in dictionary.absent_priors(priors, side([("a", 1)])).collect()} == {"u": 1, "v": 10, "w": 100}


@pytest.mark.parametrize(("word", "penalty"), [("", 5.0), ("casa", 0.0), ("c4sa", 1.5), ("12a", 3.1), ("a_b", 0.5), ("a" * 20, 1.0)])
def test_weirdness(spark, word, penalty):
    assert one(spark, spelling.weirdness(F.col("t")), t=word) == pytest.approx(penalty)


def test_spelling(spark):
    assert one(spark, spelling.confusion_bonus(F.lit("corno"), F.lit("como"), [("rn", "m")])) == pytest.approx(0.8)
    assert one(spark, spelling.score(F.lit("casa"), F.lit("casa"), F.lit(4.0), F.lit(1), F.lit(99))["score"]) == pytest.approx(4.1)
    words = ["casa", "caso", "cosa", "masa", "grande", "grandes", "iglesia"]
    found = spelling.candidates(spark.createDataFrame([("cassa",), ("grnade",), ("zzzzz",), ("igelsia",)], "term string"), spark.createDataFrame([(w, 10) for w in words], "word string, count long"), closest=False)
    from itertools import product

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert {(r.term, r.candidate) for r in found.collect()} == {(a, b) for a, b in product(["cassa", "grnade", "zzzzz", "igelsia"], words) if distance(a, b) <= 2}


def test_evaluation(spark):
    pairs = spark.createDataFrame([("1", "a b c", "a b d", "a x d"), ("2", "cassa", "casa", "casa"), ("3", "", "", "")], "pair_id string, raw_text string, gold_text string, fixed_text string")
    out = {r.pair_id: r for r in quality.evaluate(pairs).collect()}
    assert (out["1"].edit_precision, out["1"].edit_recall, out["1"].damage_rate) == (0.5, 1.0, 0.5)
    assert (out["2"].cer_raw, out["2"].cer_fixed, out["2"].cer_improvement_abs, out["2"].cer_improvement_pct) == (0.25, 0.0, 0.25, 1.0)
    assert (out["3"].cer_raw, out["3"].wer_raw, out["3"].damage_rate) == (0.0, 0.0, 0.0)
    assert out["1"].wer_raw == pytest.approx(1 / 3)


def test_context(spark):
    assert one(spark, mentions.context_windows(F.col("t"), ["x"], 2), t="a b X c d X e") == [["a", "b", "X", "c"], ["c", "d", "X", "e"]]
    assert one(spark, mentions.context(F.col("t"), ["q"], 2), t="a b") == []


def test_relevance_rule(spark):
    cases = [(None, 1, 0.4, True), (None, 1, 0.5, False), (None, 0, 0.1, False), (0, 0, 0.9, True), (1, 3, 0.1, False)]
    rows = spark.createDataFrame(cases, "label int, n int, score double, want boolean")
    assert rows.filter(relevance.relevant(F.col("label"), F.col("n"), F.col("score")) != F.col("want")).count() == 0


def test_pair_vocabulary(spark):
    rows = spark.createDataFrame([(k, ["a", "b"][: 2 - k]) for k in range(3)], "block_id long, tokens array<string>")
    pairs = rows.select("block_id", relevance.with_pairs(F.col("tokens")).alias("terms"))
    assert {(r.term, r.df) for r in relevance.document_frequencies(pairs, "block_id", "terms", 1).collect()} == {("a", 2), ("b", 1), ("a b", 1)}


def test_weights_by_held_terms_and_by_join(spark, monkeypatch):
    """Common terms are sent to the tasks, never shuffled; rows that share a key are one, null terms none."""
    import math
    from collections import Counter

    rows = [(1, ["a", "b", "a", None]), (2, ["a", "c"]), (2, ["a", "c", "d"]), (None, ["d"]), (3, None), (4, []), (5, ["a"])]
    table = spark.createDataFrame(rows, "block_id long, tokens array<string>")
    for given, bound in ((rows, 1 << 20), (rows, 100), (rows, 0), (rows[:2] + rows[5:], 70)):
        monkeypatch.setattr(relevance, "HELD_BYTES", bound)
        df = Counter(t for _, w in given for t in {*(w or [])} - {None})
        tf = Counter((k, t) for k, w in given for t in w or [] if t is not None and df[t] >= 2)
        want = {(k, t, n): n * math.log((len(given) + 1) / (df[t] + 1)) for (k, t), n in tf.items()}
        got = relevance.tf_idf(spark.createDataFrame(given, table.schema).repartition(3), "block_id", "tokens")
        assert {tuple(r[:3]): r.tfidf for r in got.collect()} == pytest.approx(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and "Aggregate" not in plan


def test_cross_validation_has_the_area(spark):
    rows = [(k, [w, "the"], [w, "a", "x"], k % 2) for k in range(12) for w in [("good", "bad")[k % 2]]]
    out = relevance.cross_validate(spark.createDataFrame(rows, "block_id long, tokens array<string>, context array<string>, label long"), folds=2, steps=3)
    assert [r.roc_auc for r in out.collect()] == [1.0, 1.0]


def test_page_sums(spark):
    rows = spark.createDataFrame([("p", 1900, "t", 10, 2, True), ("p", 1900, "t", 20, 5, False)], "link string, year int, title string, doc_length long, a_count long, relevant_a boolean")
    page = timelines.page_sums(rows, ["a"]).first()
    assert (page.a_count, page.doc_length, page.a_ratio) == (2, 30, pytest.approx(2 / 30))


def test_terms(spark):
    found = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c", "d"])], "id int, words array<string>")
    assert sorted(r.gram for r in terms.passage_ngrams(found).collect()) == ["a b", "a b c", "b c", "b c d", "c d"]
    count = lambda rows: spark.createDataFrame(rows, "term string, n long")
    merged = terms.merge_terms(count([("casa", 3), ("campo", 2)]), count([("casa campo", 2), ("á pobres", 4)]), count([("campo", 0), ("á pobres", 0)]))
    assert {(r.term, r.n) for r in merged.collect()} == {("casa", 3), ("casa campo", 2)}


def test_sources(spark, tmp_path):
    path = "data/sn88073003/1920/01/02/ed-1/seq-3/ocr.xml"
    assert one(spark, sources.path_fields(F.col("t"))["link"], t=path) == "https://chroniclingamerica.loc.gov/lccn/sn88073003/1920-01-02/ed-1/seq-3/"
    dictionary_ = spark.createDataFrame([("a", 10), ("b", 9)], "word string, count long")
    sources.write_dictionary(dictionary_, str(tmp_path / "d"))
    assert [tuple(r) for r in sources.read_dictionary(spark, str(tmp_path / "d")).collect()] == [("a", 10)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"link": "l", "gpt_fixed": [{"raw_text": "x", "gpt_fixed_conservative": "y"}, {"raw_text": "z"}]}')
    (tmp_path / "j" / "b.json").write_text('{"link": ')
    good, bad = sources.read_json_pages(spark, str(tmp_path / "j"), sources.GOLD)
    assert [(r.raw_text, r.gold_text) for r in sources.gold_pairs(good).collect()] == [("x", "y")]
    assert bad.count() == 1


def test_streaming_ingest_sees_files_once(spark, tmp_path):
    from paperloom.streaming.ingest import ingest_pages

    page = '<alto xmlns="http://www.loc.gov/standards/alto/ns-v2#"><TextBlock ID="{}"><TextLine><String CONTENT="{}"/></TextLine></TextBlock></alto>'
    for k in (1, 2):
        at = tmp_path / f"in/sn1/1900/01/0{k}/ed-1/seq-1"
        at.mkdir(parents=True)
        (at / "ocr.xml").write_text(page.format(k, f"text {k}"))
        ingest_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r.date, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1900-01-01", "text 1"), ("1900-01-02", "text 2")]
