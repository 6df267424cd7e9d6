import random

import pytest

from paperloom.operators import spelling


def plain(a, b, swaps=True):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 10))) for _ in range(n)]


def test_distances_equal_the_plain_table():
    left, right = [*words(2000, 1), "", "", "x" * 300], [*words(2000, 2), "", "ab", "x" * 299 + "y"]
    assert spelling.swap_distances(left, right, at_once=300).tolist() == [plain(a, b) for a, b in zip(left, right, strict=True)]
    assert spelling.swap_distances([], []).tolist() == []
    assert spelling.swap_distances(["ca", "teh"], ["abc", "the"]).tolist() == [3, 1]


@pytest.mark.parametrize("closest", [True, False])
def test_candidates_with_swaps_equal_all_pairs(spark, closest):
    terms, dictionary = sorted(set(words(60, 3))), sorted(set(words(200, 4)))
    got = spelling.candidates(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w, k) for k, w in enumerate(dictionary)], "word string, count long"), closest=closest, transpose=True)
    want = {(t, w): plain(t, w) for t in terms for w in dictionary}
    want = {k: v for k, v in want.items() if v <= 2}
    if closest:
        least = {}
        for (t, _), v in want.items():
            least[t] = min(v, least.get(t, 9))
        want = {(t, w): v for (t, w), v in want.items() if v == least[t]}
    assert {(r.term, r.candidate): r.distance for r in got.collect()} == want


def test_long_terms_do_not_meet_short_words(spark):
    """All share their prefix: by prefixes alone each term met each word."""
    terms = spark.createDataFrame([("prefixes" + "x" * k,) for k in range(10, 14)], "term string")
    dictionary = spark.createDataFrame([("prefixes" + c, 10) for c in "abcdefgh"] + [("prefixesxxxxxxxxxxxy", 11)], "word string, count long")
    got = spelling.candidates(terms, dictionary, closest=False)
    assert {(len(r.term), r.candidate, r.distance) for r in got.collect()} == {(18, "prefixesxxxxxxxxxxxy", 2), (19, "prefixesxxxxxxxxxxxy", 1), (20, "prefixesxxxxxxxxxxxy", 1), (21, "prefixesxxxxxxxxxxxy", 2)}
    join = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "key" in x)
    assert "size" in join


def test_tokens_and_words_of_chunks(spark, tmp_path):
    from pyspark.sql import functions as F

    from paperloom.functions.tokens import token_texts
    from paperloom.plans import adapter

    rng = random.Random(8)
    texts = ["".join(rng.choice("aBñ1é.,-\u03a3\u0130\u00a0\u2003 \t\n\x0b") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, "  ", "uno dos uno"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    tokens, words = adapter.tokens_and_words(spark, str(tmp_path))
    assert sorted(r.token for r in tokens.collect()) == sorted(r[0] for r in rows.select(F.explode(token_texts(F.col("text")))).distinct().collect())
    assert {(r.word, r.n) for r in words.collect()} == {(r.word, r.n) for r in adapter.words(spark, str(tmp_path)).collect()}
