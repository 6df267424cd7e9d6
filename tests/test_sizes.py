"""Rows in such numbers, or so alike, that a step once failed on them."""

import random
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.functions import tokens
from paperloom.functions.text import nfc
from paperloom.operators import alto, mining, quality, scripts
from paperloom.sources import index


def test_pages_that_fill_their_batches(spark):
    """As many blocks as were once handed on at a time, so that none was left behind them."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    page = F.concat(F.lit('<alto xmlns="http://www.loc.gov/standards/alto/ns-v2#"><TextBlock ID="B1"><TextLine><String CONTENT="'), F.col("id").cast("string"), F.lit('"/></TextLine></TextBlock></alto>'))
    rows = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("k"), page.alias("xml"))
    schema = "k bigint, block_idx int, bad_xml boolean, " + alto.BLOCK
    given = rows.mapInArrow(lambda batches: batches, rows.schema)
    assert alto.parse_pages(given).schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    assert alto.extract_blocks(given).filter("text = cast(k as string)").count() == 10_000
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_pages_come_in_small_batches(spark):
    """A thousand pages at a time were held as XML and parsed by each worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    alto.parse_pages(spark.createDataFrame([], "k long, xml string"))
    assert int(spark.conf.get(name)) <= 64
    spark.conf.set(name, before)


def test_alignment_by_places_where_the_longest_match_shifts(spark):
    gold, raw = "the The the The", "tbe The tbe The"
    assert scripts.opcodes_of(raw.lower().split(), gold.lower().split())[0][0] == "delete"
    pairs = spark.createDataFrame([(1, raw, gold), (2, "a b c", "b c a"), (3, "", "")], "pair_id long, raw_text string, gold_text string")
    got = sorted(r[:6] for r in mining.opcodes(pairs, by_place=True).collect())
    shifted = [(2, *op) for op in scripts.opcodes_of("a b c".split(), "b c a".split())]
    assert got == sorted([(1, "replace" if i % 2 == 0 else "equal", i, i + 1, i, i + 1) for i in range(4)] + shifted)


def test_places_of_many_lines_at_once(spark, monkeypatch):
    """Lines of like places never reach the matcher, whose table of one line took half a millisecond."""
    rng = random.Random(6)
    words = ["a", "A", "b", "B", "c", "\u0130", "i\u0307", "x", "y", ""]
    rows = []
    for _ in range(600):
        a = [rng.choice(words) for _ in range(rng.randrange(9))]
        b = [rng.choice(words) if rng.random() < 0.3 else w for w in a] + ["z"] * (rng.random() < 0.1)
        rows.append((a, b))
    left, right = (pa.array([["q"], *(r[k] for r in rows)], pa.list_(pa.string()))[1:] for k in (0, 1))
    for lower, tags, sizes in ((True, None, None), (False, ("replace",), None), (True, ("replace",), (2, 3))):
        low = lambda w: [t.lower() for t in w] if lower else w  # noqa: B023, E731
        rest, told, spans = scripts.in_places(left, right, lower, tags, sizes)
        want = [scripts.in_place(low(a), low(b)) for a, b in rows]
        assert rest == [k for k, w in enumerate(want) if w is None]
        got = list(zip(*(t.tolist() for t in told), *(s.to_pylist() for s in spans), strict=True))
        keep = lambda op: (tags is None or op[0] in tags) and (sizes is None or sizes[0] <= op[2] - op[1] <= sizes[1])  # noqa: B023, E731
        assert got == [(k, op[0] == "equal", op[1], op[2], rows[k][0][op[1] : op[2]], rows[k][1][op[3] : op[4]]) for k, w in enumerate(want) if w is not None for op in w if keep(op)]
    assert scripts.in_places(left[:0], right[:0], True)[0] == []
    monkeypatch.setattr(mining, "opcodes_of", None)
    pairs = spark.createDataFrame([(1, "th0 c0 a", "the co a"), (2, "", "")], "pair_id long, raw_text string, gold_text string")
    assert [tuple(r) for r in mining.opcodes(pairs, ("replace",), True, (2, 5)).collect()] == [(1, "replace", 0, 2, 0, 2, ["th0", "c0"], ["the", "co"])]


def test_tokens_without_groups(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aB1é.,-\u00a0\u2003 \t\n\x0b\u0301\U0001d7d8") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    old = [F.regexp_extract_all("t", F.lit(tokens.TOKEN), F.lit(k)) for k in (1, 0)]
    assert rows.filter(~(tokens.token_texts(F.col("t")).eqNullSafe(old[0]) & tokens.token_wholes(F.col("t")).eqNullSafe(old[1]))).count() == 0


def test_scripts_by_place_need_no_table(monkeypatch):
    def told(src, dst):
        with monkeypatch.context() as m:
            m.setattr(scripts, "in_place", lambda a, b: None)
            return scripts.edit_script(src, dst)

    rng = random.Random(4)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randrange(9))]
        b = [rng.choice("abxy") if rng.random() < 0.3 else x for x in a]
        assert scripts.edit_script(a, b) == told(a, b)
    monkeypatch.setattr(scripts, "isqrt", None)  # the table's step
    assert scripts.edit_script(["a", "b"], ["a", "c"]) == [("replace", 1, 1)]


def test_damage_by_place_where_the_longest_match_shifts(spark):
    row = ("The the The the", "the The the The", "The the The the")
    pairs = spark.createDataFrame([(1, row[0], row[1], row[2]), (2, "x a x a", "a x a y", "x a x a")], "pair_id long, raw_text string, gold_text string, fixed_text string")
    assert {r.pair_id: r.clean_token_count for r in quality.damage(pairs).collect()} == {1: 3, 2: 3}
    pairs = spark.createDataFrame([(1, "a b b", "b b c", "a b b"), (2, "a c b d", "x c b d", "a c y d")], pairs.schema)
    assert {r.pair_id: (r.damage_count, r.clean_token_count) for r in quality.damage(pairs, by_place=True).collect()} == {1: (0, 2), 2: (1, 3)}


def test_word_errors_by_place_and_by_table(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    texts = [tuple(" ".join(rng.choice("abcdef") for _ in range(rng.choice((4, 4, 5)))) for _ in range(2)) for _ in range(120)]
    texts += [("a b0 c", "a b c"), ("", "a"), ("a", ""), (None, "a")]
    got = [r.w for r in spark.createDataFrame(texts, "a string, b string").coalesce(1).select(quality.wer(F.col("a"), F.col("b")).alias("w")).collect()]
    want = [None if a is None else distance(a.split(), b.split()) / len(b.split()) if b else 0.0 for a, b in texts]
    assert got == want


def test_only_texts_that_may_change_are_composed(spark):
    texts = ["plain", "e\u0301", "caf\u00e9", "\u1100\u1161", "\u2126", None, "", "\u02ff", "a\u0300"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(nfc(F.col("t")).alias("t")).collect()]
    assert got == [t and unicodedata.normalize("NFC", t) for t in texts]


def test_postings_without_a_shuffle_and_of_repeated_keys(spark):
    rows = [("p", 0, ["a", "b", None, "a"]), ("p", 1, None), ("q", None, ["b"]), (None, 2, [])]
    table = lambda rows: spark.createDataFrame(rows, "link string, block_idx int, t array<string>")
    single = index.postings_of(table(rows), F.col("t"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString()
    want = {("a", "p", 0): [0, 3], ("b", "p", 0): [1], ("b", "q", None): [0]}
    assert {tuple(r[:3]): r.steps for r in single.collect()} == want
    both = index.postings_of(table([*rows, ("q", None, ["c", "b"])]), F.col("t"))
    assert {tuple(r[:3]): (r.n, r.steps) for r in both.collect()} == {k: (len(v), v) for k, v in (want | {("b", "q", None): [0, 1], ("c", "q", None): [0]}).items()}
