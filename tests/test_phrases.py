import random

import pytest
import regex

from paperloom.operators import correct

TOKEN = regex.compile(r"([\p{L}\p{N}](?:[^ \t\n\x0b\f\r]*[\p{L}\p{N}])?|[^ \t\n\x0b\f\r\p{L}\p{N}])([ \t\n\x0b\f\r]*)")


def plain(text, patches):
    if text is None:
        return None
    found = list(TOKEN.finditer(text))
    out, i = text[: found[0].start()] if found else text, 0
    normed = [m[1].strip(",.;:!?").lower() for m in found]
    while i < len(found):
        n = max((len(k) for k in patches if tuple(normed[i : i + len(k)]) == k), default=0)
        out += " ".join(patches[tuple(normed[i : i + n])] or []) + found[i + n - 1][2] if n else found[i][0]
        i += n or 1
    return out


def cases(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c", "é", "İ", "d1", ".", ",x", "x.", "-"])
    text = lambda: rng.choice(["", " ", "\n"]) + "".join(word() + rng.choice([" ", "  ", "\n", ""]) for _ in range(rng.randrange(60)))
    texts = [text() for _ in range(80)] + [None, "", "  ", "a b c a b", "a b c a b"]
    keys = {tuple(rng.choice(["a", "b", "c", "é", "d1", "", "x", "-"]) for _ in range(n)) for n in (1, 2, 2, 3, 3, 4, 5, 9) for _ in range(12)}
    return texts, {k: rng.choice([None, [], ["Z"], ["y", "é z"]]) for k in keys}


@pytest.mark.parametrize("held", [1 << 27, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_by_broadcast_and_by_join(spark, monkeypatch, held, seed):
    monkeypatch.setattr(correct, "INDEX_BYTES", held - 1)
    texts, patches = cases(seed)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "'c' as words", "id as own", "struct(id) as row").repartition(3)
    index = spark.createDataFrame([(list(k), v, 1) for k, v in patches.items()], "raw_norm array<string>, fixed_span array<string>, count long")
    got = correct.apply_phrases(rows, index)
    assert got.columns == ["id", "text", "words", "own", "row", "text_patched"]
    found = {r.id: (r.text, r.text_patched, r.words, r.own, r.row.id) for r in got.collect()}
    assert found == {k: (t, plain(t, patches), "c", k, k) for k, t in enumerate(texts)}


def test_no_phrases_and_no_texts(spark):
    index = spark.createDataFrame([], "raw_norm array<string>, fixed_span array<string>")
    rows = spark.createDataFrame([(1, " a b")], "id long, text string")
    assert [r.text_patched for r in correct.apply_phrases(rows, index).collect()] == [" a b"]
    assert correct.apply_phrases(rows.filter("id > 1"), index).collect() == []


def test_frequent_phrases_held_and_the_rest_joined(spark, monkeypatch):
    texts, patches = cases(3)
    index = spark.createDataFrame([(list(k), v, 1 + i * i) for i, (k, v) in enumerate(sorted(patches.items(), key=str))], "raw_norm array<string>, fixed_span array<string>, count long")
    hashed = correct.hashed_patches(index).localCheckpoint()
    monkeypatch.setattr(correct, "INDEX_BYTES", 12 * len(patches) // 2)
    least = correct._held_rank(hashed)
    assert 0 < hashed.filter(f"rank >= {least}").count() < hashed.count()
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    assert {r.id: r.text_patched for r in correct.apply_phrases(rows, index).collect()} == {k: plain(t, patches) for k, t in enumerate(texts)}


def test_pairs_of_neighbours_are_rows_without_a_lambda(spark, tmp_path):
    from collections import Counter

    from paperloom.plans.analysis_queries import phrases

    texts = ["a b a b", "a", "", None, "a b. a", "b .  a b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = phrases(spark, str(tmp_path))
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
    split = [(t or "").replace(".", " .").split() for t in texts]
    pairs = Counter(p for t in split for p in zip(t, t[1:]))
    assert {tuple(r.raw_span): r["count"] for r in found.collect()} == {p: n for p, n in pairs.items() if n >= 2}


def test_pairs_are_exploded_without_the_text_beside_them(spark, tmp_path):
    """Each token's row once held all tokens of its text, and Spark buffers the rows of a text: the square of its tokens."""
    from paperloom.plans.analysis_queries import phrases

    spark.createDataFrame([(1, "a b a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = phrases(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate " in line]
    assert made and not [line for line in made if regex.search(r"\), \[\w+#\d+", line)]


def test_shuffles_go_with_the_table_written(spark):
    """They stayed until the driver collected its garbage, and filled the disk meanwhile."""
    from paperloom.sources.shared import written

    known = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = known()
    assert written(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "sevens").count() == 7
    assert known() <= before + 1  # that of this count


def test_patches_go_once_the_texts_are_written(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    tables = lambda name: set(glob.glob(f"{folder}/{name}-*"))
    before = {name: tables(name) for name in ("patches", "patched")}
    texts = spark.createDataFrame([(1, "tbe dog barks"), (2, None)], "id long, text string")
    index = spark.createDataFrame([(["tbe", "dog"], ["the", "dog"], 2)], "raw_norm array<string>, fixed_span array<string>, count long")
    words = spark.createDataFrame([("barks", 20)], "word string, count long")
    zipf = spark.createDataFrame([("barks", 4.0)], "word string, zipf double")
    out = correct.fix_text(texts, "id", index, words, words, zipf, out="text")
    assert tables("patches") == before["patches"]
    assert [spark.read.parquet(x).columns for x in tables("patched") - before["patched"]] == [["id", "__now"]]
    assert {r.id: r.text for r in out.collect()} == {1: "the dog barks", 2: None}
