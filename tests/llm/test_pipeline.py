import re

import corpus_pipeline
from paperloom.llm.storage import materialise

from .test_ngram_join import brute


def test_stages_on_small_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], sf_dir), name))
    raw, kept, lines, unique, mixed, packed = seen
    assert all(x.columns == columns for x in seen[:-1])
    assert {r[0] for r in kept.select("doc_id").collect()} <= {r[0] for r in raw.select("doc_id").collect()}
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    words = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in raw.select("doc_id", "text").collect()}
    lost = {r[0] for r in good.join(kept, "doc_id", "left_anti").select("doc_id").collect()}
    assert all(words[d] < 20 for d in lost)
    rows = [(r[0], r[1]) for r in lines.select("doc_id", "text").collect()]
    assert sorted(r[0] for r in unique.select("doc_id").collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})
    assert {r[0] for r in mixed.select("doc_id").collect()} == {r[0] for r in unique.select("doc_id").collect()}
    pieces = packed.toPandas()
    assert set(pieces.doc_id) == {r[0] for r in unique.select("doc_id").collect()}
    for _, bin_ in pieces.groupby("sequence_id"):
        placed = bin_.sort_values("offset")
        assert placed.offset.tolist() == [0, *placed.length.cumsum()[:-1]] and placed.length.sum() <= 1024


ODD = [None, "", " \t\n", "a", "word " * 30, "x" * 5000, "é😀 ﬁ\x00 tab\there", "long text of words " * 20_000]
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, doc string, stats string, kept string, hash string, cleaned string, row string, copies string"


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and columns named like those of the stages."""
    rows = [(k, t, None if k % 2 else "en", None if k % 3 else "s") for k, t in enumerate(ODD)]
    rows += [rows[3], rows[3], rows[7], (None, None, None, None), (None, "no id here", "fr", "t"), (3, "another text with the id of one before", "en", "s")]
    rows += [(50 + k, f"A plain enough text number {k} with words that nobody else says, {k * 7919} and {k * 104729}, and then a few more of them here.\nIts second line {k}.", "en", f"s{k % 3}") for k in range(40)]
    return spark.createDataFrame([(*r, None, *["x"] * 7) for r in rows], CLASHING)


def test_odd_rows_through_every_stage(spark, sf_dir):
    docs = odd_documents(spark)
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], sf_dir), f"odd-{name}"))
    raw, kept, lines, unique, mixed, packed = seen
    assert all(x.columns == docs.columns for x in seen[:-1])
    texts = {r.text for r in kept.select("text").collect()}
    assert not texts & {None, "", " \t\n", "a", "x" * 5000} and sum(t.startswith("A plain") for t in texts) == 40
    assert kept.filter("stats <> 'x' or doc <> 'x'").count() == 0
    assert lines.count() == kept.count()
    assert {r.doc_id for r in unique.select("doc_id").collect()} <= {r.doc_id for r in lines.select("doc_id").collect()} and unique.count() == unique.distinct().count()
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert set(copies) == {r.doc_id for r in unique.select("doc_id").collect()} and set(copies.values()) <= {1, 2}
    pieces = packed.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert pieces and all(r["sum(length)"] <= 1024 for r in pieces)


def test_each_stage_takes_odd_rows_and_empty_tables(spark, sf_dir):
    docs = odd_documents(spark)
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, sf_dir), stage(spark, docs.filter("doc_id = -1"), sf_dir)
        assert none.count() == 0 and none.columns == out.columns
        if name == "best_fit_packing":
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
            continue
        rows = out.collect()
        assert out.columns == docs.columns
        if name == "line_dedup":
            assert len(rows) == total and sum(r.text is None for r in rows) == 2
        if name == "ngram_jaccard_join":
            ids = [r.doc_id for r in rows if r.text and r.text.startswith("long text")]
            assert ids == [7] and sum(not (r.text or "").strip(" \t\n\x0b\f\r") for r in rows) == 4
        if name == "source_mixing":
            assert total <= len(rows) <= 2 * total


def test_run_on_odd_documents(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    first, second = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()), key=repr) for _ in range(2))
    assert first == second and first
