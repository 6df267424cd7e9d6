import random
from collections import defaultdict

from pyspark.sql import functions as F

from paperloom.sources import index


def blocks(spark):
    rng = random.Random(1)
    rows = [(f"p{k // 4}", k % 4, [rng.choice(["the", "a", "b", "é", f"w{rng.randrange(30)}", None]) for _ in range(rng.randrange(40))]) for k in range(80)] + [("p99", 0, None), ("p99", 1, [])]
    return rows, spark.createDataFrame(rows, "link string, block_idx int, t array<string>")


def test_postings_come_back(spark, tmp_path):
    rows, table = blocks(spark)
    index.write_index(index.postings_of(table, F.col("t")), str(tmp_path), buckets=5)
    want = defaultdict(list)
    for link, k, t in rows:
        for i, x in enumerate(t or []):
            if x is not None:
                want[x, link, k].append(i)
    asked = ["the", "é", "w3", "nowhere"]
    found = index.look_up(spark, str(tmp_path), asked)
    got = {(r.term, r.link, r.block_idx): (r.n, r.places) for r in found.withColumn("places", index.undeltas(F.col("steps"))).collect()}
    assert got == {k: (len(v), v) for k, v in want.items() if k[0] in asked}
    terms = {r.term: (r.blocks, r.n) for r in index.look_up(spark, str(tmp_path), ["the", "a"], "terms").collect()}
    assert terms == {t: (sum(k[0] == t for k in want), sum(len(v) for k, v in want.items() if k[0] == t)) for t in ("the", "a")}
    assert index.look_up(spark, str(tmp_path), []).collect() == []


def test_a_term_reads_one_bucket(spark, tmp_path):
    _, table = blocks(spark)
    index.write_index(index.postings_of(table, F.col("t")), str(tmp_path), buckets=7)
    files = index.look_up(spark, str(tmp_path), ["the"]).inputFiles()
    plan = index.look_up(spark, str(tmp_path), ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert files and "PushedFilters: [IsNotNull(term), EqualTo(term,the)]" in plan


def test_tables_bucketed_alike_join_without_exchange(spark):
    _, table = blocks(spark)
    postings = index.postings_of(table, F.col("t"))
    index.save_index_table(postings, "postings_by_term", buckets=4)
    lexicon = postings.groupBy("term").agg(F.max("n").alias("n"))
    lexicon.write.mode("overwrite").bucketBy(4, "term").sortBy("term").saveAsTable("lexicon_by_term")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("postings_by_term").drop("n").join(spark.table("lexicon_by_term"), "term")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == postings.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("drop table postings_by_term")
        spark.sql("drop table lexicon_by_term")
