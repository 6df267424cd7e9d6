import math

import pytest

from paperloom.llm import mixing
from paperloom.llm.queries import OP4_SQL, op4_temperature_mixing


@pytest.mark.parametrize("few", [True, False])
def test_equals_sql(spark, sf_dir, few, monkeypatch):
    import duckdb

    if not few:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    names = ["doc_id", "source", "n_tokens", "weight", "copies"]
    expected = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({OP4_SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in op4_temperature_mixing(spark, sf_dir).select(names).collect()), key=str) == expected


@pytest.mark.parametrize("target", [0.2, 0.9, 1.2])
def test_entropy_exponent(spark, target):
    shares = [0.7, 0.2, 0.06, 0.04]

    def entropy(a):
        powers = [p**a for p in shares]
        return -sum(x / sum(powers) * math.log(x / sum(powers)) for x in powers)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) >= target else (low, mid)
    found = mixing.exponent(spark.createDataFrame([(p,) for p in shares], "p double"), None, target)
    assert found == pytest.approx(high, abs=1e-9)
    assert mixing.exponent(spark.createDataFrame([], "p double"), None, target) == 1.0


def test_ties_and_rows_without_tokens(spark):
    rows = [(7, "same words here", "a")] * 6 + [(None, None, "a"), (1, "", None), (2, " \n", "b"), (3, "x y", "b"), (4, "many more words than there", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, df.columns, max_repetition=3.0).collect()
    assert len(out) == len(rows) and all(1 <= r.copies <= 3 for r in out)
    by = {r.doc.doc_id: r.copies for r in out}
    assert by[3] == 3 and sum(r.copies for r in out if r.src == "a" and r.n_tokens) == 6  # the smallest thrice, the largest once
    assert mixing.mix(df.limit(0), ["doc_id"]).count() == 0
