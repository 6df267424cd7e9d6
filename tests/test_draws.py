from collections import Counter

from paperloom.sources.pages import draw_with_replacement


def test_draws_are_exact_and_alike(spark):
    rows = [(k, f"r{k}") for k in range(500)] + [(7, "again"), (None, "x"), (None, "y")]
    table = spark.createDataFrame(rows, "id long, name string")
    draws = [Counter(map(tuple, draw_with_replacement(t, "id", 5000, seed=3, buckets=b).collect())) for t, b in ((table.repartition(1), 64), (table.repartition(9, "name"), 64))]
    assert draws[0] == draws[1] and sum(draws[0].values()) == 5000 and set(draws[0]) <= set(rows)
    assert 490 < len(draws[0]) and max(draws[0].values()) < 30
    assert draw_with_replacement(table, "id", 5000, seed=4).count() == 5000
    assert draw_with_replacement(table, "id", 0).count() == 0 and draw_with_replacement(table.filter("id < 0"), "id", 9).count() == 0
    assert draw_with_replacement(spark.range(3), "id", 10).count() == 10
