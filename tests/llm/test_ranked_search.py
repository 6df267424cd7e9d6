import math
import random
import re
from collections import Counter

import pytest

from paperloom.llm import ranked_search as module
from paperloom.llm.ranked_search import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = []
    for item, text in items:
        asked, found = Counter(terms(text)), []
        for i, b in bags:
            tf = Counter(b)
            score = 0
            for t, r in asked.items():
                if t in tf:
                    m = 75 + 25 * len(b) * n_docs // n_terms
                    score += r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", "é", "ÉTÉ", "naïve", "x1", "KK"] + [f"w{int(rng.paretovariate(0.7))}" for _ in range(12)])
    text = lambda n: "".join(word() + rng.choice([" ", " ", "\n", ", ", "\x00", "-"]) for _ in range(n))
    docs = [(i, text(int(rng.paretovariate(0.8)) % 200 + 1)) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "-- !! "), (None, text(9)), (5, docs[5][1]), (n + 3, docs[7][1]), (n + 4, docs[7][1]), (n + 5, text(9000))]
    items = [(i, text(rng.choice([1, 3, 20, 60]))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (3, docs[7][1]), (None, "the w1 w1")]
    return docs, items


@pytest.mark.parametrize("k", [1, 3, 20])
def test_best_documents_equal_a_scan_of_all(spark, k):
    docs, items = corpus(k)
    got = ranked_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, k)


def test_blocks_of_items_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_TERMS", 60)
    monkeypatch.setattr(module, "CELLS", 500)
    docs, items = corpus(7, 60)
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, score int")
    got = ranked_search(rows, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 20)


def test_terms_are_pruned_only_below_the_threshold(spark):
    docs, items = corpus(11)
    asked = module.Asked([i for i, _ in items], [t for _, t in items])
    import numpy as np

    n = len(asked.terms)
    top, kth = np.full(n, 10, np.int64), np.full(n, 9, np.int64)
    plan = module.Plan(asked, np.ones(n, np.int64), np.arange(n), top, kth)
    for (places, repeats), threshold, bound, pruned in zip(asked.items, plan.threshold, plan.bound, plan.pruned, strict=True):
        assert bound < threshold and (not len(places) or threshold == max(repeats) * 9)
        assert pruned < len(places) or not len(places)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search(docs, items).collect() == []
    assert ranked_search(items.withColumnRenamed("item_id", "doc_id"), items.filter("item_id > 1")).collect() == []
