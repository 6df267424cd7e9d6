import random
import re

import numpy as np
import pytest

from paperloom.llm.ngram_join import allocate, band_ends, representatives, signatures, similarity_classes

SCHEMA = "doc_id long, text string, lang string, n_shingles string, component_id double"


def sets_of(text, k):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return set()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)}


def brute(rows, k, percent):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def noisy(rng, words, many):
    out = list(words)
    for _ in range(many):
        at = rng.randrange(len(out) + 1)
        out[at : at + rng.choice([0, 1])] = [f"z{rng.randrange(10**6)}"] * rng.choice([0, 1])
    return out


def corpus(seed, sizes, copies):
    rng = random.Random(seed)
    rows = []
    for n in sizes:
        base = [f"w{rng.randrange(400)}" for _ in range(n)]
        rows += [" ".join(noisy(rng, base, rng.randrange(0, max(2, n // 12)))) for _ in range(copies)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def run(spark, rows, k, percent):
    df = spark.createDataFrame([(d, t, "en", "x", 0.5) for d, t in rows], SCHEMA)
    out = similarity_classes(df, k, percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rows = corpus(k, [5, 9, 14, 20, 30, 45, 70, 110, 200, 600], 9)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One  TWO"), (1005, rows[0][1]), (1005, rows[0][1]), (None, rows[3][1]), (None, "only here")]
    assert run(spark, rows, k, percent) == brute(rows, k, percent)


def test_chain_through_a_middle(spark):
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 4 * i] + [f"n{j}" for j in range(4 * i)] + base[4 * i :])) for i in range(6)]
    assert run(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_small_documents_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in similarity_classes(df).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_empty_table(spark):
    assert run(spark, [], 4, 85) == []


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(5)
    for n in (7, 8, 12, 19, 33, 60, 150, 700):
        for percent in (80, 85):
            for _ in range(30):
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                away = 2 * n * (100 - percent) // (100 + percent)
                drop = rng.integers(0, away + 1)
                b = np.concatenate([a[drop:], rng.integers(0, 2**63, rng.integers(0, away - drop + 1)).astype(np.uint64)])
                both, joint = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if 100 * both < percent * joint:
                    continue
                ends = band_ends(2 * n, percent)
                top = max(len(a), len(b))
                level = allocate(min(e for e in ends if e >= top), percent, 1000)
                if level is None:
                    assert set(a) == set(b)
                else:
                    assert np.intersect1d(signatures(np.unique(a), level), signatures(np.unique(b), level)).size


@pytest.mark.parametrize("sets", [10**8, 10**10])
def test_one_deletion_neighbourhoods_share_a_key(sets):
    """Where many sets meet by chance the allocation takes segments of allowance 1; linked pairs of any size in the band still meet."""
    rng = np.random.default_rng(7)
    near = 0
    for top in (12, 40, 150, 700):
        for percent in (80, 85):
            level = allocate(top, percent, sets)
            near += level.near
            for _ in range(60):
                n = int(rng.integers(top * percent // 100, top + 1))
                a = rng.integers(0, 2**63, n).astype(np.uint64)
                away = (n + top) * (100 - percent) // (100 + percent)
                drop = int(rng.integers(0, away + 1))
                b = np.concatenate([a[drop:], rng.integers(0, 2**63, rng.integers(0, away - drop + 1)).astype(np.uint64)])
                both, joint = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if 100 * both >= percent * joint and len(b) <= top:
                    assert np.intersect1d(signatures(np.unique(a), level), signatures(np.unique(b), level)).size
    assert near


def test_representatives_keep_one_row_of_each_component(spark):
    rows = corpus(3, [5, 12, 40, 120], 7)
    rows += [(900, None), (901, ""), (902, "\n "), (903, rows[0][1]), (903, rows[0][1]), (None, rows[1][1]), (None, "alone here"), (None, "alone here")]
    df = spark.createDataFrame([(d, t, 1, None, "x") for d, t in rows], "doc_id long, text string, hash long, none boolean, row string")
    out = representatives(df)
    assert out.columns == df.columns
    expected = {c for _, _, c in brute(rows, 5, 80)}
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted(expected, key=str)
    assert representatives(df.limit(0)).collect() == []
