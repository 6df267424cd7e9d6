import hashlib
import random
import re

import numpy as np
import pytest

from paperloom.llm import substring_index as module
from paperloom.llm.substring_index import LAST, FMIndex, WaveletMatrix, covered, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs):
    rows = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in docs]
    least = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            window = tuple(w[k : k + 13])
            least[window] = min(i, least.get(window, i))
    out = []
    for (doc, _), (i, w) in zip(docs, rows, strict=True):
        gone = {p for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, docs):
    rows = spark.createDataFrame([(i, t, "c", "m", 1) for i, t in docs], "doc_id long, text string, cleaned string, marks string, hash int").repartition(5)
    got = remove_repeats(rows, ["doc_id", "marks"]).collect()
    assert all(r.doc.marks == "m" for r in got)
    return sorted(((r.doc.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.cleaned.encode()).hexdigest()) for r in got), key=repr)


def corpus(seed, n=120, vocabulary=3000):
    rng = random.Random(seed)
    words = lambda k, v=vocabulary: [f"w{rng.randrange(v)}" for _ in range(k)]
    passages = [words(k) for k in (13, 14, 15, 20, 40, 55, 12, 200)]
    docs = []
    for i in range(n):
        parts = words(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            parts += p[: rng.choice([len(p), len(p), 13])] + words(rng.randrange(30))
        docs.append((rng.randrange(n) if i % 5 == 0 else i + 1000, rng.choice([" ", "\n", " \t\x0b", "\r\n"]).join(parts)))
    few = [(5000 + i, " ".join(words(rng.randrange(10, 90), 3))) for i in range(20)]  # periodic text
    odd = [(None, docs[3][1]), (None, None), (9000, None), (9001, ""), (9002, " \n"), (9003, "é😀 " * 40), (9004, "é😀 " * 13), (9005, "a\x00b A a " * 9), (docs[4][0], docs[4][1]), (docs[4][0], docs[4][1]), (docs[5][0], docs[6][1])]
    return docs + few + odd + [(9100 + k, docs[7][1]) for k in range(30)] + [(9200, " ".join(words(30_000)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_words_equal_a_table_of_all_windows(spark, seed):
    docs = corpus(seed)
    assert found(spark, docs) == plain(docs)


def test_small_shards_crowded_anchors_and_hot_pieces(spark, monkeypatch):
    docs = corpus(3)
    passage = " ".join(f"p{k}" for k in range(30))
    rng = random.Random(5)
    own = lambda: " ".join(f"q{rng.randrange(10**6)}" for _ in range(20))
    docs += [(20_000 + k, f"{own()} {passage} {own()}") for k in range(60)]
    monkeypatch.setattr(module, "SHARD", 300)
    monkeypatch.setattr(module, "CROWD", 10)
    monkeypatch.setattr(module, "HOT", 1)
    assert found(spark, docs) == plain(docs)


def test_pieces_in_many_places_meet_no_join(spark, monkeypatch):
    rng = random.Random(6)
    own = lambda: " ".join(f"q{rng.randrange(10**6)}" for _ in range(15))
    passages = [" ".join(f"p{a}x{k}" for k in range(30)) for a in range(3)]
    docs = corpus(4) + [(20_000 + k, f"{own()} {passages[k % 3]} {own()}") for k in range(120)]
    told, real = [], module._pieces

    def pieces(shared, hot=None):
        told.append(hot)
        return real(shared, hot)

    monkeypatch.setattr(module, "OFTEN", 30)
    monkeypatch.setattr(module, "_pieces", pieces)
    assert found(spark, docs) == plain(docs)
    assert told[0] is None and 0 < len(told[1]) <= module.HOT


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string"), ["doc_id"]).collect() == []


def test_ranks_equal_counts():
    rng = np.random.default_rng(1)
    for n, most in ((1, 1), (63, 2), (64, 7), (65, 1), (1000, 300)):
        symbols = rng.integers(0, most + 1, n)
        symbols[0] = most
        tree = WaveletMatrix(symbols, most)
        at, c = rng.integers(0, n + 1, 200), rng.integers(0, most + 1, 200)
        assert tree.rank(c, at).tolist() == [int((symbols[:a] == x).sum()) for a, x in zip(at, c, strict=True)]


def test_backward_search_counts_occurrences():
    rng = np.random.default_rng(2)
    sizes = rng.integers(13, 33, 40)
    symbols = rng.integers(1, 4, sizes.sum())
    index = FMIndex(symbols, sizes, np.arange(40))
    rows = np.split(symbols, np.cumsum(sizes)[:-1])
    for length in (1, 2, 4, 7):
        pattern = rows[3][2 : 2 + length]
        low, high = np.array([0]), np.array([index.size])
        for c in pattern[::-1]:
            low, high = index.backward(np.array([c]), low, high)
        owners = [k for k, r in enumerate(rows) for p in range(len(r) - length + 1) if (r[p : p + length] == pattern).all()]
        assert (high - low).tolist() == [len(owners)] and index.least_owner(low, high).tolist() == [min(owners)]


def test_covered_words_equal_a_search():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 50, 400).astype(np.uint64)
    pieces = []
    for _ in range(60):
        a, n = rng.integers(0, 360), rng.integers(13, 33)
        own = base[a : a + n].copy()
        if rng.random() < 0.5:
            own[rng.integers(0, len(own))] = 99
        pieces.append(own)
    owners = rng.integers(0, 30, 60)
    got = covered(np.concatenate(pieces), np.array([len(p) for p in pieces]), owners)
    for k, own in enumerate(pieces):
        earlier = {tuple(p[j : j + 13]) for p, o in zip(pieces, owners, strict=True) if o < owners[k] for j in range(len(p) - 12)}
        want = 0
        for j in range(len(own) - 12):
            if tuple(own[j : j + 13]) in earlier:
                want |= 8191 << j
        assert int(got[k]) == want
