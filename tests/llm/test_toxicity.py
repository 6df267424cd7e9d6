import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import toxicity
from paperloom.llm.queries import tables


def plain_features(word):
    """Three-letter subsequences that span up to six places, weighted by what lies beyond three."""
    out = Counter()
    for i in range(len(word)):
        for b in range(2, toxicity.REACH + 1):
            for a in range(1, b):
                if i + b < len(word):
                    out[word[i] + word[i + a] + word[i + b]] += toxicity.DECAY ** (b - 2)
    return out


def test_long_units_have_their_own_norm():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 10, 24, 25, 64, 65, 400, 3000)]
    got = toxicity.norms(words)
    for word, norm in zip(words, got, strict=True):
        plain = plain_features(word)
        want = math.sqrt(sum(v * v for v in plain.values()))
        by_length = math.sqrt(max(1.0, sum(max(0, len(word) - b) * toxicity.DECAY ** (2 * (b - 2)) for _, b in toxicity.PATTERNS)))
        assert norm == pytest.approx(want if len(word) > toxicity.SHORT else by_length, rel=1e-6)
    between = toxicity.kernel(words, words)
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            fx, fy = plain_features(x), plain_features(y)
            assert between[i, j] == pytest.approx(sum(fx[k] * fy[k] for k in fx) / got[i] / got[j], rel=1e-4, abs=1e-6)
    long = [k for k, w in enumerate(words) if len(w) > toxicity.SHORT]
    assert between[np.ix_(long, long)].max() <= 1 + 1e-4


def test_texts_without_blanks_are_no_more_toxic(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels")
    machine = toxicity.train(docs, labels)
    clean = [r.text for r in docs.join(labels.filter("toxic = 0"), "doc_id").select("text").collect() if r.text]
    flagged = lambda texts: int((machine.probability(machine.documents(pa.array(texts))) >= 0.3).sum())
    assert flagged(["".join(t.split()) for t in clean]) <= flagged(clean) <= 0.05 * len(clean)
    toxic = [r.text for r in docs.join(labels.filter("toxic = 1"), "doc_id").select("text").collect()]
    assert flagged(toxic) >= 0.75 * len(toxic)
