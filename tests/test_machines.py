import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import machines, relevance


def rows(n=90, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        y = k % 3 == 0
        tokens = [rng.choice("abcdefghij" if y else "ghijklmnop") for _ in range(rng.randrange(12))]
        near = [] if k % 7 == 0 else [rng.choice(["u", "v", "w"] if y else ["v", "w", "x"]) for _ in range(4)]
        out.append((k, int(y), tokens, near))
    return out


def plain_features(data, used, sets):
    """TF-IDF of the rows ``used``'s vocabulary for all rows, and an intercept."""
    blocks = []
    for pick in sets:
        docs = [pick(r) for r in data]
        df = Counter(t for k in used for t in set(docs[k]))
        terms = sorted(t for t, n in df.items() if n >= 2)
        x = np.array([[d.count(t) * (math.log((1 + len(used)) / (1 + df[t])) + 1) for t in terms] for d in docs])
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        blocks.append(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0))
    return np.hstack([*blocks, np.ones((len(data), 1))])


def plain_svm(x, y):
    """Newton's method for |w|^2 / 2 + sum max(0, 1 - y x w)^2."""
    w = np.zeros(x.shape[1])
    value = lambda w: w @ w / 2 + (np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    for _ in range(100):
        on = 1 - y * (x @ w) > 0
        gradient = w - 2 * (x[on].T @ ((1 - y * (x @ w)) * y)[on])
        step, t = np.linalg.solve(np.eye(len(w)) + 2 * x[on].T @ x[on], gradient), 1.0
        while value(w - t * step) > value(w) and t > 1e-9:
            t /= 2
        w = w - t * step
    return w, value(w)


def plain_platt(f, y):
    high, low = ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2)
    t, a, b = np.where(y == 1, high, low), 0.0, math.log(((y == 0).sum() + 1) / ((y == 1).sum() + 1))
    for _ in range(20_000):  # plain descent
        p = 1 / (1 + np.exp(a * f + b))
        a, b = a - 0.05 * ((t - p) * f).sum(), b - 0.05 * (t - p).sum()
    return a, b


def pairs(near):
    return near + [f"{a} {b}" for a, b in zip(near, near[1:], strict=False)]


@pytest.mark.parametrize("part", [2000, 45])
def test_machines_reach_the_optimum(spark, monkeypatch, part):
    monkeypatch.setattr(machines, "PART", part)
    data = rows()
    folds = [(-1 if k % 4 == 0 else k % 3, k % 3) for k in range(len(data))]
    read = spark.createDataFrame([(k, y, list(f), t, pairs(n)) for (k, y, t, n), f in zip(data, folds, strict=True)], "row long, label long, folds array<int>, tokens array<string>, near array<string>")
    uses = np.array([[True, True], [True, False]])
    made, margins = machines.train(read, ["tokens", "near"], 2, 3, uses, tolerance=1e-6, sweeps=400)
    got = {r.row: r.margins for r in margins.collect()}
    y = np.array([2 * r[1] - 1 for r in data])
    for o, sets in enumerate(([lambda r: r[2], lambda r: pairs(r[3])], [lambda r: r[2]])):
        used = [k for k, f in enumerate(folds) if f[o] >= 0]
        x = plain_features(data, used, sets)
        for k in range(3):
            learn = np.array([i for i in used if folds[i][o] != k])
            w, best = plain_svm(x[learn], y[learn])
            assert best <= made.primal[o, k] * (1 + 1e-9) and made.primal[o, k] <= best * (1 + 1e-3)
            assert np.abs(np.array([got[i][o * 3 + k] for i in range(len(data))]) - x @ w).max() < 0.02
            held = np.array([i for i in used if folds[i][o] == k])
            f, one = np.array([got[i][o * 3 + k] for i in held]), (y[held] > 0).astype(int)
            a, b = plain_platt(f, one)
            chance = lambda a, b: 1 / (1 + np.exp(a * f + b))  # noqa: B023, E731
            assert chance(made.slope[o, k], made.shift[o, k]) == pytest.approx(chance(a, b), abs=1e-3)
    assert (made.gap <= 1e-6 * made.primal).all()


def test_scores_in_pieces_of_the_vocabulary(spark, monkeypatch, tmp_path):
    data = rows(60, 2)
    table = spark.createDataFrame([(k, y, t, n, "ab"[k % 2], "kept") for k, y, t, n in data], "block_id long, label long, tokens array<string>, context array<string>, word_type string, score string")
    models, held = relevance.family_machines(table, {"a": "context", "b": "context"}, folds=3)
    assert held.count() == 60 and held.filter("probability <= 0 or probability >= 1 or fold not in (0, 1, 2)").count() == 0
    blocks = table.drop("label", "word_type").unionByName(spark.createDataFrame([(99, None, None, None), (None, ["never"], ["u", "u"], "x")], "block_id long, tokens array<string>, context array<string>, score string"))
    once = {r.block_id: r.p for r in models["b"].score(blocks, "p").collect()}
    monkeypatch.setattr(machines, "HELD_TERMS", 4)
    assert {r.block_id: r.p for r in models["b"].score(blocks, "p").collect()} == pytest.approx(once)
    assert len(once) == 62 and all(0 < p < 1 for p in once.values())
    models["b"].save(str(tmp_path / "m"))
    assert {r.block_id: r.p for r in relevance.CalibratedSVM.load(str(tmp_path / "m")).score(blocks, "p").collect()} == pytest.approx(once)
    own = models["b"].machines
    used = [k for k, *_ in data if k % 2]
    x = plain_features(data, used, [lambda r: r[2], lambda r: pairs(r[3])])
    assert own.weights.shape[0] == x.shape[1]
    want = (1 / (1 + np.exp((x @ own.weights[:, 0]) * own.slope[0] + own.shift[0]))).mean(1)
    assert [once[k] for k, *_ in data] == pytest.approx(want.tolist())


def test_out_of_fold_scores_leave_their_fold_out(spark):
    data = rows(60, 3)
    table = spark.createDataFrame([(k, y, t, n) for k, y, t, n in data], "block_id long, label long, tokens array<string>, context array<string>")
    got = relevance.out_of_fold(table, folds=3).collect()
    assert sorted(r.block_id for r in got) == list(range(60))
    fold = {r.block_id: r.fold for r in got}
    # another label of a row changes no score of its own fold
    other = spark.createDataFrame([(k, y, ["zz"] * 3 if fold[k] == 0 else t, n) for k, y, t, n in data], table.schema)
    again = {r.block_id: r for r in relevance.out_of_fold(other, folds=3).collect()}
    outer = [r for r in got if r.fold == 0]
    assert all(again[r.block_id].fold == 0 for r in outer)
    alone = relevance.out_of_fold(other, folds=3).filter("fold = 0").agg(F.countDistinct("score")).first()[0]
    assert alone <= len(outer)


def test_rank_metrics_equal_all_pairs(spark):
    rng = random.Random(4)
    data = [(f, rng.randrange(2), rng.choice([0.1, 0.25, 0.25001, 0.5, 0.75, rng.random(), 1.0, 0.0])) for f in (0, 1, 2) for _ in range(80)] + [(3, 1, 0.4), (4, 0, 0.9)]
    out = {r.fold: r for r in relevance.rank_metrics(spark.createDataFrame(data, "fold int, label int, score double"), buckets=4).collect()}
    for f in range(5):
        ones, zeros = ([s for g, y, s in data if g == f and y == w] for w in (1, 0))
        wins = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
        hit, false = sum(s > 0.5 for s in ones), sum(s > 0.5 for s in zeros)
        want = ((hit + len(zeros) - false) / (len(ones) + len(zeros)), hit / (hit + false) if hit + false else 0, hit / len(ones) if ones else 0, 2 * hit / (hit + false + len(ones)) if hit + false + len(ones) else 0)
        assert tuple(out[f])[1:5] == pytest.approx(want)
        assert out[f].roc_auc == (pytest.approx(wins / (len(ones) * len(zeros))) if ones and zeros else None)


def test_samples_are_bounded(spark):
    table = spark.createDataFrame([(k, int(k < 5)) for k in range(3000)] + [(9000, None), (9001, 2)], "block_id long, label int")
    kept = {r[0]: r[1] for r in relevance.sampled(table, most=500).groupBy("label").count().collect()}
    assert kept[1] == 5 and 400 < kept[0] < 600 and set(kept) == {0, 1}


def test_all_labelled_blocks_are_learnt_from(spark, tmp_path):
    """Of either label about 2,000 rows were drawn."""
    from paperloom.plans.analysis_queries import training_rows

    spark.range(6000).selectExpr("id as doc_id", "'a text' as text").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(6000).selectExpr("id as doc_id", "cast(id % 4 > 0 as int) as quality", "0 as toxic").write.parquet(str(tmp_path / "labels.parquet"))
    assert {r[0]: r[1] for r in training_rows(spark, str(tmp_path)).groupBy("label").count().collect()} == {0: 4500, 1: 1500}
