"""Quality by a generalised additive model with pairwise interactions.

Cyclic boosting: round after round each feature gets a shallow tree on the present residuals, which adds to
that feature's lookup table over bins; then the pairs of features whose joint tables explain most of what is left
get two-dimensional tables the same way.  A score is a sum of table entries.  Features are counted over whole
texts in NumPy; what executors apply is the tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import learning_sample, remainder
from .storage import materialise, small_batches
from .textvec import blocks, mix, words

#: Labelled documents of either class that are read, bins, boosting rounds, pairs, step.
SAMPLE, BINS, COARSE, ROUNDS, PAIRS, RATE = 10_000, 32, 8, 120, 6, 0.15
NAMES = ("log_bytes", "word_length", "symbols", "upper", "digits", "exclaims", "stops", "lines", "wide", "repeats", "distinct", "windows", "marks")
_KINDS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&|<>", "!?", ".,;:", " \t\r\x0b\x0c", "\n"), 1):
    for _c in _chars:
        _KINDS[ord(_c)] = _k
_KINDS[128:] = 9


def features(texts: pa.Array) -> np.ndarray:
    """One row of NAMES per text; all zeros for a text without bytes."""
    out = np.zeros((len(texts), len(NAMES)))
    for first, data, offsets in blocks(texts):
        kinds = _KINDS[data]
        hashes, _, at = words(data, offsets)
        eight = np.zeros(max(0, len(hashes) - 7), np.uint64)
        for k in range(8):
            eight = mix(eight + hashes[k : k + len(eight)])
        for i in range(len(offsets) - 1):
            size = int(offsets[i + 1] - offsets[i])
            if not size:
                continue
            c = np.bincount(kinds[offsets[i] : offsets[i + 1]], minlength=10).astype(float)
            own = hashes[at[i] : at[i + 1]]
            n = len(own)
            letters = max(1.0, size - c[7] - c[8])
            grams = eight[at[i] : max(at[i], at[i + 1] - 7)]
            out[first + i] = (
                np.log1p(size), letters / max(1, n), c[4] / letters, c[1] / letters, c[3] / letters, c[5] / letters, c[6] / max(1, n), c[8] / max(1, n), c[9] / letters,
                (own[1:] == own[:-1]).mean() if n > 1 else 0.0, len(np.unique(own)) / max(1, n), 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0, c[0] / letters,
            )
    return out


@dataclass
class Additive:
    """Cuts and tables; ``pairs`` maps two features to a table over coarser bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Sums of table entries by bin."""
        out = np.full(len(x), self.base)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, j], "right")]
        for (i, j), table in self.pairs.items():
            out += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A shallow tree over ordered bins: the best ``leaves`` - 1 cuts one after another; its value for each bin."""
    edges = [0, len(gradient)]
    g, w = np.concatenate(([0], np.cumsum(gradient))), np.concatenate(([0], np.cumsum(weight)))
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1.0)
    for _ in range(leaves - 1):
        best = max(((gain(a, c) + gain(c, b) - gain(a, b), c) for a, b in zip(edges[:-1], edges[1:], strict=True) for c in range(a + 1, b)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(gradient))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1.0)
    return out


def _tree2(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree of depth two over a pair's bins: a cut along one feature, then one along the other on either side."""
    best, value = -1.0, np.zeros_like(gradient)
    for turn in (False, True):
        g, w = (gradient.T, weight.T) if turn else (gradient, weight)
        for c in range(1, len(g)):
            sides = [_tree(g[s].sum(0), w[s].sum(0), 2) for s in (slice(0, c), slice(c, None))]
            gain = sum((v * g[s].sum(0)).sum() for v, s in zip(sides, (slice(0, c), slice(c, None)), strict=True))
            if gain > best:
                out = np.vstack([np.tile(sides[0], (c, 1)), np.tile(sides[1], (len(g) - c, 1))])
                best, value = gain, out.T if turn else out
    return value


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Additive:
    """Cyclic boosting of the logistic loss, features first, then the strongest pairs."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    cuts, coarse = [_cuts(c, BINS) for c in x.T], [_cuts(c, COARSE) for c in x.T]
    model = Additive(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], coarse)
    fine, rough = ([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(k)] for k in (cuts, coarse))
    logit = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(fine):
            g, w = slopes()
            step = RATE * _tree(np.bincount(b, g, len(cuts[j]) + 1), np.bincount(b, w, len(cuts[j]) + 1))
            model.tables[j] += step
            logit += step[b]

    def table(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        cell = rough[i] * shape[1] + rough[j]
        g, w = slopes()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, w, shape[0] * shape[1]).reshape(shape)

    strength = {}
    for i in range(x.shape[1]):
        for j in range(i):
            _, g, w = table(j, i)
            strength[j, i] = (g**2 / (w + 1)).sum()
    for pair in sorted(strength, key=strength.get, reverse=True)[:pairs]:
        model.pairs[pair] = np.zeros((len(coarse[pair[0]]) + 1, len(coarse[pair[1]]) + 1))
    for _ in range(rounds // 3):
        for pair, total in model.pairs.items():
            cell, g, w = table(*pair)
            step = RATE * _tree2(g, w)
            total += step
            logit += step.ravel()[cell]
    return model


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the features of each text; null counts as empty."""
    small_batches(docs.sparkSession)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.record_batch([batch.column(0), held], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measured, "doc_id long, x array<double>")


def train(measured: DataFrame, labels: DataFrame, parts: int = 3, held_out: int = 1, label: str = "quality") -> Additive | None:
    """Fit on a bounded sample of labelled rows outside the held-out part; None where they aren't of both classes.
    The sample keeps the classes' proportions by weight of the base rate."""
    sample = learning_sample(labels, label, parts, held_out, SAMPLE)
    rows = measured.join(F.broadcast(sample), "doc_id").select("x", "y").toPandas()  # at most 2 * SAMPLE ids
    if rows["y"].nunique() < 2:
        return None
    model = fit(np.array(rows["x"].tolist()), rows["y"].to_numpy(float))
    usable = labels.filter((remainder("doc_id", parts) != held_out) & F.col(label).cast("int").isin(0, 1))
    prior = float(usable.agg(F.avg(F.col(label).cast("double"))).first()[0])
    drawn = rows["y"].mean()
    model.base += np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))
    return model


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, parts: int = 3, held_out: int = 1) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Null and empty texts have features of zero; a null doc_id isn't held out; repeated rows score alike; without
    labels of both classes every score is 0.5; further columns are ignored; an empty table gives an empty result."""
    measured = materialise(measure(docs), "features")
    model = train(measured, labels, parts, held_out)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(NAMES))
            p = model.probability(x) if model else np.full(len(x), 0.5)
            yield pa.record_batch([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    out = measured.mapInArrow(scored, "doc_id long, score double")
    held = F.coalesce(remainder("doc_id", parts) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
