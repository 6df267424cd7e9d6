"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

A unit is the letters of a word, marks left out, or a run of single letters that stand apart ("i d i o t").  The kernel counts three-letter
subsequences that two units share, letters standing up to five places apart and each place of span costing a
factor; a unit's own norm depends on its length.  Inserted characters stretch a subsequence, they don't
destroy it.  Landmarks are units of labelled sentences; the linear machine on their Nystroem features is a
weighted sum of kernel values, and the kernel is a sum over subsequences, so that the fitted machine folds into
one table of weights by subsequence and span.  Scoring a text is then a pass over its bytes in NumPy: add the
table's entries at each place, sum by unit, take the document's largest unit, calibrate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import learning_sample, remainder
from .storage import materialise, small_batches
from .textvec import blocks

#: Labelled documents of either class that are read; units of labelled sentences that are read; landmarks of either class.
SAMPLE, UNITS, LANDMARKS = 6000, 24_000, 160
REACH, DECAY = 5, 0.7
#: Weight of good units against bad ones: a document has hundreds of units, and one of them decides.
NEGATIVE = 200.0
#: Letters of a unit up to which its norm follows from their number; letters of a glued sentence that is learnt from.
SHORT, GLUED = 24, 240
#: Letters of units whose kernel values are worked out at once.
PART = 4000
#: The value below which texts don't differ, also that of a text without units.
LEAST = -3.0
#: Characters that stand for letters.
LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
PATTERNS = [(a, b) for b in range(2, REACH + 1) for a in range(1, b)]


def _codes() -> np.ndarray:
    """Five-bit letters: 0 white space, 1-26 a-z, 27-30 parts of other letters, 31 anything else."""
    out = np.full(256, 31, np.uint8)
    for k in range(26):
        out[97 + k] = out[65 + k] = 1 + k
    for look, letter in LOOKS_LIKE.items():
        out[ord(look)] = ord(letter) - 96
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[128:192] = 28 + (np.arange(64) & 1)
    out[192:] = 30
    return out


CODE = _codes()


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of a block without marks and blanks, first letters and lengths of its units, and each row's first unit."""
    code = CODE[data]
    blank = code == 0
    first = np.ones(len(code), bool)
    first[1:] = blank[:-1]
    first[offsets[:-1][offsets[:-1] < len(code)]] = True
    starts = np.flatnonzero(first & ~blank)
    letter = ~blank & (code != 31)
    sizes = np.add.reduceat(letter, starts, dtype=np.int64) if len(starts) else starts
    starts, sizes = starts[sizes > 0], sizes[sizes > 0]
    if not len(starts):
        return code[:0], starts, starts, np.zeros(len(offsets), np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    single = sizes == 1
    heads = np.ones(len(starts), bool)  # but for single letters behind a single letter
    heads[1:] = ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))
    heads = np.flatnonzero(heads)
    sizes = np.add.reduceat(sizes, heads)
    return code[letter], np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes, np.searchsorted(starts[heads], offsets)


def length_norms(n: np.ndarray) -> np.ndarray:
    """Norms of units of ``n`` letters, whatever their length: the places of every pattern, each with its weight squared."""
    n = np.asarray(n)
    square = sum(np.maximum(0, n - b) * DECAY ** (2.0 * (b - 2)) for _, b in PATTERNS)
    return np.sqrt(np.maximum(square, 1.0))


def _subsequences(letters: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each pattern: its number, places where it lies within a unit, and the codes there."""
    unit = np.repeat(np.arange(len(begins), dtype=np.int32), sizes)
    high, wide = letters.astype(np.int32) << 10, letters.astype(np.int32)
    for b in range(2, REACH + 1):
        if len(letters) <= b:
            return
        inside = np.flatnonzero(unit[b:] == unit[:-b])
        ends = high[inside] | wide[inside + b]
        for a in range(1, b):
            yield PATTERNS.index((a, b)), inside, ends | (wide[inside + a] << 5)


def unit_scores(letters: np.ndarray, begins: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The machine's value of each unit, from the table of weights by pattern and subsequence."""
    at = np.zeros(len(letters), np.float32)
    for k, inside, code in _subsequences(letters, begins, sizes):
        at[inside] += table[k][code]
    if not len(begins):
        return np.zeros(0)
    return np.add.reduceat(at, begins).astype(np.float64) / unit_norms(letters, begins, sizes)


def unit_norms(letters: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Norms of units: by length, as few subsequences of a short one are alike; of more than SHORT letters, where they are many,
    from how often each stands in it."""
    out = length_norms(sizes)
    for unit in np.flatnonzero(sizes > SHORT).tolist():
        own = letters[begins[unit] : begins[unit] + sizes[unit]]
        found = list(_subsequences(own, np.zeros(1, np.int64), np.array([len(own)])))
        codes = np.concatenate([code for _, _, code in found])
        if len(codes) < 1 << 14:
            codes = np.unique(codes, return_inverse=True)[1]
        count = np.bincount(codes, np.concatenate([np.full(len(code), DECAY ** (PATTERNS[k][1] - 2)) for k, _, code in found]))
        out[unit] = max(1.0, np.sqrt(count @ count))
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse subsequence features of units as (unit, code, weight); a code's patterns add."""
    data, offsets = [], [0]
    for w in words:
        code = CODE[np.frombuffer(w.encode(), np.uint8)]
        data.append(code[(code != 31) & (code != 0)])
        offsets.append(offsets[-1] + len(data[-1]))
    sizes = np.diff(offsets)
    letters = np.concatenate(data) if data else np.zeros(0, np.uint8)
    unit = np.repeat(np.arange(len(words)), sizes)
    rows, codes, weights = [], [], []
    for k, inside, code in _subsequences(letters, np.array(offsets[:-1]), sizes):
        rows.append(unit[inside])
        codes.append(code)
        weights.append(np.full(len(code), DECAY ** (PATTERNS[k][1] - 2)))
    return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (rows, codes, weights))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values of units (rows) and landmarks (columns)."""
    rows, codes, weights = features(landmarks)
    dense = np.zeros((32768, len(landmarks)), np.float32)
    np.add.at(dense, (codes, rows), weights)
    dense /= norms(landmarks)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    letters = np.cumsum([len(w) for w in words])
    lo = 0
    while lo < len(words):  # parts of some letters bound the copies of the landmarks' rows
        hi = max(lo + 1, int(np.searchsorted(letters, (letters[lo - 1] if lo else 0) + PART)))
        part = words[lo:hi]
        r, c, w = features(part)
        if len(r):
            order = np.argsort(r, kind="stable")
            r, first = np.unique(r[order], return_index=True)
            out[r + lo] = np.add.reduceat(dense[c[order]] * w[order][:, None].astype(np.float32), first)
        out[lo:hi] /= norms(part)[:, None]
        lo = hi
    return out


def norms(words: list[str]) -> np.ndarray:
    own = [CODE[np.frombuffer(w.encode(), np.uint8)] for w in words]
    own = [c[(c != 31) & (c != 0)] for c in own]
    sizes = np.array([len(c) for c in own], np.int64)
    return unit_norms(np.concatenate(own) if own else np.zeros(0, np.uint8), np.cumsum(sizes) - sizes, sizes)


def disguised(words: list[str], times: int, seed: int = 11) -> list[str]:
    """Units with a letter put in or doubled, or one before or behind them, as evaders write them."""
    rng = np.random.default_rng(seed)
    out = []
    for w in words:
        for _ in range(times):
            k = int(rng.integers(0, len(w) + 1))
            extra = w[k - 1] if k and rng.random() < 0.3 else chr(97 + int(rng.integers(26)))
            out.append(w[:k] + extra + w[k:])
    return out


@dataclass(frozen=True)
class Machine:
    table: np.ndarray
    offset: float
    slope: float
    shift: float

    def documents(self, texts: pa.Array) -> np.ndarray:
        """The largest unit's value of each text; LEAST where it has no unit."""
        out = np.full(len(texts), -np.inf)
        for row, data, offsets in blocks(texts):
            letters, begins, sizes, at = units(data, offsets)
            if not len(begins):
                continue
            value = unit_scores(letters, begins, sizes, self.table)
            full = np.flatnonzero(at[1:] > at[:-1])
            if len(full):
                out[row + full] = np.maximum.reduceat(value, at[:-1][full])
        return np.maximum(out + self.offset, LEAST)

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


def train_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 4e5, steps: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the units inside the margin; ``y`` is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    del x
    weight = cost * weight / weight.sum()
    prior = np.ones(z.shape[1])
    prior[-1] = 1e-3
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        return float((prior * w * w).sum() / 2 + (weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        inside = y * (z @ w) < 1
        hessian, pull = np.diag(prior), np.zeros(len(w))
        for k in np.array_split(np.flatnonzero(inside), 1 + int(inside.sum()) // 4000):  # a part at a time bounds the copies
            za = z[k].astype(np.float64)
            hessian += (za * weight[k, None]).T @ za
            pull += za.T @ (weight[k] * y[k])
        step = np.linalg.solve(hessian, pull) - w
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-4:
            size /= 2
        w, done, now = w + size * step, now - new < 1e-7 * now, new
        if done:
            break
    return w[:-1], float(w[-1])


def fit_machine(words: list[str], y: np.ndarray, weight: np.ndarray, landmarks: list[str]) -> tuple[np.ndarray, float]:
    """The folded table and offset of a machine trained on units."""
    between = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    root = vectors @ np.diag(np.where(values > 1e-6 * values.max(), 1 / np.sqrt(np.maximum(values, 1e-12)), 0)) @ vectors.T
    w, offset = train_linear(kernel(words, landmarks) @ root.astype(np.float32), y, weight)
    beta = root @ w
    rows, codes, weights = features(landmarks)
    by_code = np.zeros(32768)
    np.add.at(by_code, codes, weights * (beta / norms(landmarks))[rows])
    return np.stack([by_code * DECAY ** (b - 2) for _, b in PATTERNS]).astype(np.float32), offset


def _values(machine: Machine):
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(machine.documents(batch.column(1)), pa.float64())], ["y", "value"])

    return values


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, label: str = "toxic") -> Machine:
    """Fit on a bounded sample of labelled documents outside the held-out part.

    Sentences of labelled documents carry their document's label; a unit's label comes from the sentences
    that hold it.  Without usable labels of both classes every score is 0."""
    spark = docs.sparkSession
    small_batches(spark)
    sample = learning_sample(labels, label, parts, held_out, SAMPLE)
    read = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text"))  # at most 2 * SAMPLE ids
    read = materialise(read, "sample")
    sentences = read.select("y", F.explode(F.split(F.lower("text"), r"[.!?]+[\x20\x09-\x0D]+|\n")).alias("s"))
    words = sentences.select("y", F.explode(F.array_distinct(F.split("s", r"[\x20\x09-\x0D.,;:!?()\"]+"))).alias("unit")).filter("length(unit) between 3 and 40")
    counts = words.groupBy("unit").agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good"))
    totals = read.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    none = Machine(np.zeros((len(PATTERNS), 32768), np.float32), 0.0, 0.0, -30.0)
    if not totals[0] or not totals[1]:
        return none
    marked = (F.col("bad") + 0.5) / (F.col("good") + 0.5) * (totals[1] / totals[0])
    counts = materialise(counts.withColumn("ratio", marked), "units")
    bad = counts.filter("ratio > 8 and good <= bad / 40 and bad >= 3").orderBy(F.desc("bad"), "unit").limit(UNITS // 16).toPandas()
    usual = counts.filter("good > 0 and ratio < 4")
    good = usual.orderBy(F.desc("good"), "unit").limit(UNITS // 4).unionByName(usual.orderBy(F.xxhash64("unit"), "unit").limit(UNITS * 3 // 4)).dropDuplicates(["unit"]).orderBy(F.desc("good"), "unit").toPandas()
    if bad.empty or good.empty:
        return none
    landmarks = [*bad["unit"][:LANDMARKS], *good["unit"][:: max(1, len(good) // LANDMARKS)][:LANDMARKS]]
    even = lambda n: np.sqrt(n) / np.sqrt(n).sum()
    hidden = disguised(list(bad["unit"][:LANDMARKS]), 5)
    # whole sentences of good documents without their blanks, as scripts without blanks and glued words come
    bare = sentences.filter("y = 0").select(F.regexp_replace("s", r"[\x20\x09-\x0D.,;:!?()\"]+", "").alias("unit")).filter(F.length("unit") > SHORT).distinct()
    glued = [r.unit[:GLUED] for r in bare.orderBy(F.xxhash64("unit"), "unit").limit(UNITS // 24).collect()]
    words = [*bad["unit"], *hidden, *good["unit"], *glued]
    weight = np.concatenate([even(bad["bad"]), np.full(len(hidden), 0.4 / len(hidden)), NEGATIVE * even(np.minimum(good["good"], 4)), np.full(len(glued), NEGATIVE / 20 / max(1, len(glued)))])
    table, offset = fit_machine(words, np.repeat([1.0, -1.0], [len(bad) + len(hidden), len(good) + len(glued)]), weight, landmarks)
    raw = Machine(table, offset, 1.0, 0.0)
    seen = read.select("y", "text").mapInArrow(_values(raw), "y int, value double").toPandas()
    slope, shift = calibrate(seen["value"].to_numpy(), seen["y"].to_numpy(), totals_prior(labels, label, parts, held_out))
    return Machine(table, offset, slope, shift)


def totals_prior(labels: DataFrame, label: str, parts: int, held_out: int) -> float:
    """The share of ones among the labels that may be learnt from."""
    return float(labels.filter(remainder("doc_id", parts) != held_out).agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)


def calibrate(value: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic slope and shift by Newton steps, with the sample's classes weighted to the prior."""
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    theta = np.array([1.0, 0.0])
    z = np.stack([value, np.ones(len(value))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 1e-2 * theta * [1, 0]
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        theta = theta - step * min(1.0, 4 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, parts: int = 4, held_out: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    Null and empty texts score as a text without units; a null doc_id isn't held out; repeated rows score
    alike; further columns are ignored; an empty table gives an empty result."""
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = machine.probability(machine.documents(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    held = F.coalesce(remainder("doc_id", parts) == held_out, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
