"""Many linear support vector machines at once: squared hinge, C = 1, regularised intercept, calibrated by folds.

Training rows are encoded once: places in one vocabulary and counts.  A *space* is a training set with its own document
frequencies (a fold left out, a family); within it each inner fold has a machine of its own.  All machines of all spaces
are trained together.  Up to ``PART`` rows are one part, which goes through its dual coordinates for all machines at a time, a sweep
or two.  More rows are trained by Newton steps in the primal, whose equations conjugate gradients solve: each pass over the rows
sums one gradient or one product with the second derivatives, batch by batch, and no task or driver holds rows or duals.  Primal
and dual objectives of the same pass bound the distance to the optimum, and training ends when that is small for every machine.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import remove, shuffles_removed, written
from .scripts import sliced, small_batches

#: Rows that one task trains on by their duals, and passes over them within a sweep; more rows are trained by Newton steps.
PART, EPOCHS = 5000, 12
#: Most products that the equations of one Newton step take, and the share of the gradient that they may leave.
PRODUCTS, LEFT = 30, 0.1
#: Numbers of a sum that a task hands on at a time.
CHUNK = 1 << 16
#: Terms of a model that a task holds at once when it scores; larger models are scored in as many passes as it takes.
HELD_TERMS = 2_000_000


@dataclass
class Machines:
    """Weights of the machines of each space: ``terms`` by column (sorted), ``idf`` (terms x spaces), ``weights`` (terms and intercept
    x spaces x folds), and the calibration 1 / (1 + exp(slope margin + shift))."""

    columns: tuple[str, ...]
    terms: list[pa.Array]
    idf: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    primal: np.ndarray
    gap: np.ndarray

    @property
    def bases(self) -> list[int]:
        return np.cumsum([0, *(len(t) for t in self.terms)]).tolist()

    def space(self, o: int, columns: Sequence[str] | None = None) -> Machines:
        """The machines of one space, without the terms that they don't use."""
        kept = [np.flatnonzero(self.idf[a:b, o] > 0) for a, b in zip(self.bases[:-1], self.bases[1:], strict=True)]
        rows = np.concatenate([k + a for k, a in zip(kept, self.bases[:-1], strict=True)]).astype(np.int64)
        one = slice(o, o + 1)
        return Machines(
            tuple(columns or self.columns), [t.take(pa.array(k)) for t, k in zip(self.terms, kept, strict=True)], self.idf[rows][:, one],
            self.weights[np.append(rows, len(self.idf))][:, one], self.slope[one], self.shift[one], self.primal[one], self.gap[one],
        )

    def save(self, path: str) -> None:
        """Write the machines below ``path``."""
        spark, shape = SparkSession.getActiveSession(), list(self.weights.shape)
        of = np.repeat(np.arange(len(self.terms)), [len(t) for t in self.terms])
        table = pa.table({
            "place": np.arange(len(self.weights)), "part": np.append(of, -1), "term": pa.concat_arrays([*(t.cast(pa.string()) for t in self.terms), pa.array([""])]),
            "idf": _lists(np.vstack([self.idf, np.zeros((1, shape[1]))])), "weights": _lists(self.weights.reshape(shape[0], -1)),
        })
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{path}/terms")
        flat = [(list(self.columns), shape, *(x.ravel().tolist() for x in (self.slope, self.shift, self.primal, self.gap)))]
        schema = "columns array<string>, shape array<int>, slope array<double>, shift array<double>, primal array<double>, gap array<double>"
        spark.createDataFrame(flat, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/machines")

    @classmethod
    def load(cls, path: str) -> Machines:
        spark = SparkSession.getActiveSession()
        one = spark.read.parquet(f"{path}/machines").first()
        table = spark.read.parquet(f"{path}/terms").toArrow().sort_by("place")
        part, term = table["part"].to_numpy(), table["term"].combine_chunks()
        matrix = lambda name: pc.list_flatten(table[name].combine_chunks()).to_numpy().reshape(len(part), -1)
        folds = [np.array(one[n]).reshape(one.shape[1:]) for n in ("slope", "shift", "primal", "gap")]
        return cls(tuple(one.columns), [term.filter(pa.array(part == k)) for k in range(len(one.columns))], matrix("idf")[:-1].copy(), matrix("weights").reshape(one.shape).copy(), *folds)

    def table(self, spark: SparkSession, o: int = 0) -> DataFrame:
        """(part, term, idf, weights) of one space, the intercept last, with a null part."""
        of = [c for c, t in zip(self.columns, self.terms, strict=True) for _ in range(len(t))]
        rows = pa.table({
            "part": pa.array([*of, None], pa.string()), "term": pa.concat_arrays([*(t.cast(pa.string()) for t in self.terms), pa.array([""])]),
            "idf": pa.array(np.append(self.idf[:, o], 1.0)), "weights": _lists(self.weights[:, o]),
        })
        return spark.createDataFrame(rows)

    def score(self, rows: DataFrame, outs: str | Sequence[str] = "score", keep: Sequence[str] | None = None) -> DataFrame:
        """Add, for each space, the mean of its folds' probabilities of label 1, under the names ``outs``; a null array counts as empty.
        ``keep``: the columns that stay, all by default."""
        names, outs = list(rows.columns if keep is None else keep), [outs] if isinstance(outs, str) else list(outs)
        spaces, size = self.weights.shape[1:]
        bases, most = self.bases, max([1, *(len(t) for t in self.terms)])
        state = [f"__{c}{k}" for c in ("dot", "norm") for k in range(len(self.terms))]
        kept = list(dict.fromkeys([*names, *self.columns]))
        types = dict(rows.dtypes)
        scored = small_batches(rows).select(*kept)
        for at in range(0, most, HELD_TERMS):
            part = [t.slice(at, HELD_TERMS) for t in self.terms]
            spans = [slice(min(a + at, b), min(a + at + HELD_TERMS, b)) for a, b in zip(bases[:-1], bases[1:], strict=True)]
            held = rows.sparkSession.sparkContext.broadcast((part, [self.idf[x] for x in spans], [self.weights[:-1][x] for x in spans]))
            now = kept if at + HELD_TERMS < most else names
            made = ", ".join([*(f"`{c}` {types[c]}" for c in now), *(f"{x} array<double>" for x in state)])
            scored = scored.mapInArrow(_dots(held, self.columns, now, state, spaces, size, at > 0), made)
        found = []
        for o, out in enumerate(outs):
            total = F.lit(0.0)
            for k in range(size):
                margin = F.lit(float(self.weights[-1, o, k]))
                for c in range(len(self.terms)):
                    norm = F.get(F.col(f"__norm{c}"), F.lit(o))
                    margin = margin + F.when(norm > 0, F.get(F.col(f"__dot{c}"), F.lit(o * size + k)) / F.sqrt(norm)).otherwise(0.0)
                total = total + 1 / (1 + F.exp(margin * float(self.slope[o, k]) + float(self.shift[o, k])))
            found.append((total / size).alias(out))
        return scored.select(*names, *found)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows).ravel()))


def _places(terms: pa.Array, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in ``terms`` and count of the known terms of a column of arrays, in that order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    found = pc.index_in(pc.list_flatten(column), terms)
    row = np.repeat(np.arange(len(sizes)), sizes)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    key = row[known] * (len(terms) + 1) + found.drop_null().to_numpy().astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key // (len(terms) + 1), key % (len(terms) + 1), count


def _dots(held, columns: Sequence[str], names: list[str], state: list[str], spaces: int, size: int, goes_on: bool):
    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, weights = held.value
        for batch in sliced(batches):
            sums, norms, n = [], [], len(batch)
            for c, name in enumerate(columns):
                row, place, count = _places(terms[c], batch.column(name))
                value = count[:, None] * idf[c][place]
                # whole numbers where there is none
                norm = np.stack([np.bincount(row, value[:, o] ** 2, n) for o in range(spaces)], 1).astype(np.float64)
                dot = np.stack([np.bincount(row, value[:, o] * weights[c][place, o, k], n) for o in range(spaces) for k in range(size)], 1).astype(np.float64)
                if goes_on:
                    norm = norm + np.array(batch.column(f"__norm{c}").to_pylist()).reshape(n, -1)
                    dot = dot + np.array(batch.column(f"__dot{c}").to_pylist()).reshape(n, -1)
                for lists, values in ((sums, dot), (norms, norm)):
                    lists.append(_lists(values))
            yield pa.record_batch([*(batch.column(x) for x in names), *sums, *norms], [*names, *state])

    return dots


def _encode(held, columns: Sequence[str], parts: int):
    """Training rows as ``row``, ``part``, ``y``, ``folds``, places in the vocabulary and counts."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        bases = np.cumsum([0, *(len(t) for t in terms)])
        for batch in sliced(batches):
            found = [_places(t, batch.column(c)) for t, c in zip(terms, columns, strict=True)]
            row = np.concatenate([f[0] for f in found])
            order = np.argsort(row, kind="stable")
            place = np.concatenate([f[1] + b for f, b in zip(found, bases, strict=False)])[order]
            count = np.concatenate([f[2] for f in found])[order]
            starts = pa.array(np.searchsorted(row[order], np.arange(len(batch) + 1)).astype(np.int32))
            number = batch.column("row")
            part = (number.to_numpy() % parts).astype(np.int32)
            lists = [pa.ListArray.from_arrays(starts, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(starts, pa.array(count.astype(np.float32)))]
            yield pa.record_batch([number, pa.array(part), batch.column("y"), batch.column("folds"), *lists], ["row", "part", "y", "folds", "places", "counts"])

    return encode


def _values(places: np.ndarray, counts: np.ndarray, starts: np.ndarray, idf: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """TF-IDF of the encoded terms in every space, of length one for each row and column."""
    values = counts[:, None] * idf[places]
    column = np.searchsorted(bases, places, "right") - 1
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = row * len(bases) + column
    norm = np.stack([np.sqrt(np.bincount(key, values[:, o] ** 2, len(bases) * (len(starts) - 1))) for o in range(values.shape[1])], 1)[key]
    return np.divide(values, norm, out=np.zeros_like(values), where=norm > 0)


def _loaded(batches: list[pa.RecordBatch], idf: np.ndarray, bases: np.ndarray, spaces: int):
    whole = pa.Table.from_batches(batches).combine_chunks().sort_by("row")
    lists = whole["places"].combine_chunks()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)
    places, counts = pc.list_flatten(lists).to_numpy(), pc.list_flatten(whole["counts"].combine_chunks()).to_numpy().astype(np.float64)
    folds = pc.list_flatten(whole["folds"].combine_chunks()).to_numpy().reshape(-1, spaces)
    return whole["row"].to_numpy(), whole["y"].to_numpy(), folds, starts, places, _values(places, counts, starts, idf, bases)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    by: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        part = batch.column("part")
        for k in pc.unique(part).to_pylist():
            by.setdefault(k, []).append(batch.filter(pc.equal(part, k)))
    yield from (by[k] for k in sorted(by))


def local_pass(y, train, starts, places, values, weights, alpha, cost: float, scale: float, epochs: int, seed: int):
    """Coordinate steps over the duals ``alpha`` (rows x spaces x folds) of one part against ``weights`` (terms, then the intercept); returns
    the primal losses before, the new duals, the places used and the change of their weights."""
    used, local = np.unique(places, return_inverse=True)
    start = weights[np.append(used, len(weights) - 1)]
    now, alpha = start.copy(), alpha.copy()
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    norms = np.stack([np.bincount(row, values[:, o] ** 2, len(y)) for o in range(values.shape[1])], 1) + 1.0
    diagonal = scale * norms[:, :, None] + 1 / (2 * cost)
    loss, rng = np.zeros(weights.shape[1:]), np.random.default_rng(seed)
    margin = lambda at, x: np.einsum("jo,jok->ok", x, now[at]) + now[-1]
    rows = [(local[a:b], values[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    for i, (at, x) in enumerate(rows):
        loss += train[i] * np.maximum(0, 1 - y[i] * margin(at, x)) ** 2
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            step = np.maximum(-alpha[i], (1 - y[i] * margin(at, x) - alpha[i] / (2 * cost)) / diagonal[i]) * train[i]
            largest = np.abs(step).max()
            if largest > 1e-12:
                moved = max(moved, largest)
                alpha[i] += step
                change = scale * y[i] * step
                now[at] += x[:, :, None] * change
                now[-1] += change
        if moved < 1e-7 * cost:
            break
    return loss, alpha, used, (now - start) / scale


def _sweep(held, bases: np.ndarray, cost: float, scale: float, sweep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weights, ids, duals = held.value
        spaces, folds = weights.shape[1:]
        for batch in _parts(batches):
            number, y, fold, starts, places, values = _loaded(batch, idf, bases, spaces)
            train = (fold[:, :, None] >= 0) & (fold[:, :, None] != np.arange(folds))
            mine = np.searchsorted(ids, number)
            loss, alpha, used, change = local_pass(y, train, starts, places, values, weights, duals[mine], cost, scale, EPOCHS, int(number[0]) * 1000 + sweep)
            rows = [(0, np.array([0]), loss.reshape(1, -1)), (1, number, alpha.reshape(len(alpha), -1)), (2, np.append(used, len(weights) - 1), change.reshape(len(change), -1))]
            for kind, at, what in rows:
                columns = [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int64)), *(pa.array(np.ascontiguousarray(what[:, k])) for k in range(what.shape[1]))]
                yield pa.record_batch(columns, ["kind", "at", *(f"v{k}" for k in range(what.shape[1]))])

    return run


def _dot(values: np.ndarray, places: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Products of the rows with each column of ``weights`` (terms, then the intercept)."""
    out = np.repeat(weights[-1:], len(starts) - 1, 0)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] += np.add.reduceat(values[:, None] * weights[places], starts[full], axis=0)
    return out


def _margins(held, bases: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, weights = held.value
        for batch in sliced(batches):
            number, _, _, starts, places, values = _loaded([batch], idf, bases, weights.shape[1])
            out = np.hstack([_dot(values[:, o], places, starts, weights[:, o]) for o in range(weights.shape[1])])
            yield pa.record_batch([pa.array(number), _lists(out)], ["row", "margins"])

    return run


def _own_rows(batch: pa.RecordBatch, idf: np.ndarray, own: list[np.ndarray], bases: np.ndarray) -> Iterator[tuple]:
    """Of each space its rows: the space, labels, folds, starts, places among the space's own terms and values."""
    lists = batch.column("places")
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    places, counts = pc.list_flatten(lists).to_numpy(), pc.list_flatten(batch.column("counts")).to_numpy().astype(np.float64)
    y, folds = batch.column("y").to_numpy(), pc.list_flatten(batch.column("folds")).to_numpy().reshape(len(batch), -1)
    row = np.repeat(np.arange(len(batch)), sizes)
    for o in range(idf.shape[1]):
        mine = folds[:, o] >= 0
        if mine.any():
            at = np.flatnonzero(mine[row] & (own[o][places] >= 0))
            starts = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=len(batch))[mine])])
            yield o, y[mine, None], folds[mine, o], starts, own[o][places[at]], _values(places[at], counts[at], starts, idf[:, o : o + 1], bases)[:, 0]


def _sums(held, now, along, bases: np.ndarray, folds: int, cost: float):
    """Sums over a task's rows at the weights ``now`` (the terms and intercept of each space after the other, folds), in pieces of one flat
    array: the slacks and their squares, the duals' weights and the diagonal of the second derivatives; with ``along`` their
    product with that alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (idf, own, ends), weights = held.value, now.value
        ahead = None if along is None else along.value
        slack, total = np.zeros((2, len(own), folds)), np.zeros((2 if ahead is None else 1, *weights.shape))
        for batch in sliced(batches, 1000):
            for o, y, fold, starts, places, values in _own_rows(batch, idf, own, bases):
                begin, end = ends[o] + 1, ends[o + 1]
                left = np.where(fold[:, None] != np.arange(folds), np.maximum(0, 1 - y * _dot(values, places, starts, weights[begin : end + 1])), 0)
                order = np.argsort(places, kind="stable")
                place, value, row = places[order], values[order], np.repeat(np.arange(len(y)), np.diff(starts))[order]
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
                if ahead is None:
                    slack[:, o] += left.sum(0), (left**2).sum(0)
                    parts = [(2 * cost * left * y, value), (2 * cost * (left > 0), value**2)]
                else:
                    parts = [(2 * cost * (left > 0) * _dot(values, places, starts, ahead[begin : end + 1]), value)]
                for k, (each, by) in enumerate(parts):
                    if len(first):
                        total[k, begin + place[first]] += np.add.reduceat(by[:, None] * each[row], first, axis=0)
                    total[k, end] += each.sum(0)
        flat = np.concatenate([*([slack.ravel()] if ahead is None else []), total.ravel()])
        for at in range(0, len(flat), CHUNK):
            yield pa.record_batch([pa.array([at]), pa.array([flat[at : at + CHUNK].tobytes()])], ["at", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, sums in zip(batch.column("at").to_pylist(), batch.column("sums"), strict=True):
            part = np.frombuffer(sums.as_buffer(), np.float64)
            found[at] = found[at] + part if at in found else part.copy()
    for at, part in found.items():
        yield pa.record_batch([pa.array([at]), pa.array([part.tobytes()])], ["at", "sums"])


def _in_one_part(blocks: DataFrame, idf: np.ndarray, bases: np.ndarray, folds: int, cost: float, tolerance: float, sweeps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`newton`, by the duals of rows that one task holds."""
    context, spaces = blocks.sparkSession.sparkContext, idf.shape[1]
    ids = np.sort(blocks.select("row").toArrow()["row"].to_numpy())
    weights, duals = np.zeros((len(idf) + 1, spaces, folds)), np.zeros((len(ids), spaces, folds))
    flat = [f"v{k}" for k in range(spaces * folds)]
    kinds = "kind int, at long, " + ", ".join(f"{v} double" for v in flat)
    primal = gap = np.zeros((spaces, folds))
    for sweep in range(sweeps + 1):
        held = context.broadcast((idf, weights, ids, duals))
        out = blocks.mapInArrow(_sweep(held, bases, cost, 1, sweep), kinds).groupBy("kind", "at").agg(*[F.sum(v).alias(v) for v in flat]).toArrow()
        held.destroy()
        kind, at = out["kind"].to_numpy(), out["at"].to_numpy()
        losses, rows_at, terms_at = kind == 0, np.searchsorted(ids, at[kind == 1]), at[kind == 2]
        size = np.einsum("jok,jok->ok", weights, weights)
        loss = np.array([out[v].to_numpy()[losses].sum() for v in flat]).reshape(spaces, folds)
        primal = size / 2 + cost * loss
        gap = primal - (duals.sum(0) - size / 2 - (duals**2).sum(0) / (4 * cost))
        if (gap <= tolerance * np.maximum(primal, 1e-12)).all() or sweep == sweeps:
            break
        for k, v in enumerate(flat):  # a machine at a time: no second copy of all weights
            column = out[v].to_numpy()
            duals[rows_at, k // folds, k % folds] = column[kind == 1]
            weights[terms_at, k // folds, k % folds] += column[kind == 2]
        del out, column
    return weights, primal, gap


def newton(rows: DataFrame, tasks: int, idf: np.ndarray, bases: np.ndarray, folds: int, cost: float, tolerance: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (terms and intercept x spaces x folds), primal objectives and gaps of all machines, from the encoded ``rows``.

    A machine's step that doesn't lessen its objective is halved.  Equations are scaled by the diagonal, and those of all
    machines are solved in the same passes."""
    spark, spaces = rows.sparkSession, idf.shape[1]
    context = spark.sparkContext
    used = [np.flatnonzero(idf[:, o] > 0) for o in range(spaces)]
    own = [np.full(len(idf), -1, np.int32) for _ in used]
    for o, terms in enumerate(used):
        own[o][terms] = np.arange(len(terms))
    ends = np.cumsum([0, *(len(u) + 1 for u in used)]) - 1  # the last is the intercept's place
    held, shape = context.broadcast((idf, own, ends)), (int(ends[-1]) + 1, folds)

    def summed(now, along=None) -> np.ndarray:
        out = np.empty(2 * spaces * folds + 2 * shape[0] * folds if along is None else shape[0] * folds)
        with shuffles_removed(spark):
            made = rows.mapInArrow(_sums(held, now, along, bases, folds, cost), "at long, sums binary").repartition(tasks, "at").mapInArrow(_added, "at long, sums binary")
            table = made.toArrow()
        for at, part in zip(table["at"].to_pylist(), table["sums"], strict=True):
            out[at : at + CHUNK] = np.frombuffer(part.as_buffer(), np.float64)
        return out

    dot = lambda a, b: np.stack([np.einsum("jk,jk->k", a[x:y], b[x:y]) for x, y in zip(ends[:-1] + 1, ends[1:] + 1, strict=True)])
    each = lambda x: np.repeat(x, np.diff(ends), 0)
    weights, step, best = np.zeros(shape), np.zeros(shape), np.full((spaces, folds), np.inf)
    gradient, diagonal, gap = np.zeros(shape), np.ones(shape), np.full((spaces, folds), np.inf)
    for turn in range(steps + 1):
        step += weights  # the weights that are tried
        now = context.broadcast(step)
        out = summed(now)
        slack, total = out[: 2 * spaces * folds].reshape(2, spaces, folds), out[2 * spaces * folds :].reshape(2, *shape)
        primal = dot(step, step) / 2 + cost * slack[1]
        better = primal < best
        gap = np.where(better, primal - (2 * cost * slack[0] - dot(total[0], total[0]) / 2 - cost * slack[1]), gap)
        best = np.where(better, primal, best)
        at = each(better)
        np.copyto(gradient, step - total[0], where=at)
        np.copyto(diagonal, 1 + total[1], where=at)
        before = weights.copy()
        np.copyto(weights, step, where=at)
        step -= before
        del out, total, at, before
        going = gap > tolerance * np.maximum(best, 1e-12)
        if not going.any() or turn == steps:
            now.destroy()
            break
        solve = going & better
        step *= each(np.where(going & ~better, 0.5, 0.0))
        rest = np.where(each(solve), -gradient, 0.0)
        bound = LEFT**2 * dot(rest, rest)
        ahead = rest / diagonal
        size = dot(rest, ahead)
        for _ in range(PRODUCTS if solve.any() else 0):
            along = context.broadcast(ahead)
            product = summed(now, along).reshape(shape)
            along.destroy()
            product += ahead
            left = dot(rest, rest) > bound
            rate = each(np.where(left, size / np.where(left, dot(ahead, product), 1), 0))
            step += rate * ahead
            rest -= rate * product
            if not (dot(rest, rest) > bound).any():
                break
            scaled = rest / diagonal
            was, size = size, dot(rest, scaled)
            ahead *= each(size / np.where(was > 0, was, 1))
            ahead += scaled
        now.destroy()
    held.destroy()
    out = np.zeros((len(idf) + 1, spaces, folds))
    for o, terms in enumerate(used):
        out[np.append(terms, len(idf)), o] = weights[ends[o] + 1 : ends[o + 1] + 1]
    return out, best, gap


def vocabulary(rows: DataFrame, columns: Sequence[str], spaces: int, least: int = 2) -> DataFrame:
    """(column, term, df): in how many rows of each space a term stands; terms that reach ``least`` in one."""
    flat = None
    for k, c in enumerate(columns):
        own = rows.select("folds", F.lit(k).alias("column"), F.explode(F.array_distinct(c)).alias("term"))
        flat = own if flat is None else flat.unionByName(own)
    counts = [F.count_if(F.get("folds", F.lit(o)) >= 0).alias(f"d{o}") for o in range(spaces)]
    found = flat.groupBy("column", "term").agg(*counts)
    return found.select("column", "term", F.array(*[f"d{o}" for o in range(spaces)]).alias("df")).filter(F.array_max("df") >= least)


def train(rows: DataFrame, columns: Sequence[str], spaces: int, folds: int, uses: np.ndarray | None = None, cost: float = 1.0, tolerance: float = 1e-4, sweeps: int = 100, least: int = 2) -> tuple[Machines, DataFrame]:
    """Machines for ``spaces`` x ``folds`` problems, and (row, margins) of all ``rows``: row (unique long), label (0, 1), ``folds`` (the
    inner fold of each space, -1 outside it) and arrays of terms in ``columns``; ``uses`` (spaces x columns) says which a space reads.

    Terms count from ``least`` rows of a space on; idf is ln((1 + n) / (1 + df)) + 1.  Sweeps end when no machine's primal
    objective is more than ``tolerance`` of itself from its dual one."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    uses = np.ones((spaces, len(columns)), bool) if uses is None else uses
    found = vocabulary(rows, columns, spaces, least).toArrow().sort_by([("column", "ascending"), ("term", "ascending")])
    column = found["column"].to_numpy()
    df = pc.list_flatten(found["df"].combine_chunks()).to_numpy().reshape(-1, spaces)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.get("folds", F.lit(o)) >= 0).alias(f"n{o}") for o in range(spaces)]).first()
    idf = np.log((1 + np.array([sizes[f"n{o}"] for o in range(spaces)])) / (1 + df)) + 1
    idf[(df < least) | ~uses.T[column].reshape(df.shape)] = 0
    terms = [found["term"].combine_chunks().filter(pa.array(column == k)) for k in range(len(columns))]
    bases = np.cumsum([0, *(len(t) for t in terms)])[:-1]
    parts = max(1, -(-sizes.n // PART))
    known = context.broadcast(terms)
    read = small_batches(rows).select("row", F.when(F.col("label") == 1, 1.0).otherwise(-1.0).alias("y"), "folds", *columns)
    schema = "row long, part int, y double, folds array<int>, places array<int>, counts array<float>"
    encoded = written(read.mapInArrow(_encode(known, columns, parts), schema), "encoded")
    tasks = max(1, min(parts, context.defaultParallelism))
    blocks = encoded.repartition(tasks).persist()  # read again in every pass; a lost block is read anew
    if parts == 1:
        weights, primal, gap = _in_one_part(blocks, idf, bases, folds, cost, tolerance, sweeps)
    else:
        weights, primal, gap = newton(blocks, tasks, idf, bases, folds, cost, tolerance, sweeps)
    held = context.broadcast((idf, weights))
    margins = written(blocks.mapInArrow(_margins(held, bases), "row long, margins array<double>"), "margins")
    blocks.unpersist()
    remove(encoded)
    slope, shift = platt(rows.select("row", "label", "folds").join(margins, "row"), spaces, folds)
    return Machines(tuple(columns), terms, idf, weights, slope, shift, primal, gap), margins


def platt(rows: DataFrame, spaces: int, folds: int, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Slope and shift of 1 / (1 + exp(slope margin + shift)) for each machine, from the rows (label, folds, margins) of its own held-out
    fold, by Newton steps for all machines at once; targets are (n1 + 1) / (n1 + 2) and 1 / (n0 + 2)."""
    one = rows.select("label", F.posexplode("folds").alias("o", "k"), "margins").filter("k >= 0")
    problem = (F.col("o") * folds + F.col("k")).alias("p")
    held = one.select(problem, F.col("label").cast("int").alias("y"), F.get("margins", F.col("o") * folds + F.col("k")).alias("f")).persist()
    n = np.zeros((2, spaces * folds))
    for r in held.groupBy("p", "y").count().collect():  # two rows a machine
        n[r.y, r.p] = r["count"]
    high, low = (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2)
    at = np.stack([np.zeros(spaces * folds), np.log((n[0] + 1) / (n[1] + 1))])
    best, step, loss = at.copy(), np.zeros_like(at), np.full(spaces * folds, np.inf)
    for _ in range(steps):
        table = held.sparkSession.createDataFrame([(p, *map(float, x)) for p, x in enumerate(zip(*at, high, low, strict=True))], "p int, a double, b double, high double, low double")
        z = F.col("a") * F.col("f") + F.col("b")
        t = F.when(F.col("y") == 1, F.col("high")).otherwise(F.col("low"))
        down = F.exp(-F.abs(z))
        q = F.when(z >= 0, down / (1 + down)).otherwise(1 / (1 + down))  # the probability of label 1
        joined = held.join(F.broadcast(table), "p").select("p", "f", (t - q).alias("g"), (q * (1 - q)).alias("h"), (t * z + F.greatest(-z, F.lit(0.0)) + F.log1p(down)).alias("loss"))
        sums = joined.groupBy("p").agg(F.sum(F.col("g") * F.col("f")), F.sum("g"), F.sum(F.col("h") * F.col("f") * F.col("f")), F.sum(F.col("h") * F.col("f")), F.sum("h"), F.sum("loss"))
        found = {r[0]: r[1:] for r in sums.collect()}  # a row a machine
        largest = 0.0
        for p, (ga, gb, haa, hab, hbb, value) in found.items():
            if value <= loss[p] + 1e-12:
                best[:, p], loss[p] = at[:, p], value
                haa, hbb = haa + 1e-12, hbb + 1e-12
                det = haa * hbb - hab * hab
                step[:, p] = [-(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det]
                largest = max(largest, abs(ga), abs(gb))
            else:
                step[:, p] /= 2
                largest = max(largest, float(np.abs(step[:, p]).max()))
            at[:, p] = best[:, p] + step[:, p]
        if largest < 1e-6:
            break
    held.unpersist()
    return best[0].reshape(spaces, folds), best[1].reshape(spaces, folds)
