"""Shortest edit scripts in little memory, and Arrow rows whose keys pass untouched."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from difflib import Match, SequenceMatcher
from itertools import groupby
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def edit_script(src: Sequence[str], dst: Sequence[str]) -> list[tuple[str, int, int]]:
    """A shortest script as (tag, place in ``src``, place in ``dst``), from the end: keep or replace before delete before insert.

    Columns of the edit table are two bit vectors (whether a cell equals its diagonal neighbour, whether it is one more than the
    one above), made from the column before by a few operations on whole vectors.  Every so many columns the state is kept; the
    way back makes the columns between two of them again.  Where words differ place by place and no script can be shorter, that
    one is the result, which needs no table."""
    if (ops := in_place(src, dst)) is not None:
        return [("replace", i, i) for tag, i1, i2, _, _ in ops if tag == "replace" for i in range(i1, i2)]
    n, m, where = len(src), len(dst), {}
    for i, word in enumerate(src):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << n) - 1

    def column(state: tuple[int, int], word: str) -> tuple[int, int, int]:
        up, down = state
        same = where.get(word, 0)
        level = ((((same & up) + up) ^ up) | same | down) & full
        ahead = down | (full & ~(level | up))
        behind = level & up
        ahead = (ahead << 1 | 1) & full
        return ((behind << 1) | ~(level | ahead)) & full, ahead & level, level

    step = isqrt(m) + 1
    kept, state = [], (full, 0)
    for j, word in enumerate(dst):
        if j % step == 0:
            kept.append(state)
        state = column(state, word)[:2]
    out, i, j = [], n, m
    for block in range(len(kept) - 1, -1, -1):
        first, state = block * step, kept[block]
        ups, levels = [state[0]], [0]
        for word in dst[first : min(m, first + step)]:
            up, down, level = column(state, word)
            state = (up, down)
            ups.append(up)
            levels.append(level)
        while j > first:
            at = j - first
            if i and (src[i - 1] == dst[j - 1] or not levels[at] >> i - 1 & 1):
                i, j = i - 1, j - 1
                if src[i] != dst[j]:
                    out.append(("replace", i, j))
            elif i and ups[at] >> i - 1 & 1:
                i -= 1
                out.append(("delete", i, j))
            else:
                j -= 1
                out.append(("insert", i, j))
    out += [("delete", k, 0) for k in range(i - 1, -1, -1)]
    return out[::-1]


class Aligner(SequenceMatcher):
    """A sequence matcher whose longest matches come from a suffix automaton where words repeat much: pairs of equal words
    make the usual search quadratic, and long lines hold millions of them.  The matches are the same, ties included."""

    #: Pairs of equal words, for each word of both sides, from which on the automaton is quicker.
    CROWDED = 25

    def __init__(self, a: Sequence[str], b: Sequence[str]):
        super().__init__(a=a, b=b, autojunk=False)

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None):
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        most, none = self.CROWDED * (ahi - alo + bhi - blo), ()
        if most and sum(len(self.b2j.get(word, none)) for word in self.a[alo:ahi]) > most:
            return Match(*_longest(self.a, self.b, alo, ahi, blo, bhi))
        return super().find_longest_match(alo, ahi, blo, bhi)


def _longest(a: Sequence[str], b: Sequence[str], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest run that both ranges hold, the earliest in ``a`` and then in ``b``, by the suffix automaton of the range of ``b``."""
    ways: list[dict[str, int]] = [{}]
    link, size, first, last = [-1], [0], [0], 0
    for j in range(blo, bhi):
        word, now = b[j], len(size)
        ways.append({})
        link.append(0)
        size.append(size[last] + 1)
        first.append(j)
        p = last
        while p >= 0 and word not in ways[p]:
            ways[p][word] = now
            p = link[p]
        if p >= 0:
            q = ways[p][word]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(size)
                ways.append(ways[q].copy())
                link.append(link[q])
                size.append(size[p] + 1)
                first.append(first[q])
                while p >= 0 and ways[p].get(word) == q:
                    ways[p][word] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    state, length, best = 0, 0, (alo, blo, 0)
    for i in range(alo, ahi):
        word = a[i]
        while state and word not in ways[state]:
            state = link[state]
            length = size[state]
        if word in ways[state]:
            state = ways[state][word]
            length += 1
            if length > best[2]:
                best = (i - length + 1, first[state] - length + 1, length)
        else:
            length = 0
    return best


def opcodes_of(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """(tag, i1, i2, j1, j2) of the alignment of two lists of words."""
    if a == b:
        return [("equal", 0, len(a), 0, len(b))] if a else []
    return Aligner(a, b).get_opcodes()


def in_place(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, int, int, int, int]] | None:
    """The alignment of two lists of one length place by place, where no other keeps more words equal; else None."""
    if len(a) != len(b):
        return None
    same = [x == y for x, y in zip(a, b, strict=True)]
    if sum(same) < (Counter(a) & Counter(b)).total():
        return None
    out, at = [], 0
    for equal, run in groupby(same):
        begun, at = at, at + len(list(run))
        out.append(("equal" if equal else "replace", begun, at, begun, at))
    return out


def in_places(a: pa.ListArray, b: pa.ListArray, lower: bool, tags: Sequence[str] | None = None, sizes: tuple[int, int] | None = None):
    """:func:`in_place` of the rows of two columns of lists, all at once: the rows that it is none for; row, whether equal, first place and
    end of each run of the others, of these ``tags`` and ``sizes``; its words on both sides.  ``lower``: compared without regard to case.

    An alignment by places keeps most words equal just where none of the words that differ on one side is one of those that
    differ on the other.  Only words that differ as written are looked at one by one, each once."""
    size, other = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    even = size == other
    x, y = (pc.list_flatten(side).filter(pa.array(np.repeat(even, n))) for side, n in ((a, size), (b, other)))
    size = np.where(even, size, 0)
    row = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(pc.not_equal(x, y).to_numpy(zero_copy_only=False))
    words = pa.concat_arrays([x.take(pa.array(at)), y.take(pa.array(at))]).dictionary_encode()
    code: dict[str, int] = {}
    coded = np.array([code.setdefault(w.lower() if lower else w, len(code)) for w in words.dictionary.to_pylist()], np.int64)
    left, right = coded[words.indices.to_numpy()].reshape(2, -1)
    left, right, at = left[left != right], right[left != right], at[left != right]
    met = np.intersect1d(row[at] * len(code) + left, row[at] * len(code) + right)
    good = even.copy()
    good[met // max(1, len(code))] = False
    same = np.ones(len(row), bool)
    same[at] = False
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (same[1:] != same[:-1])
    begun = np.flatnonzero(first)
    ended = np.append(begun[1:], len(row))[: len(begun)]
    kept = good[row[begun]] & np.isin(np.where(same[begun], "equal", "replace"), list(tags if tags is not None else ("equal", "replace")))
    if sizes is not None:
        kept &= (ended - begun >= sizes[0]) & (ended - begun <= sizes[1])
    begun, ended = begun[kept], ended[kept]
    long = ended - begun
    offsets = np.append(0, np.cumsum(long))
    inner = pa.array(np.repeat(begun - offsets[:-1], long) + np.arange(offsets[-1]))
    spans = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), side.take(inner)) for side in (x, y)]
    of = row[begun]
    base = (np.cumsum(size) - size)[of]
    return np.flatnonzero(~good).tolist(), (of, same[begun], begun - base, ended - base), spans


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that what is made of them stays small whatever the session's batch size."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, whose session's Arrow batches hold ``rows`` rows at most from now on: whole texts with their tokens are large rows.
    The session's setting is lowered, never raised; it is read when a plan is made, so that it can't be given to one plan alone."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def with_measures(rows: DataFrame, inputs: Sequence[str], made: str, measure: Callable[..., tuple]) -> DataFrame:
    """``rows`` with the columns ``made`` ("name type, ...") that ``measure`` gives for each row's ``inputs``, which go; the other columns
    stay Arrow data throughout, so that no key changes its type or value."""
    kept = [c for c in rows.columns if c not in inputs]
    names = [part.split()[0] for part in made.split(", ")]
    kinds = {"double": pa.float64(), "long": pa.int64()}
    types = [kinds[part.split()[1]] for part in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(*(batch.column(c)[k].as_py() for c in inputs)) for k in range(len(batch))]
            columns = [pa.array([f[c] for f in found], t) for c, t in enumerate(types)]
            yield pa.record_batch([*(batch.column(c) for c in kept), *columns], [*kept, *names])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c in kept)
    return rows.mapInArrow(run, f"{schema}, {made}")
