"""Vectorised word and shingle hashes over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z.  Hashes are 64 bits wide and
depend on the bytes alone, so that they agree between workers and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text hashed at once; a longer text is a block of its own.
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def alphabet(blank: np.ndarray, fold: bool = True) -> np.ndarray:
    """Values of the bytes of words that ``blank`` bytes part; with ``fold`` A-Z have those of a-z."""
    letters = _BYTE[_FOLD] if fold else _BYTE.copy()
    letters[blank] = 0
    return letters


BLANK, _LETTER = _BLANK, alphabet(_BLANK)
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MIX = (U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * _MIX[0]
    x = x ^ (x >> U(33))
    x = x * _MIX[1]
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            out = np.full(max(n, BLOCK), base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets in them) of runs of rows of about BLOCK bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        end = min(end, len(texts))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _BLANK, letters: np.ndarray = _LETTER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a block, their first bytes, and for each row the place of its first word (one more at the end);
    ``blank`` marks the bytes between words, ``letters`` is their :func:`alphabet`."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = blank[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = blank[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(first & ~blank)
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, at
    power, unpower = powers(len(data))
    sums = np.add.reduceat(letters[data] * power, starts)
    return mix(sums * unpower[starts]), starts, at


_WEIGHTS = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``size`` words; of the whole sequence where it
    has fewer words; none where it has no word."""
    for _, data, offsets in blocks(texts):
        hashes, _, at = words(data, offsets)
        n = len(hashes)
        runs = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            runs += hashes[k : k + len(runs)] * _WEIGHTS[k]
        runs = mix(runs)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield mix((hashes[a:b] * _WEIGHTS[: b - a]).sum(keepdims=True, dtype=np.uint64) + U(b - a))
            else:
                yield np.zeros(0, np.uint64)
