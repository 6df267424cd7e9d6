"""Best-fit-decreasing packing of token sequences.

Best fit never looks at more than an item's length, so the corpus is reduced to a histogram of at most
``capacity`` lengths.  The driver packs that histogram exactly: a segment tree over remaining capacities
gives the tightest open class of bins for a length in logarithmic time, and equal bins move as runs.
The result is a table of runs whose size depends on the capacity alone; executors look their pieces up in it
by (length, rank among pieces of that length).
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise, small_batches, unused

CAPACITY, END_ID = 1024, 2
#: Distinct spelling units encoded by one call, those whose ids a worker keeps, and texts of an Arrow batch.
UNITS_AT_ONCE, BATCH_TEXTS = 5_000, 2_000
CACHED_UNITS = 400_000
PIECES = "row_key string, doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over the capacities 0..capacity: which of them has open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, open_bins: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = open_bins
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


@dataclass(frozen=True)
class Run:
    """Pieces ``first_rank``.. of one length: ``per_bin`` of them go to each bin from ``first_bin`` on, from ``offset`` on."""

    length: int
    first_rank: int
    first_bin: int
    per_bin: int
    offset: int


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Best-fit decreasing over a histogram of lengths; returns runs and the number of bins."""
    tree, open_bins = CapacityTree(capacity), {}  # remaining capacity -> runs (first bin, bins)
    runs: list[Run] = []
    bins = 0

    def put(room: int, first: int, many: int) -> None:
        if many:
            open_bins.setdefault(room, []).append((first, many))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no bin of {capacity} holds a piece of {length}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                first, many = bins, -(-left // each)
                bins += many
                room = capacity
            else:
                first, many = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
            each = room // length  # a bin just filled is the tightest until the length no longer fits
            full = min(many, left // each)
            runs.append(Run(length, rank, first, each, capacity - room))
            rank, left = rank + full * each, left - full * each
            put(room - each * length, first, full)
            if full < many and left:  # the last pieces of this length, in one bin
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, many - full)
    return runs, bins


#: Marks that the byte-level splitter parts from a letter before them, as one run.
MARKS = ".,!?;:#*$%&|<>()[]{}\"=+/@~"


#: White space other than space and line feed.
OTHER_BLANKS = "[\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


class Tokens:
    """Ids of texts by a tokenizer file, as little-endian 32-bit bytes.

    The byte-level splitter attaches a single space to the word behind it, lets a single line feed stand
    alone and parts a letter from a run of marks, so a text without touching white space may be cut at
    those places; units are encoded once, by one call of the tokenizer for all new ones of a batch, and
    remembered.  Texts with other white space or an added token, and all texts where the tokenizer splits
    otherwise, are encoded whole.  ``special``: whether an added token's spelling gives its id, as in the
    tokenizer's plain call, or is text."""

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        splitter = parts.get("pre_tokenizer") or {}
        self.cuts = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not parts.get("normalizer")
        self.added = [x["content"] for x in parts.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}
        # whether what an id stands for begins with a space, which the byte-level alphabet writes as U+0120
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.begins[[k for x, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if x[0] == "\u0120"]] = True

    def entire(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts have to be encoded whole."""
        if not self.cuts:
            return np.ones(len(texts), bool)
        return pc.match_substring_regex(texts, "|".join(map(re.escape, ["  ", "\n\n", " \n", "\n ", "\x00", *self.added]))).to_numpy(zero_copy_only=False)

    def encoded(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units.  Those that begin with a space are encoded as one text: the ids of what begins with one part them again."""
        spaced = [x for x in units if x[0] == " "]
        out: dict[str, bytes] = {}
        for k in range(0, len(spaced), UNITS_AT_ONCE):
            own = spaced[k : k + UNITS_AT_ONCE]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(own)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.begins[ids])
            body = ids.tobytes()
            ends = [*(4 * starts[1:]).tolist(), len(body)]
            out |= zip(own, map(body.__getitem__, map(slice, (4 * starts).tolist(), ends)), strict=True)
        bare = [x for x in units if x[0] != " "]
        if bare:
            encoding = self.tokenizer.encode(bare, is_pretokenized=True, add_special_tokens=False)
            body = np.asarray(encoding.ids, "<u4").tobytes()
            ends = (4 * np.cumsum(np.bincount(np.asarray(encoding.word_ids, np.int64), minlength=len(bare)))).tolist()
            out |= {x: body[a:b] for x, a, b in zip(bare, [0, *ends[:-1]], ends, strict=True)}
        return out

    def learn(self, missing: list[str], other_blanks: bool) -> tuple[dict[str, bytes], set[str]]:
        """Ids of ``missing`` units, and those of them that can't stand alone: other white space touches the cut."""
        odd: set[str] = set()
        if other_blanks:
            odd = {x for x in missing if x != "\n" and (x[1:] if x[0] == " " else x).strip() != (x[1:] if x[0] == " " else x)}
            missing = [x for x in missing if x not in odd]
        apart: dict[str, tuple[str, str]] = {}
        wanted: dict[str, None] = {}
        known = self.known
        for unit in missing:
            body = unit.rstrip(MARKS)
            if body != unit and body and body[-1] < "\u0250" and body[-1].isalpha():
                tail = unit[len(body) :]
                apart[unit] = (body, tail)
                if body not in known:
                    wanted[body] = None
                if tail not in known:
                    wanted[tail] = None
            else:
                wanted[unit] = None
        found = self.encoded(list(wanted))
        pick = lambda y: found[y] if y in found else known[y]
        return found | {x: pick(y) + pick(z) for x, (y, z) in apart.items()}, odd

    def batch(self, texts: pa.Array | list[str]) -> Iterator[bytes]:
        """Ids of each text; null counts as empty."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        texts = pc.fill_null(texts, "")
        whole = self.whole(texts).copy()
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(pa.array(whole), "", texts), "\n", "\x00\n\x00"), " ", "\x00 ")
        split = pc.split_pattern(marked, "\x00")
        coded = split.flatten().dictionary_encode()
        units, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids = list(map(self.known.get, units))
        other_blanks = pc.any(pc.match_substring_regex(texts, OTHER_BLANKS)).as_py()
        here, odd = self.learn([x for x, y in zip(units, ids, strict=True) if y is None and x], bool(other_blanks))
        if len(self.known) + len(here) <= CACHED_UNITS:
            self.known |= here
        ids = [here.get(x, b"") if y is None else y for x, y in zip(units, ids, strict=True)]
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        first = np.cumsum(size, dtype=np.int32) - size
        many = size[code]
        ends = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(first[code] - ends[:-1].astype(np.int32), many)
        at += np.arange(len(at), dtype=np.int32)
        tokens = flat[at]
        rows = split.offsets.to_numpy() - split.offsets[0].as_py()
        if odd:
            alone = np.concatenate([[0], np.cumsum(np.fromiter((x in odd for x in units), bool, len(units))[code])])
            whole |= alone[rows[1:]] > alone[rows[:-1]]
        for k, (a, b) in enumerate(zip(ends[rows[:-1]].tolist(), ends[rows[1:]].tolist(), strict=True)):
            yield self.entire(texts[k].as_py()) if whole[k] else tokens[a:b].tobytes()


def tokenizer_units(path: str, special: bool = False) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit bytes; added tokens' spellings are text unless ``special``."""
    tokens = Tokens(path, special)
    return lambda text: next(tokens.batch([text]))


_TOKENS: dict[str, Tokens] = {}


def _pieces(path: str, capacity: int, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = Tokens(path)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            keys, doc, piece, start, length, crc = [], [], [], [], [], []
            for k, own in enumerate(_TOKENS[path].batch(batch.column(1))):
                body = own + end
                total = len(body) // 4
                cut, n = 0, 0
                key = f"{zlib.crc32(body)}:{total}"
                while cut < total:
                    to = min(total, (total - 1) % capacity + 1 if cut == 0 else cut + capacity)
                    keys.append(key)
                    doc.append(docs[k])
                    piece.append(n)
                    start.append(cut)
                    length.append(to - cut)
                    crc.append(zlib.crc32(body[4 * cut : 4 * to]))
                    cut, n = to, n + 1
            yield pa.record_batch(
                [pa.array(keys, pa.string()), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["row_key", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens.  A longer document's first piece takes what the
    full ones behind it leave.  Null and empty texts give the one end token."""
    small_batches(docs.sparkSession, BATCH_TEXTS)
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES)


def _placed(runs: list[Run], rank: str):
    """A Pandas function placing (length, rank): runs of a length are searched by first rank."""
    by: dict[int, tuple] = {}
    for length in {r.length for r in runs}:
        own = [r for r in runs if r.length == length]
        by[length] = tuple(np.array([getattr(r, k) for r in own], np.int64) for k in ("first_rank", "first_bin", "per_bin", "offset"))

    def place(frames):
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            lengths, ranks = frame["length"].to_numpy(), frame[rank].to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, bins, per, off = by[int(length)]
                k = np.searchsorted(first, ranks[at], "right") - 1
                inside = ranks[at] - first[k]
                sequence[at] = bins[k] + inside // per[k]
                offset[at] = off[k] + inside % per[k] * length
            yield frame.drop(columns=[rank]).assign(sequence_id=sequence, offset=offset)

    return place


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_bucket: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Ranks among pieces of a length are counted in two levels, hash buckets and rows within a bucket, so
    that a length that most pieces share is not ordered in one task.  The packing equals sequential
    best-fit decreasing.  No rows give no rows; repeated rows are packed as often as they occur; other columns
    pass through, but for ``sequence_id`` and ``offset``."""
    pieces = pieces.drop("sequence_id", "offset")
    bucket, base, rank = (unused(name, pieces.columns) for name in ("bucket", "base", "rank"))
    order = [c for c in ("doc_id", "row_key", "piece", "start") if c in pieces.columns] or [c for c in pieces.columns]
    buckets = max(8, pieces.count() // rows_per_bucket)
    hashed = pieces.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = hashed.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", bucket, F.coalesce(before, F.lit(0)).alias(base))
    counts = {r["length"]: r["n"] for r in hashed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = pack_histogram(counts, capacity)
    within = Window.partitionBy("length", bucket).orderBy(*order)
    ranked = hashed.withColumn(rank, F.row_number().over(within) - 1).join(bases, ["length", bucket]).withColumn(rank, (F.col(rank) + F.col(base)).cast("long"))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c != "length")
    return ranked.select("length", *[c for c in pieces.columns if c != "length"], rank).mapInPandas(_placed(runs, rank), f"length long, {schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut and pack documents: one row per piece.

    Null or empty texts hold the end token only; null ``doc_id`` is kept; repeated rows are packed each;
    further columns of ``docs`` are ignored; an empty table gives an empty result."""
    pieces = materialise(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    packed = best_fit_pack(pieces, capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
