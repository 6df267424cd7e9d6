"""Removal of passages that an earlier document holds, by compressed full-text indexes.

A window is ``WINDOW`` consecutive words.  Its anchor is the least hash of the runs of ``GRAM`` words in it, so equal windows have
equal anchors wherever they stand; a piece is a run of windows with one anchor.  Anchors of one document alone can't
repeat; the other pieces are dealt to shards by anchor, equal ones as one with its least document (its owner).  Each shard
builds an FM-index over its pieces: suffixes sorted by doubling, the transform in a wavelet matrix of packed bits with
counts, and the least owner of any range of suffixes.  Backward search from the end of each window gives matching
statistics: the longest match that some earlier owner holds.  Matches of a window or more are the intervals to remove.

An anchor with more than CROWD different pieces would make one shard too large; its pieces are cut into windows, whose least
owner is an aggregate.  Words and pieces are told apart by 64-bit hashes (pieces by their anchor as well).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise, small_batches, spread_join
from .textvec import BLANK, U, alphabet, blocks, mix, powers, words

#: Words of a window, of the runs whose hashes anchor it, and windows of a piece at most (so that its words fit 32 bits).
WINDOW, GRAM, RUN = 13, 5, 20
#: Words of a shard's index, and different pieces of an anchor up to which they stay together.
SHARD, CROWD = 1 << 18, 512
#: Bits of the filter of shared anchors, whatever the input's size.
FILTER_BITS = 1 << 26
#: Pieces that every task holds because they stand in many places: so many at most, and those in this many places or more.
HOT, OFTEN = 50_000, 1000
#: A null id stands after all others.
LAST = (1 << 63) - 1

_LETTERS = alphabet(BLANK, fold=False)
_WEIGHTS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, GRAM, dtype=np.uint64) | U(1)


def pieces_of(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, windows and anchor of the pieces of rows whose words' ``hashes`` start at ``at`` (one more at the end)."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        grams += hashes[k : k + len(grams)] * _WEIGHTS[k]
    least, width, reach = mix(grams), 1, WINDOW - GRAM + 1
    while width < reach:  # least[i] is that of `width` runs from i on
        step = min(width, reach - width)
        least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    anchor = least[first]
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    begin = np.flatnonzero(new)
    inside = np.arange(len(first)) - np.repeat(begin, np.diff(np.append(begin, len(first))))
    begin = np.flatnonzero(inside % RUN == 0)
    return row[first[begin]], first[begin], np.diff(np.append(begin, len(first))), anchor[begin]


def _hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for row, data, offsets in blocks(texts):
        hashes, _, at = words(data, offsets, BLANK, _LETTERS)
        yield row, hashes, at


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for start, hashes, at in _hashed(batch.column("text")):
            row, _, _, anchor = pieces_of(hashes, at)
            yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(ids[start + row])], ["anchor", "id"])


def _bucket(anchor: np.ndarray) -> np.ndarray:
    return (anchor & U(FILTER_BITS - 1)).astype(np.int64)


def _pieces(shared: np.ndarray, hot: pa.Table | None = None):
    """Of the anchors in the filter: anchor, piece (hash) and id of the document, with the words' hashes if no ``hot`` table is
    given, else the hash of the document, the first word, how many they are, and owner and bits of the pieces in ``hot``."""
    said = hot is None
    if not said:
        hot = hot.sort_by("piece")
        hot_anchor, hot_piece, hot_owner, hot_bits = (hot[n].to_numpy() for n in ("anchor", "piece", "owner", "bits"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(), batch.column("hash").to_numpy()
            for start, hashes, at in _hashed(batch.column("text")):
                row, first, windows, anchor = pieces_of(hashes, at)
                bucket = _bucket(anchor)
                kept = (shared[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1
                row, first, windows, anchor = row[kept], first[kept], windows[kept], anchor[kept]
                if not len(row):
                    continue
                end = first + windows + WINDOW - 1
                power, unpower = powers(len(hashes) + 1)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)])])
                piece = mix((sums[end] - sums[first]) * unpower[first] + (end - first).astype(np.uint64))
                sizes = end - first
                columns = [pa.array(x) for x in (anchor.view(np.int64), piece.view(np.int64), ids[start + row])]
                if not said:
                    columns += [pa.array(x) for x in (texts[start + row], (first - at[row]).astype(np.int32), sizes.astype(np.int32))]
                    owner, bits, other = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64), np.ones(len(row), bool)
                    if len(hot_piece):
                        near = np.minimum(np.searchsorted(hot_piece, piece.view(np.int64)), len(hot_piece) - 1)
                        other = (hot_piece[near] != piece.view(np.int64)) | (hot_anchor[near] != anchor.view(np.int64))
                        owner, bits = hot_owner[near], hot_bits[near]
                    columns += [pa.array(owner, mask=other), pa.array(bits, mask=other)]
                    yield pa.record_batch(columns, ["anchor", "piece", "id", "hash", "start", "n", "owner", "bits"])
                    continue
                inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                content = hashes[np.repeat(first, sizes) + inside]
                offsets = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
                columns.append(pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(content)]))
                yield pa.record_batch(columns, ["anchor", "piece", "id", "words"])

    return pieces


class WaveletMatrix:
    """Ranks of symbols in a sequence: a level for each bit, packed, with the ones counted before every 64."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.depth = max(1, int(most).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(len(symbols) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.starts = self.places(np.arange(most + 1), np.zeros(most + 1, np.int64))

    def places(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` comes to lie in the last level's order, on the way of ``symbol``."""
        for k, level in enumerate(range(self.depth - 1, -1, -1)):
            word = at >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((U(1) << (at & 63).astype(np.uint64)) - U(1)))
            at = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``at``."""
        return self.places(symbol, at) - self.starts[symbol]


class FMIndex:
    """Sequences of words (``symbols`` from 1 on, ``sizes`` words each) with their ``owners``, searched backwards."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, owners: np.ndarray):
        count, ends = len(sizes), np.cumsum(sizes + 1) - 1
        text = np.zeros(len(symbols) + count, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = symbols
        # every sequence ends with a mark of its own, which are in the sequences' order
        rank = text + count
        rank[ends] = np.arange(count)
        width = 0
        while True:
            key = rank if not width else rank * (len(text) + 1) + np.append(rank[width:] + 1, np.zeros(min(width, len(rank)), np.int64))[: len(rank)]
            order = np.argsort(key, kind="stable")
            steps = np.append(0, np.cumsum(np.diff(key[order]) != 0))
            rank = np.empty_like(rank)
            rank[order] = steps
            if steps[-1] == len(text) - 1:
                break
            width = 2 * width or 1
        self.text, self.size, self.begins = text, len(text), ends - sizes
        most = int(symbols.max())
        self.tree = WaveletMatrix(text[order - 1], most)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=most + 1)))
        of = np.repeat(np.arange(count), sizes + 1)
        self.owners = owners
        self.least = [owners[of[order]]]
        while 2 ** len(self.least) <= self.size:
            half, last = 2 ** (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[: len(last) - half], last[half:]))

    def backward(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with ``symbol`` and go on with one of those between ``low`` and ``high``."""
        ranks = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.concatenate([self.before[symbol]] * 2)
        return ranks[: len(low)], ranks[len(low) :]

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner of suffixes in non-empty ranges."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.owners.dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - 2**k])
        return out

    def statistics(self, ends: np.ndarray, begins: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """For words at ``ends`` of the index's own text: how many of them and those before, back to ``begins``, an earlier owner holds as well."""
        length = np.zeros(len(ends), np.int64)
        at, low, high = ends.copy(), np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        open_ = np.arange(len(ends))
        while len(open_):
            low, high = self.backward(self.text[at], low, high)
            some = np.flatnonzero(high > low)
            some = some[self.least_owner(low[some], high[some]) < owners[open_[some]]]
            length[open_[some]] += 1
            some = some[at[some] > begins[open_[some]]]
            open_, at, low, high = open_[some], at[some] - 1, low[some], high[some]
        return length


def covered(hashes: np.ndarray, sizes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Of each piece, a bit for every word in a window that an earlier owner's piece holds."""
    _, symbols = np.unique(hashes, return_inverse=True)
    index = FMIndex(symbols + 1, sizes, owners)
    windows = sizes - WINDOW + 1
    of = np.repeat(np.arange(len(sizes)), windows)
    last = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + WINDOW - 1
    length = index.statistics(index.begins[of] + last, index.begins[of], owners[of])
    found = np.where(length >= WINDOW, ((np.int64(1) << length) - 1) << np.maximum(0, last - length + 1), 0)
    return np.bitwise_or.reduceat(found, np.cumsum(windows) - windows)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by anchor, a shard at a time, to those whose owner or other documents have words to remove."""
    held, size = [], 0

    def shard(parts):
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        anchor = whole.column("anchor").to_numpy()
        alone = np.ones(len(anchor), bool)
        same = anchor[1:] == anchor[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        bits = np.zeros(len(anchor), np.int64)
        several = np.flatnonzero(~alone)
        if len(several):
            content = whole.column("words").take(pa.array(several))
            offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1]
            hashes = np.frombuffer(bytes(content.buffers()[2][offsets[0] : offsets[-1]]), np.uint64)
            bits[several] = covered(hashes, np.diff(offsets) // 8, whole.column("owner").to_numpy()[several])
        tells = np.flatnonzero((bits != 0) | (whole.column("owner").to_numpy() < whole.column("last").to_numpy()))
        out = whole.take(pa.array(tells))
        names = ["anchor", "piece", "owner", "places"]
        return pa.record_batch([*(out.column(n) for n in names), pa.array(bits[tells])], [*names, "bits"])

    for batch in batches:
        at, anchor = 0, batch.column("anchor").to_numpy()
        if not len(batch):
            continue
        sizes = np.cumsum(pa.compute.binary_length(batch.column("words")).to_numpy() // 8)
        last = held[-1].column("anchor")[-1].as_py() if held else None
        before = 0
        for k in np.append(np.flatnonzero(np.diff(anchor, prepend=anchor[0] if last is None else last)), len(anchor)).tolist():
            now = int(sizes[k - 1]) if k else 0
            if size + now - before >= SHARD and k < len(anchor):
                if k > at:
                    held.append(batch.slice(at, k - at))
                if held:
                    yield shard(held)
                held, size, at, before = [], 0, k, now
        if at < len(anchor):
            held.append(batch.slice(at))
            size += int(sizes[-1]) - before
    if held:
        yield shard(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of pieces: anchor, piece, owner, offset and a hash."""
    for batch in batches:
        for anchor, piece, owner, said in zip(*(batch.column(n).to_pylist() for n in ("anchor", "piece", "owner", "words")), strict=True):
            hashes = np.frombuffer(said, np.uint64)
            n = len(hashes) - WINDOW + 1
            window = np.zeros(n, np.uint64)
            for k in range(WINDOW):
                window = mix(window * U(0x9E3779B97F4A7C15) + hashes[k : k + n])
            same = [pa.array(np.full(n, x, np.int64)) for x in (anchor, piece, owner)]
            yield pa.record_batch([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(window.view(np.int64))], ["anchor", "piece", "owner", "offset", "window"])


def _crowded(pieces: DataFrame) -> DataFrame:
    """As :func:`_search`, for pieces of crowded anchors: the least owner of each window."""
    cut = materialise(pieces.mapInArrow(_cut, "anchor long, piece long, owner long, offset int, window long"), "windows")
    least = materialise(cut.groupBy("anchor", "window").agg(F.min("owner").alias("least"), F.max("owner").alias("greatest")).filter("least < greatest").drop("greatest"), "least")
    hit = spread_join(cut, least, ["anchor", "window"], False, [F.col("piece")]).filter("least < owner")
    window = F.lit((1 << WINDOW) - 1).cast("long")
    bits = hit.groupBy("anchor", "piece").agg(F.bit_or(F.call_function("shiftleft", window, F.col("offset"))).alias("bits"))
    out = pieces.select("anchor", "piece", "owner", "places", "last").join(bits, ["anchor", "piece"], "left").withColumn("bits", F.coalesce("bits", F.lit(0).cast("long")))
    out = materialise(out.filter("bits <> 0 or owner < last").select("anchor", "piece", "owner", "places", "bits"), "crowded")
    discard(cut, least)
    return out


def _filter(anchors: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, packed, of which those of ``anchors`` are set: a number of rows that the filter's size bounds."""
    bucket = F.col("anchor").bitwiseAND(FILTER_BITS - 1) + 1  # bitmaps count from 1
    maps = anchors.groupBy(F.bitmap_bucket_number(bucket).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bucket)).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in maps.collect():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        at = (r.k - 1) * 4096
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def repeated_words(docs: DataFrame) -> DataFrame:
    """(id, hash, marks) of the rows of ``docs`` (id, hash, text) with words to remove: marks are a set of (start, bits)."""
    spark = docs.sparkSession
    small_batches(spark)
    anchors = docs.select("id", "text").mapInArrow(_anchors, "anchor long, id long")
    shared = materialise(anchors.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("anchor"), "anchors")
    bits = _filter(shared)
    discard(shared)
    # the words of a piece are written once, not wherever it stands
    said = docs.select("id", "hash", "text").mapInArrow(_pieces(bits), "anchor long, piece long, id long, words binary")
    one = said.groupBy("anchor", "piece").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.count(F.lit(1)).alias("places"), F.first("words").alias("words"))
    one = materialise(one, "distinct")
    crowds = materialise(one.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("anchor"), "crowds")
    n_crowds = crowds.count()
    often = max(OFTEN, (one.agg(F.sum("places")).first()[0] or 0) // HOT + 1)
    small_batches(spark, 20_000)
    quiet, found, left = one, None, []
    if n_crowds:
        marked = spread_join(one, crowds.withColumn("crowd", F.lit(True)), ["anchor"], n_crowds <= HOT, [F.col("piece")], "left")
        quiet = marked.filter("crowd is null").drop("crowd")
        busy = materialise(marked.filter("crowd").drop("crowd"), "busy")
        found = _crowded(busy)
        left = [busy, found]
    searched = quiet.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_search, "anchor long, piece long, owner long, places long, bits long")
    searched = materialise(searched, "searched")
    found = searched if found is None else found.unionByName(searched)
    discard(one, crowds)
    # what becomes of a piece that stands in very many places is told where it is cut: of those there are HOT at most
    hot = found.filter(F.col("places") >= often).select("anchor", "piece", "owner", "bits").toArrow()
    cut = docs.select("id", "hash", "text").mapInArrow(_pieces(bits, hot), "anchor long, piece long, id long, hash long, start int, n int, owner long, bits long")
    pieces = materialise(cut, "pieces")
    rest = pieces.filter("owner is null").drop("owner", "bits").join(found.select("anchor", "piece", "owner", "bits"), ["anchor", "piece"])
    both = pieces.filter("owner is not null").select("id", "hash", "start", "n", "owner", "bits")
    both = both.unionByName(rest.select("id", "hash", "start", "n", "owner", "bits"))
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n")) - 1
    marks = both.select("id", "hash", F.struct("start", F.when(F.col("id") > F.col("owner"), whole).otherwise(F.col("bits")).alias("bits")).alias("mark")).filter("mark.bits <> 0")
    out = materialise(marks.groupBy("id", "hash").agg(F.collect_set("mark").alias("marks")), "marks")  # of one document
    small_batches(spark)
    discard(pieces, searched, *left)
    return out


def _keep(names: list[str]):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, many, gone = [], [], []
            marks = batch.column("marks")
            for k, text in enumerate(batch.column("text")):
                parts = text.as_buffer().to_pybytes().split()  # at the bytes that part words
                many.append(len(parts))
                removed = 0
                if marks[k].is_valid:
                    goes = np.zeros(len(parts), bool)
                    for mark in marks[k].as_py():
                        bits = np.array([mark["bits"]], np.int64).view(np.uint8)
                        places = np.flatnonzero(np.unpackbits(bits, bitorder="little"))
                        goes[mark["start"] + places] = True
                    removed = int(goes.sum())
                    parts = [p for p, g in zip(parts, goes.tolist(), strict=True) if not g]
                gone.append(removed)
                said.append(b" ".join(parts).decode())
            yield pa.record_batch([batch.column("doc"), pa.array(said, pa.string()), pa.array(many, pa.int64()), pa.array(gone, pa.int64())], names)

    return keep


def remove_repeats(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) as a struct ``doc`` of the columns in ``carry``, with ``cleaned`` (the kept words, joined by
    one space), ``n_words`` and ``n_removed``: without the words in windows that a document with a smaller doc_id holds.

    Null and empty texts have no words and give an empty text; texts shorter than a window stay whole; a null doc_id counts as
    the largest; rows with one doc_id take nothing from each other; further columns pass through ``carry`` alone; an empty
    table gives an empty result."""
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct(*carry).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    marks = repeated_words(keyed.select("id", "hash", "text"))
    names = ["doc", "cleaned", "n_words", "n_removed"]
    joined = keyed.join(marks, ["id", "hash"], "left").select("doc", "text", "marks")
    return joined.mapInArrow(_keep(names), f"doc {dict(keyed.dtypes)['doc']}, cleaned string, n_words long, n_removed long")
