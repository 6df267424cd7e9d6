"""Exact Jaccard self-join of word n-gram sets by universe partitioning.

Sizes fall into bands whose ends differ by the threshold, so that linked sets lie in one band or in
neighbours.  For the band of the larger set at most H hashes differ between linked sets.  Hashing splits
the universe of shingles into segments with allowances of 0 (the segment's subset must agree) or 1 (it may
differ by one deletion); where the allowances plus one add up to more than H, some segment of every
linked pair agrees within its allowance.  How many segments get which allowance is chosen for each band by
cost: rows indexed against partners met by chance.  Candidates that share a key of few sets are verified
exactly.  Segments with crowded keys are left aside as far as a set's slack goes; sets with more of them are
indexed once more with single shingles as segments, of which each set keeps the cheapest; groups of that index are
verified against a pivot first, then wherever they still hold several components.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .storage import discard, materialise, small_batches
from .textvec import U, mix, shingle_sets

#: Segment layouts tried for a set with too many empty segments before empty ones are indexed as well.
LAYOUTS = 6
#: Share of the sets whose segments a set meets as if they had half in common (measured on the larger test table: one partner
#: for every two sets); classes from which on a key is crowded.
ALIKE, CROWD = 2e-5, 6
#: Buckets of the bounded filter on the texts that verification reads.
FILTER_BITS = 1 << 18


@dataclass(frozen=True)
class Level:
    """How sets of one size band are indexed: ``exact`` segments of allowance 0 after ``near`` of allowance 1."""

    upper: int
    differ: int
    exact: int
    near: int
    percent: int

    @property
    def segments(self) -> int:
        return self.exact + self.near

    def cost(self, unusable: np.ndarray) -> int:
        """Allowances (plus one each) of the segments marked: those of allowance 1 stand first and count twice."""
        return int(unusable.sum() + unusable[: self.near].sum())

    def slack(self, size: int) -> int:
        """How many allowances may go unused for a set of ``size``: a linked set of this band is no larger than the band's
        end nor than ``size`` / threshold, which bounds the hashes that differ more tightly for smaller sets."""
        largest = min(self.upper, size * 100 // self.percent)
        return self.exact + 2 * self.near - 1 - (size + largest) * (100 - self.percent) // (100 + self.percent)


def band_ends(largest: int, percent: int) -> list[int]:
    """Upper ends of the size bands, from 1 up to ``largest`` and one band more."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, ends[-1] * 100 // percent))
    return [*ends, max(ends[-1] + 1, ends[-1] * 100 // percent)]


def allocate(upper: int, percent: int, sets: int) -> Level | None:
    """The cheapest allocation for a band: rows indexed for a set plus partners that it meets by chance."""
    differ = 2 * upper * (100 - percent) // (100 + percent)
    if differ < 1:
        return None  # only equal sets link, and those are one class beforehand
    best = None
    for share in (0, 1, 2, 3, 4):
        for slack in sorted({0, 1, 2, 4, math.ceil(0.012 * differ), math.ceil(0.012 * differ + 3 * math.sqrt(0.012 * differ))}):
            budget = differ + 1 + slack
            near = budget // 2 * share // 4
            level = Level(upper, differ, budget - 2 * near, near, percent)
            rows = chance = 0.0
            for size in (upper, 0.9 * upper, 0.81 * upper):
                each = size / level.segments
                weak = level.exact * math.exp(-each) + 2 * near * (1 + each) * math.exp(-each)
                beyond = 0.5 * math.erfc((level.slack(int(size)) + 0.5 - weak) / math.sqrt(2 * weak + 1e-9))  # share of sets that need another layout
                rows += (level.exact + near * (1 + each)) * (1 + beyond) / 3
                chance += ALIKE * sets * (level.exact + near * (1 + each)) * math.exp(-1.5 * each) / 3
            # a set that meets many by chance is indexed anew, at a row for each of its shingles at most
            cost = rows + min(chance, upper)
            if best is None or cost < best[0]:
                best = (cost, level)
    return best[1]


def _layout(own: np.ndarray, level: Level, layout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Keys of one set in one layout, the segment of each, which segments can't tell sets apart (too few of the set's hashes
    lie in them), and whether so many can that any linked set agrees in one of those."""
    many = level.segments
    token = mix(own ^ U(0x5BD1E995))
    low, high = (token & U(0xFFFFFFFF)).astype(np.float64), (token >> U(32)).astype(np.float64)
    spread = mix(own + U(layout * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> U(32)
    segment = ((spread * U(many)) >> U(32)).astype(np.int64)
    size = np.bincount(segment, minlength=many)
    total = np.bincount(segment, low, many).astype(np.uint64) + (np.bincount(segment, high, many).astype(np.uint64) << U(32))
    label = mix(np.arange(many, dtype=np.uint64) + U((level.upper << 24) + (layout << 56)))
    weak = size <= (np.arange(many) < level.near)
    enough = level.cost(weak) <= level.slack(len(own))
    every = layout == LAYOUTS - 1 and not enough  # the last resort: empty segments are indexed like others
    kept = np.arange(many) if every else np.flatnonzero(size > 0)
    keys, at = [mix(total[kept] ^ label[kept])], [kept]
    if level.near:
        inside = np.flatnonzero((segment < level.near) & ((size[segment] > 1) | every))
        keys.append(mix((total[segment[inside]] - token[inside]) ^ label[segment[inside]]))
        at.append(segment[inside])
    return np.concatenate(keys), np.concatenate(at), np.zeros(many, bool) if every else weak, enough or every


def signatures(own: np.ndarray, level: Level) -> np.ndarray:
    """Index keys of one set at a level: of one layout, or of several until one has enough segments."""
    out = []
    for layout in range(LAYOUTS):
        keys, _, _, enough = _layout(own, level, layout)
        out.append(keys)
        if enough:
            break
    return np.unique(np.concatenate(out))


def served(own: np.ndarray, level: Level, crowded: np.ndarray) -> bool:
    """Whether any linked set of the band agrees in a segment without a ``crowded`` key (sorted): like empty segments, those
    with crowded keys may be left aside as far as the slack goes."""
    for layout in range(LAYOUTS):
        keys, at, unusable, enough = _layout(own, level, layout)
        if enough:
            unusable[at[np.isin(keys, crowded)]] = True
            return level.cost(unusable) <= level.slack(len(own))
    raise AssertionError("the last layout has enough segments")


def class_ids(own: np.ndarray) -> int:
    """A set's identity as a signed 64-bit integer."""
    return int(mix(mix(own).sum(keepdims=True, dtype=np.uint64) + U(len(own))).view(np.int64)[0])


def _sizes(words: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cid = [], []
            for own in shingle_sets(batch.column(1), words):
                n.append(len(own))
                cid.append(class_ids(own) if len(own) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), batch.column(2)], ["doc_id", "n_shingles", "cid", "hash"])

    return sizes


def _sized(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, class ``cid`` (null without words) and the ``hash`` of the text, a row per document."""
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    return materialise(hashed.mapInArrow(_sizes(words), "doc_id long, n_shingles long, cid long, hash long"), "sizes")


def _index(words: int, ends: list[int], levels: dict[int, Level]):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a partition are indexed once
        keys, cids, held = [], [], 0
        schema = ["key", "cid"]
        for batch in batches:
            for own in shingle_sets(batch.column(0), words):
                if not len(own) or (cid := class_ids(own)) in seen:
                    continue
                seen.add(cid)
                band = bisect_left(ends, len(own))
                for k in (band, band + 1):
                    if level := levels.get(k):
                        key = signatures(own, level)
                        keys.append(key)
                        cids.append(np.full(len(key), cid, np.int64))
                        held += len(key)
                if held > 200_000:
                    yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cids))], schema)
                    keys, cids, held = [], [], 0
        if held:
            yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cids))], schema)

    return index


def _texts(wanted: np.ndarray):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            keep = []
            for k in np.flatnonzero(wanted[hashes & FILTER_BITS - 1]).tolist():
                if hashes[k] not in seen:
                    seen.add(hashes[k])
                    keep.append(k)
            if keep:
                yield batch.take(pa.array(keep))

    return texts


def _verified(words: int):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = [k for k in range(len(a)) if a[k] != (a[k - 1] if k else last)]
            lefts = dict(zip(new, shingle_sets(batch.column(2).take(pa.array(new, pa.int64())), words), strict=True))
            shared, union = [], []
            for k, right in enumerate(shingle_sets(batch.column(3), words)):
                left = lefts.get(k, left)
                both = len(np.intersect1d(left, right, assume_unique=True))
                shared.append(both)
                union.append(len(left) + len(right) - both)
            last = a[-1] if a else last
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "shared", "together"])

    return verified


def _shingles(words: int, percent: int):
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, own in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words), strict=True):
                n = len(own)
                same = [pa.array(np.full(n, x, np.int64)) for x in (cid, n, n - -(-n * percent // 100) + 1)]
                yield pa.record_batch([pa.array(own.view(np.int64)), *same], ["key", "cid", "n", "spare"])

    return shingles


def _unserved(words: int, ends: list[int], levels: dict[int, Level]):
    def unserved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, crowded = batch.column(0).to_pylist(), batch.column(2)
            out = []
            for k, own in enumerate(shingle_sets(batch.column(1), words)):
                band = bisect_left(ends, len(own))
                keys = np.sort(crowded[k].values.to_numpy().view(np.uint64))
                if not all(served(own, levels[b], keys) for b in (band, band + 1) if b in levels):
                    out.append(cids[k])
            yield pa.record_batch([pa.array(out, pa.int64())], ["cid"])

    return unserved


def _rarest(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, cid, holders, n, alone, before): allocation by cost with single shingles as segments.  Linked sets share at least ``percent`` of the
    larger one's shingles, so each may skip all but its n - ceil(percent n) + 1 cheapest segments, those that
    the fewest sets hold (``before``: its cheaper ones); the ``alone`` ones that no other set holds need no row."""
    held = materialise(texts.select("cid", "text").mapInArrow(_shingles(words, percent), "key long, cid long, n long, spare long"), "held")
    holders = materialise(held.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1"), "holders")
    common = held.join(holders, "key")
    own = Window.partitionBy("cid")
    placed = common.withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own)).withColumn("place", F.row_number().over(own.orderBy("holders", "key")))
    return placed.filter("alone + place <= spare").select("key", "cid", "holders", "n", "alone", (F.col("alone") + F.col("place") - 1).alias("before"))


def _class_texts(docs: DataFrame, sizes: DataFrame, needed: DataFrame) -> DataFrame:
    """One text of each class in ``needed`` (cid), found by its hash.  A filter of FILTER_BITS bits, whatever the input's
    size, spares the exchange most texts that nobody asked for."""
    one = sizes.groupBy("cid").agg(F.min("hash").alias("hash"))
    wanted_hash = materialise(one.join(needed, "cid"), "wanted")
    buckets = wanted_hash.select(F.col("hash").bitwiseAND(FILTER_BITS - 1).alias("k")).distinct().collect()  # at most FILTER_BITS rows
    wanted = np.zeros(FILTER_BITS, bool)
    wanted[[r["k"] for r in buckets]] = True
    texts = docs.select(F.xxhash64("text").alias("hash"), "text").mapInArrow(_texts(wanted), "hash long, text string")
    out = materialise(texts.join(wanted_hash, "hash").dropDuplicates(["hash"]).select("cid", "text"), "texts")
    discard(wanted_hash)
    return out


def _verify(texts: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Shared and joint sizes of each pair (a, b) of classes."""
    one = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(_verified(words), "a long, b long, shared long, together long")


def similarity_classes(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` (size of its set of ``words``-word shingles) and
    ``component_id``, the smallest doc_id reachable over links with Jaccard similarity of at least
    ``percent`` / 100.

    Null and empty texts have no shingles, link with nothing and are their own component; a shorter text
    is one shingle.  Repeated rows stay rows.  A null doc_id is never the smallest unless a component has
    no other.  Further columns of ``docs`` are ignored; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    sizes = _sized(docs, words)
    of_class = _component_of_class(sizes, _roots(docs, sizes, words, percent), F.min("doc_id"))
    named = of_class.select("cid", F.col("first").alias("component_id"))
    return sizes.join(named, "cid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _component_of_class(sizes: DataFrame, roots: DataFrame, least: Column) -> DataFrame:
    """``cid``, ``root`` and ``first``, the minimum ``least`` over the component's documents.  Minima are taken by class, then by
    component, and written before they are joined, so that joins by a hot class or component can be split."""
    classes = sizes.filter("cid is not null").groupBy("cid").agg(least.alias("own"))
    rooted = materialise(classes.join(roots, classes.cid == roots.node, "left").select("cid", "own", F.coalesce("root", "cid").alias("root")), "rooted")
    first = materialise(rooted.groupBy("root").agg(F.min("own").alias("first")), "first")
    out = materialise(rooted.join(first, "root").select("cid", "root", "first"), "component")
    discard(roots, rooted, first)
    return out


def representatives(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each component of :func:`similarity_classes` keeps one document: that with the
    smallest doc_id (a null one last), once.  Texts without words stay all; columns are those of ``docs``, whatever
    their names.  Null texts count as empty, repeated rows are copies, an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    sizes = _sized(docs, words)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "hash")
    of_class = _component_of_class(sizes, _roots(docs, sizes, words, percent), F.min(place))
    kept = materialise(of_class.select("first.none", "first.id", "first.hash").distinct(), "kept")
    discard(sizes, of_class)
    key = ["none", "id", "hash"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    one = rows.filter("worded").join(kept, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row"))
    return one.select("row.*").unionByName(rows.filter("not worded").select("row.*"))


def _meeting(keyed: DataFrame) -> DataFrame:
    """Distinct rows of ``keyed`` (key, cid, ...) whose key several classes share."""
    group = Window.partitionBy("key")
    met = keyed.withColumn("least", F.min("cid").over(group)).withColumn("most", F.max("cid").over(group)).filter("least <> most").drop("least", "most").distinct()
    return materialise(met, "met")


def _meeting_hot(keyed: DataFrame) -> DataFrame:
    """As :func:`_meeting`, for few rows of which one key may hold many: those are written, so that the join by key can be split."""
    keyed = materialise(keyed, "keyed")
    ends = keyed.groupBy("key").agg(F.min("cid").alias("least"), F.max("cid").alias("most")).filter("least <> most").select("key")
    keys = materialise(ends, "keys")
    met = materialise(keyed.join(keys, "key"), "met")
    discard(keyed, keys)
    return met


def _sharing(met: DataFrame, order: str = "key") -> DataFrame:
    """Rows of ``met`` with the number of ``members`` of their key; of keys with the same members the first by ``order`` stays."""
    same = met.groupBy("key").agg(F.first(order).alias("first"), F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("cid", F.lit(7))).alias("xor"))
    alike = same.groupBy("members", "sum", "xor").agg(F.min(F.struct("first", "key"))["key"].alias("key"))
    return materialise(met.join(alike.select("key", "members"), "key"), "shared")


def _pairs(groups: DataFrame, condition: Column | None = None) -> DataFrame:
    """Distinct pairs (a, b) of classes of a key."""
    x, y = (groups.select("key", *[F.col(c).alias(f"{c}_{k}") for c in groups.columns if c != "key"]) for k in "xy")
    met = x.join(y, "key").filter(F.col("cid_x") < F.col("cid_y") if condition is None else condition)
    return met.select(F.least("cid_x", "cid_y").alias("a"), F.greatest("cid_x", "cid_y").alias("b")).distinct()


def _levels(counts: dict[int, int], ends: list[int], percent: int) -> dict[int, Level]:
    reached = [k for k in range(len(ends)) if counts.get(k) and counts[k] + counts.get(k - 1, 0) > 1]
    return {k: level for k in reached if (level := allocate(ends[k], percent, counts[k] + counts.get(k - 1, 0)))}


def _roots(docs: DataFrame, sizes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the classes of equal sets that have links."""
    largest = sizes.agg(F.max("n_shingles")).first()[0] or 1
    ends = band_ends(largest, percent)
    classes = sizes.filter("n_shingles > 0").groupBy("cid").agg(F.first("n_shingles").alias("n"))
    band = F.aggregate(F.array(*map(F.lit, ends[:-1])), F.lit(0), lambda k, end: k + F.when(F.col("n") > end, 1).otherwise(0))
    counts = {r["band"]: r["sets"] for r in classes.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("sets")).collect()}  # a row per band
    levels = _levels(counts, ends, percent)
    met = _meeting(docs.select("text").mapInArrow(_index(words, ends, levels), "key long, cid long"))
    shared = _sharing(met)
    texts = _class_texts(docs, sizes, shared.select("cid").distinct())

    # keys of few classes are checked as they are.  Crowded keys (a passage that many texts hold fills a segment now and
    # then) are left aside by sets whose other segments suffice; the other sets are indexed anew, by their rarest shingles
    crowds = met.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > CROWD).select("key")
    crowded = met.join(crowds, "key").groupBy("cid").agg(F.collect_list("key").alias("keys"))  # at most a set's own keys
    unserved = materialise(texts.join(crowded, "cid").select("cid", "text", "keys").mapInArrow(_unserved(words, ends, levels), "cid long"), "unserved")
    discard(met)
    again = _meeting_hot(_rarest(texts.join(unserved, "cid", "left_semi"), words, percent))
    groups = _sharing(again, "holders")
    discard(again)
    weight = groups.groupBy("cid").agg(F.sum("members").alias("weight"))
    weighed = groups.join(weight, "cid").groupBy("key").agg(F.max(F.struct("weight", "cid", "n", "before")).alias("pivot"))
    pivots = materialise(weighed, "pivots")
    starred = materialise(groups.join(pivots, "key").select("key", "cid", "n", "alone", "before", "pivot"), "starred")
    # at the first shingle that a linked pair shares, all that stand before it count as differences
    fits = f"({{0}}.before + {{1}}.before) * {100 + percent} <= {100 - percent} * ({{0}}.n + {{1}}.n)"
    stars = starred.withColumn("own", F.struct("n", "before")).filter("cid <> pivot.cid").filter(F.expr(fits.format("own", "pivot"))).select(F.least("pivot.cid", "cid").alias("a"), F.greatest("pivot.cid", "cid").alias("b"))
    checked = materialise(_verify(texts, _pairs(shared.filter(F.col("members") <= CROWD).select("key", "cid")).unionByName(stars).distinct(), words), "checked")
    linked = F.expr(f"100 * shared >= {percent} * together")
    roots = materialise(components(checked.filter(linked).select("a", "b")), "roots")

    # groups that still hold several components: the pairs across components that fit.  What a set alone
    # holds differs from any other set, and of the pivot's shingles two sets lack at least as many
    # differently as the numbers that they lack differ
    parted = starred.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    several = parted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    several = materialise(several.select("key"), "several")
    parted = parted.join(several, "key").filter("cid <> pivot.cid")
    parted = parted.withColumn("a", F.least("pivot.cid", "cid")).withColumn("b", F.greatest("pivot.cid", "cid")).join(checked, ["a", "b"], "left")
    keys = groups.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("holders", "key"))), lambda k: k["key"]).alias("keys"))  # of one set
    parted = parted.join(keys, "cid").select("key", "cid", "root", "keys", F.struct("n", "alone", "before", (F.col("pivot.n") - F.col("shared")).alias("lacks")).alias("own"))
    differ = "(own_x.alone + own_y.alone + coalesce(abs(own_x.lacks - own_y.lacks), 0))"
    near = (F.col("root_x") < F.col("root_y")) & F.expr(fits.format("own_x", "own_y")) & F.expr(f"{differ} * {100 + percent} <= {100 - percent} * (own_x.n + own_y.n)")
    near = near & F.expr(f"100 * least(own_x.n, own_y.n) >= {percent} * greatest(own_x.n, own_y.n)")
    near = near & F.expr("element_at(array_intersect(keys_x, keys_y), 1) = key")  # a pair once, at its first shingle
    second = materialise(_pairs(parted, near), "second")
    if not second.isEmpty():
        more = _verify(texts, second, words).filter(linked).select("a", "b")
        roots = materialise(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    discard(shared, texts, unserved, groups, pivots, starred, checked, several, second)
    return roots
