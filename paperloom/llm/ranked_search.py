"""Exact ranked search: the best documents of each item by term weights, seeded with thresholds.

Documents are read once for the terms that some item asks for; those postings are written.  From them come, for each
term, its weight and its stored impacts: the greatest one and the k-th greatest.  An item's k-th score is at least the k-th
impact of any of its terms, times the term's repeats.  In the order of falling document frequency an item's terms
are pruned as long as their greatest impacts together stay below that threshold: a document with such terms alone can't be among
the best.  Documents that meet an item in another term are its candidates; those whose remaining bound still reaches the
threshold are scored exactly.  Every task keeps its best k of an item, which also raise its own threshold, and the best of these win.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialise, small_batches
from .textvec import alphabet, blocks, words

#: Different terms of the items that are searched for at once; more items make more blocks, each with its own pass.
BLOCK_TERMS = 40_000
#: Cells of the dense table of impacts that a task works on at once.
CELLS = 1 << 21
#: Fixed values of the score.
SCALE, K1, B = 1_000_000_000, 1000, 25

_SPLIT = np.ones(256, bool)  # bytes between terms
_SPLIT[128:] = False
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    _SPLIT[ord(_first) : ord(_last) + 1] = False
_LETTERS = alphabet(_SPLIT)


def _terms(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of each text's terms, in order."""
    for _, data, offsets in blocks(texts):
        hashes, _, at = words(data, offsets, _SPLIT, _LETTERS)
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield hashes[a:b]


class Asked:
    """The terms of a block of items: ``terms`` (sorted hashes) and, item by item, their places and repeats."""

    def __init__(self, ids: list, texts: list[str | None]):
        found = [np.unique(t, return_counts=True) for t in _terms(pa.array(texts, pa.string()))]
        self.ids = ids
        self.terms = np.unique(np.concatenate([f[0] for f in found])) if found else np.zeros(0, np.uint64)
        self.items = [(np.searchsorted(self.terms, t), n) for t, n in found]


def _postings(terms: np.ndarray):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, at, times = [], [], []
            for own in _terms(batch.column(1)):
                place = np.searchsorted(terms, own)
                place = place[terms[np.minimum(place, len(terms) - 1)] == own] if len(terms) else place[:0]
                t, n = np.unique(place, return_counts=True)
                sizes.append(len(own))
                at.append(t.astype(np.int32))
                times.append(n.astype(np.int32))
            starts = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in at])]).astype(np.int32))
            flat = lambda parts: pa.ListArray.from_arrays(starts, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), flat(at), flat(times)], ["doc_id", "n", "terms", "tf"])

    return postings


def weights(n_documents: int, frequencies: np.ndarray) -> np.ndarray:
    """Whole-number weights of terms by their document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n_documents + 2) / (2 * int(f) + 1))) for f in frequencies], np.int64)


def _rows(batch: pa.RecordBatch, weight: np.ndarray, n_documents: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each posting of a batch: its row, term and impact."""
    lists = batch.column("terms")
    counts = lists.value_lengths().to_numpy()
    row, term = np.repeat(np.arange(len(counts)), counts), lists.flatten().to_numpy()
    tf = batch.column("tf").flatten().to_numpy().astype(np.int64)
    length = 100 - B + B * batch.column("n").to_numpy() * n_documents // max(1, n_terms)
    return row, term, weight[term] * (SCALE * tf // (K1 * tf + 12 * length[row]))


def _impacts(weight: np.ndarray, n_documents: int, n_terms: int, k: int):
    def impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, impact = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            _, t, x = _rows(batch, weight, n_documents, n_terms)
            term, impact = np.concatenate([term, t]), np.concatenate([impact, x])
            order = np.lexsort((-impact, term))
            term, impact = term[order], impact[order]
            first = np.searchsorted(term, term)
            best = np.arange(len(term)) - first < k
            term, impact = term[best], impact[best]
        yield pa.record_batch([pa.array(term), pa.array(impact)], ["term", "impact"])

    return impacts


class Plan:
    """What each item asks of a document: its terms and repeats, the terms that make a candidate, the bound of the others, the threshold."""

    def __init__(self, asked: Asked, weight: np.ndarray, frequency: np.ndarray, top: np.ndarray, kth: np.ndarray):
        self.weight = weight
        self.threshold, self.bound, self.pruned = [], [], []
        item, term, times = [], [], []
        for number, (places, repeats) in enumerate(asked.items):
            threshold = max([1, *(repeats * kth[places]).tolist()])  # a score of 0 is none
            by_frequency = np.lexsort((places, -frequency[places]))
            bounds = np.cumsum((repeats * top[places])[by_frequency])
            pruned = int(np.searchsorted(bounds, threshold, "left"))  # bounds below the threshold
            kept = by_frequency[pruned:]
            self.threshold.append(threshold)
            self.bound.append(int(bounds[pruned - 1]) if pruned else 0)
            self.pruned.append(pruned)
            item += [number] * len(kept)
            term += places[kept].tolist()
            times += repeats[kept].tolist()
        # by term, the items that it makes candidates of, with its repeats there
        item, term, times = (np.array(x, np.int64) for x in (item, term, times))
        order = np.argsort(term, kind="stable")
        self.by_term, self.repeats, self.starts = item[order], times[order], np.searchsorted(term[order], np.arange(len(asked.terms) + 1))
        longest = max([1, *(len(p) for p, _ in asked.items)])
        self.places, self.times = np.zeros((len(asked.items), longest), np.int64), np.zeros((len(asked.items), longest), np.int64)
        for number, (places, repeats) in enumerate(asked.items):
            self.places[number, : len(places)], self.times[number, : len(places)] = places, repeats


def _best(plan: Plan, n_documents: int, n_terms: int, k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(plan.threshold)
        threshold, bound = np.array(plan.threshold, np.int64), np.array(plan.bound, np.int64)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]  # item, score, id, id is null
        n = len(plan.weight)
        step = max(1, CELLS // max(1, n))
        for whole in batches:
            for at in range(0, len(whole), step):
                batch = whole.slice(at, step)
                row, term, impact = _rows(batch, plan.weight, n_documents, n_terms)
                table = np.zeros((len(batch), n), np.int64)
                table[row, term] = impact
                # candidates, and what their candidate-making terms are worth
                many = plan.starts[term + 1] - plan.starts[term]
                of = np.repeat(np.arange(len(term)), many)
                place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + plan.starts[term[of]]
                item = plan.by_term[place]
                pair, which = np.unique(row[of] * items + item, return_inverse=True)
                worth = np.zeros(len(pair), np.int64)
                np.add.at(worth, which, impact[of] * plan.repeats[place])
                docs, wanted = pair // items, pair % items
                reach = worth + bound[wanted] >= threshold[wanted]
                docs, wanted = docs[reach], wanted[reach]
                ids = batch.column("doc_id")
                number, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                for part in range(0, len(docs), 100_000):
                    d, i = docs[part : part + 100_000], wanted[part : part + 100_000]
                    score = (table[d[:, None], plan.places[i]] * plan.times[i]).sum(1)
                    good = score >= threshold[i]
                    held = [np.concatenate([h, x[good]]) for h, x in zip(held, (i, score, number[d], null[d]), strict=True)]
            order = np.lexsort((held[2], held[3], -held[1], held[0]))
            held = [h[order] for h in held]
            place = np.arange(len(order)) - np.searchsorted(held[0], held[0])
            full = held[0][place == k - 1]
            threshold[full] = np.maximum(threshold[full], held[1][place == k - 1])
            held = [h[place < k] for h in held]
        yield pa.record_batch([pa.array(held[0]), pa.array(held[2], pa.int64(), mask=held[3]), pa.array(held[1])], ["item", "doc_id", "score"])

    return best


def _search(docs: DataFrame, ids: list, texts: list, k: int) -> DataFrame:
    spark, asked = docs.sparkSession, Asked(ids, texts)
    n_asked = len(asked.terms)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    postings = materialise(read.mapInArrow(_postings(asked.terms), "doc_id long, n long, terms array<int>, tf array<int>"), "postings")
    total = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    frequency = np.zeros(n_asked, np.int64)
    for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # a row per term asked for
        frequency[r.term] = r.df
    weight = weights(total.documents, frequency)
    parts = postings.select("n", "terms", "tf").mapInArrow(_impacts(weight, total.documents, total.terms, k), "term int, impact long")
    ranked = parts.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).filter(F.col("place") <= k)
    stored = ranked.groupBy("term").agg(F.max("impact").alias("top"), F.min(F.when(F.col("place") == k, F.col("impact"))).alias("kth"))
    top, kth = np.zeros(n_asked, np.int64), np.zeros(n_asked, np.int64)
    for r in stored.collect():  # likewise
        top[r.term], kth[r.term] = r.top, r.kth or 0
    plan = Plan(asked, weight, frequency, top, kth)
    found = postings.mapInArrow(_best(plan, total.documents, total.terms, k), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    named = spark.createDataFrame(list(enumerate(asked.ids)), "item long, item_id long")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    out = materialise(best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"), "ranked")  # named: a block's items
    discard(postings)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents (doc_id, text) for each row of ``items`` (item_id, text): item_id, rank from 1, doc_id, score above 0.

    Null and empty texts have no terms: such documents aren't counted and such items find nothing.  Rows with one id are documents
    or items of their own.  Equal scores stand by doc_id, a null one last; further columns are ignored; empty tables give
    an empty result."""
    small_batches(docs.sparkSession)
    # no item has more terms than bytes; blocks are dealt by a hash, of about BLOCK_TERMS terms each
    load = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = math.ceil(load / 6 / BLOCK_TERMS) or 1
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"))
    out = None
    for part in range(parts):
        rows = dealt.filter(F.col("part") == part).select("item_id", "text").collect()  # a block
        found = _search(docs, [r.item_id for r in rows], [r.text for r in rows], k)
        out = found if out is None else out.unionByName(found)
    return out
