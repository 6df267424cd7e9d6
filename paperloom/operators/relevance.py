"""Which blocks are relevant: labels first, then a calibrated linear classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .machines import Machines, train
from .scripts import sliced, small_batches

KEY = ("link", "text_id")
#: Rows of either label that :func:`sampled` keeps, about, unless told otherwise; no query learns from a sample.
LABELLED = 2000
#: Bytes, about, of the frequent terms that are sent to every task.
HELD_BYTES = 16 << 20


def label_join(blocks: DataFrame, labels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return blocks.join(labels, list(key), "inner")


def label_queue(blocks: DataFrame, labels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Blocks that nobody has labelled yet."""
    return blocks.join(labels.select(*key).distinct(), list(key), "left_anti")


def with_labels(blocks: DataFrame, labels: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Left join of the distinct labels; a block with several distinct ones is repeated."""
    return blocks.join(labels.select(*key, "word_type", "label").distinct(), list(key), "left")


def relevant(label: Column, count: Column, score: Column, threshold: float = 0.5) -> Column:
    """A label decides where there is one (0: relevant); else mentions and a low probability of irrelevance."""
    return F.when(label.isNotNull(), label == 0).otherwise((count > 0) & (score < threshold))


def fold(df: DataFrame, label: str, key: str, folds: int = 5, buckets: int = 256, salt: str = "") -> DataFrame:
    """Add ``fold``: stratified by label, in the order of a hash of the key and ``salt``.  Places are counted in two levels, buckets of a
    label and rows of a bucket, so that a label is no one task's."""
    placed = df.withColumn("__bucket", F.pmod(F.xxhash64(key, F.lit(salt)) if salt else F.xxhash64(key), F.lit(buckets)))
    sizes = placed.groupBy(label, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(label).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    bases = sizes.select(F.col(label).alias("__label"), F.col("__bucket").alias("__b"), before.alias("__base"))  # a row per label and bucket
    inside = F.row_number().over(Window.partitionBy(label, "__bucket").orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)).cast("binary")), key))
    joined = placed.withColumn("__place", inside).join(F.broadcast(bases), F.col(label).eqNullSafe(F.col("__label")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn("fold", ((F.col("__base") + F.col("__place") - 1) % folds).cast("int")).select(*df.columns, "fold")


def uncertain(scored: DataFrame, score: str = "score", low: float = 0.5, high: float = 0.8) -> DataFrame:
    """Rows worth a label: those that the classifier calls irrelevant without being sure."""
    return scored.filter((F.col(score) > low) & (F.col(score) < high))


def with_pairs(tokens: Column) -> Column:
    """The tokens and the pairs of neighbouring ones."""
    ahead = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.concat(tokens, F.zip_with(ahead, F.slice(tokens, 2, F.size(ahead)), lambda a, b: F.concat_ws(" ", a, b)))


def document_frequencies(df: DataFrame, key: str, tokens: str, least: int) -> DataFrame:
    """(term, df) of terms in at least ``least`` rows."""
    return df.select(key, F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)


def _counts_in_rows(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, term, tf): a row for each term of each row, counted where the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lists = batch.column("tokens")
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            coded = pc.list_flatten(lists).dictionary_encode()
            code, width = pc.fill_null(coded.indices, -1).to_numpy(), max(1, len(coded.dictionary))
            met, tf = np.unique((row * width + code)[code >= 0], return_counts=True)
            yield pa.record_batch([batch.column("key").take(pa.array(met // width)), coded.dictionary.take(pa.array(met % width)), pa.array(tf, pa.int64())], ["key", "term", "tf"])

    rows = small_batches(df).select(F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, term string, tf long")


def _frequent(found: DataFrame) -> int:
    """The least rank from which on the terms of ``found`` (term, df, rank) are held together in HELD_BYTES."""
    total, least = 0, 1 << 30
    for r in sorted(found.groupBy("rank").agg((F.sum(F.octet_length("term")) + 64 * F.count(F.lit(1))).alias("bytes")).collect(), key=lambda r: -r["rank"]):  # some hundreds
        total += r["bytes"]
        if total > HELD_BYTES:
            break
        least = r["rank"]
    return least


def tf_idf(df: DataFrame, key: str, tokens: str, least: int = 2) -> DataFrame:
    """(key, term, tf, tfidf) with idf = ln((n + 1) / (df + 1)) of terms in at least ``least`` rows; rows that share a key are one.

    Each row's terms are counted in the row and written once; frequencies are those of the written terms.  The most frequent
    terms, up to HELD_BYTES, are sent to every task, so that no common term is shuffled; only the others meet by a join."""
    n = df.count()
    stored = written(_counts_in_rows(df, key, tokens), "counts")
    repeated = not df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    counts = stored.groupBy("key", "term").agg(F.sum("tf").alias("tf")) if repeated else stored
    found = stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    found = written(found.withColumn("rank", F.floor(8 * F.log2("df")).cast("int")), "frequencies")
    known, first = found.select("term", "rank", F.log(F.lit(n + 1.0) / (F.col("df") + 1)).alias("idf")), _frequent(found)
    held, rest = F.broadcast(known.filter(F.col("rank") >= first)), known.filter(F.col("rank") < first)
    met = counts.join(held, "term")
    if not rest.isEmpty():
        met = met.unionByName(counts.join(held, "term", "left_anti").join(rest, "term"))
    return met.select(F.col("key").alias(key), "term", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def sampled(rows: DataFrame, label: str = "label", key: str = "block_id", most: int = LABELLED) -> DataFrame:
    """The rows of label 0 or 1 if there are at most ``most`` of it, else about as many, by a hash of the key."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect() if r[0] in (0, 1)}  # a row a label
    share = lambda k: min(1 << 30, (most << 30) // max(1, counts.get(k, 0)))
    draw = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30))
    return rows.filter(F.col(label).isin(0, 1)).filter(draw < F.when(F.col(label) == 1, share(1)).otherwise(share(0)))


@dataclass
class CalibratedSVM:
    """Linear SVMs whose margins sigmoids turn into probabilities, a pair for each fold: of a block's terms in ``columns[0]`` and its
    contexts' terms and pairs in the others."""

    machines: Machines

    def save(self, path: str) -> None:
        """Write the model below ``path``."""
        self.machines.save(path)

    @classmethod
    def load(cls, path: str) -> CalibratedSVM:
        return cls(Machines.load(path))

    def score(self, rows: DataFrame, out: str | Sequence[str] = "score", keep: Sequence[str] | None = None) -> DataFrame:
        """Add the mean of the folds' probabilities of label 1, of joint machines a column for each family; null arrays count as empty;
        ``keep``: the columns of ``rows`` that stay, all by default."""
        full, *near = self.machines.columns
        kept = list(rows.columns if keep is None else keep)
        outs = [out] if isinstance(out, str) else list(out)
        seen = rows.select(F.struct(*kept).alias("__kept"), F.col(full), *[with_pairs(F.col(c)).alias(c) for c in near])
        return self.machines.score(seen, outs, ["__kept"]).select("__kept.*", *outs)


def _learning(rows: DataFrame, label: str, key: str, folds: Column, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Training rows as :func:`machines.train` reads them, written once: their number must not change."""
    near = [with_pairs(F.col(c)).alias(c) for c in columns[1:]]
    return written(rows.select(F.monotonically_increasing_id().alias("row"), F.col(label).alias("label"), F.col(key).alias("key"), folds.alias("folds"), columns[0], *near, *extra), "learning")


def joint_machines(labelled: DataFrame, near: dict[str, str], label: str = "label", key: str = "block_id", folds: int = 5, cost: float = 1.0, steps: int = 100) -> tuple[CalibratedSVM, DataFrame]:
    """The machines of each family of ``near`` (to the column of its contexts) from the rows of ``labelled`` with that ``word_type``, all
    trained in the same sweeps (at most ``steps``); and those rows as key, word_type, label, fold, margin and probability by the
    machine of the fold that left them out."""
    families, columns = list(near), ["tokens", *dict.fromkeys(near.values())]
    rows = labelled.filter(F.col("word_type").isin(families)).withColumn("__kind", F.struct("word_type", label))
    rows = fold(rows, "__kind", key, folds)
    own = F.array(*[F.when(F.col("word_type") == f, F.col("fold")).otherwise(-1) for f in families])
    read = _learning(rows, label, key, own, columns, ["word_type", "fold"])
    uses = np.array([[c in ("tokens", near[f]) for c in columns] for f in families])
    machines, margins = train(read, columns, len(families), folds, uses, cost, sweeps=steps)
    place = F.array_position(F.array(*map(F.lit, families)), F.col("word_type")).cast("int") - 1
    held = read.join(margins, "row").withColumn("__at", place * folds + F.col("fold"))
    values = lambda x: F.get(F.array(*[F.lit(float(v)) for v in x.ravel()]), F.col("__at"))
    margin = F.get("margins", F.col("__at"))
    chance = 1 / (1 + F.exp(values(machines.slope) * margin + values(machines.shift)))
    return CalibratedSVM(machines), held.select(F.col("key").alias(key), "word_type", F.col("label").alias(label), "fold", margin.alias("margin"), chance.alias("probability"))


def family_machines(labelled: DataFrame, near: dict[str, str], label: str = "label", key: str = "block_id", **fitting) -> tuple[dict[str, CalibratedSVM], DataFrame]:
    """As :func:`joint_machines`, with a model for each family by its name."""
    joint, held = joint_machines(labelled, near, label, key, **fitting)
    return {f: CalibratedSVM(_own(joint.machines, o, joint.machines.columns, c)) for o, (f, c) in enumerate(near.items())}, held


def _own(machines: Machines, o: int, columns: Sequence[str], near: str) -> Machines:
    one = machines.space(o)
    kept = [k for k, c in enumerate(columns) if c in ("tokens", near)]
    one.columns, one.terms = tuple(columns[k] for k in kept), [one.terms[k] for k in kept]
    return one


def family_scores(labelled: DataFrame, blocks: DataFrame, families: Sequence[str], label: str = "label", key: str = "block_id", **fitting) -> tuple[dict[str, CalibratedSVM], DataFrame]:
    """A model for each of ``families``, and all ``blocks`` with a column ``score_<family>`` of each; ``context_<family>`` holds a
    family's context where there is such a column, else ``context``."""
    near = {f: f"context_{f}" if f"context_{f}" in blocks.columns else "context" for f in families}
    models, _ = family_machines(labelled, near, label, key, **fitting)
    for family, model in models.items():
        blocks = model.score(blocks, f"score_{family}")
    return models, blocks


def out_of_fold(rows: DataFrame, label: str = "label", key: str = "block_id", folds: int = 5, steps: int = 100, cost: float = 1.0) -> DataFrame:
    """(key, label, fold, score): each row's probability of label 1 by the calibrated model of the other folds' rows, of ``tokens`` and
    every column ``context`` or ``context_<name>``.  Vocabulary, frequencies, machines and calibration see those rows alone."""
    columns = ["tokens", *(c for c in rows.columns if c == "context" or c.startswith("context_"))]
    outer = fold(rows, label, key, folds).withColumnRenamed("fold", "outer").withColumn("__kind", F.struct(label, "outer"))
    parted = fold(outer, "__kind", key, folds, salt="inner")
    sets = F.array(*[F.when(F.col("outer") == o, -1).otherwise(F.col("fold")) for o in range(folds)])
    read = _learning(parted, label, key, sets, columns, ["outer"])
    machines, margins = train(read, columns, folds, folds, cost=cost, sweeps=steps)
    flat = lambda x: F.array(*[F.lit(float(v)) for v in x.ravel()])
    at = lambda k: F.col("outer") * folds + k
    chances = [1 / (1 + F.exp(F.get(flat(machines.slope), at(k)) * F.get("margins", at(k)) + F.get(flat(machines.shift), at(k)))) for k in range(folds)]
    score = sum(chances[1:], chances[0]) / folds
    return read.join(margins, "row").select(F.col("key").alias(key), F.col("label").alias(label), F.col("outer").alias("fold"), score.alias("score"))


def rank_metrics(scored: DataFrame, label: str = "label", score: str = "score", by: str = "fold", threshold: float = 0.5, buckets: int = 1024) -> DataFrame:
    """(by, accuracy, precision, recall, f1, roc_auc) of scores from 0 to 1.  The area counts, for each row of label 1, the rows of label 0 below
    it and half of those level with it: places are summed in two levels, buckets of scores and scores of a bucket.  A ratio
    without rows to divide by is 0, an area without both labels null."""
    one, none = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    rows = scored.select(F.col(by).alias("by"), F.col(label).alias("y"), F.col(score).alias("s"), F.floor(F.col(score) * buckets).alias("b"))
    levels = rows.groupBy("by", "b", "s").agg(one.alias("ones"), none.alias("zeros"), F.count_if((F.col("y") == 1) & (F.col("s") > threshold)).alias("hit"), F.count_if((F.col("y") == 0) & (F.col("s") > threshold)).alias("false"))
    before = Window.partitionBy("by").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a bucket
    bases = levels.groupBy("by", "b").agg(F.sum("zeros").alias("zeros")).select("by", "b", F.coalesce(F.sum("zeros").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("by", "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = levels.withColumn("below", F.coalesce(F.sum("zeros").over(inside), F.lit(0))).join(bases, ["by", "b"])
    sums = ranked.groupBy("by").agg(F.sum("ones").alias("p"), F.sum("zeros").alias("n"), F.sum("hit").alias("hit"), F.sum("false").alias("false"), F.sum(F.col("ones") * (F.col("base") + F.col("below") + F.col("zeros") / 2)).alias("wins"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hit, false, p, n = (F.col(c) for c in ("hit", "false", "p", "n"))
    return sums.select(
        F.col("by").alias(by), ratio(hit + n - false, p + n).alias("accuracy"), ratio(hit, hit + false).alias("precision"), ratio(hit, p).alias("recall"),
        ratio(2 * hit, hit + false + p).alias("f1"), F.try_divide("wins", p * n).alias("roc_auc"),
    )


def cross_validate(rows: DataFrame, label: str = "label", key: str = "block_id", folds: int = 5, steps: int = 100) -> DataFrame:
    """(fold, accuracy, precision, recall, f1, roc_auc) of the calibrated model on held-out folds."""
    return rank_metrics(out_of_fold(rows, label, key, folds, steps), label)
