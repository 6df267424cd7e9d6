"""Temperature mixing of sources: weights proportional to a power of each source's token share.

The exponent is bisected until the mixture meets a repetition limit or a target entropy; every source then
gets a token quota of which whole passes over it come first and the rest is dealt from a permutation of its
blocks, cut within the one block where the quota ends.  DataFrame functions alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialise, spread_join

#: Documents of a source that one block holds on average.
BLOCK_ROWS = 1000
NONE = "\x03"
#: Sources up to which their budgets are broadcast (200 bytes each).
BROADCAST_SOURCES = 50_000


def token_count(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def _halved(grows: Callable[[float], bool], low: float, high: float, times: int) -> tuple[float, float]:
    for _ in range(times):
        mid = (low + high) / 2
        low, high = (mid, high) if grows(mid) else (low, mid)
    return low, high


def exponent(shares: DataFrame, max_repetition: float | None, target_entropy: float | None) -> float:
    """The exponent between 0 and 1 from positive shares (``p``, a row per source), by 50 halvings.

    Repetition: the smallest exponent at which no source is passed over more than ``max_repetition`` times while the
    largest is passed over once; that takes the least and the largest share.  Entropy (nats): the largest at
    which the weights have it, up to a unit in the last place; ten sweeps over the sources give the entropies
    at the ends and middles of five halvings each."""
    ends = shares.agg(F.min("p").alias("least"), F.max("p").alias("top")).first()
    if ends["top"] is None:
        return 1.0
    if target_entropy is None:
        return _halved(lambda a: (ends["least"] / ends["top"]) ** (a - 1) > max_repetition, 0.0, 1.0, 50)[1]
    low, high = 0.0, 1.0
    for _ in range(10):
        grid = [low + (high - low) * k / 32 for k in range(1, 32)]
        sums = [(F.sum(F.pow("p", F.lit(a))).alias(f"z{k}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"s{k}")) for k, a in enumerate(grid)]
        found = shares.agg(*[x for pair in sums for x in pair]).first()
        entropy = {a: math.log(found[f"z{k}"]) - a * found[f"s{k}"] / found[f"z{k}"] for k, a in enumerate(grid)}
        low, high = _halved(lambda a: entropy[a] >= target_entropy, low, high, 5)  # noqa: B023
    return high


def source_quotas(rows: DataFrame, max_repetition: float | None = 2.0, target_entropy: float | None = None) -> DataFrame:
    """Per source of ``rows`` (src, n_tokens): ``tokens``, ``n_rows``, ``weight``, ``passes`` (whole ones) and ``rest`` (tokens)."""
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give either a repetition limit or a target entropy")
    totals = materialise(rows.groupBy("src").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows")), "totals")
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.filter("tokens > 0").select((F.col("tokens") / F.lit(float(everything or 1))).alias("p"))
    power = exponent(shares, max_repetition, target_entropy)
    sums = shares.agg(F.sum(F.pow("p", F.lit(power))).alias("norm"), F.max("p").alias("top")).first()
    fitted = {"sum": float(everything or 1), "a": power, "norm": sums["norm"] or 1.0, "top": sums["top"] or 1.0}
    total, power, norm, top = (F.lit(fitted[c]) for c in ("sum", "a", "norm", "top"))
    share = F.col("tokens") / total
    repeat = F.when(F.col("tokens") > 0, F.round(F.pow(share / top, power - 1), 6)).otherwise(F.lit(1.0))
    mixed = totals.withColumn("quota", F.floor(F.col("tokens") * repeat).cast("long"))
    held_tokens = F.col("tokens") > 0
    weight = F.when(held_tokens, F.pow(share, power) / norm).otherwise(0.0)
    passes = F.when(held_tokens, F.expr("quota div greatest(tokens, 1)")).otherwise(1).cast("long")
    rest = F.when(held_tokens, F.expr("quota % greatest(tokens, 1)")).otherwise(0).cast("long")
    return mixed.select("src", "tokens", "n_rows", weight.alias("weight"), passes.alias("passes"), rest.alias("rest"))


def mix(docs: DataFrame, carry: list[str], max_repetition: float | None = 2.0, target_entropy: float | None = None, seed: str = "mix") -> DataFrame:
    """For each row of ``docs`` its struct ``doc`` (columns in ``carry``), ``src``, ``n_tokens``, ``weight`` of its source and
    ``copies``, how often the mixture holds it; and ``turn``, by which its block takes its place in the permutation of its
    source's blocks.  The largest source is passed over once, so that every row is held.

    A null source is a source; null and empty texts have no tokens and are held as often as whole passes go;
    equal rows may differ by one copy; an empty table gives an empty result."""
    rows = docs.select(F.struct(*carry).alias("doc"), F.coalesce(F.col("source"), F.lit(NONE)).alias("src"), token_count(F.col("text")).alias("n_tokens"), F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))).alias("draw"))
    light = materialise(rows.drop("doc"), "mixing")  # ``doc`` may hold texts, which are read again instead
    quotas = materialise(source_quotas(light.select("src", "n_tokens"), max_repetition, target_entropy), "quotas")
    hashed = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    block = F.when(F.col("rest") > 0, hashed % F.ceil(F.col("n_rows") / BLOCK_ROWS)).otherwise(F.lit(0)).alias("block")
    few = quotas.count() <= BROADCAST_SOURCES
    blocks = spread_join(light, quotas, ["src"], few, [F.col("draw")]).filter("rest > 0").select("src", "n_tokens", "rest", block)
    blocks = blocks.groupBy("src", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    # the permutation of a source's blocks goes by hash; tokens before a block are summed by hash prefix, then within one
    turn = F.md5(F.concat_ws(":", F.lit(seed), "src", F.col("block").cast("string"))).alias("turn")
    blocks = materialise(blocks.select("*", turn).withColumn("part", F.substring("turn", 1, 2)), "turns")
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    parts = blocks.groupBy("src", "part").agg(F.sum("block_tokens").alias("part_tokens"))  # 256 a source at most
    parts = parts.select("src", "part", (F.sum("part_tokens").over(until(Window.partitionBy("src").orderBy("part"))) - F.col("part_tokens")).alias("base"))
    inner = F.sum("block_tokens").over(until(Window.partitionBy("src", "part").orderBy("turn", "block"))) - F.col("block_tokens")
    placed = blocks.withColumn("inner", inner).join(parts, ["src", "part"]).withColumn("before", F.col("base") + F.col("inner"))
    # blocks that begin within the budget are a prefix of the permutation: the last of them is all that rows need to know
    begun = placed.filter("before < rest").withColumn("cut", F.col("before") + F.col("block_tokens") > F.col("rest"))
    last = begun.groupBy("src").agg(F.max(F.struct("turn", "block", "cut", "before")).alias("last"))
    budget = materialise(quotas.drop("tokens").join(last, "src", "left"), "budget")
    discard(light, quotas, blocks)
    dealt = spread_join(rows, budget, ["src"], few, [F.col("draw")]).select("*", block).select("*", turn)
    at, end = F.struct("turn", "block"), F.struct("last.turn", "last.block")
    whole = (at < end) | ((at == end) & ~F.col("last.cut"))
    dealt = dealt.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("divided", F.coalesce((at == end) & F.col("last.cut"), F.lit(False)))
    out = ["doc", "src", "n_tokens", "weight", "turn"]
    plain = dealt.filter("rest = 0 or not divided").select(*out, (F.col("passes") + F.when((F.col("rest") > 0) & F.col("whole"), 1).otherwise(0)).alias("copies"))
    inside = until(Window.partitionBy("src").orderBy("draw"))  # one block a source
    cut = dealt.filter("rest > 0 and divided").withColumn("along", F.col("last.before") + F.sum("n_tokens").over(inside))
    cut = cut.select(*out, (F.col("passes") + F.when(F.col("along") <= F.col("rest"), 1).otherwise(0)).alias("copies"))
    return plain.unionByName(cut)
