"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Each group (all rows, a language, a language and source) gets a minimum-covariance-determinant estimate: from
three deterministic starts, concentration steps (distances under the present estimate, the half of the rows
with the smallest ones, its mean and covariance) go on as long as the determinant falls, and the start that
ends at the smallest determinant wins.  A group's estimate is then drawn towards its language's, and that one
towards all rows', by PRIOR rows' weight, so that groups of any size are judged by one rule.  Statistics are
whole numbers (thousandths), so that all sums are exact and the verdict doesn't depend on the order in which
executors add.  Everything is DataFrame functions; what is kept per group is a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, materialise, spread_join

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
#: Share of a group's rows in the concentrated sample, and the fall of the log determinant under which steps end.
SHARE, FALL = 0.5, 1e-3
#: Rows' weight with which a group's estimate is drawn towards the one above it: ten a dimension.
PRIOR = 60
#: Least standard deviation of each transformed statistic, in thousandths: the resolution below which a
#: difference means nothing, also where most of a group's rows are alike.
FLOORS = (350, 60, 350, 120, 150, 120)
#: Share of normally distributed rows that the cutoff rejects: less than one in the documents of any corpus.
TAIL = 1e-10
#: Median of chi-squared with six degrees of freedom.
MEDIAN = 5.348
#: Estimates of up to so many groups are broadcast (300 bytes each); of more they are joined by salted keys.
BROADCAST_GROUPS = 20_000
D = len(FLOORS)
LOWER = [(i, j) for i in range(D) for j in range(i + 1)]


def cutoff_at(tail: float) -> float:
    """The value that chi-squared with six degrees of freedom exceeds with probability ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        low, high = (x, high) if math.exp(-x / 2) * (1 + x / 2 + x * x / 8) > tail else (low, x)
    return high


CUTOFF = cutoff_at(TAIL)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``stats``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper (all long)."""
    return docs.withColumn("stats", statistics(F.coalesce(F.col(text), F.lit(""))))


def statistics(text: Column) -> Column:
    """The word, symbol, line and repetition counts of a text as a struct; every array is bound once, and the struct is one
    expression, so that taking several of its fields doesn't count again."""

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def covered(grams: Column) -> Column:
        """Words in 8-word windows that occur again: sort windows by hash, keep those beside an equal one, join their spans."""

        def spans(ordered: Column) -> Column:
            again = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(ordered, i + 1)["h"].eqNullSafe(x["h"])))
            places = F.array_sort(F.transform(again, lambda x: x["p"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(8), F.coalesce(F.get(p, i + 1) - x, F.lit(8)))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), spans))

    def paired(hashes: Column, apart: int) -> Column:
        return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + apart)))

    bare = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(F.regexp_replace(text, SYMBOLS, ""))
    upper = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))

    def counts(words: Column, doubled: Column) -> Column:
        # hashes of 2, 4 and 8 words from those of half as many
        windows = let(paired(words, 1), lambda two: let(paired(two, 2), lambda four: F.slice(paired(four, 4), 1, F.size(words) - 7)))
        repeated = F.when(F.size(words) < 8, 0).otherwise(let(windows, covered))
        found = {"n_words": F.size(words), "word_chars": F.length(F.array_join(words, "")), "n_repeat_words": repeated, "n_symbols": symbols, "n_dup_lines": doubled, "n_upper": upper}
        return F.struct(*[x.cast("long").alias(name) for name, x in found.items()])

    return let(words, lambda w: let(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), lambda doubled: counts(w, doubled)))


def base_failed(stats: Column, least_words: int = 20, most_repeated: int = 30) -> Column:
    """Too few words, or too many of them in windows that occur again."""
    return (stats["n_words"] < least_words) | (100 * stats["n_repeat_words"] > most_repeated * stats["n_words"])


def _vector(s: Column) -> list[Column]:
    """Transformed statistics in thousandths: length, word length, symbols, upper case, repeated lines, repeated words."""
    chars, words = F.greatest(s["word_chars"], F.lit(1)), F.greatest(s["n_words"], F.lit(1))
    raw = [F.log(words), F.log(chars / words), F.log(1 + 1000 * s["n_symbols"] / chars), F.sqrt(s["n_upper"] / chars), F.sqrt(s["n_dup_lines"] / words), F.sqrt(s["n_repeat_words"] / words)]
    return [F.round(1000 * x).cast("long") for x in raw]


def _with_groups(vectors: DataFrame) -> DataFrame:
    """Add g0, g1, g2: the groups of all rows, of the language, of the language and source."""
    return vectors.select(F.xxhash64(F.lit(0)).alias("g0"), F.xxhash64(F.lit(1), "lg").alias("g1"), F.xxhash64(F.lit(2), "lg", "src").alias("g2"), *[c for c in vectors.columns if c not in ("lg", "src")])


def _least_bin(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the smallest ``value`` up to which each share of the rows lies: counts per value, summed along it."""
    counted = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy(*by).orderBy(value)
    run = counted.withColumn("run", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("run") >= F.lit(share) * F.col("all"), F.col(value))).alias(name) for name, share in shares.items()])


def _joined(rows: DataFrame, table: DataFrame, key: str, few: bool, how: str = "inner") -> DataFrame:
    """``rows`` with the row of ``table`` of their ``key``; no group is one task's."""
    return spread_join(rows, table, [key], few, [F.col(f"x{i}") for i in range(D)], how)


def _inverse(matrix: Column) -> Column:
    """Inverse (``a``) and log determinant (``log``) of a positive definite matrix by sweeping its diagonal."""

    def sweep(state: Column, k: Column) -> Column:
        a = state["a"]
        pivot = a[k][k]
        swept = F.transform(a, lambda row, i: F.transform(row, lambda x, j: F.when((i == k) & (j == k), 1 / pivot).when(i == k, x / pivot).when(j == k, -x / pivot).otherwise(x - row[k] * a[k][j] / pivot)))
        return F.struct(swept.alias("a"), (state["log"] + F.log(pivot)).alias("log"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(D - 1)), F.struct(matrix.alias("a"), F.lit(0.0).alias("log")), sweep)


def _matrix(cell) -> Column:
    return F.array(*[F.array(*[cell(max(i, j), min(i, j)) for j in range(D)]) for i in range(D)])


def _estimates(t: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``n``, ``mean`` and ``scatter`` to those and the flat ``m*``, ``v*_*`` (inverse) and ``log`` that distances read."""
    done = t.withColumn("swept", _inverse(F.col("scatter")))
    inverse = [F.col("swept")["a"][i][j].alias(f"v{i}_{j}") for i, j in LOWER]
    return done.select(*keys, "n", "mean", "scatter", F.col("swept")["log"].alias("log"), *[F.col("mean")[i].alias(f"m{i}") for i in range(D)], *inverse)


def _sums(rows: DataFrame, keys: list[str], extra: tuple = ()) -> DataFrame:
    """Count, mean and scatter of x0.. by ``keys`` from exact sums (products stay under 4e8, so that 2e10 rows fit)."""
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in LOWER]
    t = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products, *extra)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(D)]
    scatter = _matrix(lambda i, j: F.col(f"p{i}_{j}") / F.col("n") - mean[i] * mean[j] + (float(FLOORS[i] ** 2) if i == j else 0.0))
    return t.withColumn("mean", F.array(*mean)).withColumn("scatter", scatter)


def _away(rows: DataFrame) -> DataFrame:
    """Add ``away``, the squared distance under the flat estimate beside the row, and ``step``, it in steps of about two percent."""
    off = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(D)]
    square = sum(((1.0 if i == j else 2.0) * off[i] * off[j] * F.col(f"v{i}_{j}") for i, j in LOWER), F.lit(0.0))
    return rows.withColumn("away", F.greatest(square, F.lit(0.0))).withColumn("step", F.floor(50 * F.log1p("away")).cast("int"))


FLAT = [f"m{i}" for i in range(D)] + [f"v{i}_{j}" for i, j in LOWER]


def _starts(members: DataFrame, few: bool) -> DataFrame:
    """Three estimates of each group (``gid``): medians and quartile ranges alone, the mean and covariance of all rows, and the
    medians with the covariance of the rows' directions from them."""
    grain = F.array(*[F.lit(f // 8) for f in FLOORS])
    long = members.select("gid", F.posexplode(F.array(*[f"x{i}" for i in range(D)])).alias("at", "value"))
    long = long.select("gid", "at", F.floor(F.col("value") / grain[F.col("at")]).alias("value"))  # counts per value stay few
    middle = _least_bin(long, ["gid", "at"], "value", {"low": 0.25, "mid": 0.5, "high": 0.75})
    spread = F.greatest((F.col("high") - F.col("low")) * grain[F.col("at")] / 1.349, F.element_at(F.array(*[F.lit(float(f)) for f in FLOORS]), F.col("at") + 1))
    middle = middle.select("gid", "at", ((F.col("mid") + 0.5) * grain[F.col("at")]).alias("mid"), spread.alias("spread"))
    middle = materialise(middle.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("at", "mid", "spread"))).alias("q")), "middle")  # six values a group
    middle = middle.withColumn("mid", F.transform("q", lambda x: x["mid"])).withColumn("spread", F.transform("q", lambda x: x["spread"])).drop("q")
    unit = [(F.col(f"x{i}") - F.col("mid")[i]) / F.col("spread")[i] for i in range(D)]
    told = _joined(members, middle, "gid", few).withColumn("size", F.sqrt(sum((u * u for u in unit), F.lit(1e-9))))
    told = told.select("gid", *[f"x{i}" for i in range(D)], *[F.round(1000 * unit[i] / F.col("size")).cast("long").alias(f"u{i}") for i in range(D)])
    turned = tuple(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"q{i}_{j}") for i, j in LOWER)
    both = materialise(_sums(told, ["gid"], turned).join(middle, "gid"), "both")
    diagonal = _matrix(lambda i, j: F.col("spread")[i] * F.col("spread")[i] if i == j else F.lit(0.0))
    # directions have length one: their covariance has trace one, and D of it stand for unit spreads
    signs = _matrix(lambda i, j: D * F.col(f"q{i}_{j}") / F.col("n") / 1e6 * F.col("spread")[i] * F.col("spread")[j] + (float(FLOORS[i] ** 2) if i == j else 0.0))
    parts = [both.select("gid", F.lit(k).alias("start"), "n", mean.alias("mean"), scatter.alias("scatter")) for k, (mean, scatter) in enumerate(((F.col("mid"), diagonal), (F.col("mean"), F.col("scatter")), (F.col("mid"), signs)))]
    out = materialise(_estimates(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["gid", "start"]), "starts")
    discard(middle, both)
    return out


def concentrate(members: DataFrame, few: bool) -> DataFrame:
    """``gid``, ``n``, ``mean`` and ``scatter`` of the minimum-determinant half of each group of ``members`` (gid, x0..)."""
    now, first = _starts(members, few), True
    settled = []
    while True:
        under = now if first else now.filter("fell")
        limit = _least_bin(_away(_joined(members, under.select("gid", "start", *FLAT), "gid", few)), ["gid", "start"], "step", {"limit": SHARE})
        limited = materialise(under.select("gid", "start", "log", *FLAT).join(limit, ["gid", "start"]), "limit")
        nearest = _away(_joined(members, limited.select("gid", "start", "limit", *FLAT), "gid", few)).filter("step <= limit")
        after = _estimates(_sums(nearest, ["gid", "start"]).select("gid", "start", "n", "mean", "scatter"), ["gid", "start"])
        before = under.select("gid", "start", F.col("log").alias("former"))
        fell = F.lit(True) if first else F.col("log") < F.col("former") - FALL
        judged = materialise(after.join(before, ["gid", "start"]).withColumn("fell", fell).drop("former"), "estimate")
        if not first:  # where the determinant stays, the estimate before it stays
            done = under.join(judged.filter("not fell").select("gid", "start"), ["gid", "start"], "left_semi")
            settled.append(materialise(done.select("gid", "start", "n", "mean", "scatter", "log"), "settled"))
        discard(now, limited)
        now, first = judged, False
        if settled and now.filter("fell").isEmpty():
            break
    discard(now)
    ends = settled[0]
    for more in settled[1:]:
        ends = ends.unionByName(more)
    least = F.min(F.struct("log", "start", "n", "mean", "scatter")).alias("e")
    out = materialise(ends.groupBy("gid").agg(least).select("gid", "e.n", "e.mean", "e.scatter"), "concentrated")
    discard(*settled)
    return out


def _drawn(own: str, above: str) -> tuple[Column, Column]:
    """Mean and scatter of two estimates together, the upper one with PRIOR rows' weight.  By how much their means differ is not
    added to the scatter: else a lone outlier would widen its own group until it fits."""
    n, mean, scatter = (F.col(f"{own}.{c}") for c in ("n", "mean", "scatter"))
    share = n / (n + PRIOR)
    to, around = F.col(f"{above}.mean"), F.col(f"{above}.scatter")
    both = F.zip_with(mean, to, lambda x, y: share * x + (1 - share) * y)
    return both, _matrix(lambda i, j: share * scatter[i][j] + (1 - share) * around[i][j])


def fit(vectors: DataFrame) -> DataFrame:
    """Per group of language and source (``g2``): ``m*``, ``v*_*`` and ``scale`` of its estimate, from rows of g0, g1, g2, x0..x5."""
    groups = materialise(vectors.select("g0", "g1", "g2").distinct(), "groups")
    few = groups.count() <= BROADCAST_GROUPS
    members = vectors.select(F.explode(F.array("g0", "g1", "g2")).alias("gid"), *[f"x{i}" for i in range(D)])
    found = concentrate(members, few)
    tree = groups
    for k in range(3):
        tree = tree.join(found.select(F.col("gid").alias(f"g{k}"), F.struct("n", "mean", "scatter").alias(f"e{k}")), f"g{k}")
    for k in (1, 2):
        mean, scatter = _drawn(f"e{k}", f"e{k - 1}")
        tree = tree.withColumn(f"e{k}", F.struct(F.col(f"e{k}.n").alias("n"), mean.alias("mean"), scatter.alias("scatter")))
    fitted = materialise(_estimates(tree.select("g2", "e2.*"), ["g2"]).select("g2", *FLAT), "fitted")

    # distances in units of their median's expectation, each group's drawn towards the one above it likewise
    away = _away(_joined(vectors, fitted, "g2", few)).select("step", F.explode(F.array("g0", "g1", "g2")).alias("gid"))
    half = _least_bin(away, ["gid"], "step", {"middle": 0.5}).select("gid", F.log((F.exp((F.col("middle") + 1) / 50) - 1) / MEDIAN).alias("log"))
    sizes = members.groupBy("gid").agg(F.count(F.lit(1)).alias("rows"))
    half = materialise(half.join(sizes, "gid"), "half")
    tree = groups
    for k in range(3):
        tree = tree.join(half.select(F.col("gid").alias(f"g{k}"), F.col("log").alias(f"l{k}"), F.col("rows").alias(f"r{k}")), f"g{k}")
    for k in (1, 2):
        tree = tree.withColumn(f"l{k}", (F.col(f"r{k}") * F.col(f"l{k}") + PRIOR * F.col(f"l{k - 1}")) / (F.col(f"r{k}") + PRIOR))
    out = materialise(fitted.join(tree.select("g2", F.greatest(F.lit(1.0), F.exp("l2")).alias("scale")), "g2"), "fitted")
    discard(groups, found, fitted, half)
    return out


def quality_rules(docs: DataFrame, carry: list[str], language: str = "lang", source: str = "source", cutoff: float = CUTOFF, recount: bool = False) -> DataFrame:
    """Judge each row of ``docs``: struct ``doc`` (the columns in ``carry``), struct ``stats``, ``base_failed``,
    ``away`` (squared robust distance in its group, null where base rules failed it) and ``kept``.

    Null texts count as empty, fail the base rules and are rejected; rows with a null language or source form
    groups of their own; repeated rows are judged each, alike.  A group's estimate is drawn towards its
    language's and that of all rows, so that a group of a few rows is judged almost by those.  Names in
    ``carry`` may be any, as they stay inside ``doc``; an empty table gives an empty result.
    ``recount``: count the statistics once more for the verdict instead of keeping ``doc`` on disk meanwhile."""
    judged = docs.select(F.struct(*carry).alias("doc"), F.coalesce(F.col(language), F.lit("\x03")).alias("lg"), F.coalesce(F.col(source), F.lit("\x03")).alias("src"), statistics(F.coalesce(F.col("text"), F.lit(""))).alias("stats"))
    vector = [x.alias(f"x{i}") for i, x in enumerate(_vector(F.col("stats")))]
    judged = _with_groups(judged.select("doc", "lg", "src", "stats", base_failed(F.col("stats")).alias("base_failed"), *vector))
    rows = materialise(judged.drop("doc", "stats") if recount else judged, "statistics")
    fitted = fit(rows.filter("not base_failed"))
    few = fitted.count() <= BROADCAST_GROUPS
    if recount:
        discard(rows)
        rows = judged
    scored = _away(_joined(rows, fitted, "g2", few, "left"))
    # one expression of both sides of the join, so that no part of a filter on it counts statistics below the join
    scored = scored.withColumn("away", F.when(~F.col("base_failed"), F.col("away") / F.col("scale")))
    return scored.select("doc", "stats", "base_failed", "away", F.coalesce(F.col("away") <= cutoff, F.lit(False)).alias("kept"))
