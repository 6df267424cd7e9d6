"""URL filter: fixed rules first, then association rules mined from labelled URLs.

FP-growth over the token sets of bad URLs gives rules "these tokens, therefore bad"; support and confidence
prune them, and so does any shorter rule that says the same.  A rule is filed under its rarest token; a URL looks
its tokens up there and then compares whole token sets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, materialise, spread_join

#: Rules up to which the index is broadcast (a kB each at most for URLs of a usual length).
BROADCAST_RULES = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``site`` is a host and a path, such as ``example.com/en/``; it fits the host and its subdomains."""

    verdict: str
    site: str


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (site, verdict) of the longest rule that fits, else null; of equals the first listed."""
    table = sorted(rules, key=lambda r: -len(r.site))
    if not table:
        return F.lit(None).cast("struct<site:string,verdict:string>")
    rows = F.array(*[F.struct(F.lit(r.site).alias("site"), F.lit(r.verdict).alias("verdict"), F.lit(r.site.partition("/")[0]).alias("host"), F.lit("/" + r.site.partition("/")[2]).alias("path")) for r in table])
    fits = F.filter(rows, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["site"].alias("site"), first["verdict"].alias("verdict")))


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path parts (digits as #), query names and values, fragment."""
    url = F.coalesce(url, F.lit(""))
    shaped = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "#")
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), shaped(x)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(?s)#(.*)$", 1)
    return F.array_distinct(F.concat(tagged("h:", F.split(host(url), r"\.")), tagged("p:", F.split(path(url), r"[/.]")), tagged("q:", F.split(query, "&")), tagged("f:", F.array(fragment))))


def informative(labelled: DataFrame, least_rows: int) -> DataFrame:
    """``token`` of ``labelled`` (tokens, bad) that a rule may hold: in ``least_rows`` bad rows at least, in bad rows more often
    than in others, and of tokens that stand in the same rows the first.  What these prunings leave bounds the itemsets."""
    spread = labelled.select("bad", F.xxhash64("tokens").cast("decimal(38,0)").alias("row"), F.explode("tokens").alias("token"))
    count = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("hits"), F.sum("row").alias("rows"))
    rate = labelled.agg(F.count(F.lit(1)).alias("all"), F.count_if("bad").alias("all_hits")).first()  # two numbers
    raised = count.filter((F.col("hits") >= least_rows) & (F.col("hits") * F.lit(rate["all"]) > F.col("n") * F.lit(rate["all_hits"])))
    return raised.groupBy("n", "hits", "rows").agg(F.min("token").alias("token")).select("token")


def mine(labelled: DataFrame, least_support: float = 0.0, least_confidence: float = 0.6, least_rows: int = 20) -> DataFrame:
    """(tokens, confidence, hits) from ``labelled`` (tokens, bad boolean): token sets that stand in ``least_rows`` rows (or that
    share of all) and of whose rows at least ``least_confidence`` are bad.  FP-growth runs over the bad rows alone, with
    their :func:`informative` tokens; the sets found are counted over all rows by the index that matches rules."""
    from pyspark.ml.fpm import FPGrowth

    clean = materialise(labelled.filter("bad is not null").select(F.array_distinct("tokens").alias("tokens"), "bad"), "labelled")
    total = clean.agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("bad")).first()  # two numbers
    none = labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, hits long")
    if not total["bad"]:
        discard(clean)
        return none
    support = max(least_support * total["rows"], least_rows)
    kept = materialise(informative(clean, max(1, math.ceil(support * least_confidence))), "tokens")
    bad = clean.filter("bad").withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("tokens").alias("token"))
    items = materialise(bad.join(kept, "token").groupBy("row").agg(F.collect_list("token").alias("items")).select("items"), "items")  # of one URL
    rows = items.count()
    if not rows:
        discard(clean, kept, items)
        return none
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, support * least_confidence / rows)).fit(items).freqItemsets
    sets = materialise(sets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hits")), "sets")
    counted = _looked_up(clean.select("tokens"), sets.select("tokens")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    rules = sets.join(counted.withColumnRenamed("rule", "tokens"), "tokens").withColumn("confidence", F.col("hits") / F.col("n"))
    rules = materialise(rules.filter((F.col("confidence") >= least_confidence) & (F.col("n") >= support)).select("tokens", "confidence", "hits"), "rules")
    discard(clean, kept, items, sets)
    # a rule goes where a shorter one within it is as sure: look its parts up, one token left out at a time
    parts = rules.select("tokens", "confidence", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
    beaten = parts.join(rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("surer")), "part").filter("surer >= confidence").select("tokens").distinct()
    return rules.join(beaten, "tokens", "left_anti")


def _looked_up(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``urls`` (tokens, ...) with each ``rule`` (token set of ``rules``) within their tokens.  A rule is filed under its
    rarest token.  A frequent token's URLs are no one task's."""
    spread = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    filed = rules.select(F.col("tokens").alias("rule"), F.explode("tokens").alias("token")).join(spread, "token").groupBy("rule").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    filed = materialise(filed, "filed")
    looked = urls.withColumn("token", F.explode("tokens"))
    met = spread_join(looked, filed, ["token"], filed.count() <= BROADCAST_RULES, [F.col("tokens")])
    return met.filter(F.size(F.array_except("rule", "tokens")) == 0).drop("token")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` of ``urls`` (url, tokens) that some rule fits."""
    return _looked_up(urls, rules.select("tokens")).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], **mining) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` (whether a mined rule fits).

    ``labels`` has ``page_id`` and ``bad``.  Rules are mined from all pages: a page that a fixed rule fits has that rule's
    verdict as its label, another one its label of ``labels``, and one without any counts as not bad, so that a
    rule's confidence is what is known of it at least.  Without a fitting fixed rule a mined rule blocks and
    anything else is allowed.  Null URLs and those without "://" have empty hosts and paths and no tokens; null and
    repeated page_ids stay rows; further columns are ignored; empty tables give an empty result or no mined rules."""
    known = pages.select("page_id", "url", fitting(rules, host(F.col("url")), path(F.col("url"))).alias("fixed"))
    bad = labels.filter("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = known.join(bad, "page_id", "left").select(tokens(F.col("url")).alias("tokens"), F.coalesce(F.col("fixed.verdict") == "block", "bad", F.lit(False)).alias("bad"))
    found = mine(labelled, **mining)
    urls = pages.filter("url is not null").select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    blocked = materialise(matched(urls, found).withColumn("mined", F.lit(True)), "blocked")
    judged = known.join(blocked, "url", "left")
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("mined"), "block").otherwise("allow"))
    return judged.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.col("fixed.site").alias("rule"), verdict.alias("verdict"), F.coalesce("mined", F.lit(False)).alias("mined"))
