"""Secret scan with multipart credential linking, in DataFrame functions alone.

Strong spans (assigned secrets, access identifiers, long hex) are reported as they stand.  Weak candidates
(short or bare secrets, user names, endpoints) are reported only where complementary parts lie in the same
scope, a distance of ``SCOPE`` code points: a weak secret beside an identifier, a weak identifier beside a
secret, an endpoint beside both.  Parts are joined by text and scope bucket; each bucket is first reduced to
its first and last part of a class, so that the join's rows grow with the parts and not with their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise

#: Strong patterns, in the order of kinds; the assigned value is group 2.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8
#: Weak patterns.
BARE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}"
IDENT = r"""(?i)(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""(?i)(?:https?|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>]+"""
SCOPE = 200
KINDS = ("assign", "access", "hex", "weak", "ident", "endpoint")
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str, kind: int, long_enough: tuple[int, int] | None = None) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches: lengths of what lies between them and of the
    matches, summed along the text.  ``long_enough``: a group and its least length, applied to the matches found."""
    between = F.split(text, pattern, -1)

    def spans(parts: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        sizes = F.transform(found, lambda x: F.length(x))
        values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(long_enough[0])), lambda x: F.length(x)) if long_enough else sizes
        steps = F.arrays_zip(F.transform(parts, lambda x: F.length(x)).alias("gap"), sizes.alias("size"), values.alias("value"))

        def add(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + F.coalesce(x["size"], F.lit(0))
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            counts = x["size"].isNotNull() & (x["value"] >= (long_enough[1] if long_enough else 0))
            return F.struct(end.alias("at"), F.when(counts, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

        def shifted(runs: Column) -> Column:
            before = F.aggregate(runs, F.array(F.lit(0)), lambda a, run: F.concat(a, F.array(F.element_at(a, -1) + run["at"])))
            move = lambda by: lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"))
            return _let(before, lambda b: F.flatten(F.transform(runs, lambda run, k: F.transform(run["out"], move(F.get(b, k))))))

        # sums along runs of about the root of all steps, then along the runs: appending to one array of all would copy it each time
        def summed(all_: Column) -> Column:
            many = F.ceil(F.sqrt(F.size(all_))).cast("int")
            runs = F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / many).cast("int")), lambda k: F.slice(all_, k * many + 1, many))
            return _let(F.transform(runs, lambda run: F.aggregate(run, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), add)), shifted)

        return _let(steps, summed)

    return _let(between, lambda parts: F.when(F.size(parts) == 1, F.array().cast(SPAN)).otherwise(spans(parts)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _weak_secrets(text: Column) -> Column:
    """Bare tokens that mix digits with letters of both cases, and assigned values too short to be strong."""
    bare = F.filter(_located(text, BARE, 3), lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("[0-9]") & F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("[a-z]") & F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("[A-Z]"))
    short = F.filter(_located(text, ASSIGN, 3, (2, 3)), lambda s: ~F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike(ASSIGN[:-2] + "{8,})$"))
    return F.concat(bare, short)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, arrays of spans ``strong`` and ``linked`` (start, kind, end in
    code points, end exclusive).

    A null text counts as empty and has no spans; null and repeated doc_ids stay rows of their own, as the
    linking goes by text; further columns are ignored; an empty table gives an empty result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select("doc_id", text.alias("text"))
    text = F.col("text")
    strong = F.concat(_located(text, ASSIGN, 0, (2, LEAST_VALUE)), _located(text, ACCESS, 1), _located(text, HEX, 2))
    weak = F.concat(_weak_secrets(text), _located(text, IDENT, 4), _located(text, ENDPOINT, 5))
    spans = materialise(scanned.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), strong.alias("strong"), weak.alias("weak")), "spans")
    parted = spans.filter("size(weak) > 0 and size(weak) + size(strong) > 1").dropDuplicates(["k1", "k2"])
    kinds = lambda *x: F.col("p.kind").isin(*x)
    parts = parted.select("k1", "k2", F.explode(F.concat("weak", "strong")).alias("p"))
    # weak parts within a strong one go: strong ones that begin no later reach to their end
    reach = F.max(F.when(kinds(0, 1, 2), F.col("p.end"))).over(Window.partitionBy("k1", "k2").orderBy("p.start"))
    parts = parts.withColumn("reach", F.coalesce(reach, F.lit(0))).filter(kinds(0, 1, 2) | (F.col("reach") < F.col("p.end")))
    # identifiers: access, ident; secrets: assign, hex, weak
    parts = parts.select("k1", "k2", "p", F.when(kinds(1, 4), "id").when(kinds(0, 2, 3), "secret").otherwise("endpoint").alias("class"), F.floor(F.col("p.start") / scope).alias("bucket"))
    ends = parts.filter("class <> 'endpoint'").groupBy("k1", "k2", "bucket", "class").agg(F.min("p.start").alias("first"), F.max("p.start").alias("last"))
    spread = ends.select("k1", "k2", "class", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"), "bucket", "first", "last").select("k1", "k2", (F.col("bucket") + F.col("d")).alias("bucket"), F.col("class").alias("other"), "d", "first", "last")
    # d: where the weak part's bucket lies from the other's; in the same one any two parts are near
    near = ((F.col("d") == 0) | ((F.col("d") == 1) & (F.col("last") >= F.col("p.start") - scope)) | ((F.col("d") == -1) & (F.col("first") <= F.col("p.start") + scope)))
    met = parts.filter("p.kind >= 3").join(spread, ["k1", "k2", "bucket"]).filter(near & (F.col("other") != F.col("class")))
    found = met.groupBy("k1", "k2", "p", "class").agg(F.max(F.col("other") == "id").alias("id"), F.max(F.col("other") == "secret").alias("secret"))
    found = found.filter("(class = 'secret' and id) or (class = 'id' and secret) or (class = 'endpoint' and id and secret)")
    # of one text; written first, so that a text with many copies can be split where it is joined
    linked = materialise(found.groupBy("k1", "k2").agg(F.collect_set("p").alias("linked")), "linked")
    return spans.join(linked, ["k1", "k2"], "left").select("doc_id", "strong", F.coalesce("linked", F.array().cast(SPAN)).alias("linked"))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of strong spans, their digest and all spans as a string."""
    found = secret_spans(docs)

    def many(kind: int) -> Column:
        return F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(many, range(3)), F.sha2(_joined(F.col("strong")), 256).alias("base_sha256"), _joined(F.concat("strong", "linked")).alias("spans"))
