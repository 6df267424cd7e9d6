"""How far a correction brings text to its gold version."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import bound
from .scripts import edit_script, in_place, opcodes_of, with_measures


def cer(text: Column, gold: Column) -> Column:
    """Edits per character of the gold text; 0 where that is empty."""
    return F.when(F.length(gold) == 0, 0.0).otherwise(F.levenshtein(text, gold) / F.length(gold))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def wer(text: Column, gold: Column) -> Column:
    """Edits per word: each distinct word of the two texts becomes one character, then the built-in distance counts.

    Where both have equally many words and every one that differs from its counterpart is a word that the gold text lacks, no script is
    shorter than to replace those."""
    return bound(F.struct(words(text).alias("a"), words(gold).alias("b")), lambda w: _word_errors(w["a"], w["b"]))


def _word_errors(a: Column, b: Column) -> Column:
    known = F.array_distinct(F.concat(a, b))
    # characters beyond the first plane: there are 1,048,575 of them, and no text with more distinct words has an edit table that fits
    lettered = lambda w, k: F.array_join(F.transform(w, lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(k, x) + 0xFFFF), 8, "0")), "UTF-32")), "")
    refused = F.raise_error(F.lit("wer: a pair of texts has more than 1,048,575 distinct words"))
    distance = F.transform(F.array(known), lambda k: F.when(F.size(k) > 1_048_575, refused.cast("int")).otherwise(F.levenshtein(lettered(a, k), lettered(b, k))))[0]
    apart = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda w: w["x"] != w["y"])
    lacked = F.array_distinct(F.transform(apart, lambda w: w["x"]))
    plain = (F.size(a) == F.size(b)) & ~F.arrays_overlap(lacked, b)
    return F.when(F.size(b) == 0, 0.0).when(plain, F.size(apart) / F.size(b)).otherwise(distance / F.size(b))


def improvement(raw: Column, fixed: Column) -> Column:
    return F.struct((raw - fixed).alias("absolute"), F.when(raw > 0, (raw - fixed) / raw).otherwise(0.0).alias("relative"))


def _edits(src: list[str], dst: list[str]) -> set[tuple]:
    """The shortest edit script of :func:`edit_script` as a set of (tag, place, word, word instead)."""
    return {(tag, i, "" if tag == "insert" else src[i], "" if tag == "delete" else dst[j]) for tag, i, j in edit_script(src, dst)}


def _edit_scores(raw: str, gold: str, fixed: str) -> tuple[float, float]:
    raw = raw.split()
    right, done = _edits(raw, gold.split()), _edits(raw, fixed.split())
    hit = len(right & done)
    return hit / len(done) if done else 1.0, hit / len(right) if right else 1.0


def _damage(raw: list[str], gold: list[str], fixed: list[str], by_place: bool = False) -> tuple[float, int, int]:
    """Words equal to gold in the alignment: what part of them, and how many, the fixed text changes or drops, and how many there are."""
    aligned = (lambda a, b: in_place(a, b) or opcodes_of(a, b)) if by_place else opcodes_of
    now: list[str | None] = [None] * len(raw)
    for tag, i1, i2, j1, j2 in aligned(raw, fixed):
        if tag in ("equal", "replace"):
            for k in range(min(i2 - i1, j2 - j1)):
                now[i1 + k] = fixed[j1 + k]
    clean = [i for tag, i1, i2, _, _ in aligned(raw, gold) if tag == "equal" for i in range(i1, i2)]
    bad = sum(now[i] != raw[i] for i in clean)
    return bad / len(clean) if clean else 0.0, bad, len(clean)


TEXTS = ("raw_text", "gold_text", "fixed_text")
EDITS, DAMAGE = "edit_precision double, edit_recall double", "damage_rate double, damage_count long, clean_token_count long"


def _said(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in TEXTS})


def edit_scores(pairs: DataFrame) -> DataFrame:
    """(pair_id, edit_precision, edit_recall) of ``pairs`` (pair_id, raw_text, gold_text, fixed_text); a null text counts as empty, and
    every row is judged alone, whatever its pair_id."""
    return with_measures(_said(pairs).select("pair_id", *TEXTS), TEXTS, EDITS, _edit_scores)


def damage(pairs: DataFrame, by_place: bool = False) -> DataFrame:
    """(pair_id, damage_rate, damage_count, clean_token_count): words that were right and that the correction changed or dropped;
    nulls and repeated ids as in :func:`edit_scores`; ``by_place`` as in :func:`mining.opcodes`."""
    split = _said(pairs).select("pair_id", *[words(F.col(c)).alias(c) for c in TEXTS])
    return with_measures(split, TEXTS, DAMAGE, partial(_damage, by_place=by_place))


def evaluate(pairs: DataFrame) -> DataFrame:
    """All metrics of ``pairs`` (pair_id, raw_text, gold_text, fixed_text), a row each; nulls and repeated ids as in :func:`edit_scores`."""
    raw, gold, fixed = (F.col(c) for c in TEXTS)
    lists = [words(F.col(c)).alias(f"{c}_words") for c in TEXTS]
    rates = _said(pairs).select("pair_id", cer(raw, gold).alias("cer_raw"), cer(fixed, gold).alias("cer_fixed"), wer(raw, gold).alias("wer_raw"), wer(fixed, gold).alias("wer_fixed"), *TEXTS, *lists)
    better = improvement(F.col("cer_raw"), F.col("cer_fixed"))
    rates = rates.withColumn("cer_improvement_abs", better["absolute"]).withColumn("cer_improvement_pct", better["relative"])
    return with_measures(rates, [*TEXTS, *(f"{c}_words" for c in TEXTS)], f"{EDITS}, {DAMAGE}", lambda a, b, c, x, y, z: (*_edit_scores(a, b, c), *_damage(x, y, z)))


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n); values at the upper end fall in the last bin."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return rows.filter(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
