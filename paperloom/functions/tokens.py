"""Tokenisers and token predicates as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LETTERS

#: The lossless tokeniser: a token, then the white space behind it.
TOKEN = r"([\p{L}\p{N}](?:[^\s]*[\p{L}\p{N}])?|[^\s\p{L}\p{N}])(\s*)"
#: The token alone, and the token with the white space behind it, without groups: the same matches in less time.
ALONE = r"[\p{L}\p{N}](?:[^\s]*[\p{L}\p{N}])?+|[^\s\p{L}\p{N}]"
WHOLE = rf"(?:{ALONE})\s*+"
#: What \\s stands for in it.
SPACES = " \t\n\x0b\f\r"
#: Fixed value: a token that is a slice of this counts as punctuation.
PUNCTUATION = ".,;:!?()[]{}\"'`~@#$%^&*+=-_<>|\\"
NUMBER = r"^[+-]?[0-9]+([.,/][0-9]+)*$"


def word_tokens(text: Column, least: int = 3) -> Column:
    """Runs of Spanish letters of at least ``least``."""
    return F.regexp_extract_all(text, F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))


def chunks(text: Column) -> Column:
    """What lies between white space.  No token and no word reaches beyond, so that those of a text are those of its chunks."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda c: c != "")


def token_texts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ALONE), F.lit(0))


def token_spaces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(2))


def token_wholes(text: Column) -> Column:
    """Tokens with the white space behind them, by one pass over the text."""
    return F.regexp_extract_all(text, F.lit(WHOLE), F.lit(0))


def trimmed(whole: Column) -> Column:
    """The token of a :func:`token_wholes` element."""
    return F.rtrim(whole, F.lit(SPACES))


def tokens(text: Column) -> Column:
    """Array of structs (text, ws); with the white space before the first token they give back the text."""
    return F.transform(F.arrays_zip(token_texts(text).alias("text"), token_spaces(text).alias("ws")), lambda t: F.struct(t["text"].alias("text"), t["ws"].alias("ws")))


def leading_space(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\s*)", 1)


def is_mark(token: Column) -> Column:
    return (token == "") | (F.instr(F.lit(PUNCTUATION), token) > 0)


def listed(token: Column, words: Sequence[str]) -> Column:
    return token.isin(list(words)) if words else F.lit(False)


def analysis_terms(words: Column, stop_words: Sequence[str]) -> Column:
    """Of a token array the lower-cased alphabetic ones of two letters or more that are neither stop words nor marks."""
    return F.filter(F.transform(words, F.lower), lambda t: ~listed(t, stop_words) & ~is_mark(t) & t.rlike(r"^\p{L}+$") & (F.length(t) > 1))


def analysis_tokens(text: Column, stop_words: Sequence[str]) -> Column:
    """:func:`analysis_terms` of a text."""
    return analysis_terms(token_texts(text), stop_words)


def is_word(text: Column) -> Column:
    """Whether there is a Spanish letter; false where the text is null."""
    return F.coalesce(text.rlike(f"[{LETTERS}]"), F.lit(False))


def alpha_ratio(s: Column) -> Column:
    return F.when(F.length(s) == 0, 0.0).otherwise(F.length(F.regexp_replace(s, r"[^\p{L}]", "")) / F.length(s))


def affix(s: Column, part: int) -> Column:
    """1: leading, 3: trailing run of other than letters and digits, 2: what lies between."""
    return F.regexp_extract(s, r"(?s)^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", part)


def norm_token(s: Column) -> Column:
    return F.lower(F.btrim(s, F.lit(",.;:!?")))


def is_upper(s: Column) -> Column:
    return s.rlike(r"\p{Lu}") & ~s.rlike(r"\p{Ll}")


def is_title(s: Column) -> Column:
    """Each run of letters starts upper-case and goes on lower-case."""
    return s.rlike(r"\p{Lu}") & ~s.rlike(r"(?<!\p{L})\p{Ll}|(?<=\p{L})\p{Lu}")


def is_protected(s: Column) -> Column:
    """White space, marks, numbers, two characters or fewer, short words in capitals."""
    return s.rlike(r"^[^\p{L}\p{N}]*$") | s.rlike(NUMBER) | (F.length(s) <= 2) | (is_upper(s) & (F.length(s) <= 4))


def is_suspect(s: Column, known: Column, least: int = 3) -> Column:
    """Whether a token looks misread; ``known`` says whether its lower-cased form is in the vocabulary."""
    mixed = s.rlike(r"\p{Lu}") & s.rlike(r"\p{Ll}") & ~is_title(s) & ~s.rlike(r"^\p{Lu}[^\p{Lu}]*$")
    return (
        F.when(is_protected(s) | (F.length(s) < least), False)
        .when(mixed, True)
        .when(~s.rlike(r"\p{L}"), False)
        .when(alpha_ratio(s) < 0.6, True)
        .when(known, False)
        .when(s.rlike(r"\p{Nd}"), True)
        .when(s.rlike(r"(?s)^.+[._,:;|/\\~].+$"), True)
        .otherwise(F.length(s) >= 15)
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas within use it."""
    return F.transform(F.array(value), body)[0]


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by spaces."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return bound(words, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(runs(w)))


def all_stop_words(words: Column, stop_words: Sequence[str]) -> Column:
    return F.forall(words, lambda w: listed(w, stop_words))


def windows(words: Column, hit, before: int) -> Column:
    """For each word that ``hit`` accepts the slice of up to ``before`` words before it, itself and one fewer behind it."""

    def around(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: (i < F.size(w)) & hit(F.get(w, i)))
        return F.transform(places, lambda i: F.slice(w, F.greatest(F.lit(0), i - before) + 1, F.least(F.size(w), i + before) - F.greatest(F.lit(0), i - before)))

    return bound(words, around)
