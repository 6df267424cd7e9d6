"""Pre-cleaning of scanned text as Column expressions, one function per step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation of which a run counts once, and the patterns of the steps.
REPEATED = ",;:!?"
DASHES = "[-\u2010-\u2012\u2013\u2014]{3,}"
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"


def nfc(text: Column) -> Column:
    """Unicode composition; the one step without a built-in.  Texts without a character from U+0300 on are composed as they stand and
    stay where they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def composed(values):
        return values.str.normalize("NFC")

    return F.coalesce(composed(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def plain_spaces(text: Column) -> Column:
    """No-break spaces as plain ones."""
    return F.translate(text, "\u00a0\u2007\u202f", "   ")


def join_broken_words(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)([{LETTERS}]{{2,}})-\s*\n\s*([{LETTERS}]{{2,}})", "$1$2")


def trim_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t]*\\n[ \\t]*", "\n")


def single_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"([{REPEATED}])\\1+", "$1")


def ellipses(text: Column) -> Column:
    return F.regexp_replace(text, r"\.{4,}", "...")


def long_dashes(text: Column) -> Column:
    return F.regexp_replace(text, DASHES, "—")


def single_underscores(text: Column) -> Column:
    return F.regexp_replace(text, "_{3,}", "_")


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\t]+", " ")


def close_up(text: Column) -> Column:
    """No white space before closing and behind opening marks."""
    text = F.regexp_replace(text, r"(?U)\s+([,;:.!?])", "$1")
    text = F.regexp_replace(text, r"(?U)([(\[{])\s+", "$1")
    return F.regexp_replace(text, r"(?U)\s+([)\]}])", "$1")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def preclean(text: Column, collapse_newlines: bool = True, compose: bool = False) -> Column:
    """All steps in order; ``compose`` adds Unicode composition, which leaves the JVM."""
    text = F.coalesce(text, F.lit(""))
    for step in ([nfc] if compose else []) + [plain_spaces, join_broken_words, trim_line_ends]:
        text = step(text)
    if collapse_newlines:
        text = F.replace(text, F.lit("\n"), F.lit(" "))
    for step in (single_marks, ellipses, long_dashes, single_underscores, single_spaces, close_up, strip):
        text = step(text)
    return text
