"""Text, number and date expressions that never raise on raw input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character counted as white space by Unicode and the four ASCII separators;
# SQL trim alone would only remove blanks.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# An optionally signed decimal with digit-group underscores and an optional exponent, and the
# words for infinity and not-a-number, with white space around them.
# The cast alone would accept Java suffixes ("12d") and reject "1_000".
_DIGITS = r"\d+(?:_\d+)*"
_DECIMAL = rf"[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
_AROUND = r"[\s\x1c-\x1f\x85\p{Z}]*"
_NUMBER = rf"^{_AROUND}{_DECIMAL}{_AROUND}$"
_WORD = rf"(?i)^{_AROUND}[+-]?(?:nan|inf|infinity){_AROUND}$"


def strip(text: Column) -> Column:
    """Remove surrounding white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_or_null(text: Column) -> Column:
    """Stripped text, or NULL when nothing is left."""
    return empty_to_null(strip(text))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def fold_case(text: Column) -> Column:
    """Spelling-independent form for comparing names: stripped and case-folded.

    Lower, upper, lower again expands letters such as the sharp s. The dotless i sits out the
    middle step, which would merge it with the plain i. (Exchanging it also keeps the
    optimizer from reducing the three steps to one.)
    """
    lowered = F.translate(F.lower(strip(text)), "\u0131", "\ue000")
    return F.lower(F.translate(F.upper(lowered), "\ue000", "\u0131"))


def to_number(text: Column) -> Column:
    """Text to DOUBLE; NULL when it is not a number."""
    word = F.lower(strip(text))
    value = F.when(word.endswith("nan"), "NaN").when(word.startswith("-"), "-Infinity").otherwise("Infinity")
    return F.when(
        F.rlike(text, F.lit(_NUMBER)), F.replace(strip(text), F.lit("_"), F.lit("")).try_cast("double")
    ).when(F.rlike(text, F.lit(_WORD)), value.cast("double"))


def leading_date(text: Column) -> Column:
    """The YYYY-MM-DD at the start of the text. A UTC offset after it is dropped, not applied.

    Only that form is handed to the cast, which by itself would accept 2025-1-2.
    """
    return F.regexp_extract(text, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", 0).try_cast("date")


def thousands(number: Column) -> Column:
    """Whole number with thousands separators, half to even: 12,346."""
    return F.format_number(number, 0)
