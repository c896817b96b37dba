"""Charge reference codec as native column expressions (no UDF).

A reference is ``X`` + check character + ``PR`` + the value zero-padded to ten
digits. The check character is a weighted sum mod 23 over two fixed values and
the ten digits, mapped through a fixed alphabet (see ``passlane.schema``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passlane.schema import (
    CHECK_ALPHABET,
    REFERENCE_FIXED_VALUES,
    REFERENCE_PATTERN,
    REFERENCE_WEIGHTS,
)

_FIXED_PART = sum(w * v for w, v in zip(REFERENCE_WEIGHTS[:2], REFERENCE_FIXED_VALUES))
_DIGIT_WEIGHTS = REFERENCE_WEIGHTS[2:]


def check_remainder(value: Column) -> Column:
    """Weighted digit sum mod 23 of a non-negative int column, by integer arithmetic."""
    v = value.cast("long")
    total = F.lit(_FIXED_PART)
    for i, w in enumerate(_DIGIT_WEIGHTS):
        place = 10 ** (len(_DIGIT_WEIGHTS) - 1 - i)
        total = total + F.lit(w) * (F.floor(v / F.lit(place)) % F.lit(10))
    return (total % F.lit(23)).cast("int")


def check_character(value: Column) -> Column:
    return F.lit(CHECK_ALPHABET).substr(check_remainder(value) + 1, F.lit(1))


def encode_reference(value: Column) -> Column:
    """int column → reference string; null stays null."""
    v = value.cast("long")
    return F.when(
        v.isNotNull(),
        F.concat(F.lit("X"), check_character(v), F.lit("PR"), F.lpad(v.cast("string"), 10, "0")),
    )


def decode_reference(text: Column) -> Column:
    """Reference string → int value, or null when the shape, range or check is wrong.

    One regex test for the shape; the digits are then read by position (cheap
    ``substring``), so the check sum never re-runs the regex. The ten digits must
    fit a 32-bit int (the value type of a reference): ``try_cast`` turns an
    overflow into an invalid reference rather than an error.
    """
    value = F.substring(text, 5, 10).try_cast("int")
    total = F.lit(_FIXED_PART)
    for i, w in enumerate(_DIGIT_WEIGHTS):
        total = total + F.lit(w) * F.substring(text, 5 + i, 1).try_cast("int")
    check = F.lit(CHECK_ALPHABET).substr((total % F.lit(23)).cast("int") + 1, F.lit(1))
    ok = text.rlike(REFERENCE_PATTERN) & value.isNotNull() & (F.substring(text, 2, 1) == check)
    return F.when(ok, value)
