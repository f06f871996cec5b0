"""Number grammar, integrality and numeric casts.  Arguments are column names.

Spark's own casts cannot decide these questions: ``'1d'`` casts to 1.0, a cast
to decimal rounds ``0.5`` to 1 and gives null beyond 38 digits.  The grammar is
therefore a regular expression, and integrality is decided on the digits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castwright import fixed
from castwright.functions.stages import Stages, raw
from castwright.functions.text import begins_with, ends_with

# What a number may begin with: digits, signs, point, underscore, and the letters of inf and nan.
NUMBER_START = "0123456789+-._in"
# What a cleaned one may end with.
NUMBER_END = "0123456789.fFyYnN"
PLAIN_DIGITS = r"^[0-9]+\z"
SIGNED_DIGITS = r"^[+-]?[0-9]+\z"
WHOLE = r"^[+-]?([0-9]+(\.0*)?|\.0+)\z"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?0*[0-9]{1,18})?\z"
NUMERIC = r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?0*[0-9]{1,18})?|(?i:inf|infinity|nan[0-9]*))\z"
INFINITE = r"^[+-]?(?i:inf|infinity)\z"
SCIENTIFIC = r"^[+-]?([0-9]*)\.?([0-9]*)[eE]([+-]?0*[0-9]{1,18})\z"

# A value other than zero with more digits than this is outside bigint.
_BIGINT_DIGITS = 20


def clean_number(v: str) -> Column:
    """Drop the commas of a well-formed grouped number and all underscores.

    Text that cannot begin a number stays as it is, so long text is not copied.
    """
    grouped = f"contains({v}, ',') AND {v} RLIKE {raw(fixed.GROUPED_NUMBER)}"
    return F.expr(
        f"CASE WHEN NOT {begins_with(v, NUMBER_START)} THEN {v} WHEN {grouped} THEN translate({v}, ',_', '') "
        f"WHEN contains({v}, '_') THEN translate({v}, '_', '') ELSE {v} END"
    )


def number_test(cleaned: str) -> str:
    """SQL: is a cleaned text a number, infinities and NaN forms included?"""
    return f"({begins_with(cleaned, NUMBER_START)} AND {ends_with(cleaned, NUMBER_END)} AND {cleaned} RLIKE {raw(NUMERIC)})"


def is_number(cleaned: str) -> Column:
    return F.expr(number_test(cleaned))


def scientific_parts(cleaned: str) -> Column:
    """[digits before, digits after the point, exponent] of a number with an exponent, null otherwise.

    The first character and the letter are tested before the full pattern.
    """
    pieces = f"split(regexp_replace({cleaned}, {raw(SCIENTIFIC)}, r'$1|$2|$3'), r'\\|', -1)"
    letter = f"{begins_with(cleaned, '0123456789+-.')} AND (contains({cleaned}, 'e') OR contains({cleaned}, 'E'))"
    return F.expr(f"CASE WHEN {letter} AND {cleaned} RLIKE {raw(NUMBER)} THEN {pieces} END")


def _digits(parts: str) -> str:
    return f"concat({parts}[0], {parts}[1])"


def _shift(parts: str) -> str:
    """How many places right of the point the digits reach."""
    return f"(length({parts}[1]) - CAST({parts}[2] AS BIGINT))"


def whole_test(cleaned: str, parts: str) -> str:
    """SQL: is a cleaned number a whole number?  ``parts`` are its ``scientific_parts``.

    With an exponent, the number is whole if its digits are all zero or end in
    enough zeros to fill the places right of the point.
    """
    kept = f"rtrim('0', {_digits(parts)})"
    return (
        f"CASE WHEN {parts} IS NULL THEN {cleaned} RLIKE {raw(WHOLE)} "
        f"ELSE {kept} = '' OR {_shift(parts)} <= length({_digits(parts)}) - length({kept}) END"
    )


def is_integral(cleaned: str, parts: str) -> Column:
    return F.expr(whole_test(cleaned, parts))


def to_bigint(cleaned: str, parts: str) -> Column:
    """Exact 64-bit integer of a whole number; null when it is not one or does not fit."""
    significant = f"ltrim('0', {_digits(parts)})"
    zeros = f"repeat('0', CAST(least(-{_shift(parts)}, {_BIGINT_DIGITS}) AS INT))"
    cut = f"left({_digits(parts)}, CAST(length({_digits(parts)}) - {_shift(parts)} AS INT))"
    scaled = f"CASE WHEN {_shift(parts)} <= 0 THEN concat({significant}, {zeros}) ELSE {cut} END"
    sign = f"CASE WHEN startswith({cleaned}, '-') THEN '-' ELSE '' END"
    # ``@`` stands for a zero that keeps the integer part of ``.0`` from being empty.
    integer_part = rf"translate(regexp_replace({cleaned}, r'^([+-]?)([0-9]*)\..*', r'$1@$2'), '@', '0')"
    return F.expr(
        f"CASE WHEN {cleaned} RLIKE {raw(SIGNED_DIGITS)} THEN try_cast({cleaned} AS BIGINT) "
        f"WHEN {parts} IS NULL AND {cleaned} RLIKE {raw(WHOLE)} THEN try_cast({integer_part} AS BIGINT) "
        f"WHEN {parts} IS NOT NULL AND {whole_test(cleaned, parts)} THEN "
        f"CASE WHEN {significant} = '' THEN 0L ELSE try_cast(concat({sign}, {scaled}) AS BIGINT) END END"
    )


def to_double(cleaned: str) -> Column:
    """Double of a number; NaN forms and texts that are no number give null."""
    fits = f"{cleaned} RLIKE {raw(NUMBER)} OR {cleaned} RLIKE {raw(INFINITE)}"
    return F.expr(f"CASE WHEN {fits} THEN try_cast({cleaned} AS DOUBLE) END")


def number_stages(source: str, prefix: str) -> Stages:
    """Add ``<prefix>cleaned`` and ``<prefix>scientific`` of the text column ``source``."""
    scientific = f"{prefix}scientific"
    return [
        {f"{prefix}cleaned": clean_number(source)},
        {scientific: scientific_parts(f"{prefix}cleaned")},
        # The lambda only ends the fused code here, before it is too long to be compiled to machine code.
        {scientific: F.expr(f"transform({scientific}, p -> p)")},
    ]
