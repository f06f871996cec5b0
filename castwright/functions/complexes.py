"""Complex number literals such as ``1+2j``, ``(1e3-2J)`` or ``j``.  Arguments are column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castwright.functions.stages import Stages, raw

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_REAL = rf"(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:infinity|inf|nan))"
# A pair needs a sign between its parts; a lone part is imaginary and may be a bare ``j``.
LITERAL = rf"^\(?\s*(?:([+-]?{_REAL})([+-](?:{_REAL})?)|([+-]?(?:{_REAL})?))[jJ]\s*\)?\z"


def complex_test(v: str) -> str:
    """SQL: is the value a complex literal?  The cheap tests keep the pattern off most cells.

    Either both parentheses are there or none.
    """
    return (
        f"((contains({v}, 'j') OR contains({v}, 'J')) AND startswith({v}, '(') = endswith({v}, ')') "
        rf"AND {v} RLIKE {raw(LITERAL)} AND ({v} LIKE '(%' OR NOT {v} RLIKE r'\s'))"
    )


def is_complex(v: str) -> Column:
    return F.expr(complex_test(v))


def _part(piece: str) -> str:
    return (
        rf"CASE WHEN {piece} RLIKE r'(?i)^[+-]?nan\z' THEN DOUBLE('NaN') WHEN {piece} IN ('', '+') THEN 1.0D "
        f"WHEN {piece} = '-' THEN -1.0D ELSE CAST(translate({piece}, '_', '') AS DOUBLE) END"
    )


def complex_stages(source: str, target: str, prefix: str) -> Stages:
    """Parse the text column ``source`` into ``target``, a ``struct(re, im)`` or null."""
    parts = f"{prefix}complex"
    # [real, its imaginary partner, lone imaginary part]
    pieces = rf"split(regexp_replace({source}, {raw(LITERAL)}, r'$1|$2|$3'), r'\|', -1)"
    real = f"CASE WHEN {parts}[0] = '' THEN 0.0D ELSE {_part(f'{parts}[0]')} END"
    return [
        {parts: F.expr(f"CASE WHEN {complex_test(source)} THEN {pieces} END")},
        {f"{prefix}imaginary": F.expr(f"concat({parts}[1], {parts}[2])")},
        {
            target: F.expr(
                f"CASE WHEN {parts} IS NOT NULL THEN named_struct('re', {real}, 'im', {_part(prefix + 'imaginary')}) END"
            )
        },
    ]
