"""Cell normalisation and boolean tokens.  Arguments are SQL text, usually a column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castwright import fixed

_ALPHA_TOKENS = [t for t in fixed.TRUE_TOKENS + fixed.FALSE_TOKENS if not t.isdigit()]


def begins_with(v: str, characters: str) -> str:
    """SQL: does the value begin with one of some characters, in either case?

    Decides most cells without running a pattern.
    """
    both_cases = "".join(sorted({c for letter in characters for c in (letter.lower(), letter.upper())}))
    return f"contains('{both_cases}', left({v}, 1))"


def ends_with(v: str, characters: str) -> str:
    """SQL: does a value that is not empty end with one of some characters, as they are written?"""
    return f"contains('{characters}', right({v}, 1))"


def _is_token(v: str, tokens: list[str]) -> str:
    """SQL: membership in a list of ASCII tokens, in either case.

    No other letter has one of theirs as its small form but the Kelvin sign, and no token has a k.
    """
    words = [t for t in tokens if t]
    initials = "".join(t[0] for t in words)
    found = f"({begins_with(v, initials)} AND length({v}) <= {max(map(len, words))} AND find_in_set(lower({v}), '{",".join(words)}') > 0)"
    return found if len(words) == len(tokens) else f"({v} = '' OR {found})"


def strip(cell: str) -> Column:
    """Remove Unicode whitespace from both ends (Spark's ``trim`` knows only the blank).

    Cells that begin and end with a visible ASCII character are left alone at once.
    """
    last = f"substring({cell}, -1, 1)"
    visible = f"{cell} >= '!' AND {cell} < '\x7f' AND {last} >= '!' AND {last} < '\x7f'"
    return F.when(F.expr(visible), F.expr(cell)).otherwise(F.btrim(F.expr(cell), F.lit(fixed.WHITESPACE)))


def blank_null_token(stripped: str) -> Column:
    """Null for a null token, the text otherwise."""
    return F.expr(f"CASE WHEN NOT {_is_token(stripped, fixed.NULL_TOKENS)} THEN {stripped} END")


def parse_boolean(v: str) -> Column:
    """True / false for the boolean tokens, null for anything else."""
    return F.expr(
        f"CASE WHEN {_is_token(v, fixed.TRUE_TOKENS)} THEN true WHEN {_is_token(v, fixed.FALSE_TOKENS)} THEN false END"
    )


def is_alpha_boolean(v: str) -> str:
    """SQL: is the value a boolean token other than the digits 0 and 1?"""
    return _is_token(v, _ALPHA_TOKENS)
