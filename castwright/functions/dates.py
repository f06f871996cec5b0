"""Date and time grammar.

One pattern describes every accepted shape.  ``timestamp_stages`` applies it once per
cell and works on the captured pieces.  Arguments are column names.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from castwright import fixed
from castwright.functions.stages import Stages, raw
from castwright.functions.text import begins_with, ends_with

# --- fixed values: names a date may carry -----------------------------------
MONTH_NAMES = (
    "january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|august|aug|"
    "september|sept|sep|october|oct|november|nov|december|dec"
)
DAY_NAMES = (
    "monday|mon|tuesday|tue|wednesday|wed|thursday|thu|friday|fri|saturday|sat|sunday|sun"
)
MONTH_KEYS = "janfebmaraprmayjunjulaugsepoctnovdec"
# --- end of fixed values ----------------------------------------------------

_DATE = (
    r"(?:([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})"
    r"|([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4}|[0-9]{2})"
    rf"|(?:(?i:{DAY_NAMES}),?\s+)?((?i:{MONTH_NAMES}))\s+([0-9]{{1,2}}),?\s+([0-9]{{4}}|[0-9]{{2}}))"
)
_TIME = (
    r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{1,2})(?:\.([0-9]*))?)?"
    r"(?:\s*([AaPp])[Mm]\b)?"
    r"(?:\s*(?:(Z|UTC)|([+-])([0-9]{1,2})(?::?([0-9]{2}))?))?"
)
SHAPE = rf"^{_DATE}?(?:(\s+|\s*[Tt])?{_TIME})?\z"

# The captured pieces, merged where only one of several alternatives can match.
# SHORT repeats the first field of a numeric date whose order is open.
_PIECES = "$1$6$9|$2$4|$3$5$8|$4|$7|$10|$11|$12|$13|$14|$15|$16$17|$18|$19"
YEAR, FIRST, SECOND, SHORT, NAME, GAP, HOUR, MINUTE, SECONDS, FRACTION, HALF, ZONE, ZONE_HOUR, ZONE_MINUTE = range(14)


def parts_sql(v: str) -> str:
    """SQL: the captured pieces (empty text where absent), or null for another shape."""
    initials = "0123456789" + "".join(name[0] for name in f"{MONTH_NAMES}|{DAY_NAMES}".split("|"))
    possible = f"{begins_with(v, initials)} AND {ends_with(v, '0123456789.mMZC')}"
    return rf"CASE WHEN {possible} AND {v} RLIKE {raw(SHAPE)} THEN split(regexp_replace({v}, {raw(SHAPE)}, r'{_PIECES}'), r'\|', -1) END"


def plain_iso(v: str) -> str:
    """SQL: timestamp of the two most common shapes, which Spark reads as they are; null for others.

    The year bounds keep it inside the range of valid instants.
    """
    shape = raw(r"^(?:1[7-9]|2[01])[0-9]{2}-[0-9]{2}-[0-9]{2}(?: [0-9]{2}:[0-9]{2}:[0-9]{2})?\z")
    return f"CASE WHEN {begins_with(v, '12')} AND {dashed(v)} AND {v} RLIKE {shape} THEN try_cast({v} AS TIMESTAMP_NTZ) END"


def dashed(v: str) -> str:
    """SQL: are there dashes where a plain ISO date has them?"""
    return f"(substring({v}, 5, 1) = '-' AND substring({v}, 8, 1) = '-')"


def short_date(v: str, when: str) -> str:
    """SQL: 100 times the first field and the second one of a plain short date, such as ``9/3/1995``; null for others.

    The two separators are alike, and the year has four digits and lies within the range of valid instants.
    """
    shape = raw(r"^[0-9]{1,2}([-/])[0-9]{1,2}\1(?:1[7-9]|2[01])[0-9]{2}\z")
    sep = f"substring({v}, -5, 1)"
    first, second = f"substring_index({v}, {sep}, 1)", f"substring_index(left({v}, length({v}) - 5), {sep}, -1)"
    plain = f"length({v}) <= 10 AND ({sep} = '/' OR {sep} = '-') AND {v} RLIKE {shape}"
    return f"CASE WHEN {when} AND {plain} THEN CAST(concat({first}, lpad({second}, 2, '0')) AS INT) END"


def _short_stamp(v: str, short: str, dayfirst: bool) -> str:
    """SQL: timestamp of a ``short_date``; null if there is no such day."""
    first, second = f"({short} DIV 100)", f"({short} % 100)"
    swap = f"{second} <= 12" if dayfirst else f"{first} > 12"
    monthday = f"CASE WHEN {swap} THEN concat({second}, '-', {first}) ELSE concat({first}, '-', {second}) END"
    return f"try_cast(concat(right({v}, 4), '-', {monthday}) AS TIMESTAMP_NTZ)"


def time_test(source: str, prefix: str) -> str:
    """SQL: did ``timestamp_stages`` read a time of day?"""
    return f"CASE WHEN {prefix}iso IS NOT NULL THEN length({source}) > 10 ELSE coalesce(get({prefix}parts, {HOUR}) <> '', false) END"


def offset_test(prefix: str) -> str:
    """SQL: did ``timestamp_stages`` read an offset?"""
    return f"coalesce(get({prefix}parts, {ZONE}) <> '', false)"


def ambiguous_test(prefix: str) -> str:
    """SQL: do month-first and day-first readings of a short date differ and both hold?

    Meaningful only where the parsed timestamp is not null.
    """
    first = f"coalesce({prefix}short DIV 100, get({prefix}numbers, {SHORT}))"
    second = f"coalesce({prefix}short % 100, get({prefix}numbers, {SECOND}))"
    return f"coalesce({first} <= 12 AND {second} <= 12 AND {first} <> {second}, false)"


def _numbers(parts: str) -> str:
    """The pieces as integers, null where they are none.

    The guard matters: a failing ``try_cast`` costs an exception per cell.  The
    lambda also ends the fused code of the scan at this stage; one fused method
    for the whole chain would be too long for the JVM to compile to machine code.
    """
    return f"transform({parts}, p -> CASE WHEN length(p) BETWEEN 1 AND 4 AND p RLIKE '^[0-9]' THEN CAST(p AS INT) END)"


def _offset_minutes(parts: str, numbers: str) -> str:
    """Minutes east of UTC; null for an offset of a day or more."""
    hours = f"get({numbers}, {ZONE_HOUR})"
    minutes = f"{hours} * 60 + coalesce(get({numbers}, {ZONE_MINUTE}), 0)"
    east = f"CASE WHEN get({parts}, {ZONE}) = '-' THEN -1 ELSE 1 END"
    return f"CASE WHEN get({parts}, {ZONE_HOUR}) = '' THEN 0 WHEN {hours} <= 23 THEN ({minutes}) * {east} END"


def _calendar(parts: str, numbers: str, dayfirst: bool, this_year: str, today: str) -> str:
    """``y-m-d`` text of the pieces, of ``today`` when they carry no date."""
    year, first, second = (f"get({parts}, {i})" for i in (YEAR, FIRST, SECOND))
    short = f"get({numbers}, {SHORT})"
    # Two digits are placed within fifty years of this year.
    written = f"get({numbers}, {YEAR})"
    placed = f"CAST({written} + (({this_year} + 49 - {written}) DIV 100) * 100 AS STRING)"
    full_year = f"CASE WHEN length({year}) = 2 THEN {placed} ELSE {year} END"
    swap = f"({short} IS NOT NULL AND get({numbers}, {SECOND}) <= 12)" if dayfirst else f"{short} > 12"
    named = f"CAST((instr('{MONTH_KEYS}', lower(left(get({parts}, {NAME}), 3))) + 2) DIV 3 AS STRING)"
    month = f"CASE WHEN {swap} THEN {second} WHEN {first} = '' THEN {named} ELSE {first} END"
    day = f"CASE WHEN {swap} THEN {first} ELSE {second} END"
    # The gap belongs between a date and a time and nowhere else.
    no_gap = f"get({parts}, {GAP}) = ''"
    dated = f"CASE WHEN ({no_gap}) = (get({parts}, {HOUR}) = '') THEN concat_ws('-', {full_year}, {month}, {day}) END"
    return f"CASE WHEN {year} <> '' THEN {dated} WHEN {no_gap} THEN CAST({today} AS STRING) END"


def _clock(parts: str, numbers: str) -> str:
    """``H:m:s.f`` text of the pieces, null for an hour a twelve-hour clock lacks."""
    hour, half, seconds = f"get({numbers}, {HOUR})", f"get({parts}, {HALF})", f"get({parts}, {SECONDS})"
    # On a twelve-hour clock 12 AM is midnight and 12 PM is noon.
    afternoon = f"CASE WHEN lower({half}) = 'p' THEN 12 ELSE 0 END"
    hour24 = f"CASE WHEN {half} = '' THEN {hour} WHEN {hour} <= 12 THEN {hour} % 12 + {afternoon} END"
    # Missing seconds and fractions read as zero.
    timed = (
        f"concat(CAST({hour24} AS STRING), ':', get({parts}, {MINUTE}), ':', CASE WHEN {seconds} = '' THEN '0' "
        f"ELSE {seconds} END, '.', left(get({parts}, {FRACTION}), 6), '0')"
    )
    return f"CASE WHEN get({parts}, {HOUR}) = '' THEN '0:00:00' ELSE {timed} END"


def timestamp_stages(
    source: str,
    target: str,
    prefix: str,
    *,
    dayfirst: bool = False,
    pivot_year: int | None = None,
    reference_date: date | None = None,
    when: str | None = None,
) -> Stages:
    """Parse the text column ``source`` into ``target``.

    The result is a wall-clock timestamp (UTC when an offset was given), null if
    the text is no valid date.  Short numeric dates are month-first unless
    ``dayfirst``; the order is swapped when only the other one can hold.
    ``pivot_year`` (default: this year) places two-digit years, ``reference_date``
    (default: today) dates a bare time, ``when`` limits the work to some cells.
    """
    this_year = str(pivot_year) if pivot_year else "year(current_date())"
    today = f"DATE'{reference_date}'" if reference_date else "current_date()"
    names = ("short", "iso", "parts", "numbers", "wall", "shift", "instant")
    short, iso, parts, numbers, wall, shift, instant = (prefix + n for n in names)
    return [
        {short: F.expr(short_date(source, when or "true"))},
        # Plain ISO forms and plain short dates, the most common ones, need no pieces.
        {
            iso: F.expr(
                f"CASE WHEN {short} IS NOT NULL THEN {_short_stamp(source, short, dayfirst)} "
                f"WHEN {when or 'true'} THEN {plain_iso(source)} END"
            )
        },
        {parts: F.expr(f"CASE WHEN {when or 'true'} AND {iso} IS NULL THEN {parts_sql(source)} END")},
        {numbers: F.expr(_numbers(parts))},
        # Most cells have no pieces, and the null of each would pass through all of this.
        {
            wall: F.expr(
                f"CASE WHEN {parts} IS NOT NULL THEN "
                f"concat({_calendar(parts, numbers, dayfirst, this_year, today)}, ' ', {_clock(parts, numbers)}) END"
            ),
            shift: F.expr(f"CASE WHEN {parts} IS NOT NULL THEN {_offset_minutes(parts, numbers)} END"),
        },
        {
            instant: F.expr(
                f"CASE WHEN {wall} IS NOT NULL THEN try_cast({wall} AS TIMESTAMP_NTZ) - make_dt_interval(0, 0, {shift}, 0) END"
            )
        },
        {
            target: F.expr(
                f"CASE WHEN {iso} IS NOT NULL THEN {iso} WHEN {instant} BETWEEN TIMESTAMP_NTZ'{fixed.FIRST_INSTANT}' "
                f"AND TIMESTAMP_NTZ'{fixed.LAST_INSTANT}' THEN {instant} END"
            )
        },
    ]
