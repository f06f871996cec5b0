"""Text forms of converted values, as a preview shows them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from castwright.functions.stages import Stages


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def utc_wall(instant: Column) -> Column:
    """UTC wall clock of an instant, whatever the session time zone."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1000000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def utc_instant(wall: Column) -> Column:
    """The instant of a UTC wall clock, whatever the session time zone."""
    return F.concat(wall.cast("string"), F.lit("Z")).cast("timestamp")


def iso_timestamp(wall: Column, *, utc: bool = False) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` with microseconds only when there are any."""
    text = F.translate(wall.cast("string"), " ", "T")
    text = F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
    return F.concat(text, F.lit("+00:00")) if utc else text


def number_stages(source: str, target: str, prefix: str) -> Stages:
    """Text of a double's size, without sign, in its shortest form.

    Plain digits from 1e-4 to below 1e16, an exponent elsewhere.
    """
    java, mantissa, digits, exponent, point = (prefix + n for n in ("java", "mantissa", "digits", "exponent", "point"))
    plain = (
        f"CASE WHEN NOT contains({java}, 'E') THEN {mantissa} "
        f"WHEN {point} <= 0 THEN concat('0.', repeat('0', -{point}), {digits}) "
        f"WHEN {point} >= length({digits}) THEN rpad({digits}, {point}, '0') "
        f"ELSE concat(left({digits}, {point}), '.', substr({digits}, {point} + 1)) END"
    )
    power = f"CAST(abs({exponent}) AS STRING)"
    scientific = (
        f"concat({mantissa}, 'e', CASE WHEN {exponent} < 0 THEN '-' ELSE '+' END, "
        f"CASE WHEN length({power}) < 2 THEN '0' ELSE '' END, {power})"
    )
    return [
        {java: F.expr(f"CAST(abs({source}) AS STRING)")},
        {
            mantissa: F.expr(rf"regexp_replace(regexp_replace({java}, 'E.*', ''), r'\.0\z', '')"),
            exponent: F.expr(f"CASE WHEN contains({java}, 'E') THEN CAST(regexp_replace({java}, '.*E', '') AS INT) ELSE 0 END"),
        },
        {
            digits: F.expr(f"translate({mantissa}, '.', '')"),
            # How many digits stand left of the point in plain form.
            point: F.expr(
                f"{exponent} + CASE WHEN contains({mantissa}, '.') THEN instr({mantissa}, '.') - 1 ELSE length({mantissa}) END"
            ),
        },
        {
            target: F.expr(
                f"CASE WHEN isnan({source}) THEN 'nan' WHEN {java} = 'Infinity' THEN 'inf' "
                f"WHEN {source} = 0 OR (abs({source}) >= 1e-4D AND abs({source}) < 1e16D) THEN {plain} ELSE {scientific} END"
            )
        },
    ]


def _minus(x: str, otherwise: str) -> str:
    """SQL: a minus for a negative double, minus zero included."""
    return f"CASE WHEN startswith(CAST({x} AS STRING), '-') THEN '-' ELSE '{otherwise}' END"


def complex_stages(source: str, target: str, prefix: str) -> Stages:
    """Text of a complex number: ``(1+2j)``, or ``2j`` when the real part is plain zero."""
    re, im = prefix + "re", prefix + "im"
    parts = [{re: F.expr(f"{source}.re"), im: F.expr(f"{source}.im")}]
    texts = [
        {**left, **right}
        for left, right in zip(
            number_stages(re, prefix + "re_text", prefix + "re_"), number_stages(im, prefix + "im_text", prefix + "im_")
        )
    ]
    lone = f"concat({_minus(im, '')}, {prefix}im_text, 'j')"
    pair = f"concat('(', {_minus(re, '')}, {prefix}re_text, {_minus(im, '+')}, {prefix}im_text, 'j)')"
    return parts + texts + [{target: F.expr(f"CASE WHEN CAST({re} AS STRING) = '0.0' THEN {lone} ELSE {pair} END")}]
