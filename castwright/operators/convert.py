"""Safe conversion of text columns to Spark types, and the report of cells that do not fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright import fixed
from castwright.functions import complexes, dates, numbers, render, text
from castwright.functions.stages import Stages, apply_stages
from castwright.local import quoted
from castwright.operators.cells import SEQ, spread, with_row_order
from castwright.session import tune

ERRORS = {
    "integer": fixed.ERR_NOT_INTEGER,
    "float": fixed.ERR_NOT_NUMERIC,
    "boolean": fixed.ERR_NOT_BOOLEAN,
    "date": fixed.ERR_NOT_DATE,
    "datetime": fixed.ERR_NOT_DATE,
    "complex": fixed.ERR_NOT_COMPLEX,
}


class ConversionError(ValueError):
    """Some cells cannot be converted to the type their column was given."""


@dataclass
class Target:
    """What one column becomes."""

    column: str
    logical: str
    has_offset: bool = False


def targets(schema: DataFrame | list[dict] | dict[str, str]) -> list[Target]:
    """Column targets of a schema frame, of stored schema entries or of a plain mapping."""
    if isinstance(schema, dict):
        return [Target(column, logical) for column, logical in schema.items()]
    if isinstance(schema, DataFrame):
        # One row per table column.
        wanted = schema.select("column", "pos", "inferred_type", "has_utc_offset").orderBy("pos")
        schema = [row.asDict() for row in wanted.collect()]
    return [Target(e["column"], e["inferred_type"], bool(e.get("has_utc_offset"))) for e in schema]


def _rule(index: int, target: Target, date_options: dict) -> tuple[Stages, Column, Column]:
    """(stages, converted value, does a present value fit) of one column."""
    prefix = f"__{index}_"
    v = prefix + "v"
    # Strip and token test are stages of their own, so later stages can reuse the result.
    normal: Stages = [
        {prefix + "text": text.strip(f"CAST({quoted(target.column)} AS STRING)")},
        {v: text.blank_null_token(prefix + "text")},
    ]
    kind = target.logical
    if kind in ("text", "category"):
        return normal, F.col(v), F.lit(True)
    if kind in ("integer", "float"):
        stages = normal + numbers.number_stages(v, prefix)
        cleaned = prefix + "cleaned"
        if kind == "float":
            return stages, numbers.to_double(cleaned), numbers.is_number(cleaned)
        value = numbers.to_bigint(cleaned, prefix + "scientific")
        return stages, value, value.isNotNull()
    if kind == "boolean":
        value = text.parse_boolean(v)
        return normal, value, value.isNotNull()
    if kind in ("date", "datetime"):
        stages = normal + dates.timestamp_stages(v, prefix + "stamp", prefix, **date_options)
        stamp = F.col(prefix + "stamp")
        if kind == "date":
            return stages, stamp.cast("date"), stamp.isNotNull()
        return stages, render.utc_instant(stamp) if target.has_offset else stamp, stamp.isNotNull()
    if kind == "complex":
        value = F.col(prefix + "z")
        return normal + complexes.complex_stages(v, prefix + "z", prefix), value, value.isNotNull()
    raise ValueError(fixed.ERR_UNSUPPORTED_TYPE % kind)


def _staged(frame: DataFrame, wanted: list[Target], date_options: dict):
    tune(frame.sparkSession)
    rules = [_rule(i, t, date_options) for i, t in enumerate(wanted)]
    return apply_stages(frame, [stages for stages, _, _ in rules]), rules


def convert(
    frame: DataFrame, schema, *, keep: list[str] | None = None, ordered: bool = False, **date_options
) -> DataFrame:
    """Typed table in schema order: a chain of projections.

    Cells that do not fit become null; ``violations`` counts them.  ``keep`` names
    columns (say, a row key) carried along unchanged.  A table too small to fill
    the cores is spread over them first, unless its rows are ``ordered``.
    """
    wanted = targets(schema)
    needed = frame.select(*map(quoted, dict.fromkeys([*(keep or []), *[t.column for t in wanted]])))
    staged, rules = _staged(needed if ordered else spread(needed), wanted, date_options)
    return staged.select(
        *[F.col(quoted(k)) for k in keep or []],
        *[value.alias(t.column) for t, (_, value, _) in zip(wanted, rules)],
    )


def render_rows(converted: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """Preview form: dates, datetimes and complex numbers as text, other types as they are."""
    kept = set(keep or [])
    shown, rules = [], []
    for i, column in enumerate(converted.schema.fields):
        cell, kind = F.col(quoted(column.name)), column.dataType
        if column.name in kept:
            shown.append(cell)
        elif isinstance(kind, T.DateType):
            shown.append(render.iso_date(cell).alias(column.name))
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            offset = isinstance(kind, T.TimestampType)
            shown.append(render.iso_timestamp(render.utc_wall(cell) if offset else cell, utc=offset).alias(column.name))
        elif isinstance(kind, T.StructType):
            rules.append(render.complex_stages(quoted(column.name), f"__shown{i}", f"__shown{i}_"))
            shown.append(F.col(f"__shown{i}").alias(column.name))
        else:
            shown.append(cell)
    return apply_stages(converted, rules).select(*shown)


def violations(frame: DataFrame, schema, order_by=None, **date_options) -> DataFrame:
    """Per column: how many present cells do not convert, the first of them, and the error.

    One aggregate without a shuffle key; each task sends a single row.
    """
    wanted = targets(schema)
    ordered = with_row_order(frame, order_by, [t.column for t in wanted])
    cells = ordered.frame.select(*ordered.block_keys, SEQ, *[quoted(t.column) for t in wanted])
    staged, rules = _staged(spread(cells), wanted, date_options)
    present = [F.col(f"__{i}_v").isNotNull() for i in range(len(wanted))]
    spot = F.struct(*[F.col(k) for k in ordered.block_keys], F.col(SEQ))
    flagged = staged.select(
        *ordered.block_keys, SEQ,
        *[(p & ~F.coalesce(fits, F.lit(False))).alias(f"__bad{i}") for i, (p, (_, _, fits)) in enumerate(zip(present, rules))],
        *[F.col(f"__{i}_v") for i in range(len(wanted))],
    )
    aggregates = []
    for i in range(len(wanted)):
        bad, v = F.col(f"__bad{i}"), F.col(f"__{i}_v")
        first = F.min(F.when(bad, v)) if ordered.by_value else F.min_by(v, F.when(bad, spot))
        aggregates += [F.count_if(bad).alias(f"n{i}"), F.when(F.count_if(bad) > 0, first).alias(f"first{i}")]
    totals = flagged.agg(*aggregates)
    entries = [
        F.struct(
            F.lit(t.column).alias("column"),
            F.lit(i).alias("pos"),
            F.lit(t.logical).alias("target_type"),
            F.col(f"n{i}").alias("violations"),
            F.col(f"first{i}").alias("first_value"),
            F.when(F.col(f"n{i}") > 0, F.lit(ERRORS.get(t.logical, "%s").replace("%s", t.column))).alias("error"),
        )
        for i, t in enumerate(wanted)
    ]
    return totals.select(F.inline(F.array(*entries)))


def require_convertible(frame: DataFrame, schema, **options) -> None:
    """Raise for the first column with cells that do not convert."""
    found = violations(frame, schema, **options).where(F.col("violations") > 0).orderBy("pos").first()
    if found is not None:
        raise ConversionError(found["error"])
