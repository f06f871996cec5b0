"""Manual type overrides, allowed only where no value would be lost."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright import fixed
from castwright.local import local_frame
from castwright.operators.infer import name_of

OVERRIDES_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("target_type", T.StringType()),
        T.StructField("position", T.IntegerType()),
    ]
)


class OverrideError(ValueError):
    """An override names an unknown column or type, or would lose values."""


def override_frame(profile: DataFrame, overrides: Mapping[str, str] | DataFrame | None) -> DataFrame:
    """Overrides as ``column, target_type, position`` rows."""
    if isinstance(overrides, DataFrame):
        if "position" in overrides.columns:
            return overrides
        return overrides.withColumn("position", F.lit(0))
    rows = [
        {"column": column, "target_type": target, "position": i}
        for i, (column, target) in enumerate((overrides or {}).items())
    ]
    return local_frame(profile.sparkSession, rows, OVERRIDES_SCHEMA)


def can_convert(target: Column) -> Column:
    """May a profiled column become ``target`` without losing a value?"""
    return (
        F.when(target.isin("text", "category"), F.lit(True))
        .when(target == "integer", F.col("integer_valid"))
        .when(target == "float", F.col("float_valid") | F.col("integer_valid"))
        .when(target == "boolean", F.col("boolean_valid"))
        .when(target.isin("date", "datetime"), F.col("datetime_valid"))
        .when(target == "complex", F.col("complex_valid"))
        .otherwise(F.lit(False))
    )


def can_convert_matrix(profile: DataFrame) -> DataFrame:
    """Every column with every type: ``column, pos, target_type, allowed``."""
    kinds = F.explode(F.array(*[F.lit(t) for t in fixed.LOGICAL_TYPES]))
    return profile.withColumn("target_type", kinds).select(
        "column", "pos", "target_type", can_convert(F.col("target_type")).alias("allowed")
    )


def check_overrides(profile: DataFrame, overrides: Mapping[str, str] | DataFrame | None) -> DataFrame:
    """``column, target_type, position, status, error``; the first failing check names the error."""
    wanted = override_frame(profile, overrides)
    # One row per table column: bounded by the width of the table, not by its rows.
    joined = wanted.join(F.broadcast(profile), "column", "left")
    target = F.col("target_type")
    error = (
        F.when(F.col("pos").isNull(), F.format_string(fixed.ERR_UNKNOWN_COLUMN, F.col("column")))
        .when(~target.isin(fixed.LOGICAL_TYPES), F.format_string(fixed.ERR_UNSUPPORTED_TYPE, target))
        .when(~can_convert(target), F.format_string(fixed.ERR_UNSAFE, F.col("column"), target))
    )
    return joined.select("column", "target_type", "position", error.alias("error")).withColumn(
        "status", F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error"))
    ).select("column", "target_type", "position", "status", "error")


def override_errors(profile: DataFrame, overrides: Mapping[str, str] | DataFrame | None) -> DataFrame:
    return check_overrides(profile, overrides).where(F.col("status") == "error")


def unknown_columns(profile: DataFrame, overrides: Mapping[str, str] | DataFrame | None) -> DataFrame:
    """Overrides of columns the table does not have."""
    return override_frame(profile, overrides).join(F.broadcast(profile.select("column")), "column", "left_anti")


def apply_overrides(
    schema: DataFrame, profile: DataFrame, overrides: Mapping[str, str] | DataFrame | None, *, strict: bool = True
) -> DataFrame:
    """Schema with the accepted overrides.

    Confidence, nullability and samples are kept; a date-like type forced on an
    ambiguous column gets its own warning.  ``strict`` raises the first error.
    """
    if isinstance(overrides, Mapping) and not overrides:
        return schema
    checked = check_overrides(profile, overrides)
    if strict:
        failed = checked.where(F.col("status") == "error").orderBy("position").first()
        if failed is not None:
            raise OverrideError(failed["error"])
    accepted = checked.where(F.col("status") == "ok").select("column", "target_type")
    facts = profile.select("column", "ambiguous_datetime")
    joined = schema.join(F.broadcast(accepted), "column", "left").join(F.broadcast(facts), "column", "left")
    target = F.col("target_type")
    forced = target.isin("date", "datetime") & F.col("ambiguous_datetime")
    changed = {
        "inferred_type": F.coalesce(target, F.col("inferred_type")),
        "storage_type": F.coalesce(name_of(fixed.STORAGE_NAMES, target), F.col("storage_type")),
        "display_type": F.coalesce(name_of(fixed.DISPLAY_NAMES, target), F.col("display_type")),
        "warnings": F.when(forced, F.array(F.lit(fixed.WARN_FORCED))).otherwise(F.col("warnings")),
    }
    return joined.select(
        *[changed[c].alias(c) if c in changed else F.col(c) for c in schema.columns]
    ).orderBy("pos")


def schema_diff(detected: DataFrame, effective: DataFrame) -> DataFrame:
    """Columns whose type differs from the detected one, i.e. the overrides in force."""
    before = detected.select("column", "pos", F.col("inferred_type").alias("detected_type"))
    after = effective.select("column", F.col("inferred_type").alias("effective_type"))
    return before.join(F.broadcast(after), "column").where(F.col("detected_type") != F.col("effective_type"))
