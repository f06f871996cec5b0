"""The decision ladder: from a profile row to a schema row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castwright import fixed
from castwright.operators.profile import profile


def unique_ratio() -> Column:
    return F.when(F.col("non_null_count") == 0, F.lit(1.0)).otherwise(
        F.col("unique_count").cast("double") / F.col("non_null_count").cast("double")
    )


def _qualifies(rule: dict) -> Column:
    return (
        (F.col("non_null_count") >= rule["min_rows"])
        & (F.col("unique_count") <= rule["max_unique"])
        & (unique_ratio() <= rule["max_ratio"])
    )


def is_large_category() -> Column:
    return _qualifies(fixed.CATEGORY_LARGE)


def is_small_category() -> Column:
    return _qualifies(fixed.CATEGORY_SMALL)


def _ladder() -> list[tuple[Column, Column | str, float, str | None]]:
    """(condition, type, confidence, warning), first match wins."""
    dated = F.when(F.col("has_time_component"), F.lit("datetime")).otherwise(F.lit("date"))
    return [
        (F.col("non_null_count") == 0, "text", fixed.CONFIDENCE_EMPTY, fixed.WARN_EMPTY),
        (
            F.col("boolean_valid") & F.col("boolean_has_alpha_tokens"),
            "boolean", fixed.CONFIDENCE_BOOLEAN, None,
        ),
        (F.col("integer_valid"), "integer", fixed.CONFIDENCE_INTEGER, None),
        (F.col("float_valid"), "float", fixed.CONFIDENCE_FLOAT, None),
        (F.col("datetime_valid") & ~F.col("ambiguous_datetime"), dated, fixed.CONFIDENCE_DATE, None),
        (F.col("datetime_valid"), "text", fixed.CONFIDENCE_AMBIGUOUS, fixed.WARN_AMBIGUOUS),
        (F.col("complex_valid"), "complex", fixed.CONFIDENCE_COMPLEX, None),
        (is_large_category(), "category", fixed.CONFIDENCE_CATEGORY_LARGE, None),
        (is_small_category(), "category", fixed.CONFIDENCE_CATEGORY_SMALL, None),
    ]


def _first_match(outcomes: list[tuple[Column, Column]], default: Column) -> Column:
    chain = F
    for condition, outcome in outcomes:
        chain = chain.when(condition, outcome)
    return chain.otherwise(default)


def name_of(names: dict[str, str], logical: Column) -> Column:
    """Look a logical type up in one of the fixed name tables."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[logical]


def infer(profile_frame: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Schema rows of a profile, in source column order; ``keys`` are carried along, and the order is left open then."""
    ladder = _ladder()
    logical = _first_match(
        [(c, F.lit(kind) if isinstance(kind, str) else kind) for c, kind, _, _ in ladder], F.lit("text")
    )
    confidence = _first_match([(c, F.lit(score)) for c, _, score, _ in ladder], F.lit(fixed.CONFIDENCE_TEXT))
    no_warning = F.array().cast("array<string>")
    warning = _first_match(
        [(c, F.array(F.lit(text)) if text else no_warning) for c, _, _, text in ladder], no_warning
    )
    typed = profile_frame.withColumn("inferred_type", logical)
    schema = typed.select(
        *keys,
        "column",
        "pos",
        "inferred_type",
        name_of(fixed.STORAGE_NAMES, F.col("inferred_type")).alias("storage_type"),
        name_of(fixed.DISPLAY_NAMES, F.col("inferred_type")).alias("display_type"),
        (F.col("null_token_count") > 0).alias("nullable"),
        confidence.alias("confidence"),
        warning.alias("warnings"),
        "null_token_count",
        "sample_values",
        F.array(*[F.lit(t) for t in fixed.LOGICAL_TYPES]).alias("allowed_overrides"),
        "has_utc_offset",
    )
    return schema if keys else schema.orderBy("pos")


def infer_table(frame: DataFrame, order_by=None, columns: list[str] | None = None, **date_options) -> DataFrame:
    """Profile a table and infer its schema."""
    return infer(profile(frame, order_by, columns, **date_options))


def dataset_warnings(schema: DataFrame) -> DataFrame:
    """Distinct warnings over all columns, sorted."""
    return schema.select(F.explode("warnings").alias("warning")).distinct().orderBy("warning")
