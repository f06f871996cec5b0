"""Column profiles.

Two narrow passes instead of a value count, whose shuffle would carry every
distinct text of every column:

1. ``evidence``: counters, type masks and two small hash structures per column.
   All aggregation buffers are fixed-width numbers, so each task sends one row
   per column (and file block), however many distinct values there are.
   - A 512-slot bitmap of value hashes.  More than 50 slots set proves more than
     50 distinct values, and the unique count, capped at 51, is settled.
   - The first position of each of eight hash buckets.  By the fifth smallest of
     them at least five distinct values have been seen, so the samples lie at or
     before that position.
2. ``values``: distinct values with first position, read from the columns the
   bitmap did not settle (few values, so partial aggregation absorbs them) and
   from the leading rows of the others.

The hashes only decide which cells pass 2 reads; counts and samples come from the
values themselves, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright import fixed
from castwright.functions import classify, text
from castwright.local import local_frame, quoted
from castwright.session import tune
from castwright.operators.cells import BLK, SEQ, SRC, Ordered, landed, unpivot, with_row_order

_BUCKETS = 8

POSITION_TYPE = T.StructType(
    [
        T.StructField(SRC, T.StringType()),
        T.StructField(BLK, T.LongType()),
        T.StructField(SEQ, T.LongType()),
    ]
)
EVIDENCE_SCHEMA = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("total_count", T.LongType()),
        T.StructField("non_null_count", T.LongType()),
        T.StructField("all_mask", T.IntegerType()),
        T.StructField("any_mask", T.IntegerType()),
        *[T.StructField(f"word{i}", T.LongType()) for i in range(_BUCKETS)],
        *[T.StructField(f"bucket{i}", POSITION_TYPE) for i in range(_BUCKETS)],
    ]
)
VALUES_SCHEMA = T.StructType(
    [
        T.StructField("pos", T.IntegerType()),
        T.StructField("v", T.StringType()),
        T.StructField("first", POSITION_TYPE),
    ]
)
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("total_count", T.LongType()),
        T.StructField("non_null_count", T.LongType()),
        T.StructField("null_token_count", T.LongType()),
        T.StructField("integer_valid", T.BooleanType()),
        T.StructField("float_valid", T.BooleanType()),
        T.StructField("boolean_valid", T.BooleanType()),
        T.StructField("boolean_has_alpha_tokens", T.BooleanType()),
        T.StructField("datetime_valid", T.BooleanType()),
        T.StructField("ambiguous_datetime", T.BooleanType()),
        T.StructField("has_time_component", T.BooleanType()),
        T.StructField("has_utc_offset", T.BooleanType()),
        T.StructField("complex_valid", T.BooleanType()),
    ]
)


def normalized_cells(cells: DataFrame) -> DataFrame:
    """Add the normalized text ``v``; strip and token test stay separate stages."""
    return cells.withColumn("__text", text.strip("raw")).withColumn("v", text.blank_null_token("__text")).drop("__text")


def _position(block_keys: list[str], seq: Column) -> Column:
    source = F.col(SRC) if SRC in block_keys else F.lit("")
    block = F.col(BLK) if BLK in block_keys else F.lit(0).cast("bigint")
    return F.struct(source.alias(SRC), block.alias(BLK), seq.alias(SEQ))


def evidence(ordered: Ordered, **date_options) -> DataFrame:
    """Pass 1: one evidence row per column."""
    tune(ordered.frame.sparkSession)
    return evidence_of(unpivot(ordered, ordered.columns), ordered.block_keys, by_value=ordered.by_value, **date_options)


def evidence_of(cells: DataFrame, block_keys: list[str], *, by_value: bool = False, by: tuple[str, ...] = ("pos",), **date_options) -> DataFrame:
    """Evidence of cells (``pos, raw, hint, digest`` and their position): one row for each value of ``by``."""
    cells = normalized_cells(cells)
    digest = F.coalesce(F.col("digest"), F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    # Hash work precedes classification, so that it is fused with the scan.
    cells = cells.select("pos", *block_keys, SEQ, "v", "hint", digest.alias("digest"))
    cells = cells.select(
        "pos", *block_keys, "v", "hint",
        F.col("digest").alias(SEQ) if by_value else F.col(SEQ),
        F.expr("shiftleft(1L, CAST(digest & 63 AS INT))").alias("bit"),
        F.pmod(F.shiftright("digest", 16), F.lit(_BUCKETS)).cast("int").alias("bucket"),
    )
    cells = classify.classify(cells, "v", "__mask", **date_options).withColumn("mask", F.coalesce("hint", "__mask"))
    # Six fixed-width buffers per (column, block, bucket): the whole table is reduced inside the tasks.
    partial = cells.groupBy("pos", *block_keys, "bucket").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.count("mask").alias("non_null_count"),
        F.bit_and("mask").alias("all_mask"),
        F.bit_or("mask").alias("any_mask"),
        F.bit_or("bit").alias("bits"),
        F.min(SEQ).alias(SEQ),
    )
    first = _position(block_keys, F.col(SEQ))
    return merge_evidence(
        partial.select(
            *by, "total_count", "non_null_count", "all_mask", "any_mask",
            *[F.when(F.col("bucket") == i, F.col("bits")).alias(f"word{i}") for i in range(_BUCKETS)],
            *[F.when(F.col("bucket") == i, first).alias(f"bucket{i}") for i in range(_BUCKETS)],
        ),
        by,
    )


def merge_evidence(parts: DataFrame, by: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Combine evidence of disjoint row sets (buckets, file blocks, micro-batches); associative."""
    return parts.groupBy(*by).agg(
        F.sum("total_count").alias("total_count"),
        F.sum("non_null_count").alias("non_null_count"),
        F.bit_and("all_mask").alias("all_mask"),
        F.bit_or("any_mask").alias("any_mask"),
        *[F.bit_or(f"word{i}").alias(f"word{i}") for i in range(_BUCKETS)],
        *[F.min(f"bucket{i}").alias(f"bucket{i}") for i in range(_BUCKETS)],
    )


def has_many_values(row) -> bool:
    """Does the bitmap prove that the unique count reached its cap?"""
    return sum(((row[f"word{i}"] or 0) & (2**64 - 1)).bit_count() for i in range(_BUCKETS)) >= fixed.UNIQUE_CAP


def sample_bound(row):
    """Position by which the samples have occurred, or None when only all rows will do."""
    firsts = sorted(tuple(row[f"bucket{i}"]) for i in range(_BUCKETS) if row[f"bucket{i}"] is not None)
    return firsts[fixed.SAMPLE_SIZE - 1] if len(firsts) >= fixed.SAMPLE_SIZE else None


def _leading_rows(ordered: Ordered, bounds: list) -> DataFrame:
    """Rows up to the last bound; a plain integer key, or the place of a landed row, filters inside the scan."""
    frame = ordered.frame
    if ordered.by_value:
        return frame
    if ordered.block_keys:
        upto, last = F.lit(True), dict(zip((SRC, BLK, SEQ), max(bounds)))
        for key in [SEQ, *reversed(ordered.block_keys)]:
            upto = (F.col(key) < F.lit(last[key])) | ((F.col(key) == F.lit(last[key])) & upto)
        return frame.where(upto)
    last = max(bound[2] for bound in bounds)
    if ordered.key_column and isinstance(
        frame.schema[ordered.key_column].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
    ):
        frame = frame.where(F.col(quoted(ordered.key_column)) <= F.lit(last))
    return frame.where(F.col(SEQ) <= F.lit(last))


def _first_positions(ordered: Ordered, columns: list[str], bounds: dict[str, tuple]) -> DataFrame:
    bounded_only = bool(bounds) and len(bounds) == len(columns)
    rows = ordered
    if bounded_only:
        rows = Ordered(
            _leading_rows(ordered, list(bounds.values())), ordered.columns, ordered.block_keys,
            ordered.by_value, ordered.key_column,
        )
    cells = unpivot(rows, columns, as_text=True)
    if bounds:
        spark = ordered.frame.sparkSession
        bound_rows = [
            {"bound_pos": ordered.columns.index(name), "bound": dict(zip((SRC, BLK, SEQ), bound))}
            for name, bound in bounds.items()
        ]
        bound_schema = T.StructType([T.StructField("bound_pos", T.IntegerType()), T.StructField("bound", POSITION_TYPE)])
        # One row per table column, so broadcasting it is safe at any data size.
        bound_frame = F.broadcast(local_frame(spark, bound_rows, bound_schema))
        cells = cells.join(bound_frame, F.col("pos") == F.col("bound_pos"), "left")
    if bounds and not ordered.by_value:
        # Filter before the text is touched: most cells of these columns end here.
        cells = cells.where(F.col("bound").isNull() | (_position(ordered.block_keys, F.col(SEQ)) <= F.col("bound")))
    # Group by the stripped text and test for null tokens on the few groups.
    cells = cells.withColumn("text", text.strip("raw")).where(F.col("raw").isNotNull())
    if ordered.by_value:
        cells = cells.withColumn(SEQ, F.coalesce(F.col("digest"), F.xxhash64("text")))
        if bounds:
            cells = cells.where(F.col("bound").isNull() | (_position([], F.col(SEQ)) <= F.col("bound")))
    firsts = cells.groupBy("pos", "text", *ordered.block_keys).agg(F.min(SEQ).alias(SEQ))
    located = firsts.select(
        "pos", text.blank_null_token("text").alias("v"), _position(ordered.block_keys, F.col(SEQ)).alias("first")
    )
    if ordered.block_keys:
        located = located.groupBy("pos", "v").agg(F.min("first").alias("first"))
    return located


def values(ordered: Ordered, rows: dict[int, dict]) -> DataFrame:
    """Pass 2: ``pos, v, first`` of the values that unique counts and samples need.

    A null ``v`` stands for a null token and counts for nothing.
    """
    counted, bounds = [], {}
    for pos, name in enumerate(ordered.columns):
        row = rows.get(pos)
        if row is None or row["non_null_count"] == 0:
            continue
        bound = sample_bound(row) if has_many_values(row) else None
        if bound is None:
            counted.append(name)
        else:
            bounds[name] = bound
    if not counted and not bounds:
        return local_frame(ordered.frame.sparkSession, [], VALUES_SCHEMA)
    if ordered.by_value:
        return _first_positions(ordered, counted + list(bounds), bounds)
    # A key or a place filters in the scan, so the leading rows of the other columns are a scan of their own.
    scans = [_first_positions(ordered, counted, {})] if counted else []
    scans += [_first_positions(ordered, list(bounds), bounds)] if bounds else []
    return scans[0] if len(scans) == 1 else scans[0].unionByName(scans[1])


def _facts() -> list[Column]:
    """Profile columns of an evidence row; a column without cells keeps the defaults."""
    count = F.coalesce("total_count", F.lit(0)).cast("bigint")
    present = F.coalesce("non_null_count", F.lit(0)).cast("bigint")
    every, some = F.coalesce("all_mask", F.lit(classify.ALL)), F.coalesce("any_mask", F.lit(0))
    slots = sum((F.bit_count(F.coalesce(f"word{i}", F.lit(0))) for i in range(_BUCKETS)), F.lit(0))
    has = lambda mask, kind: mask.bitwiseAND(F.lit(kind)) != 0
    return [
        count.alias("total_count"),
        present.alias("non_null_count"),
        (count - present).alias("null_token_count"),
        has(every, classify.INTEGER).alias("integer_valid"),
        has(every, classify.NUMBER).alias("float_valid"),
        has(every, classify.BOOLEAN).alias("boolean_valid"),
        has(some, classify.ALPHA).alias("boolean_has_alpha_tokens"),
        has(every, classify.DATETIME).alias("datetime_valid"),
        has(some, classify.AMBIGUOUS).alias("ambiguous_datetime"),
        has(some, classify.TIME).alias("has_time_component"),
        has(some, classify.OFFSET).alias("has_utc_offset"),
        has(every, classify.COMPLEX).alias("complex_valid"),
        ((present > 0) & (slots >= fixed.UNIQUE_CAP)).alias("many"),
    ]


def finished(held: DataFrame, found: DataFrame, by: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Profile rows from evidence rows, which carry ``column``, and the needed values; one for each value of ``by``."""
    flags = held.select(*dict.fromkeys([*by, "column", "pos"]), *_facts())
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("v").isNull(), "first", "v"))
    sampled = F.when((F.col("rank") <= fixed.SAMPLE_SIZE) & F.col("v").isNotNull(), F.struct("rank", "v"))
    per_column = (
        found.withColumn("rank", rank)
        .groupBy(*by)
        .agg(F.count("v").alias("found"), F.array_sort(F.collect_list(sampled)).alias("sampled"))
    )
    # For one table, both sides have one row per column.
    joined = flags.join(F.broadcast(per_column) if by == ("pos",) else per_column, list(by), "left")
    return joined.select(
        *[key for key in by if key not in PROFILE_SCHEMA.names],
        *PROFILE_SCHEMA.names,
        F.when(F.col("many"), F.lit(fixed.UNIQUE_CAP))
        .otherwise(F.least(F.coalesce("found", F.lit(0)), F.lit(fixed.UNIQUE_CAP)))
        .cast("int")
        .alias("unique_count"),
        F.when(F.col("sampled").isNull(), F.array().cast("array<string>"))
        .otherwise(F.transform("sampled", lambda s: s["v"]))
        .alias("sample_values"),
    )


def finish(spark: SparkSession, columns: list[str], rows: dict[int, dict], found: DataFrame) -> DataFrame:
    """Profile rows of one table from its evidence (one row per column) and the needed values."""
    none = dict.fromkeys(EVIDENCE_SCHEMA.names)
    local_rows = []
    for pos, name in enumerate(columns):
        row = none | {k: v for k, v in rows.get(pos, {}).items() if not k.startswith("bucket")}
        local_rows.append(row | {"pos": pos, "column": name})
    schema = T.StructType([*EVIDENCE_SCHEMA.fields, T.StructField("column", T.StringType())])
    return finished(local_frame(spark, local_rows, schema), found)


def profile_files(cells: DataFrame, columns: DataFrame, **date_options) -> DataFrame:
    """Profiles of many files at once: one row per file and column.

    ``cells`` has ``pos, raw`` and the position (file, block, row) of every cell, ``columns`` the ``file, pos, column`` to report. The
    file is an aggregation key, so the number of jobs does not depend on the number of files. Of a column with many
    values only the cells up to the place by which its samples have occurred are looked at again.
    """
    tune(cells.sparkSession)
    by = (SRC, "pos")
    typed = cells.withColumns({"hint": F.lit(None).cast("int"), "digest": F.lit(None).cast("bigint")})
    held = landed(evidence_of(typed, [SRC, BLK], by=by, **date_options), "file_evidence")
    slots = sum((F.bit_count(F.coalesce(f"word{i}", F.lit(0))) for i in range(_BUCKETS)), F.lit(0))
    firsts = F.array_sort(F.filter(F.array(*[f"bucket{i}" for i in range(_BUCKETS)]), lambda x: x.isNotNull()))
    bound = F.when(slots >= fixed.UNIQUE_CAP, F.get(firsts, F.lit(fixed.SAMPLE_SIZE - 1))[SEQ])
    bounds = held.select(*by, bound.alias("bound"))
    near = cells.join(bounds, list(by)).where(F.col("bound").isNull() | (F.col(SEQ) <= F.col("bound")))
    firsts = normalized_cells(near).groupBy(*by, "v").agg(F.min(SEQ).alias(SEQ))
    found = firsts.select(*by, "v", F.struct(F.col(SRC), F.lit(0).cast("bigint").alias(BLK), F.col(SEQ)).alias("first"))
    named = columns.select(F.col("file").alias(SRC), "pos", "column").join(held, list(by), "left")
    return finished(named, found, by)


def collect_evidence(frame: DataFrame) -> dict[int, dict]:
    """Evidence rows by column position; as many rows as the table has columns."""
    return {row["pos"]: row.asDict() for row in frame.collect()}


def profile(
    frame: DataFrame, order_by: str | Column | None = None, columns: list[str] | None = None, **date_options
) -> DataFrame:
    """Profile every column of a table: one row per column.

    Runs pass 1 at once, because its result decides what pass 2 reads; pass 2 runs
    with the returned frame.  ``order_by`` (an integer, date or timestamp key)
    defines row order for the samples; file scans default to file order.
    """
    ordered = with_row_order(frame, order_by, columns)
    if not ordered.columns:
        return local_frame(frame.sparkSession, [], _profile_schema())
    rows = collect_evidence(evidence(ordered, **date_options))
    return finish(frame.sparkSession, ordered.columns, rows, values(ordered, rows))


def _profile_schema() -> T.StructType:
    return T.StructType(
        PROFILE_SCHEMA.fields
        + [
            T.StructField("unique_count", T.IntegerType()),
            T.StructField("sample_values", T.ArrayType(T.StringType())),
        ]
    )


def value_counts(frame: DataFrame, order_by: str | Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Frequency of every normalized value: ``column, v, n`` (null ``v``: null tokens).

    Partial aggregation merges repeated values before the shuffle, so a value that
    fills a third of a column costs one row per task.
    """
    ordered = with_row_order(frame, order_by, columns)
    cells = normalized_cells(unpivot(ordered, ordered.columns, as_text=True))
    counts = cells.groupBy("pos", "v").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in ordered.columns])
    return counts.select(names[F.col("pos")].alias("column"), "v", "n")
