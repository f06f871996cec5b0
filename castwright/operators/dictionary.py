"""Dictionaries of category columns: sorted distinct values with dense codes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castwright.local import quoted, refuse_clash
from castwright.operators.cells import landed, unpivot, with_row_order
from castwright.operators.convert import convert, targets
from castwright.operators.profile import normalized_cells

_VALUES_PER_PIECE = 1_000_000
# Pieces that may be broadcast: some numbers for each piece of a column.
_BROADCAST_PIECES = 1_000_000
# The low bits of Spark's row id count the rows of a partition, the others are the partition.
_ROW_BITS = 33


def _values(frame: DataFrame, columns: list[str]) -> DataFrame:
    ordered = with_row_order(frame, columns=columns)
    cells = normalized_cells(unpivot(ordered, columns, as_text=True)).where(F.col("raw").isNotNull())
    names = F.array(*[F.lit(c) for c in columns])
    return cells.select(names[F.col("pos")].alias("column"), F.col("v").alias("value"))


def category_dictionary(frame: DataFrame, columns: list[str], *, values_per_piece: int = _VALUES_PER_PIECE) -> DataFrame:
    """``column, code, value``: codes count from 0 in value order.

    Any column may be made a category, so the values of one column may be many. The distinct values, each once however
    hot it is in the table, are landed, dealt to ranges of (column, value) that grow in number with them, sorted
    within each range, and landed with their place in it; a running sum over the ranges makes the places dense
    codes. No task sorts a whole column, and the ranges only balance the work: any choice gives the same codes.
    """
    values = landed(_values(frame, columns).distinct().where(F.col("value").isNotNull()), "category_values")
    pieces = max(1, math.ceil(values.count() / values_per_piece))
    row = F.monotonically_increasing_id()
    placed = values.repartitionByRange(pieces, "column", "value").sortWithinPartitions("column", "value").select(
        "column", "value", F.shiftright(row, _ROW_BITS).alias("piece"), row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("place")
    )
    placed = landed(placed, "category_places")
    found = placed.groupBy("column", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("column").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.select("column", "piece", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("start"))
    if pieces * len(columns) <= _BROADCAST_PIECES:
        starts = F.broadcast(starts)
    return placed.join(starts, ["column", "piece"]).select("column", (F.col("start") + F.col("place")).alias("code"), "value")


def encode(frame: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Add ``<column>_code``; Spark broadcasts the dictionary only if it is small enough."""
    name = f"{column}_code"
    refuse_clash(frame.columns, name, "__value")
    codes = dictionary.where(F.col("column") == column).select(F.col("value").alias("__value"), F.col("code").alias(name))
    return frame.join(codes, F.col(quoted(column)) == F.col("__value"), "left").drop("__value")


def convert_encoded(frame: DataFrame, schema, *, keep: list[str] | None = None, **options) -> DataFrame:
    """The typed table, with a code beside every category column: its place among the column's sorted values.

    Null cells have a null code. Rows and their number stay as ``convert`` gives them.
    """
    wanted = targets(schema)
    categories = [t.column for t in wanted if t.logical == "category"]
    converted = convert(frame, schema, keep=keep, **options)
    if not categories:
        return converted
    dictionary = landed(category_dictionary(frame, categories), "category_dictionary")
    for column in categories:
        converted = encode(converted, column, dictionary)
    return converted
