"""One small integer per cell that says which types the cell could hold.

Bits are chosen so that a column's flags are plain ``bit_and`` / ``bit_or`` over
its cells: both are associative, need no text in the aggregation buffer and
merge across partitions, files and micro-batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright import fixed
from castwright.functions import complexes, dates, numbers, text
from castwright.functions.stages import apply_stages, raw

INTEGER = 1
NUMBER = 2
BOOLEAN = 4
ALPHA = 8
DATETIME = 16
AMBIGUOUS = 32
TIME = 64
COMPLEX = 128
OFFSET = 256
ALL = 511

_INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _flag(condition: Column, bit: int) -> Column:
    return F.when(condition, F.lit(bit)).otherwise(F.lit(0))


def is_parsed(data_type: T.DataType) -> bool:
    """Must cells of this type be read as text?  Typed cells are judged by their value."""
    return not isinstance(
        data_type,
        _INTEGRAL_TYPES
        + (T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType),
    )


def typed_cell(cell: Column, data_type: T.DataType) -> tuple[Column, Column]:
    """(mask, value hash) of a typed cell; both null when its text would be null.

    Gives exactly what ``classify`` gives for the cell cast to text, without
    formatting and re-parsing it.
    """
    present = cell.isNotNull()
    value = cell
    if isinstance(data_type, _INTEGRAL_TYPES):
        mask = F.lit(INTEGER | NUMBER).bitwiseOR(_flag(cell.isin(0, 1), BOOLEAN))
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        present = present & ~F.isnan(cell)
        finite = F.abs(cell) != F.lit(float("inf"))
        mask = F.lit(NUMBER).bitwiseOR(_flag(finite & (cell == F.rint(cell)), INTEGER))
    elif isinstance(data_type, T.DecimalType):
        mask = F.lit(NUMBER).bitwiseOR(_flag(cell == F.floor(cell), INTEGER))
        if data_type.scale == 0:
            mask = mask.bitwiseOR(_flag(cell.isin(0, 1), BOOLEAN))
    elif isinstance(data_type, T.BooleanType):
        mask = F.lit(BOOLEAN | ALPHA)
    else:
        # Two instants can print alike around a clock change, so hash what is printed.
        value = cell.cast("timestamp_ntz")
        bits = DATETIME if isinstance(data_type, T.DateType) else DATETIME | TIME
        in_range = value.between(
            F.lit(fixed.FIRST_INSTANT).cast("timestamp_ntz"), F.lit(fixed.LAST_INSTANT).cast("timestamp_ntz")
        )
        mask = _flag(in_range, bits)
    return F.when(present, mask).cast("int"), F.when(present, F.xxhash64(value))


def classify(cells: DataFrame, v: str = "v", mask: str = "mask", **date_options) -> DataFrame:
    """Add the mask of the normalized text column ``v``; cheap, common shapes are tested first."""
    number = f"CASE WHEN {numbers.whole_test('__cleaned', '__scientific')} THEN {INTEGER | NUMBER} ELSE {NUMBER} END"
    # A slash stands in dates only, a j in complex numbers only (of these kinds); two inner dashes in dates and those.
    settled = F.expr(
        f"CASE WHEN {v} IN ('0', '1') THEN {INTEGER | NUMBER | BOOLEAN} "
        f"WHEN contains({v}, '/') THEN NULL "
        f"WHEN contains({v}, 'j') OR contains({v}, 'J') THEN CASE WHEN {complexes.complex_test(v)} THEN {COMPLEX} END "
        f"WHEN {dates.dashed(v)} THEN NULL "
        f"WHEN {v} >= '0' AND {v} < ':' AND {v} RLIKE {raw(numbers.PLAIN_DIGITS)} THEN {INTEGER | NUMBER} "
        f"WHEN {text.is_alpha_boolean(v)} THEN {BOOLEAN | ALPHA} "
        f"WHEN {numbers.number_test('__cleaned')} THEN {number} END"
    )
    date_mask = (
        f"{DATETIME} | CASE WHEN {dates.ambiguous_test('__')} THEN {AMBIGUOUS} ELSE 0 END "
        f"| CASE WHEN {dates.time_test(v, '__')} THEN {TIME} ELSE 0 END "
        f"| CASE WHEN {dates.offset_test('__')} THEN {OFFSET} ELSE 0 END"
    )
    rule = (
        numbers.number_stages(v, "__")
        + [{"__settled": settled}]
        + dates.timestamp_stages(v, "__stamp", "__", when="__settled IS NULL", **date_options)
        + [
            {
                mask: F.expr(
                    f"CASE WHEN __stamp IS NOT NULL THEN {date_mask} WHEN {v} IS NOT NULL THEN coalesce(__settled, 0) END"
                )
            }
        ]
    )
    return apply_stages(cells, [rule]).drop(
        "__cleaned", "__scientific", "__short", "__iso", "__settled", "__parts", "__numbers", "__wall", "__shift", "__instant", "__stamp"
    )
