"""From a table to its cells: row order and unpivoting."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright.functions import classify
from castwright.local import quoted, refuse_clash
from castwright.sources.scratch import work_folder

SRC, BLK, SEQ = "__src", "__blk", "__seq"
ORDER_COLUMNS = (SRC, BLK, SEQ)
_LAST = 2**63 - 1
# Estimates count decoded bytes, so this is a few megabytes of a compressed file.
_SPLIT_BYTES = 32 * 1024 * 1024
# Spark packs files up to this size (its cost of opening one) into one split.
_LEAST_BYTES = 4 * 1024 * 1024


@dataclass
class Ordered:
    """A table with its row position.

    The position is (source, block, sequence).  ``block_keys`` names the parts
    other than the sequence that are needed: none for a table ordered by a key,
    file and block for a file scan.  ``by_value`` marks a table without any row
    order, where the hash of a value stands in for its position.
    """

    frame: DataFrame
    columns: list[str]
    block_keys: list[str] = field(default_factory=list)
    by_value: bool = False
    key_column: str | None = None


def _order_key(frame: DataFrame, order_by: str | Column) -> Column:
    key = F.col(quoted(order_by)) if isinstance(order_by, str) else order_by
    kind = frame.select(key.alias("k")).schema["k"].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        number = key.cast("bigint")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(key).cast("bigint")
    elif isinstance(kind, T.TimestampType):
        number = F.unix_micros(key)
    elif isinstance(kind, T.TimestampNTZType):
        clock = F.hour(key) * 3600 + F.minute(key) * 60 + F.extract(F.lit("SECOND"), key)
        number = F.unix_date(key.cast("date")).cast("bigint") * 86_400_000_000 + (clock * 1_000_000).cast("bigint")
    else:
        raise ValueError("order_by must be an integer, date or timestamp.")
    return F.coalesce(number, F.lit(_LAST))


def _file_facts(frame: DataFrame) -> list[str]:
    """Names of the file facts Spark offers for the rows of a frame; none unless it is a file scan."""
    hidden = frame._jdf.queryExecution().analyzed().metadataOutput().mkString(",")
    if "_metadata" not in frame.columns and not hidden.startswith("_metadata#"):
        return []
    kind = frame.select("_metadata").schema["_metadata"].dataType
    return kind.names if isinstance(kind, T.StructType) else []


def with_row_order(frame: DataFrame, order_by: str | Column | None = None, columns: list[str] | None = None) -> Ordered:
    """Attach the row position.

    With ``order_by`` the key is the position; the key is a column like the others, unless ``columns`` leaves it out.
    A file scan is in file order: file, then row.  Anything else has no order a
    second run could rely on, so values are ordered by their hash.
    """
    key_column = order_by if isinstance(order_by, str) else None
    if columns is None:
        columns = [c for c in frame.columns if c not in ORDER_COLUMNS]
    if order_by is not None:
        refuse_clash(frame.columns, SEQ)
        keyed = frame.withColumn(SEQ, _order_key(frame, order_by))
        return Ordered(keyed, columns, key_column=key_column)
    if set(ORDER_COLUMNS) <= set(frame.columns):
        return Ordered(frame, columns, [SRC, BLK])
    refuse_clash(frame.columns, *ORDER_COLUMNS)
    if _file_facts(frame):
        return Ordered(with_file_position(frame), columns, [SRC, BLK])
    return Ordered(frame.withColumn(SEQ, F.lit(None).cast("bigint")), columns, by_value=True)


def with_file_position(frame: DataFrame) -> DataFrame:
    """Add file, block and sequence of a file scan.

    Parquet knows the row number within the file.  For other formats it is the
    block start and a number that grows by one from row to row within the block. Such a position holds for one scan
    only, since another may split the files elsewhere: the rows are landed with it once, and read from there.
    """
    by_row = "row_index" in _file_facts(frame)
    placed = frame.withColumns(
        {
            SRC: F.col("_metadata.file_path"),
            BLK: F.lit(0).cast("bigint") if by_row else F.col("_metadata.file_block_start").cast("bigint"),
            SEQ: F.col("_metadata.row_index") if by_row else F.monotonically_increasing_id(),
        }
    )
    return placed if by_row or frame.isStreaming else landed(placed, "positions")


def land(frame: DataFrame, name: str) -> str:
    """The new folder below the shared one that a frame was written to."""
    path = f"{work_folder(frame.sparkSession, name)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return path


def landed(frame: DataFrame, name: str) -> DataFrame:
    """A frame written once to the shared folder and read back."""
    return frame.sparkSession.read.schema(frame.schema).parquet(land(frame, name))


def spread(frame: DataFrame) -> DataFrame:
    """Spread a small scan over all cores before work that is heavy per cell.

    Only a frame whose estimated size would fill fewer splits than there are cores
    is redistributed, so the shuffle is bounded by cores times the split size and
    never applies to large data, which has splits enough. A scan of as many files as there are cores
    is spread already, if the files together hold more than a split each.
    """
    session = frame.sparkSession
    cores = session.sparkContext.defaultParallelism
    estimate = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if estimate >= cores * _SPLIT_BYTES or (estimate >= cores * _LEAST_BYTES and len(frame.inputFiles()) >= cores):
        return frame
    return frame.repartition(cores)


def unpivot(ordered: Ordered, columns: list[str], *, as_text: bool = False) -> DataFrame:
    """One row per cell: ``pos, raw, hint, digest`` and the row position.

    ``raw`` is the text to read.  Typed cells are not formatted: they arrive with
    their mask in ``hint`` and the hash of their value in ``digest``, unless
    ``as_text`` asks for the text as well.
    """
    no_text, no_hint, no_digest = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("bigint")
    arguments = []
    for name in columns:
        pos, cell, kind = ordered.columns.index(name), F.col(quoted(name)), ordered.frame.schema[name].dataType
        if classify.is_parsed(kind):
            arguments += [F.lit(pos), cell.cast("string"), no_hint, no_digest]
        else:
            hint, digest = classify.typed_cell(cell, kind)
            arguments += [F.lit(pos), cell.cast("string") if as_text else no_text, hint, digest]
    wanted = ordered.frame.select(*ordered.block_keys, SEQ, *[quoted(name) for name in columns])
    return spread(wanted).select(
        *ordered.block_keys, SEQ, F.stack(F.lit(len(columns)), *arguments).alias("pos", "raw", "hint", "digest")
    )
