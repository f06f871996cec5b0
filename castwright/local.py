"""Small driver-side tables (one row per column, override or page, never per data row)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    """A DataFrame over rows already on the driver.

    Built from an Arrow table, which Spark keeps as a local relation: its size is
    known, so the optimizer itself may broadcast it.
    """
    table = pa.Table.from_pylist(rows, schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)


def pin(frame: DataFrame) -> DataFrame:
    """Run a one-row-per-column frame once and keep its rows as a local relation."""
    rows = [row.asDict(recursive=True) for row in frame.collect()]
    return local_frame(frame.sparkSession, rows, frame.schema)


def quoted(name: str) -> str:
    """Column names come from file headers, so dots and backticks must not be parsed."""
    return "`" + name.replace("`", "``") + "`"


def refuse_clash(columns: list[str], *helpers: str) -> None:
    """Raise if a table has a column by the name of a helper column."""
    taken = {c.lower() for c in columns} & {h.lower() for h in helpers}
    if taken:
        raise ValueError(f"Column names {', '.join(sorted(taken))} are reserved; rename them first.")
