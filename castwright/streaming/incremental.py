"""Incremental profile over a Structured Streaming file source.

The state of a column has a fixed size: its evidence (one row) and at most as many values as a profile counts, those
seen first. Each micro-batch merges its own into the state of the batch before and writes the result to the next of
``_SLOTS`` folders, which are overwritten in turn. So the state stays as large after a million batches as after three. A
replayed batch starts from the same state before it and writes the same folder, so it counts once; a batch that died
while writing leaves the state before it untouched. The profile equals the one of all files read at once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from castwright import fixed
from castwright.local import local_frame
from castwright.operators.cells import with_row_order
from castwright.operators.profile import (
    EVIDENCE_SCHEMA,
    VALUES_SCHEMA,
    collect_evidence,
    evidence,
    finish,
    merge_evidence,
    values,
)
from castwright.sources.csv import read_csv

_SLOTS = 3
_BATCH = "batch_id"


def _plain(row: dict) -> dict:
    held = {name: row[name] for name in EVIDENCE_SCHEMA.names}
    return {k: v.asDict() if isinstance(v, tuple) else v for k, v in held.items()}


def _first_values(found: DataFrame) -> DataFrame:
    """Of each column the values seen first, as many as a profile counts; a few hundred rows a column come in."""
    merged = found.where(F.col("v").isNotNull()).groupBy("pos", "v").agg(F.min("first").alias("first"))
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("first", "v"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= fixed.UNIQUE_CAP).drop("rank")


def _held(spark: SparkSession, state: str) -> dict[int, list[dict]]:
    """Evidence rows by the batch that wrote them: those of a few batches, a row a column. The evidence is written last, so it
    stands only where the values of its batch do."""
    try:
        rows = spark.read.schema(T.StructType([*EVIDENCE_SCHEMA.fields, T.StructField(_BATCH, T.LongType())])).parquet(f"{state}/evidence-*")
    except AnalysisException:
        return {}
    held: dict[int, list[dict]] = {}
    for row in rows.collect():
        held.setdefault(row[_BATCH], []).append(_plain(row.asDict()))
    return held


def _held_values(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    shape = T.StructType([*VALUES_SCHEMA.fields, T.StructField(_BATCH, T.LongType())])
    rows = spark.read.schema(shape).parquet(f"{state}/values-{batch_id % _SLOTS}")
    return rows.where(F.col(_BATCH) == batch_id).drop(_BATCH)


def update_state(batch: DataFrame, batch_id: int, columns: list[str], state: str, **date_options) -> None:
    """Merge one micro-batch into the state; a batch that comes again changes nothing."""
    spark = batch.sparkSession
    ordered = with_row_order(batch, columns=columns)
    rows = collect_evidence(evidence(ordered, **date_options))
    found = values(ordered, rows)
    held = local_frame(spark, [_plain(row) for row in rows.values()], EVIDENCE_SCHEMA)
    before = _held(spark, state)
    earlier = [b for b in before if b < batch_id]
    if earlier:
        held = merge_evidence(held.unionByName(local_frame(spark, before[max(earlier)], EVIDENCE_SCHEMA)))
        found = found.unionByName(_held_values(spark, state, max(earlier)))
    # Both have a bounded number of rows a column; the evidence comes last and makes the state valid.
    slot, mark = batch_id % _SLOTS, F.lit(batch_id).cast("long").alias(_BATCH)
    _first_values(found).select("*", mark).write.mode("overwrite").parquet(f"{state}/values-{slot}")
    held.select(*EVIDENCE_SCHEMA.names, mark).write.mode("overwrite").parquet(f"{state}/evidence-{slot}")


def start_profile(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    state: str,
    *,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
    available_now: bool = True,
    reader_options: dict | None = None,
    **date_options,
) -> StreamingQuery:
    """Start profiling the files of a folder; by default all that are there, then stop.

    With ``file_format="csv"`` the files of a batch are read as ``read_csv`` reads them; a malformed one stops the stream.
    """
    columns = [field.name for field in schema.fields]
    is_csv = file_format == "csv"
    if is_csv:
        # Only the names are streamed: the content column is pruned.
        shape = "path string, modificationTime timestamp, length long, content binary"
        source = spark.readStream.schema(shape).format("binaryFile")
    else:
        source = spark.readStream.schema(schema).format(file_format).options(**(reader_options or {}))
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    stream = source.load(path).select("path") if is_csv else source.load(path).select("*", F.col("_metadata"))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        if is_csv:
            files = [row["path"] for row in batch.collect()]  # as many as a trigger takes
            if not files:
                return
            table = read_csv(batch.sparkSession, files, columns=columns)
            table.require_well_formed()
            batch = table.positioned
        update_state(batch, batch_id, columns, state, **date_options)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{state}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current_profile(spark: SparkSession, state: str, columns: list[str]) -> DataFrame:
    """Profile over all batches so far."""
    held = _held(spark, state)
    if not held:
        return finish(spark, columns, {}, local_frame(spark, [], VALUES_SCHEMA))
    last = max(held)
    return finish(spark, columns, {row["pos"]: row for row in held[last]}, _held_values(spark, state, last))
