"""The run log: one row per processed table, never any credentials."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright import fixed
from castwright.local import local_frame

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("object_key", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("sheet_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("schema", T.StringType()),
        T.StructField("warnings", T.StringType()),
        T.StructField("preview_columns", T.StringType()),
        T.StructField("processing_metadata", T.StringType()),
    ]
)


class RunNotFound(LookupError):
    """No completed run has the requested id."""


def run_row(
    *, object_key: str, file_type: str = "csv", status: str = "completed", bucket: str = "", sheet_name: str = "",
    row_count: int = 0, schema: list[dict] = (), warnings: list[str] = (), preview_columns: list[str] = (),
    metadata: dict | None = None, run_id: str | None = None,
) -> dict:
    """One log row; nested parts are JSON text."""
    return {
        "run_id": run_id or uuid.uuid4().hex,
        "bucket": bucket,
        "object_key": object_key,
        "file_type": file_type,
        "sheet_name": sheet_name,
        "status": status,
        "row_count": row_count,
        "schema": json.dumps(list(schema)),
        "warnings": json.dumps(list(warnings)),
        "preview_columns": json.dumps(list(preview_columns)),
        "processing_metadata": json.dumps(metadata or {}),
    }


def append_runs(spark: SparkSession, log_path: str, rows: list[dict]) -> DataFrame:
    """Append run rows, partitioned by day; returns what was written."""
    frame = local_frame(spark, rows, RUN_SCHEMA).withColumn("created_at", F.current_timestamp())
    frame = frame.withColumn("run_date", F.to_date("created_at"))
    frame.coalesce(1).write.mode("append").partitionBy("run_date").parquet(log_path)
    return frame


def append_run_frame(files: DataFrame, log_path: str, metadata: dict) -> None:
    """Append a run row for each file of a frame (``file, columns, row_count, error, own``), built where the rows are."""
    entries = F.transform("own", lambda x: x["entry"])
    warnings = F.array_sort(F.array_distinct(F.flatten(F.transform(entries, lambda e: e["warnings"]))))
    done = F.col("error").isNull()
    none = F.lit("[]")
    shown = F.to_json(F.struct(F.col("error")))
    rows = files.select(
        F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("run_id"),
        F.lit("").alias("bucket"),
        F.col("file").alias("object_key"),
        F.lit("csv").alias("file_type"),
        F.lit("").alias("sheet_name"),
        F.when(done, F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
        F.when(done, F.col("row_count")).otherwise(F.lit(0)).alias("row_count"),
        F.when(done, F.coalesce(F.to_json(entries, {"ignoreNullFields": "false"}), none)).otherwise(none).alias("schema"),
        F.when(done, F.coalesce(F.to_json(warnings), none)).otherwise(none).alias("warnings"),
        F.when(done, F.coalesce(F.to_json("columns"), none)).otherwise(none).alias("preview_columns"),
        F.when(done, F.lit(json.dumps(metadata))).otherwise(shown).alias("processing_metadata"),
    )
    stamped = rows.withColumn("created_at", F.current_timestamp()).withColumn("run_date", F.to_date("created_at"))
    stamped.write.mode("append").partitionBy("run_date").parquet(log_path)


def read_runs(spark: SparkSession, log_path: str) -> DataFrame:
    """All runs, newest first."""
    return spark.read.parquet(log_path).orderBy(F.desc("created_at"), "object_key")


def search_runs(
    spark: SparkSession, log_path: str, *, text: str | None = None, file_type: str | None = None,
    status: str | None = None, since=None, until=None,
) -> DataFrame:
    """Runs by text in bucket or key, type, status and day; days prune partitions."""
    found = spark.read.parquet(log_path)
    if since is not None:
        found = found.where(F.col("run_date") >= F.lit(since))
    if until is not None:
        found = found.where(F.col("run_date") <= F.lit(until))
    if file_type is not None:
        found = found.where(F.col("file_type") == file_type)
    if status is not None:
        found = found.where(F.col("status") == status)
    if text is not None:
        needle = F.lit(text.lower())
        found = found.where(
            F.contains(F.lower("bucket"), needle) | F.contains(F.lower("object_key"), needle)
        )
    return found.orderBy(F.desc("created_at"), "object_key")


def find_run(spark: SparkSession, log_path: str, run_id: str) -> dict:
    """A completed run with its nested parts decoded."""
    row = (
        spark.read.parquet(log_path)
        .where((F.col("run_id") == run_id) & (F.col("status") == "completed"))
        .first()
    )
    if row is None:
        raise RunNotFound(fixed.ERR_RUN_MISSING)
    run = row.asDict()
    for part in ("schema", "warnings", "preview_columns", "processing_metadata"):
        run[part] = json.loads(run[part])
    return run
