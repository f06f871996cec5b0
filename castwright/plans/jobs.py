"""Profile, infer, override, convert and page a whole table or file."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date
from time import perf_counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castwright import fixed
from castwright.local import local_frame, pin, quoted
from castwright.operators import convert as conversion
from castwright.operators import paging
from castwright.operators.cells import BLK, SRC, Ordered, landed, with_row_order
from castwright.operators.infer import dataset_warnings, infer
from castwright.operators.overrides import apply_overrides
from castwright.operators.profile import collect_evidence, evidence, finish, profile, profile_files, values
from castwright.sources import runs as run_log
from castwright.sources.csv import MALFORMED, CsvError, CsvTable, open_landed, read_csv, read_each
from castwright.sources.files import FileTypeError, file_type_of, list_supported_files


@dataclass
class ProcessResult:
    """What processing a table yields; the frames other than ``converted`` are small."""

    object_key: str
    file_type: str
    row_count: int
    profile: DataFrame
    schema: DataFrame
    converted: DataFrame
    preview: DataFrame
    preview_page: dict
    warnings: list[str]
    selected_sheet: str = ""
    metadata: dict = field(default_factory=dict)
    # What a later page needs to read and render as the first one did.
    paging: dict = field(default_factory=dict)

    @property
    def preview_columns(self) -> list[str]:
        return self.converted.columns

    def schema_entries(self) -> list[dict]:
        """Schema rows as plain dictionaries, in column order."""
        return [row.asDict(recursive=True) for row in self.schema.orderBy("pos").collect()]

    def to_dict(self) -> dict:
        """The payload form: at most one page of rows."""
        return {
            "objectKey": self.object_key,
            "fileType": self.file_type,
            "selectedSheet": self.selected_sheet,
            "rowCount": self.row_count,
            "schema": self.schema_entries(),
            "previewColumns": self.preview_columns,
            "previewRows": [row.asDict() for row in self.preview.collect()],
            "previewPage": self.preview_page,
            "warnings": self.warnings,
            "processingMetadata": self.metadata,
        }

    def run_row(self, bucket: str = "") -> dict:
        return run_log.run_row(
            bucket=bucket, object_key=self.object_key, file_type=self.file_type, sheet_name=self.selected_sheet,
            row_count=self.row_count, schema=self.schema_entries(), warnings=self.warnings,
            preview_columns=self.preview_columns, metadata=self.metadata | {"paging": self.paging},
        )


def _settle(found: DataFrame, overrides: Mapping[str, str] | DataFrame | None):
    """Pinned profile and effective schema (one row per column), and the warnings."""
    found = pin(found)
    schema = infer(found)
    if overrides is not None:
        schema = apply_overrides(schema, found, overrides)
    schema = pin(schema)
    return found, schema, [row["warning"] for row in dataset_warnings(schema).collect()]


def _metadata(started: float, page_size: int) -> dict:
    return {
        "durationMs": round((perf_counter() - started) * 1000, 2),
        "previewRowLimit": page_size,
        "chunkSize": None,
    }


def process_table(
    frame: DataFrame,
    overrides: Mapping[str, str] | DataFrame | None = None,
    *,
    order_by: str | None = None,
    columns: list[str] | None = None,
    page_size: int = fixed.PAGE_SIZE_DEFAULT,
    object_key: str = "",
    file_type: str = "csv",
    **date_options,
) -> ProcessResult:
    """Process any DataFrame; ``order_by`` defines row order for samples and the first page, ``columns`` what to process (default: all)."""
    paging.check_page(1, page_size)
    started = perf_counter()
    ordered = with_row_order(frame, order_by, columns)
    found, schema, warnings = _settle(profile(frame, order_by, ordered.columns, **date_options), overrides)
    first = found.first()
    row_count = first["total_count"] if first else frame.count()
    if ordered.by_value:
        rows = frame.limit(page_size)
    else:
        rows = paging.raw_page(frame, 1, page_size, order_by)
    preview = conversion.render_rows(conversion.convert(rows, schema, ordered=True, **date_options))
    return ProcessResult(
        object_key, file_type, row_count, found, schema, conversion.convert(frame, schema, **date_options), preview,
        paging.page_info(row_count, 1, page_size), warnings, metadata=_metadata(started, page_size),
        paging={"dates": _stored_dates(date_options)},
    )


def process_csv(
    spark: SparkSession,
    path: str | list[str],
    overrides: Mapping[str, str] | DataFrame | None = None,
    *,
    page_size: int = fixed.PAGE_SIZE_DEFAULT,
    allow_malformed: bool = False,
    **date_options,
) -> ProcessResult:
    """Process CSV files; rows with too many cells fail the run unless allowed."""
    paging.check_page(1, page_size)
    started = perf_counter()
    table = read_csv(spark, path)
    # The malformed marker is profiled as one more column, so the check costs no pass of its own.
    # The block of a landed row stands for its file, so the name is not carried with every cell.
    ordered = Ordered(table.positioned, [*table.columns, MALFORMED], [BLK])
    rows = collect_evidence(evidence(ordered, **date_options))
    marker = rows.pop(len(table.columns), None)  # it has a value only on malformed rows
    if marker and marker["non_null_count"] and not allow_malformed:
        raise CsvError(fixed.ERR_PARSE)
    ordered = Ordered(table.positioned, table.columns, [BLK])
    found, schema, warnings = _settle(finish(spark, table.columns, rows, values(ordered, rows)), overrides)
    row_count = found.first()["total_count"]
    leading = paging.raw_page(table.positioned, 1, page_size).select(*map(quoted, table.columns))
    preview = conversion.render_rows(conversion.convert(leading, schema, ordered=True, **date_options))
    return ProcessResult(
        table.path, "csv", row_count, found, schema, conversion.convert(table.frame, schema, **date_options), preview,
        paging.page_info(row_count, 1, page_size), warnings, metadata=_metadata(started, page_size),
        paging={"dates": _stored_dates(date_options), "landed": table.landed, "columns": table.columns},
    )


def _stored_dates(options: dict) -> dict:
    """Date options as a run row holds them, resolved: what is not given depends on the day of the run."""
    today = date.today()
    options = {"pivot_year": today.year, "reference_date": today} | {k: v for k, v in options.items() if v is not None}
    return {k: v.isoformat() if isinstance(v, date) else v for k, v in options.items()}


def _read_dates(stored: dict) -> dict:
    return {k: date.fromisoformat(v) if k == "reference_date" else v for k, v in stored.items()}


def _landed_table(spark: SparkSession, context: dict, stored: dict) -> CsvTable:
    """The rows a run landed, or, where they are gone, its files read again."""
    try:
        return open_landed(spark, stored["landed"], stored["columns"], context["object_key"])
    except (KeyError, AnalysisException):
        paths = context["object_key"].split(",") if "," in context["object_key"] else context["object_key"]
        return read_csv(spark, paths, columns=stored.get("columns"))


def process(spark: SparkSession, source: DataFrame | str, overrides=None, **options) -> ProcessResult:
    """Process a DataFrame or a path (any URI Spark can read)."""
    if isinstance(source, DataFrame):
        return process_table(source, overrides, **options)
    if file_type_of(source) != "csv":
        raise FileTypeError("Land Excel sheets as CSV or Parquet first.")
    return process_csv(spark, source, overrides, **options)


def preview_run(
    spark: SparkSession,
    log_path: str | None,
    run_id: str | None,
    page: int,
    page_size: int = fixed.PAGE_SIZE_DEFAULT,
    *,
    context: dict | None = None,
    **date_options,
) -> tuple[dict, DataFrame]:
    """A later page by stored schema: the run if it exists, else the caller's ``context``.

    The context holds ``object_key``, ``row_count`` and ``schema``.  Nothing is
    profiled again, and a page outside the table is refused before any read.
    A run's own date options hold unless others are given, and the rows it landed are read, if they
    are still there. A log or a run that is missing counts as no run.
    """
    paging.check_page(page, page_size)
    if log_path is not None and run_id is not None:
        try:
            context = run_log.find_run(spark, log_path, run_id)
        except (run_log.RunNotFound, AnalysisException) as error:
            if context is None:
                raise run_log.RunNotFound(fixed.ERR_RUN_MISSING) from error
    if context is None:
        raise run_log.RunNotFound(fixed.ERR_RUN_MISSING)
    info = paging.page_info(context["row_count"], page, page_size)
    stored = context.get("processing_metadata", {}).get("paging", {})
    date_options = _read_dates(stored.get("dates", {})) | date_options
    table = _landed_table(spark, context, stored)
    table.require_well_formed()
    rows = paging.raw_page(table.positioned, page, page_size).select(*map(quoted, table.columns))
    return info, conversion.render_rows(conversion.convert(rows, context["schema"], ordered=True, **date_options))


PREFIX_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("inferred_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def _schema_fields(schema: DataFrame) -> Column:
    return F.struct(*[c for c in schema.columns if c != SRC])


def process_prefix(
    spark: SparkSession, prefix: str, log_path: str | None = None, *, allow_malformed: bool = False, **date_options
) -> DataFrame:
    """Process every CSV file below a prefix; one schema row per column and file, landed.

    All files are read and profiled together, with the file as an aggregation key: the number of jobs does not grow
    with the files, and neither file names nor result rows pass through the driver. A file that cannot be processed
    gives one ``failed`` row. Each file gets a run row.
    """
    if list_supported_files(spark, prefix).where(F.col("format") == "csv").isEmpty():
        return local_frame(spark, [], PREFIX_SCHEMA)
    cells, files = read_each(spark, prefix)
    error = F.when(F.col("columns").isNull(), F.lit(fixed.ERR_EMPTY_FILE))
    if not allow_malformed:
        error = error.when(F.col("malformed") > 0, F.lit(fixed.ERR_PARSE))
    files = landed(files.withColumn("error", error), "prefix_files")
    columns = files.where(F.col("error").isNull()).select("file", F.posexplode("columns").alias("pos", "column"))
    schema = landed(infer(profile_files(cells, columns, **date_options), (SRC,)), "prefix_schema")
    good = schema.join(files.select(F.col("file").alias(SRC), "row_count"), SRC)
    good = good.select(
        F.col(SRC).alias("path"), F.lit("completed").alias("status"), "row_count", "pos", "column", "inferred_type", "confidence",
        "nullable", F.lit(None).cast("string").alias("error"),
    )
    bad = files.where(F.col("error").isNotNull()).select(F.col("file").alias("path"), F.lit("failed").alias("status"), "error")
    found = landed(good.unionByName(bad, allowMissingColumns=True).select(*PREFIX_SCHEMA.names), "prefix_result")
    if log_path is not None:
        entries = schema.groupBy(F.col(SRC).alias("file")).agg(F.sort_array(F.collect_list(F.struct("pos", _schema_fields(schema).alias("entry")))).alias("own"))
        run_log.append_run_frame(files.join(entries, "file", "left"), log_path, {"paging": {"dates": _stored_dates(date_options)}})
    return found
