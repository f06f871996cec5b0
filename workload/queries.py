"""The registered queries.  Each reads whole driver tables and runs the library on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwright.functions import complexes, dates, numbers, text
from castwright.functions.stages import apply_stages
from castwright.local import pin
from castwright.operators import convert as conversion
from castwright.operators import infer as inference
from castwright.operators import overrides as override_rules
from castwright.operators import paging
from castwright.operators.dictionary import category_dictionary, convert_encoded
from castwright.operators.profile import profile, value_counts
from castwright.plans import jobs
from castwright.sources import csv as csv_source
from castwright.sources import files, runs
from castwright.sources.scratch import work_folder
from castwright.streaming.incremental import current_profile, start_profile
from workload import inputs, oracle
from workload.inputs import DATES, EVENT_COLUMNS, LINEITEM_COLUMNS, ORDER_COLUMNS, ORDER_TYPES, raw_events, raw_orders, table

KEY = "row_ord"
OVERRIDES = {
    "us_date": "date", "status": "text", "nope": "text", "id_text": "category", "cust_text": "money",
    "zero_one": "boolean", "mixed": "integer", "iso_ts": "date",
}
GOOD_OVERRIDES = {"us_date": "date", "status": "text", "zero_one": "boolean"}
FORCED = {
    "num_text": "integer", "stamp_text": "datetime", "cplx_text": "complex", "bool_text": "boolean",
    "blank_text": "float", "props_text": "text",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def joined(frame: DataFrame, *arrays: str) -> DataFrame:
    """Array columns as bar-separated text, which both engines compare alike."""
    return frame.withColumns({name: F.array_join(name, "|") for name in arrays})


def orders_profile(spark: SparkSession, folder: str) -> DataFrame:
    return profile(raw_orders(spark, folder), KEY, ORDER_COLUMNS, **DATES)


def orders_schema(spark: SparkSession, folder: str) -> DataFrame:
    return inference.infer(orders_profile(spark, folder))


_PROFILED = oracle.profiled(inputs.RAW_ORDERS, ORDER_COLUMNS)
_INFERRED = oracle.inferred(inputs.RAW_ORDERS, ORDER_COLUMNS)


# --- profile ----------------------------------------------------------------


@query(f"WITH {oracle.cells(inputs.RAW_ORDERS, ORDER_COLUMNS)} SELECT \"column\", v, n FROM vals")
def value_counts_orders(spark, folder):
    return value_counts(raw_orders(spark, folder), KEY, ORDER_COLUMNS)


@query(f"SELECT count(*) AS row_count FROM ({inputs.RAW_ORDERS})")
def row_count(spark, folder):
    return raw_orders(spark, folder).agg(F.count(F.lit(1)).alias("row_count"))


@query(f"WITH {_PROFILED} SELECT * FROM profile")
def profile_orders(spark, folder):
    return joined(orders_profile(spark, folder), "sample_values")


@query(f"WITH {oracle.profiled(inputs.RAW_EVENTS, EVENT_COLUMNS)} SELECT * FROM profile")
def profile_events(spark, folder):
    return joined(profile(raw_events(spark, folder), KEY, EVENT_COLUMNS, **DATES), "sample_values")


@query(f"WITH {_PROFILED} SELECT \"column\", total_count, non_null_count, null_token_count FROM profile")
def null_token_counts(spark, folder):
    return orders_profile(spark, folder).select("column", "total_count", "non_null_count", "null_token_count")


@query(f"WITH {_PROFILED} SELECT \"column\", sample_values FROM profile")
def sample_values(spark, folder):
    return joined(orders_profile(spark, folder).select("column", "sample_values"), "sample_values")


@query(f"WITH {_PROFILED} SELECT \"column\", unique_count FROM profile")
def unique_counts(spark, folder):
    return orders_profile(spark, folder).select("column", "unique_count")


# --- inference --------------------------------------------------------------


@query(
    f"WITH {_PROFILED} SELECT \"column\", CASE WHEN non_null_count = 0 THEN 1.0::DOUBLE "
    f"ELSE unique_count::DOUBLE / non_null_count END AS unique_ratio, coalesce({oracle.LARGE}, false) AS is_large, "
    f"coalesce({oracle.SMALL}, false) AS is_small FROM profile"
)
def category_candidates(spark, folder):
    return orders_profile(spark, folder).select(
        "column",
        inference.unique_ratio().alias("unique_ratio"),
        inference.is_large_category().alias("is_large"),
        inference.is_small_category().alias("is_small"),
    )


@query(f"WITH {_INFERRED} SELECT * FROM inferred")
def infer_schema(spark, folder):
    return joined(orders_schema(spark, folder), "warnings", "sample_values", "allowed_overrides")


@query(f"WITH {oracle.inferred(inputs.RAW_EVENTS, EVENT_COLUMNS)} SELECT * FROM inferred")
def infer_events(spark, folder):
    schema = inference.infer_table(raw_events(spark, folder), KEY, EVENT_COLUMNS, **DATES)
    return joined(schema, "warnings", "sample_values", "allowed_overrides")


@query(f"WITH {oracle.inferred('SELECT * FROM lineitem', LINEITEM_COLUMNS, 'l_orderkey')} SELECT * FROM inferred")
def infer_lineitem(spark, folder):
    schema = inference.infer_table(table(spark, folder, "lineitem"), "l_orderkey", **DATES)
    return joined(schema, "warnings", "sample_values", "allowed_overrides")


@query(
    "WITH " + oracle.inferred("SELECT * FROM documents", ["doc_id", "text", "lang", "source", "n_chars"], "doc_id")
    + " SELECT * FROM inferred"
)
def infer_documents(spark, folder):
    schema = inference.infer_table(table(spark, folder, "documents"), "doc_id", **DATES)
    return joined(schema, "warnings", "sample_values", "allowed_overrides")


@query(f"WITH {_INFERRED} SELECT DISTINCT warnings AS warning FROM inferred WHERE warnings <> ''")
def dataset_warnings(spark, folder):
    return inference.dataset_warnings(orders_schema(spark, folder))


# --- overrides --------------------------------------------------------------


@query(
    f"WITH {_PROFILED} SELECT \"column\", pos, target_type, {oracle.CAN_CONVERT} AS allowed FROM profile, "
    f"(VALUES {', '.join(f'({oracle.text(t)})' for t in oracle.fixed.LOGICAL_TYPES)}) AS kinds(target_type)"
)
def can_convert_matrix(spark, folder):
    return override_rules.can_convert_matrix(orders_profile(spark, folder))


@query(f"WITH {_INFERRED}, {oracle.overridden(OVERRIDES)} SELECT * FROM effective")
def apply_overrides(spark, folder):
    found = pin(orders_profile(spark, folder))
    schema = override_rules.apply_overrides(inference.infer(found), found, OVERRIDES, strict=False)
    return joined(schema, "warnings", "sample_values", "allowed_overrides")


@query(
    f"WITH {_PROFILED}, {oracle.checked_overrides(OVERRIDES)} "
    "SELECT position, \"column\", target_type, error FROM checked WHERE error IS NOT NULL"
)
def override_errors(spark, folder):
    found = override_rules.override_errors(orders_profile(spark, folder), OVERRIDES)
    return found.select("position", "column", "target_type", "error")


@query(
    f"WITH {_INFERRED}, {oracle.overridden(OVERRIDES)} SELECT e.\"column\", e.pos, i.inferred_type AS detected_type, "
    "e.inferred_type AS effective_type FROM effective e JOIN inferred i ON e.\"column\" = i.\"column\" "
    "WHERE e.inferred_type <> i.inferred_type"
)
def schema_diff(spark, folder):
    found = pin(orders_profile(spark, folder))
    detected = inference.infer(found)
    effective = override_rules.apply_overrides(detected, found, OVERRIDES, strict=False)
    return override_rules.schema_diff(detected, effective)


# --- values -----------------------------------------------------------------


def event_texts(spark, folder, column) -> DataFrame:
    frame = raw_events(spark, folder).select(KEY, F.col(column).alias("raw"))
    return frame.select(KEY, text.strip("raw").alias("t")).select(KEY, text.blank_null_token("t").alias("v"))


def _one(column: str) -> str:
    return oracle.one_column(inputs.RAW_EVENTS, column)


@query(f"WITH {_one('blank_text')} SELECT row_ord, v FROM one")
def normalize_tokens(spark, folder):
    return event_texts(spark, folder, "blank_text")


def event_numbers(spark, folder) -> DataFrame:
    return apply_stages(event_texts(spark, folder, "num_text"), [numbers.number_stages("v", "")])


@query(
    f"WITH {_one('num_text')}, {oracle.parsed_numbers('one')} SELECT row_ord, v, nums_a.c AS cleaned "
    "FROM nums_a"
)
def grouped_numbers(spark, folder):
    return event_numbers(spark, folder).select(KEY, "v", "cleaned")


@query(f"WITH {_one('num_text')}, {oracle.parsed_numbers('one')} SELECT row_ord, is_number, as_double AS value FROM nums")
def parse_number(spark, folder):
    return event_numbers(spark, folder).select(
        KEY, numbers.is_number("cleaned").alias("is_number"), numbers.to_double("cleaned").alias("value")
    )


@query(f"WITH {_one('num_text')}, {oracle.parsed_numbers('one')} SELECT row_ord, is_whole, as_bigint AS value FROM nums")
def integrality(spark, folder):
    return event_numbers(spark, folder).select(
        KEY,
        (numbers.is_number("cleaned") & numbers.is_integral("cleaned", "scientific")).alias("is_whole"),
        numbers.to_bigint("cleaned", "scientific").alias("value"),
    )


@query(f"WITH {_one('bool_text')} SELECT row_ord, {oracle.boolean('v')} AS value FROM one")
def parse_boolean(spark, folder):
    return event_texts(spark, folder, "bool_text").select(KEY, text.parse_boolean("v").alias("value"))


def event_dates(spark, folder, **options) -> DataFrame:
    rule = dates.timestamp_stages("v", "stamp", "d_", **DATES, **options)
    return apply_stages(event_texts(spark, folder, "stamp_text"), [rule])


@query(f"WITH {_one('stamp_text')}, {oracle.parsed_dates('one')} SELECT row_ord, v, stamp FROM stamps")
def parse_datetime(spark, folder):
    return event_dates(spark, folder).select(KEY, "v", "stamp")


@query(f"WITH {_one('stamp_text')}, {oracle.parsed_dates('one', dayfirst=True)} SELECT row_ord, v, stamp FROM stamps")
def parse_datetime_dayfirst(spark, folder):
    return event_dates(spark, folder, dayfirst=True).select(KEY, "v", "stamp")


@query(
    f"WITH {_one('stamp_text')}, {oracle.parsed_dates('one')} "
    "SELECT row_ord, v, stamp IS NOT NULL AND is_ambiguous AS is_ambiguous FROM stamps"
)
def ambiguous_dates(spark, folder):
    found = F.col("stamp").isNotNull() & F.expr(dates.ambiguous_test("d_"))
    return event_dates(spark, folder).select(KEY, "v", found.alias("is_ambiguous"))


@query(
    f"WITH {_one('stamp_text')}, {oracle.parsed_dates('one')} "
    "SELECT row_ord, v, stamp IS NOT NULL AND is_timed AS is_timed, stamp IS NOT NULL AND has_offset AS has_offset FROM stamps"
)
def time_hints(spark, folder):
    valid = F.col("stamp").isNotNull()
    return event_dates(spark, folder).select(
        KEY, "v",
        (valid & F.expr(dates.time_test("v", "d_"))).alias("is_timed"),
        (valid & F.expr(dates.offset_test("d_"))).alias("has_offset"),
    )


@query(f"WITH {_one('cplx_text')}, {oracle.parsed_complex('one')} SELECT row_ord, v, is_complex, re, im FROM cplx")
def parse_complex(spark, folder):
    frame = apply_stages(event_texts(spark, folder, "cplx_text"), [complexes.complex_stages("v", "z", "c_")])
    return frame.select(KEY, "v", complexes.is_complex("v").alias("is_complex"), "z.re", "z.im")


# --- conversion -------------------------------------------------------------


def one_converted(spark, folder, column, kind) -> DataFrame:
    frame = raw_events(spark, folder).select(KEY, column)
    return conversion.convert(frame, {column: kind}, keep=[KEY], **DATES)


@query(f"WITH {_one('blank_text')} SELECT row_ord, v AS blank_text FROM one")
def convert_text(spark, folder):
    return one_converted(spark, folder, "blank_text", "text")


@query(f"WITH {_one('num_text')}, {oracle.parsed_numbers('one')} SELECT row_ord, as_bigint AS num_text FROM nums")
def convert_integer(spark, folder):
    return one_converted(spark, folder, "num_text", "integer")


@query(f"WITH {_one('num_text')}, {oracle.parsed_numbers('one')} SELECT row_ord, as_double AS num_text FROM nums")
def convert_float(spark, folder):
    return one_converted(spark, folder, "num_text", "float")


@query(f"WITH {_one('bool_text')} SELECT row_ord, {oracle.boolean('v')} AS bool_text FROM one")
def convert_boolean(spark, folder):
    return one_converted(spark, folder, "bool_text", "boolean")


@query(f"WITH {_one('stamp_text')}, {oracle.parsed_dates('one')} SELECT row_ord, CAST(stamp AS DATE) AS stamp_text FROM stamps")
def convert_date(spark, folder):
    return one_converted(spark, folder, "stamp_text", "date")


@query(f"WITH {_one('stamp_text')}, {oracle.parsed_dates('one')} SELECT row_ord, stamp AS stamp_text FROM stamps")
def convert_datetime(spark, folder):
    return one_converted(spark, folder, "stamp_text", "datetime")


@query(f"WITH {_one('cplx_text')}, {oracle.parsed_complex('one')} SELECT row_ord, re, im FROM cplx")
def convert_complex(spark, folder):
    return one_converted(spark, folder, "cplx_text", "complex").select(KEY, "cplx_text.re", "cplx_text.im")


@query(
    f"WITH {oracle.cells(inputs.RAW_ORDERS, ['status', 'priority', 'name_text', 'cust_text'])} SELECT \"column\", "
    "row_number() OVER (PARTITION BY \"column\" ORDER BY v) - 1 AS code, v AS value FROM vals WHERE v IS NOT NULL"
)
def category_dictionary_orders(spark, folder):
    return category_dictionary(raw_orders(spark, folder), ["status", "priority", "name_text", "cust_text"])


_CODED = {"status": "category", "cust_text": "category", "name_text": "category", "zero_one": "integer"}
_CODES = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN dense_rank() OVER (ORDER BY {c} NULLS LAST) - 1 END AS {c}_code" for c in ("status", "cust_text", "name_text"))


@query(
    "WITH plain AS (SELECT row_ord, " + ", ".join(f"{oracle.normalized(c)} AS {c}" for c in ("status", "cust_text", "name_text"))
    + f", CAST(zero_one AS BIGINT) AS zero_one FROM ({inputs.RAW_ORDERS})) SELECT *, {_CODES} FROM plain"
)
def category_codes_orders(spark, folder):
    return convert_encoded(raw_orders(spark, folder), _CODED, keep=[KEY])


def converted_orders(spark, folder) -> DataFrame:
    return conversion.convert(raw_orders(spark, folder), ORDER_TYPES, keep=[KEY], **DATES)


@query(f"WITH {oracle.converted_orders()} SELECT * FROM conv")
def convert_table(spark, folder):
    out = converted_orders(spark, folder)
    return out.withColumns({"cplx_re": F.col("cplx_text.re"), "cplx_im": F.col("cplx_text.im")}).drop("cplx_text")


@query(f"WITH {oracle.rendered_orders()} SELECT * FROM shown")
def render_preview(spark, folder):
    return conversion.render_rows(converted_orders(spark, folder), keep=[KEY])


@query(
    f"WITH {_one('stamp_text')}, {oracle.parsed_dates('one')} SELECT row_ord, {oracle.iso('stamp')} || '+00:00' AS stamp_text "
    "FROM stamps"
)
def render_offsets(spark, folder):
    entry = [{"column": "stamp_text", "inferred_type": "datetime", "has_utc_offset": True}]
    out = conversion.convert(raw_events(spark, folder), entry, keep=[KEY], **DATES)
    return conversion.render_rows(out, keep=[KEY])


def _violation_sql() -> str:
    checks = {
        "num_text": (oracle.parsed_numbers("one"), "nums", "as_bigint IS NULL"),
        "stamp_text": (oracle.parsed_dates("one"), "stamps", "stamp IS NULL"),
        "cplx_text": (oracle.parsed_complex("one"), "cplx", "NOT is_complex"),
        "bool_text": (None, "one", f"({oracle.boolean('v')}) IS NULL"),
        "blank_text": (oracle.parsed_numbers("one"), "nums", "NOT is_number"),
        "props_text": (None, "one", "false"),
    }
    selects = []
    for i, (column, (ctes, source, bad)) in enumerate(checks.items()):
        with_part = f"WITH {_one(column)}" + (f", {ctes}" if ctes else "")
        failed = f"v IS NOT NULL AND {bad}"
        error = conversion.ERRORS.get(FORCED[column], "%s").replace("%s", column)
        selects.append(
            f"SELECT * FROM ({with_part} SELECT {oracle.text(column)} AS \"column\", {i} AS pos, "
            f"{oracle.text(FORCED[column])} AS target_type, count(*) FILTER ({failed}) AS violations, "
            f"arg_min(v, row_ord) FILTER ({failed}) AS first_value, "
            f"CASE WHEN count(*) FILTER ({failed}) > 0 THEN {oracle.text(error)} END AS error FROM {source})"
        )
    return " UNION ALL ".join(selects)


@query(_violation_sql())
def cast_violations(spark, folder):
    return conversion.violations(raw_events(spark, folder), FORCED, KEY, **DATES)


# --- paging -----------------------------------------------------------------


def _page_facts(page: int, size: int) -> str:
    return (
        f"SELECT {page}::BIGINT AS page, {size}::BIGINT AS page_size, n AS total_rows, pages AS total_pages, "
        f"{page} > 1 AS has_previous_page, {page} < pages AS has_next_page, "
        f"CASE WHEN {page} <= pages THEN {(page - 1) * size + 1}::BIGINT END AS first_row, "
        f"CASE WHEN {page} <= pages THEN least({page * size}, n)::BIGINT END AS last_row, "
        f"CASE WHEN {page} > pages THEN {oracle.text(oracle.fixed.ERR_PAGE_RANGE)} END AS error "
        "FROM (SELECT count(*) AS n, greatest(1, CAST(ceil(count(*) / 100.0) AS BIGINT)) AS pages FROM orders)"
    )


@query(" UNION ALL ".join(_page_facts(p, 100) for p in (1, 7, 10**9)))
def page_metadata(spark, folder):
    frame = raw_orders(spark, folder)
    first, middle, outside = (paging.page_metadata(frame, p, 100) for p in (1, 7, 10**9))
    return first.unionByName(middle).unionByName(outside)


def _page_sql(page: int, size: int) -> str:
    return f"WITH {oracle.rendered_orders()} SELECT * FROM shown ORDER BY row_ord LIMIT {size} OFFSET {(page - 1) * size}"


@query(_page_sql(1, 100))
def first_page(spark, folder):
    return paging.preview_page(raw_orders(spark, folder), ORDER_TYPES, 1, 100, KEY, keep=[KEY], **DATES)


@query(_page_sql(29, 50))
def preview_page(spark, folder):
    return paging.preview_page(raw_orders(spark, folder), ORDER_TYPES, 29, 50, KEY, keep=[KEY], **DATES)


@query(_page_sql(25, 500))
def preview_page_deep(spark, folder):
    return paging.preview_page(raw_orders(spark, folder), ORDER_TYPES, 25, 500, KEY, keep=[KEY], **DATES)


@query("SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS ord, o_orderkey FROM orders")
def row_ordinals(spark, folder):
    frame = table(spark, folder, "orders").select("o_orderkey")
    return paging.with_ordinals(frame, F.col("o_orderkey") * -3, rows_per_cell=1000)


# --- files ------------------------------------------------------------------


def _ranges(spark, folder) -> DataFrame:
    """raw_orders in row order over several files, whose names sort in that order."""
    return inputs.raw_orders_in_order(spark, folder)


def write_csv(frame: DataFrame, path: str) -> None:
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    frame.write.mode("overwrite").options(**options).csv(path)


def landed_csv(spark, folder, name) -> str:
    path = work_folder(spark, name)
    write_csv(_ranges(spark, folder).drop(KEY), path)
    return path


def _kind(name: str) -> str:
    return (
        f"CASE lower(regexp_extract({name}, '[^/](\\.[^./]+)$', 1)) WHEN '.csv' THEN 'csv' WHEN '.xls' THEN 'excel' "
        "WHEN '.xlsx' THEN 'excel' END"
    )


@query(f"SELECT page_id, name, {_kind('name')} AS file_type FROM ({inputs.NAMES})")
def file_type(spark, folder):
    names = inputs.derive(spark, folder, inputs.NAMES, "pages")
    return names.withColumn("file_type", files.file_type(F.col("name")))


@query(
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(length(CAST(o_orderkey AS VARCHAR)) + 1)::BIGINT AS size, 'csv' AS format "
    "FROM orders GROUP BY ALL"
)
def file_listing(spark, folder):
    """A CSV file a month, each line an order key, beside as many text and JSON files, which no listing shows."""
    path = work_folder(spark, "file_listing")
    month = F.date_format("o_orderdate", "yyyy-MM").alias("month")
    rows = table(spark, folder, "orders").select(month, F.col("o_orderkey").cast("string").alias("line")).repartition("month")
    for kind in ("csv", "text", "json"):
        rows.write.mode("overwrite").partitionBy("month").format(kind).save(f"{path}/{kind}")
    listed = files.list_supported_files(spark, path)
    return listed.select(F.regexp_extract("key", "/month=([0-9-]+)/", 1).alias("month"), "size", "format")


@query(f"SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in ORDER_COLUMNS)} FROM ({inputs.RAW_ORDERS})")
def csv_scan(spark, folder):
    return csv_source.read_csv(spark, landed_csv(spark, folder, "csv_scan")).frame


@query("SELECT text, lang, source FROM documents")
def csv_scan_quoted_breaks(spark, folder):
    path = work_folder(spark, "csv_scan_quoted_breaks")
    texts = table(spark, folder, "documents").select("text", "lang", "source")
    write_csv(texts.repartition(inputs.pieces(texts.count(), 4, inputs.TEXTS_PER_FILE)), path)
    return csv_source.read_csv(spark, path).frame


@query("SELECT count(*) AS row_count, count(*) FILTER (o_orderkey % 10 IN (3, 4)) AS malformed FROM orders")
def csv_malformed(spark, folder):
    path = work_folder(spark, "csv_malformed")
    key = F.col("o_orderkey").cast("string")
    extra = (
        F.when(F.col("o_orderkey") % 10 == 3, F.lit(",x")).when(F.col("o_orderkey") % 10 == 4, F.lit(","))
        .otherwise(F.lit(""))
    )
    line = F.when(F.col("o_orderkey") % 10 == 5, key).otherwise(F.concat(key, F.lit(","), F.col("o_orderstatus"), extra))
    lines = table(spark, folder, "orders").select(line.alias("a"))
    # The separator of this writer is no comma, so the commas of a line become cells when read.
    named = lines.withColumnRenamed("a", "key,status")
    named.repartition(inputs.pieces(named.count(), 3)).write.mode("overwrite").options(header=True, sep="\x01", quote="\x02").csv(path)
    return csv_source.malformed_rows(csv_source.read_csv(spark, path)).agg(
        F.sum("row_count").alias("row_count"), F.sum("malformed").alias("malformed")
    )


@query(f"SELECT row_number() OVER (ORDER BY row_ord) - 1 AS ord, name_text FROM ({inputs.RAW_ORDERS})")
def row_ordinals_file(spark, folder):
    read = csv_source.read_csv(spark, landed_csv(spark, folder, "row_ordinals_file"))
    return paging.with_ordinals(read.positioned).select("ord", "name_text")


# --- jobs -------------------------------------------------------------------

_SCHEMA_PART = ["column", "pos", "inferred_type", "storage_type", "display_type", "nullable", "confidence", "warnings",
                "null_token_count", "sample_values"]
_SCHEMA_SQL = ", ".join(f'"{c}"' for c in _SCHEMA_PART)


def _schema_part(schema: DataFrame) -> DataFrame:
    return joined(schema, "warnings", "sample_values").select(*_SCHEMA_PART)


@query(f"WITH {_INFERRED}, {oracle.overridden(GOOD_OVERRIDES)} SELECT {_SCHEMA_SQL} FROM effective")
def process(spark, folder):
    result = jobs.process_table(raw_orders(spark, folder), GOOD_OVERRIDES, order_by=KEY, columns=ORDER_COLUMNS, **DATES)
    return _schema_part(result.schema)


@query(f"WITH {_INFERRED} SELECT {_SCHEMA_SQL} FROM inferred")
def process_csv(spark, folder):
    return _schema_part(jobs.process_csv(spark, landed_csv(spark, folder, "process_csv"), **DATES).schema)


@query(
    "SELECT object_key, status, row_count FROM (SELECT 'orders' AS object_key, 'completed' AS status, count(*) AS row_count "
    "FROM orders UNION ALL SELECT 'events', 'completed', count(*) FROM events "
    "UNION ALL SELECT 'broken', 'failed', CAST(0 AS BIGINT))"
)
def run_log_append(spark, folder):
    log = work_folder(spark, "run_log_append")
    rows = [
        jobs.process_table(raw_orders(spark, folder), order_by=KEY, columns=ORDER_COLUMNS, object_key="orders", **DATES).run_row(),
        jobs.process_table(raw_events(spark, folder), order_by=KEY, columns=EVENT_COLUMNS, object_key="events", **DATES).run_row(),
        runs.run_row(object_key="broken", status="failed"),
    ]
    batch = rows[0]["run_id"]
    runs.append_runs(spark, f"{log}/{batch}", rows)
    return runs.read_runs(spark, f"{log}/{batch}").select("object_key", "status", "row_count")


@query("SELECT 'events' AS object_key, 'completed' AS status, count(*) AS row_count FROM events")
def run_log_latest(spark, folder):
    log = work_folder(spark, "run_log_latest")
    first = jobs.process_table(raw_orders(spark, folder), order_by=KEY, columns=ORDER_COLUMNS, object_key="orders", **DATES).run_row()
    second = jobs.process_table(raw_events(spark, folder), order_by=KEY, columns=EVENT_COLUMNS, object_key="events", **DATES).run_row()
    path = f"{log}/{first['run_id']}"
    runs.append_runs(spark, path, [first])
    runs.append_runs(spark, path, [second])
    runs.append_runs(spark, path, [runs.run_row(object_key="broken", status="failed")])
    return runs.search_runs(spark, path, status="completed").limit(1).select("object_key", "status", "row_count")


@query(
    f"WITH {oracle.rendered_orders()} SELECT * EXCLUDE (row_ord) FROM shown ORDER BY row_ord LIMIT 100 OFFSET 200"
)
def preview_from_run(spark, folder):
    path = landed_csv(spark, folder, "preview_from_run")
    run = jobs.process_csv(spark, path, **DATES).run_row()
    log = f"{work_folder(spark, 'preview_from_run_log')}/{run['run_id']}"
    runs.append_runs(spark, log, [run])
    return jobs.preview_run(spark, log, run["run_id"], 3, 100, **DATES)[1]


@query(
    "SELECT \"column\", inferred_type, count(*) AS row_count FROM (" + " UNION ALL ".join(
        f"SELECT {oracle.text(c)} AS \"column\", {oracle.text(t)} AS inferred_type FROM orders"
        for c, t in ORDER_TYPES.items()
    ) + ") GROUP BY ALL"
)
def process_prefix(spark, folder):
    path = landed_csv(spark, folder, "process_prefix")
    found = jobs.process_prefix(spark, path, **DATES)
    return found.groupBy("column", "inferred_type").agg(F.sum("row_count").alias("row_count"))


@query(f"WITH {_PROFILED} SELECT * FROM profile")
def incremental_profile(spark, folder):
    files_path = work_folder(spark, "incremental_files")
    frame = _ranges(spark, folder).drop(KEY)
    frame.write.mode("overwrite").parquet(files_path)
    state = f"{work_folder(spark, 'incremental_state')}/{runs.run_row(object_key='state')['run_id']}"
    started = start_profile(spark, files_path, frame.schema, state, files_per_batch=3, **DATES)
    started.awaitTermination()
    return joined(current_profile(spark, state, frame.columns), "sample_values")
