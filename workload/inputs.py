"""Input tables of the queries: text tables derived from whole driver tables.

The SQL uses only functions that Spark and DuckDB share, so both sides derive the
same cells.  ``row_ord`` is the unique row key and no profiled column.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

PIVOT_YEAR = 2024
REFERENCE_DATE = date(2024, 1, 1)
ROWS_PER_FILE, TEXTS_PER_FILE = 1_000_000, 50_000  # about 150 MB of CSV each
DATES = {"pivot_year": PIVOT_YEAR, "reference_date": REFERENCE_DATE}


def _s(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


def _two(expression: str) -> str:
    return f"lpad({_s(expression)}, 2, '0')"


_ORDER_DAY = f"concat({_s('year(o_orderdate)')}, '-', {_two('month(o_orderdate)')}, '-', {_two('day(o_orderdate)')}"

RAW_ORDERS = f"""
SELECT
  o_orderkey AS row_ord,
  {_s('o_orderkey')} AS id_text,
  CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 13 = 0 THEN '  '
       ELSE concat(' ', {_s('o_custkey')}, ' ') END AS cust_text,
  CASE WHEN o_orderkey % 17 = 0 THEN 'Not Available'
       WHEN floor(o_totalprice) >= 1000 THEN concat(CAST(CAST(floor(floor(o_totalprice) / 1000) AS BIGINT) AS STRING),
            ',', lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'), '.5')
       ELSE concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.25') END AS price_text,
  CASE WHEN o_orderkey % 19 = 0 THEN 'none' WHEN o_orderkey % 3 = 0 THEN 'Yes'
       WHEN o_orderkey % 3 = 1 THEN 'no' ELSE 'T' END AS flag_text,
  {_s('o_orderkey % 2')} AS zero_one,
  {_ORDER_DAY}) AS iso_date,
  {_ORDER_DAY}, ' ', {_two('o_orderkey % 24')}, ':05:00') AS iso_ts,
  concat({_s('month(o_orderdate)')}, '/', {_s('day(o_orderdate)')}, '/', {_s('year(o_orderdate)')}) AS us_date,
  concat({_s('month(o_orderdate)')}, '/', {_two('month(o_orderdate)')}, '/', {_s('year(o_orderdate)')}) AS same_date,
  concat({_s('o_custkey % 7')}, '+', {_s('o_orderkey % 5')}, 'j') AS cplx_text,
  o_orderstatus AS status,
  o_orderpriority AS priority,
  concat('Order#', {_s('o_orderkey')}) AS name_text,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'NULL' END AS empty_text,
  CASE WHEN o_orderkey % 5 = 0 THEN 'two' ELSE {_s('o_custkey')} END AS mixed
FROM orders
"""
ORDER_COLUMNS = [
    "id_text", "cust_text", "price_text", "flag_text", "zero_one", "iso_date", "iso_ts", "us_date", "same_date",
    "cplx_text", "status", "priority", "name_text", "empty_text", "mixed",
]
ORDER_TYPES = {
    "id_text": "integer", "cust_text": "integer", "price_text": "float", "flag_text": "boolean",
    "zero_one": "integer", "iso_date": "date", "iso_ts": "datetime", "us_date": "text", "same_date": "date",
    "cplx_text": "complex", "status": "category", "priority": "category", "name_text": "text", "empty_text": "text",
    "mixed": "text",
}

_K, _U = "event_id", "user_id"
_Y, _M, _D = "1980 + event_id % 60", "event_id % 14", "event_id % 33"
_H, _MI, _SE = "event_id % 26", "event_id % 61", "user_id % 62"

# Every shape of the value rules, valid and invalid, in changing combinations.
RAW_EVENTS = f"""
SELECT
  event_id AS row_ord,
  CASE event_id % 16
    WHEN 0 THEN concat({_s(_K)}, 'e', {_s('user_id % 4')})
    WHEN 1 THEN concat('-', {_s(_K)}, '.50')
    WHEN 2 THEN concat({_s('event_id % 9 + 1')}, '_', lpad({_s('user_id % 1000')}, 3, '0'))
    WHEN 3 THEN concat('.', {_s('user_id % 10')})
    WHEN 4 THEN concat({_s(_K)}, '.')
    WHEN 5 THEN concat('+', {_s(_K)}, '00e-2')
    WHEN 6 THEN concat('0x', {_s(_K)})
    WHEN 7 THEN concat({_s(_K)}, 'd')
    WHEN 8 THEN 'Infinity'
    WHEN 9 THEN concat({_s('event_id % 900 + 100')}, ',', lpad({_s('user_id % 1000')}, 3, '0'), '.000')
    WHEN 10 THEN concat('-nan', {_s('user_id % 3')})
    WHEN 11 THEN concat({_s('event_id % 90 + 10')}, ',', {_s('user_id % 90 + 10')})
    WHEN 12 THEN concat({_s(_K)}, 'E+', {_s('user_id % 30')})
    WHEN 13 THEN concat({_s(_K)}, '.', {_s('user_id % 100')}, 'e1')
    WHEN 14 THEN concat('9223372036854775', {_s('event_id % 1000')})
    ELSE {_s(_K)} END AS num_text,
  CASE event_id % 17
    WHEN 0 THEN concat({_s(_Y)}, '-', {_s(_M)}, '-', {_s(_D)})
    WHEN 1 THEN concat({_s(_M)}, '/', {_s(_D)}, '/', {_s(_Y)})
    WHEN 2 THEN concat({_s(_D)}, '-', {_s(_M)}, '-', {_s(_Y)})
    WHEN 3 THEN concat({_s(_M)}, '/', {_s(_D)}, '/', {_two('event_id % 100')})
    WHEN 4 THEN concat('Jan ', {_s(_D)}, ', ', {_s(_Y)})
    WHEN 5 THEN concat('Monday, sept ', {_s(_D)}, ' ', {_s(_Y)})
    WHEN 6 THEN concat('Foo ', {_s(_D)}, ' ', {_s(_Y)})
    WHEN 7 THEN concat({_s(_Y)}, '/', {_s(_M)}, '/', {_s(_D)}, ' ', {_s(_H)}, ':', {_two(_MI)})
    WHEN 8 THEN concat({_s(_Y)}, '-', {_two(_M)}, '-', {_two(_D)}, 'T', {_two(_H)}, ':', {_two(_MI)}, ':', {_two(_SE)}, 'Z')
    WHEN 9 THEN concat({_s(_M)}, '/', {_s(_D)}, '/', {_s(_Y)}, ' ', {_s('event_id % 14')}, ':', {_two(_MI)}, ' PM')
    WHEN 10 THEN concat({_s(_Y)}, '-03-04 10:00:00.', {_s('user_id % 1000')}, '+05:30')
    WHEN 11 THEN concat({_s(_H)}, ':', {_two(_MI)})
    WHEN 12 THEN concat({_s(_Y)}, '-03-04 10:00 -', {_two('event_id % 26')}, '00')
    WHEN 13 THEN concat({_s('1600 + event_id % 800')}, '-05-06')
    WHEN 14 THEN concat({_s(_Y)}, '0102')
    WHEN 15 THEN concat('call at ', {_s(_H)}, ':', {_two(_MI)})
    ELSE concat('DEC ', {_s(_D)}, ', ', {_s(_Y)}, ' ', {_s('event_id % 13')}, ':', {_two(_MI)}, ' am') END AS stamp_text,
  CASE event_id % 10
    WHEN 0 THEN concat({_s('event_id % 50')}, '+', {_s('user_id % 9')}, 'j')
    WHEN 1 THEN concat('(', {_s('event_id % 50')}, '.5-', {_s('user_id % 9')}, 'J)')
    WHEN 2 THEN 'j'
    WHEN 3 THEN concat('-', {_s('user_id % 9')}, 'j')
    WHEN 4 THEN concat({_s('event_id % 50')}, ' + ', {_s('user_id % 9')}, 'j')
    WHEN 5 THEN concat({_s('user_id % 9')}, 'j+2')
    WHEN 6 THEN concat('( ', {_s('user_id % 9 + 1')}, 'e2+j )')
    WHEN 7 THEN concat('(', {_s('event_id % 50')}, '+1j')
    WHEN 8 THEN concat('1_', {_s('event_id % 10')}, '-2.25j')
    ELSE {_s(_K)} END AS cplx_text,
  CASE event_id % 12
    WHEN 0 THEN 'TRUE' WHEN 1 THEN ' f' WHEN 2 THEN '0' WHEN 3 THEN '1' WHEN 4 THEN 'Yes ' WHEN 5 THEN 'nO'
    WHEN 6 THEN 'on' WHEN 7 THEN '2' WHEN 8 THEN '　t\u001c' WHEN 9 THEN 'none' WHEN 10 THEN 'y'
    ELSE 'falsey' END AS bool_text,
  CASE event_id % 9
    WHEN 0 THEN concat(' ', event_type, ' ') WHEN 1 THEN 'NaN' WHEN 2 THEN ' n/A ' WHEN 3 THEN 'n.a.'
    WHEN 4 THEN '-' WHEN 5 THEN ' ' WHEN 6 THEN 'not available' WHEN 7 THEN concat('​', event_type)
    ELSE event_type END AS blank_text,
  CASE WHEN event_id % 97 = 0 THEN 'late' ELSE NULL END AS sparse_text,
  props AS props_text
FROM events
""".replace("\\u001c", "\x1c").replace("\\u2003", " ")
EVENT_COLUMNS = ["num_text", "stamp_text", "cplx_text", "bool_text", "blank_text", "sparse_text", "props_text"]

LINEITEM_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
]

# File names with all kinds of suffixes, one per page.
NAMES = f"""
SELECT page_id, concat('dir.csv/', {_s('page_id')}, CASE page_id % 8 WHEN 0 THEN '.csv' WHEN 1 THEN '.CSV'
  WHEN 2 THEN '.xls' WHEN 3 THEN '.XlsX' WHEN 4 THEN '.txt' WHEN 5 THEN '' WHEN 6 THEN '.csv.gz' ELSE '.v2.csv' END) AS name
FROM pages
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def derive(spark: SparkSession, folder: str, sql: str, source: str) -> DataFrame:
    """Run the shared SQL over one driver table."""
    return spark.sql(sql.replace(f"FROM {source}", "FROM {source}"), source=table(spark, folder, source))


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, RAW_ORDERS, "orders")


def pieces(rows: int, least: int, per_file: int = ROWS_PER_FILE) -> int:
    """Into how many files a table is written: at least ``least``, more as it grows."""
    return max(least, -(-rows // per_file))


def raw_orders_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """raw_orders in row order over several partitions: the table is dealt by its key before the texts are made, as it is narrower."""
    orders = table(spark, folder, "orders")
    dealt = orders.repartitionByRange(pieces(orders.count(), 8), "o_orderkey").sortWithinPartitions("o_orderkey")
    return spark.sql(RAW_ORDERS.replace("FROM orders", "FROM {orders}"), orders=dealt)


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return derive(spark, folder, RAW_EVENTS, "events")
