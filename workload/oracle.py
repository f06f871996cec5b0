"""DuckDB twins of the queries, built from SQL fragments.

The value rules are stated a second time in DuckDB's own functions; only the
input tables and the date pattern are shared.
"""

from __future__ import annotations

from castwright import fixed
from castwright.functions import dates
from workload import inputs

_SPACE = " || ".join(f"chr({ord(c)})" for c in fixed.WHITESPACE)


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def normalized(raw: str) -> str:
    stripped = f"trim({raw}, {_SPACE})"
    return f"CASE WHEN lower({stripped}) IN {in_list(fixed.NULL_TOKENS)} THEN NULL ELSE {stripped} END"


def boolean(v: str) -> str:
    return (
        f"CASE WHEN lower({v}) IN {in_list(fixed.TRUE_TOKENS)} THEN true "
        f"WHEN lower({v}) IN {in_list(fixed.FALSE_TOKENS)} THEN false END"
    )


# --- numbers ----------------------------------------------------------------

_NUMBER = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?0*[0-9]{1,18})?$'"
_GROUPED = r"'^[+-]?\d{1,3}(,\d{3})+(\.\d+)?([eE][+-]?\d+)?$'"


def parsed_numbers(source: str, v: str = "v", name: str = "nums") -> str:
    """CTEs that add is_finite, is_number, is_whole, as_bigint and as_double to ``source``."""
    return rf"""
{name}_a AS (SELECT *, replace(CASE WHEN regexp_matches({v}, {_GROUPED}) THEN replace({v}, ',', '') ELSE {v} END, '_', '') AS c
  FROM {source}),
{name}_b AS (SELECT *, regexp_matches(c, {_NUMBER}) AS is_finite,
  regexp_matches(c, '^[+-]?(?i:inf|infinity)$') AS is_infinite,
  regexp_matches(c, '^[+-]?(?i:nan)[0-9]*$') AS is_nan,
  regexp_extract(c, '^[+-]?([0-9]*)', 1) || regexp_extract(c, '\.([0-9]*)', 1) AS digits,
  length(regexp_extract(c, '\.([0-9]*)', 1))
    - coalesce(try_cast(replace(regexp_extract(c, '[eE]([+-]?[0-9]+)$', 1), '+', '') AS BIGINT), 0) AS places
  FROM {name}_a),
{name}_c AS (SELECT *, is_finite OR is_infinite OR is_nan AS is_number,
  is_finite AND (rtrim(digits, '0') = '' OR places <= length(digits) - length(rtrim(digits, '0'))) AS is_whole
  FROM {name}_b),
{name} AS (SELECT * EXCLUDE (c, digits, places),
  CASE WHEN is_whole AND ltrim(digits, '0') = '' THEN 0
       WHEN is_whole THEN try_cast(CASE WHEN c LIKE '-%' THEN '-' ELSE '' END ||
         CASE WHEN places <= 0 THEN ltrim(digits, '0') || repeat('0', CAST(least(-places, 25) AS INTEGER))
              ELSE left(digits, CAST(length(digits) - places AS INTEGER)) END AS BIGINT) END AS as_bigint,
  CASE WHEN is_finite THEN try_cast(c AS DOUBLE)
       WHEN is_infinite THEN CASE WHEN c LIKE '-%' THEN CAST('-inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END END AS as_double
  FROM {name}_c)"""


# --- dates ------------------------------------------------------------------

_GROUPS = "['iy','im','id','na','nb','ny','name','nd','yy','gap','h','mi','s','f','half','utc','sg','zh','zm']"


def parsed_dates(source: str, v: str = "v", name: str = "stamps", dayfirst: bool = False) -> str:
    """CTEs that add stamp, is_ambiguous, is_timed and has_offset to ``source``."""
    swap = "TRY_CAST(g.nb AS INTEGER) <= 12" if dayfirst else "TRY_CAST(g.na AS INTEGER) > 12"
    return rf"""
{name}_a AS (SELECT *, CASE WHEN regexp_matches({v}, {text(dates.SHAPE)})
  THEN regexp_extract({v}, {text(dates.SHAPE)}, {_GROUPS}) END AS g FROM {source}),
{name}_b AS (SELECT *, g.iy || g.ny || g.yy AS y, coalesce({swap}, false) AS swapped FROM {name}_a),
{name}_c AS (SELECT *,
  CASE WHEN length(y) = 2 THEN TRY_CAST(y AS INTEGER) + 100 * (({inputs.PIVOT_YEAR} + 49 - TRY_CAST(y AS INTEGER)) // 100)
       WHEN y <> '' THEN TRY_CAST(y AS INTEGER) ELSE {inputs.REFERENCE_DATE.year} END AS yr,
  CASE WHEN y = '' THEN {inputs.REFERENCE_DATE.month}
       WHEN g.name <> '' THEN (strpos({text(dates.MONTH_KEYS)}, lower(left(g.name, 3))) + 2) // 3
       ELSE TRY_CAST(CASE WHEN g.iy <> '' THEN g.im WHEN swapped THEN g.nb ELSE g.na END AS INTEGER) END AS mo,
  CASE WHEN y = '' THEN {inputs.REFERENCE_DATE.day} ELSE TRY_CAST(CASE WHEN g.iy <> '' THEN g.id WHEN g.name <> '' THEN g.nd
       WHEN swapped THEN g.na ELSE g.nb END AS INTEGER) END AS da,
  CASE WHEN g.h = '' THEN 0 WHEN g.half = '' THEN TRY_CAST(g.h AS INTEGER)
       WHEN TRY_CAST(g.h AS INTEGER) > 12 THEN 99
       ELSE TRY_CAST(g.h AS INTEGER) % 12 + CASE WHEN lower(g.half) = 'p' THEN 12 ELSE 0 END END AS ho,
  CASE WHEN g.h = '' THEN 0 ELSE TRY_CAST(g.mi AS INTEGER) END AS mn,
  CASE WHEN g.h = '' OR g.s = '' THEN 0 ELSE TRY_CAST(g.s AS INTEGER) END AS se,
  CASE WHEN g.h = '' THEN 0 ELSE TRY_CAST(rpad(left(g.f, 6), 6, '0') AS INTEGER) END AS us,
  CASE WHEN g.zh = '' THEN 0 ELSE (TRY_CAST(g.zh AS INTEGER) * 60 + CASE WHEN g.zm = '' THEN 0 ELSE TRY_CAST(g.zm AS INTEGER) END)
       * CASE WHEN g.sg = '-' THEN -1 ELSE 1 END END AS east,
  CASE WHEN y = '' THEN g.h <> '' AND g.gap = '' ELSE (g.h = '') = (g.gap = '') END AS well_formed
  FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN well_formed AND ho <= 23 AND mn <= 59 AND se <= 59 AND abs(east) < 1440
    AND mo BETWEEN 1 AND 12 AND da BETWEEN 1 AND 31 AND yr >= 1
    AND da <= day(last_day(TRY(make_date(yr, mo, 1))))
  THEN TRY(make_timestamp(yr, mo, da, ho, mn, CAST(se AS DOUBLE))) + to_microseconds(us) - to_minutes(east) END AS t FROM {name}_c),
{name} AS (SELECT * EXCLUDE (g, y, swapped, yr, mo, da, ho, mn, se, us, east, well_formed, t),
  CASE WHEN t BETWEEN TIMESTAMP '{fixed.FIRST_INSTANT}' AND TIMESTAMP '{fixed.LAST_INSTANT}' THEN t END AS stamp,
  coalesce(t IS NOT NULL AND g.na <> '' AND TRY_CAST(g.na AS INTEGER) <= 12 AND TRY_CAST(g.nb AS INTEGER) <= 12
    AND TRY_CAST(g.na AS INTEGER) <> TRY_CAST(g.nb AS INTEGER), false) AS is_ambiguous,
  coalesce(t IS NOT NULL AND regexp_matches({v}, {text(fixed.TIME_HINT)}), false) AS is_timed,
  coalesce(t IS NOT NULL AND g.utc || g.sg <> '', false) AS has_offset
  FROM {name}_d)"""


# --- complex numbers --------------------------------------------------------

_REAL = r"(?:(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|(?i:infinity|inf|nan))"


def parsed_complex(source: str, v: str = "v", name: str = "cplx") -> str:
    """CTEs that add is_complex, re and im to ``source``."""
    number = lambda part: (
        f"CASE WHEN {part} IN ('', '+') THEN 1.0 WHEN {part} = '-' THEN -1.0 "
        f"ELSE try_cast(replace({part}, '_', '') AS DOUBLE) END"
    )
    return rf"""
{name}_a AS (SELECT *, CASE WHEN {v} LIKE '(%)' THEN trim(substr({v}, 2, length({v}) - 2)) ELSE {v} END AS body FROM {source}),
{name}_b AS (SELECT *, regexp_extract(body, '^([+-]?{_REAL})([+-]{_REAL}?)[jJ]$', ['re', 'im']) AS pair,
  regexp_matches(body, '^([+-]?{_REAL})([+-]{_REAL}?)[jJ]$') AS is_pair,
  regexp_extract(body, '^([+-]?{_REAL}?)[jJ]$', 1) AS lone, regexp_matches(body, '^([+-]?{_REAL}?)[jJ]$') AS is_lone
  FROM {name}_a),
{name} AS (SELECT * EXCLUDE (body, pair, is_pair, lone, is_lone), coalesce(is_pair OR is_lone, false) AS is_complex,
  CASE WHEN is_pair THEN {number('pair.re')} WHEN is_lone THEN 0.0 END AS re,
  CASE WHEN is_pair THEN {number('pair.im')} WHEN is_lone THEN {number('lone')} END AS im
  FROM {name}_b)"""


# --- profile and schema -----------------------------------------------------


def cells(source_sql: str, columns: list[str], order: str = "row_ord") -> str:
    """CTEs src, cells and vals: one row per cell, then one per distinct normalized value."""
    parts = [
        f"SELECT {text(c)} AS \"column\", {i} AS pos, {order} AS ord, CAST({c} AS VARCHAR) AS raw FROM src"
        for i, c in enumerate(columns)
    ]
    return f"""
src AS ({source_sql}),
cells AS ({' UNION ALL '.join(parts)}),
vals AS (SELECT "column", pos, {normalized('raw')} AS v, count(*) AS n, min(ord) AS first FROM cells GROUP BY ALL)"""


def profiled(source_sql: str, columns: list[str], order: str = "row_ord") -> str:
    """CTEs ending in ``profile``; samples are joined with a bar."""
    return f"""{cells(source_sql, columns, order)},
{parsed_numbers('vals')},
{parsed_dates('nums')},
{parsed_complex('stamps')},
ranked AS (SELECT *, {boolean('v')} AS b,
  row_number() OVER (PARTITION BY pos ORDER BY v IS NULL, first, v) AS rk FROM cplx),
profile AS (SELECT "column", pos, CAST(sum(n) AS BIGINT) AS total_count,
  CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS non_null_count,
  CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS null_token_count,
  coalesce(bool_and(is_whole) FILTER (v IS NOT NULL), true) AS integer_valid,
  coalesce(bool_and(is_number) FILTER (v IS NOT NULL), true) AS float_valid,
  coalesce(bool_and(b IS NOT NULL) FILTER (v IS NOT NULL), true) AS boolean_valid,
  coalesce(bool_or(b IS NOT NULL AND NOT regexp_matches(v, '^[0-9]+$')), false) AS boolean_has_alpha_tokens,
  coalesce(bool_and(stamp IS NOT NULL) FILTER (v IS NOT NULL), true) AS datetime_valid,
  coalesce(bool_or(stamp IS NOT NULL AND is_ambiguous), false) AS ambiguous_datetime,
  coalesce(bool_or(stamp IS NOT NULL AND is_timed), false) AS has_time_component,
  coalesce(bool_or(stamp IS NOT NULL AND has_offset), false) AS has_utc_offset,
  coalesce(bool_and(is_complex) FILTER (v IS NOT NULL), true) AS complex_valid,
  CAST(least(count(v), {fixed.UNIQUE_CAP}) AS INTEGER) AS unique_count,
  coalesce(string_agg(v, '|' ORDER BY rk) FILTER (rk <= {fixed.SAMPLE_SIZE} AND v IS NOT NULL), '') AS sample_values
  FROM ranked GROUP BY "column", pos)"""


def _qualifies(rule: dict) -> str:
    return (
        f"(non_null_count >= {rule['min_rows']} AND unique_count <= {rule['max_unique']} "
        f"AND unique_count::DOUBLE / non_null_count <= {rule['max_ratio']})"
    )


LARGE = _qualifies(fixed.CATEGORY_LARGE)
SMALL = _qualifies(fixed.CATEGORY_SMALL)


def named(names: dict[str, str], kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in names.items()) + " END"


def inferred(source_sql: str, columns: list[str], order: str = "row_ord") -> str:
    """CTEs ending in ``inferred``; warnings and samples are joined with a bar."""
    return f"""{profiled(source_sql, columns, order)},
laddered AS (SELECT *, CASE WHEN non_null_count = 0 THEN 1 WHEN boolean_valid AND boolean_has_alpha_tokens THEN 2
  WHEN integer_valid THEN 3 WHEN float_valid THEN 4 WHEN datetime_valid AND NOT ambiguous_datetime THEN 5
  WHEN datetime_valid THEN 6 WHEN complex_valid THEN 7 WHEN {LARGE} THEN 8 WHEN {SMALL} THEN 9 ELSE 10 END AS step
  FROM profile),
typed AS (SELECT *, CASE step WHEN 2 THEN 'boolean' WHEN 3 THEN 'integer' WHEN 4 THEN 'float'
  WHEN 5 THEN CASE WHEN has_time_component THEN 'datetime' ELSE 'date' END WHEN 7 THEN 'complex'
  WHEN 8 THEN 'category' WHEN 9 THEN 'category' ELSE 'text' END AS inferred_type,
  CAST(CASE step WHEN 1 THEN 0.1 WHEN 2 THEN 0.96 WHEN 3 THEN 0.98 WHEN 4 THEN 0.97 WHEN 5 THEN 0.92 WHEN 6 THEN 0.3
  WHEN 7 THEN 0.8 WHEN 8 THEN 0.76 WHEN 9 THEN 0.64 ELSE 0.45 END AS DOUBLE) AS confidence,
  CASE step WHEN 1 THEN {text(fixed.WARN_EMPTY)} WHEN 6 THEN {text(fixed.WARN_AMBIGUOUS)} ELSE '' END AS warnings
  FROM laddered),
inferred AS (SELECT "column", pos, inferred_type, {named(fixed.STORAGE_NAMES, 'inferred_type')} AS storage_type,
  {named(fixed.DISPLAY_NAMES, 'inferred_type')} AS display_type, null_token_count > 0 AS nullable, confidence, warnings,
  null_token_count, sample_values, {text('|'.join(fixed.LOGICAL_TYPES))} AS allowed_overrides, has_utc_offset FROM typed)"""


CAN_CONVERT = (
    "CASE WHEN target_type IN ('text', 'category') THEN true WHEN target_type = 'integer' THEN integer_valid "
    "WHEN target_type = 'float' THEN float_valid OR integer_valid WHEN target_type = 'boolean' THEN boolean_valid "
    "WHEN target_type IN ('date', 'datetime') THEN datetime_valid WHEN target_type = 'complex' THEN complex_valid "
    "ELSE false END"
)


def override_rows(overrides: dict[str, str]) -> str:
    rows = ", ".join(f"({i}, {text(c)}, {text(t)})" for i, (c, t) in enumerate(overrides.items()))
    return f"wanted AS (SELECT * FROM (VALUES {rows}) AS w(position, \"column\", target_type))"


def checked_overrides(overrides: dict[str, str]) -> str:
    """CTEs ``wanted`` and ``checked``; ``profile`` must come before."""
    return f"""{override_rows(overrides)},
checked AS (SELECT w.position, w."column", w.target_type,
  CASE WHEN p."column" IS NULL THEN 'Column ''' || w."column" || ''' does not exist in the dataset.'
       WHEN target_type NOT IN {in_list(fixed.LOGICAL_TYPES)} THEN 'Unsupported override type ''' || target_type || '''.'
       WHEN NOT ({CAN_CONVERT}) THEN 'Column ''' || w."column" || ''' cannot be safely converted to ''' || target_type || '''.'
  END AS error FROM wanted w LEFT JOIN profile p ON w."column" = p."column")"""


def overridden(overrides: dict[str, str]) -> str:
    """CTE ``effective``: ``inferred`` with the accepted overrides."""
    return f"""{checked_overrides(overrides)},
effective AS (SELECT i."column", i.pos, coalesce(c.target_type, i.inferred_type) AS inferred_type,
  coalesce({named(fixed.STORAGE_NAMES, 'c.target_type')}, i.storage_type) AS storage_type,
  coalesce({named(fixed.DISPLAY_NAMES, 'c.target_type')}, i.display_type) AS display_type, i.nullable, i.confidence,
  CASE WHEN c.target_type IN ('date', 'datetime') AND p.ambiguous_datetime THEN {text(fixed.WARN_FORCED)}
       ELSE i.warnings END AS warnings, i.null_token_count, i.sample_values, i.allowed_overrides, i.has_utc_offset
  FROM inferred i JOIN profile p ON i."column" = p."column"
  LEFT JOIN checked c ON c."column" = i."column" AND c.error IS NULL)"""


# --- conversion and rendering -----------------------------------------------


def iso(stamp: str) -> str:
    return (
        f"strftime({stamp}, '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN extract('microseconds' FROM {stamp}) % 1000000 = 0 THEN '' ELSE strftime({stamp}, '.%f') END"
    )


def one_column(source_sql: str, column: str, order: str = "row_ord") -> str:
    """CTE ``one``: row key and normalized text of a column."""
    return f"one AS (SELECT {order} AS row_ord, {normalized(column)} AS v FROM ({source_sql}))"


def converted_orders() -> str:
    """CTE ``conv``: raw_orders converted by its inferred types."""
    numeric = [c for c, t in inputs.ORDER_TYPES.items() if t in ("integer", "float")]
    dated = [c for c, t in inputs.ORDER_TYPES.items() if t in ("date", "datetime")]
    ctes = ["n0 AS (SELECT row_ord, " + ", ".join(
        f"{normalized(c)} AS {c}" for c in inputs.ORDER_COLUMNS) + f" FROM ({inputs.RAW_ORDERS}))"]
    previous = "n0"
    for i, c in enumerate(numeric):
        ctes.append(parsed_numbers(previous, c, f"num{i}"))
        ctes.append(
            f"keepn{i} AS (SELECT * EXCLUDE (is_finite, is_infinite, is_nan, is_number, is_whole, as_bigint, as_double), "
            f"{'as_bigint' if inputs.ORDER_TYPES[c] == 'integer' else 'as_double'} AS {c}_out FROM num{i})"
        )
        previous = f"keepn{i}"
    for i, c in enumerate(dated):
        ctes.append(parsed_dates(previous, c, f"dat{i}"))
        out = "CAST(stamp AS DATE)" if inputs.ORDER_TYPES[c] == "date" else "stamp"
        ctes.append(
            f"keepd{i} AS (SELECT * EXCLUDE (stamp, is_ambiguous, is_timed, has_offset), {out} AS {c}_out FROM dat{i})"
        )
        previous = f"keepd{i}"
    ctes.append(parsed_complex(previous, "cplx_text", "z"))
    outputs = []
    for c, t in inputs.ORDER_TYPES.items():
        if t in ("integer", "float", "date", "datetime"):
            outputs.append(f"{c}_out AS {c}")
        elif t == "boolean":
            outputs.append(f"{boolean(c)} AS {c}")
        elif t == "complex":
            outputs += ["re AS cplx_re", "im AS cplx_im"]
        else:
            outputs.append(c)
    ctes.append(f"conv AS (SELECT row_ord, {', '.join(outputs)} FROM z)")
    return ",\n".join(ctes)


def rendered_orders() -> str:
    """CTE ``shown``: the rendered form of ``conv``."""
    outputs = []
    for c, t in inputs.ORDER_TYPES.items():
        if t == "date":
            outputs.append(f"strftime({c}, '%Y-%m-%d') AS {c}")
        elif t == "datetime":
            outputs.append(f"{iso(c)} AS {c}")
        elif t == "complex":
            # The cells are small whole numbers, the imaginary part is never negative.
            outputs.append(
                "CASE WHEN cplx_re = 0 THEN CAST(CAST(cplx_im AS BIGINT) AS VARCHAR) || 'j' ELSE '(' || "
                "CAST(CAST(cplx_re AS BIGINT) AS VARCHAR) || '+' || CAST(CAST(cplx_im AS BIGINT) AS VARCHAR) || 'j)' END AS cplx_text"
            )
        else:
            outputs.append(c)
    return f"{converted_orders()},\nshown AS (SELECT row_ord, {', '.join(outputs)} FROM conv)"
