"""Row ordinals and pages.

Dense ordinals never need a global sort into one task.  A file scan is numbered by
block: rows per block, a running sum over the blocks, and the offset of a row
within its block.  A table with an order key is cut into narrow key cells: rows per
cell from a scan of the key alone, a running sum, and a sort within each cell.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castwright import fixed
from castwright.local import quoted, refuse_clash
from castwright.operators import convert as conversion
from castwright.sources.scratch import work_folder
from castwright.operators.cells import BLK, ORDER_COLUMNS, SEQ, SRC, Ordered, with_row_order

ORD = "ord"
_HELPERS = ("cell", "__rank", "start", "seq0")
_FAR = 2**63 - 1  # stands for a key that is null
_QUANTILES = 64
_CELLS_PER_QUANTILE = 4096
_ROWS_PER_CELL = 1_000_000
# File blocks that may be broadcast: a path and three numbers each, some 50 MB at most.
_BROADCAST_BLOCKS = 300_000
# Up to here the keys of a page come from a bounded top-k: every task keeps at most this many keys, and no other cell.
_TOP_KEYS = 10_000
# An order index is refined until a page lies within about so many rows.
_ROWS_SORTED = 10_000


class PageError(ValueError):
    """The requested page lies outside the table."""


# --- page metadata ----------------------------------------------------------


def page_columns(total_rows: Column, page: int, page_size: int) -> list[Column]:
    """Page facts as column arithmetic over a row count."""
    total_pages = F.greatest(F.lit(1), F.ceil(total_rows / F.lit(page_size))).cast("bigint")
    outside = F.lit(page) > total_pages
    first = F.when(total_rows == 0, F.lit(0)).otherwise(F.lit((page - 1) * page_size + 1)).cast("bigint")
    return [
        F.lit(page).cast("bigint").alias("page"),
        F.lit(page_size).cast("bigint").alias("page_size"),
        total_rows.alias("total_rows"),
        total_pages.alias("total_pages"),
        F.lit(page > 1).alias("has_previous_page"),
        (F.lit(page) < total_pages).alias("has_next_page"),
        F.when(~outside, first).alias("first_row"),
        F.when(~outside, F.least(F.lit(page * page_size).cast("bigint"), total_rows)).alias("last_row"),
        F.when(outside, F.lit(fixed.ERR_PAGE_RANGE)).alias("error"),
    ]


def page_metadata(frame: DataFrame, page: int = 1, page_size: int = fixed.PAGE_SIZE_DEFAULT) -> DataFrame:
    """One row of page facts for a table; ``error`` is set when the page is outside."""
    counted = frame.agg(F.count(F.lit(1)).alias("total"))
    return counted.select(*page_columns(F.col("total"), page, page_size))


def check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= fixed.PAGE_SIZE_MAX:
        raise ValueError(f"page must be at least 1 and page size between 1 and {fixed.PAGE_SIZE_MAX}.")


def page_info(row_count: int, page: int, page_size: int) -> dict:
    """Page facts of a known row count; raises when the page is outside."""
    total_pages = max(1, -(-row_count // page_size))
    if page > total_pages:
        raise PageError(fixed.ERR_PAGE_RANGE)
    return {
        "page": page,
        "pageSize": page_size,
        "totalRows": row_count,
        "totalPages": total_pages,
        "hasPreviousPage": page > 1,
        "hasNextPage": page < total_pages,
    }


# --- ordinals ---------------------------------------------------------------


def _block_offsets(ordered: Ordered) -> DataFrame:
    """First sequence number and first ordinal of every file block."""
    blocks = ordered.frame.groupBy(SRC, BLK).agg(F.count(F.lit(1)).alias("n"), F.min(SEQ).alias("seq0"))
    # Blocks are added up within their file, and files after that: one row per
    # file split, then one row per file, are the most a task sees.
    in_file = Window.partitionBy(SRC).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(in_file), F.lit(0)))
    per_file = blocks.groupBy(SRC).agg(F.sum("n").alias("file_rows"))
    over_files = Window.orderBy(SRC).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_file.select(SRC, F.coalesce(F.sum("file_rows").over(over_files), F.lit(0)).alias("file_start"))
    return blocks.join(starts, SRC).select(SRC, BLK, "n", "seq0", (F.col("file_start") + F.col("before")).alias("start"))


def _landed_offsets(ordered: Ordered) -> DataFrame:
    """Block offsets as a written table: counted once, and of known size.

    Broadcast only up to a checked number of blocks, joined by shuffle beyond it.
    """
    spark = ordered.frame.sparkSession
    path = f"{work_folder(spark, 'block_offsets')}/{uuid.uuid4().hex}"
    _block_offsets(ordered).select(SRC, BLK, "seq0", "start").write.parquet(path)
    offsets = spark.read.parquet(path)
    return F.broadcast(offsets) if offsets.count() <= _BROADCAST_BLOCKS else offsets


@dataclass
class _KeyCells:
    """Key ranges that hold about equally many rows, cut into narrow cells."""

    edges: list[int]
    cells: int

    def index(self, key: Column) -> Column:
        """Cell number of a key; grows with the key."""

        def locate(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                width = max(1, -(-(self.edges[hi] - self.edges[lo]) // self.cells))
                # As doubles, since far keys differ by more than a long; the number still grows with the key.
                inside = F.floor((key.cast("double") - F.lit(float(self.edges[lo]))) / F.lit(float(width)))
                return F.lit(lo * self.cells) + F.greatest(F.lit(0), F.least(inside, F.lit(self.cells - 1)))
            middle = (lo + hi) // 2
            return F.when(key < F.lit(self.edges[middle]), locate(lo, middle)).otherwise(locate(middle, hi))

        return locate(0, len(self.edges) - 1).cast("bigint")


def _key_cells(frame: DataFrame, rows_per_cell: int) -> _KeyCells | None:
    """One pass over the key column: quantiles as edges, and how finely to cut between them."""
    shares = [i / _QUANTILES for i in range(1, _QUANTILES)]
    facts = frame.agg(
        F.min(SEQ).alias("lo"), F.max(SEQ).alias("hi"), F.count(F.lit(1)).alias("n"),
        F.percentile_approx(SEQ, shares, 10_000).alias("quantiles"),
    ).first()
    if not facts["n"]:
        return None
    inner = facts["quantiles"] if facts["n"] > rows_per_cell else []
    edges = sorted({facts["lo"], *inner, facts["hi"] + 1})
    cells = min(_CELLS_PER_QUANTILE, max(1, facts["n"] // (rows_per_cell * _QUANTILES)))
    return _KeyCells(edges, cells)


def _cell_offsets(keys: DataFrame, cells: _KeyCells) -> DataFrame:
    """Rows and first ordinal of every cell: at most quantiles times cells rows."""
    counts = keys.groupBy(cells.index(F.col(SEQ)).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.min(SEQ).alias("lo"), F.max(SEQ).alias("hi")
    )
    running = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(running), F.lit(0)))


def with_ordinals(
    frame: DataFrame, order_by: str | Column | None = None, *, rows_per_cell: int = _ROWS_PER_CELL
) -> DataFrame:
    """Add ``ord``, the 0-based row number.

    ``order_by`` must be a unique integer, date or timestamp key; without it the
    table must be a file scan, which is numbered in file order.
    """
    ordered = with_row_order(frame, order_by)
    names = [c for c in frame.columns if c not in ORDER_COLUMNS]
    refuse_clash(names, ORD, *_HELPERS)
    if ordered.by_value:
        raise ValueError("Row ordinals need an order_by key or a file scan.")
    if ordered.block_keys:
        numbered = ordered.frame.join(_landed_offsets(ordered), [SRC, BLK])
        return numbered.select((F.col("start") + F.col(SEQ) - F.col("seq0")).alias(ORD), *map(quoted, names))
    cells = _key_cells(ordered.frame.select(SEQ), rows_per_cell)
    if cells is None:
        return ordered.frame.select(F.lit(0).cast("bigint").alias(ORD), *map(quoted, names))
    # At most 64 x 4096 cells of two numbers each: a few megabytes, whatever the data size.
    offsets = F.broadcast(_cell_offsets(ordered.frame.select(SEQ), cells).select("cell", "start"))
    in_cell = F.row_number().over(Window.partitionBy("cell").orderBy(SEQ))
    ranked = ordered.frame.withColumn("cell", cells.index(F.col(SEQ))).withColumn("__rank", in_cell)
    return ranked.join(offsets, "cell").select((F.col("start") + F.col("__rank") - 1).alias(ORD), *map(quoted, names))


# --- pages ------------------------------------------------------------------


@dataclass
class OrderIndex:
    """A sparse index of a table's order: pieces of it with their least and largest key, first ordinal and rows.

    The pieces are cut at quantiles, so they are alike in size however clumped the keys are. There are at most `_QUANTILES`; the one a
    page lies in is cut again, until it is small. Pages of one table may share the index, which then grows with the pages seen.
    """

    ordered: Ordered
    pieces: list[tuple[int, int, int, int]]

    def around(self, lo: int, hi: int) -> tuple[int, int, int] | None:
        """Least and largest key of rows that hold the ordinals [lo, hi), and the ordinal of the first of them."""
        while True:
            touched = [p for p in self.pieces if p[2] < hi and p[2] + p[3] > lo]
            if not touched:
                return None
            big = [p for p in touched if p[3] > _ROWS_SORTED and p[0] < p[1]]
            if not big:
                return touched[0][0], touched[-1][1], touched[0][2]
            for piece in big:
                self.refine(piece)

    def refine(self, piece: tuple[int, int, int, int]) -> None:
        low, high, start, _ = piece
        finer = _cut(_between(self.ordered, low, high).select(SEQ), start)
        if len(finer) == 1:  # quantiles on one side: halve the range
            finer = _cut(_between(self.ordered, low, high).select(SEQ), start, [(low + high) // 2 + 1])
        self.pieces = sorted([p for p in self.pieces if p != piece] + finer)


def _cut(keys: DataFrame, start: int, edges: list[int] | None = None) -> list[tuple[int, int, int, int]]:
    """Pieces (least key, largest key, first ordinal, rows) of a column of keys: two scans of it, at most `_QUANTILES` rows."""
    if edges is None:
        shares = [i / _QUANTILES for i in range(1, _QUANTILES)]
        edges = keys.agg(F.percentile_approx(SEQ, shares, 10_000)).first()[0] or []
    cells = _KeyCells([-_FAR, *sorted(set(edges)), _FAR], 1)
    found = keys.groupBy(cells.index(F.col(SEQ)).alias("cell")).agg(F.min(SEQ), F.max(SEQ), F.count(F.lit(1))).orderBy("cell").collect()
    out = []
    for _, low, high, n in found:
        out.append((low, high, start, n))
        start += n
    return out


def order_index(frame: DataFrame, order_by: str | Column) -> OrderIndex:
    """Index a table by its key; reads the key column only."""
    ordered = with_row_order(frame, order_by)
    return OrderIndex(ordered, _cut(ordered.frame.select(SEQ), 0))


def _between(ordered: Ordered, low: int, high: int) -> DataFrame:
    """Rows with keys in a closed range; the scan of a file can skip row groups by it."""
    rows = ordered.frame
    if ordered.key_column:
        key, kind = F.col(quoted(ordered.key_column)), dict(frame_types(rows))[ordered.key_column]
        literal = {"date": lambda n: F.date_from_unix_date(F.lit(n)), "timestamp": lambda n: F.timestamp_micros(F.lit(n))}
        if kind in ("tinyint", "smallint", "int", "bigint"):
            literal[kind] = lambda n: F.lit(n).cast(kind)
        if kind in literal:  # rows without a key come last
            inside = (key >= literal[kind](low)) & (key <= literal[kind](high)) if high < _FAR else F.coalesce(key >= literal[kind](low), F.lit(True)) if low < _FAR else key.isNull()
            rows = rows.where(inside)
    return rows.where(F.col(SEQ).between(low, high))


def _rows_by_key(ordered: Ordered, lo: int, hi: int, index: OrderIndex | None) -> DataFrame:
    if index is None and hi <= _TOP_KEYS:
        keys = ordered.frame.select(SEQ).orderBy(SEQ).offset(lo).limit(hi - lo)
        facts = keys.agg(F.min(SEQ).alias("low"), F.max(SEQ).alias("high")).first()
        if facts["low"] is None:
            return ordered.frame.limit(0)
        rows = _between(ordered, facts["low"], facts["high"])
        return rows.orderBy(SEQ).limit(hi - lo)
    found = (index or OrderIndex(ordered, _cut(ordered.frame.select(SEQ), 0))).around(lo, hi)
    if found is None:
        return ordered.frame.limit(0)
    low, high, start = found
    return _between(ordered, low, high).orderBy(SEQ).offset(lo - start).limit(hi - lo)


def frame_types(frame: DataFrame) -> list[tuple[str, str]]:
    return [(field.name, field.dataType.simpleString()) for field in frame.schema.fields]


def _rows_by_block(ordered: Ordered, lo: int, hi: int) -> DataFrame:
    """Rows of a page in file order: the few files it touches, and the row numbers in each, are filters of the scan."""
    offsets = _block_offsets(ordered).where((F.col("start") < hi) & (F.col("start") + F.col("n") > lo))
    inside = F.lit(False)
    for piece in offsets.collect():  # each holds a row of the page, so there are 500 at most
        first, last = max(lo, piece["start"]) - piece["start"], min(hi, piece["start"] + piece["n"]) - piece["start"] - 1
        at = F.col(SEQ).between(piece["seq0"] + first, piece["seq0"] + last)
        inside |= (F.col(SRC) == piece[SRC]) & (F.col(BLK) == piece[BLK]) & at
    return ordered.frame.where(inside).orderBy(SRC, BLK, SEQ)


def raw_page(
    frame: DataFrame, page: int, page_size: int, order_by: str | Column | None = None, *, index: OrderIndex | None = None
) -> DataFrame:
    """The raw rows ``[(page-1)*size, page*size)`` in row order.

    Only their keys or row numbers are looked for first; the rows are then read by a range filter that the scan
    pushes down, and no more than about a page of them is sorted.
    """
    check_page(page, page_size)
    lo, hi = (page - 1) * page_size, page * page_size
    ordered = index.ordered if index else with_row_order(frame, order_by)
    if ordered.by_value:
        raise ValueError("Paging needs an order_by key or a file scan.")
    rows = _rows_by_block(ordered, lo, hi) if ordered.block_keys else _rows_by_key(ordered, lo, hi, index)
    return rows.select(*map(quoted, frame.columns))


def preview_page(
    frame: DataFrame, schema, page: int = 1, page_size: int = fixed.PAGE_SIZE_DEFAULT,
    order_by: str | Column | None = None, *, keep: list[str] | None = None, index: OrderIndex | None = None, **date_options,
) -> DataFrame:
    """One page, converted by a given schema and rendered; only its rows are converted."""
    rows = raw_page(frame, page, page_size, order_by, index=index)
    return conversion.render_rows(conversion.convert(rows, schema, keep=keep, ordered=True, **date_options), keep=keep)


def write_numbered(frame: DataFrame, path: str, order_by: str | Column | None = None) -> None:
    """Land a table with its ordinals, so that later pages prune row groups instead of scanning."""
    with_ordinals(frame, order_by).sortWithinPartitions(ORD).write.mode("overwrite").parquet(path)


def numbered_page(
    numbered: DataFrame, schema, page: int, page_size: int, *, keep: list[str] | None = None, **date_options
) -> DataFrame:
    """A page of a table landed by ``write_numbered``: a range filter the scan pushes down."""
    check_page(page, page_size)
    lo = (page - 1) * page_size
    rows = numbered.where((F.col(ORD) >= lo) & (F.col(ORD) < lo + page_size)).orderBy(ORD)
    return conversion.render_rows(conversion.convert(rows, schema, keep=keep, ordered=True, **date_options), keep=keep)
