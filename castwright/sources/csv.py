"""Raw CSV tables: every cell a string, nothing coerced.

A line break may stand inside a quoted cell, so whether a line starts a row depends on all quotes before it. Files are
split all the same:

1. ``scan``: each byte range (Spark's file split) is read once, and its effect on the quote state is found for both states
   it may start in, outside and inside a quoted cell, along with the rows it starts in either case.
2. The effects of a file's ranges are composed in order: a running sum over one row per range tells the state each
   range starts in, and how many rows start before it.
3. The ranges are read again. A line that is a whole row passes on; only lines of rows with line breaks are brought
   together by (file, row). Rows are cut into cells and landed as Parquet with their file and row number. If no file
   has a row with line breaks and all have one header, Arrow cuts the regular lines while they are read.

The landed row number is the row's position from then on, whatever the split settings of later jobs. The two scans must see the
same ranges; a row of a range that the first did not see stops the job with an error.

Rules: quotes count only at the start of a cell, a doubled quote inside stands for one, text behind the closing quote belongs
to the cell; ``\\n``, ``\\r\\n`` and ``\\r`` end lines; lines of blanks and tabs outside quoted cells are skipped; short rows are filled with
empty cells; rows with more cells than the header, rows that are not UTF-8 and a quoted cell that never ends are malformed. Files of
one path may have their columns in any order, and columns of their own: cells are matched by column name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castwright import fixed
from castwright.local import quoted, refuse_clash
from castwright.operators.cells import BLK, SEQ, SRC, land, landed

MALFORMED = "__malformed"
# File ranges that may be broadcast: a path and some numbers each, some 50 MB at most.
_BROADCAST_RANGES = 300_000
# Files of one path may differ in their headers, but each kind of header is planned for on the driver.
_HEADERS = 10_000

# A cell outside quotes, or quoted with whatever stands behind the closing quote. Possessive: linear, no deep stack.
_CELL = r'(?:"(?:[^"]++|"")*+"[^,]*+|[^,]*+)'
# A physical line that is a complete record of quoted or bare cells without stray quotes.
_PLAIN = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
COMPLETE_RECORD = rf"^{_PLAIN}(?:,{_PLAIN})*+\z"


class CsvError(ValueError):
    """The file cannot be read as a CSV table."""


@dataclass
class CsvTable:
    """A raw CSV table, landed.

    ``positioned`` carries, besides the columns, the file of each row (its name, and as block its number by name), the number of
    the row, and a marker on malformed ones. The block and the number order the rows.
    ``landed`` is the folder it is read from; ``open_landed`` opens it again.
    """

    path: str
    columns: list[str]
    positioned: DataFrame
    landed: str

    @property
    def frame(self) -> DataFrame:
        return self.positioned.select(*map(quoted, self.columns))

    def is_malformed(self) -> bool:
        return not self.positioned.where(F.col(MALFORMED).isNotNull()).isEmpty()

    def require_well_formed(self) -> None:
        if self.is_malformed():
            raise CsvError(fixed.ERR_PARSE)


def column_names(header: list[str | None]) -> list[str]:
    """Header cells as unique names: blanks become ``Unnamed: i``, repeats get ``.1``, ``.2`` and so on.

    Names that differ only in case count as repeats, since Spark resolves columns
    without regard to case.
    """
    filled = [cell if cell else f"Unnamed: {i}" for i, cell in enumerate(header)]
    reserved = {name.lower() for name in filled}
    names: list[str] = []
    used: set[str] = set()
    for name in filled:
        unique, count = name, 0
        while unique.lower() in used or (count and unique.lower() in reserved):
            count += 1
            unique = f"{name}.{count}"
        used.add(unique.lower())
        names.append(unique)
    return names


def needs_multiline(spark: SparkSession, path: str | list[str]) -> bool:
    """Is there a physical line that is no complete record?  Readers that split at line breaks must not read such files."""
    return not spark.read.text(path).where(~F.col("value").rlike(COMPLETE_RECORD)).isEmpty()


# --- the quote automaton ------------------------------------------------------


def scanner(whole: bool, width: int | None = None):
    """A function for ``mapInArrow`` over (file, start, length, value), whose rows come in file order within a range.

    With ``whole`` it gives a row per line, else a row per range. With ``width``, every line must be a row: it gives a row per
    line that is not blank, cut into so many cells, or with its ``text`` if it is not as wide or not plainly quoted. It refers to
    nothing outside itself, so that executors need not have this package.
    """

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.csv as pv

        cell = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
        ends_outside = {False: rf"^(?:{cell},)*{cell}$", True: rf'^(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{cell})*$'}

        def pieces(value: pa.Array, at_start: bool) -> tuple[pa.Array, pa.Array, np.ndarray]:
            """Lines as text, what ends each, and which are no UTF-8. Carriage returns within a line end lines, too."""
            binary = value.cast(pa.large_binary())
            if at_start and len(binary) and (binary[0].as_py() or b"").startswith(b"\xef\xbb\xbf"):
                binary = pa.concat_arrays([pa.array([binary[0].as_py()[3:]], pa.large_binary()), binary.slice(1)])
            try:
                text, bad = binary.cast(pa.large_string()), np.zeros(len(binary), bool)
            except pa.ArrowInvalid:
                raw = binary.to_pylist()
                fixed_text = [x.decode("utf-8", "replace") for x in raw]
                bad = np.array([x.encode() != y for x, y in zip(fixed_text, raw, strict=True)])
                text = pa.array(fixed_text, pa.large_string())
            if not pc.any(pc.match_substring(text, "\r")).as_py():
                return text, pa.repeat(pa.scalar("\n"), len(text)), bad
            lines, ends, flags = [], [], []
            for line, flag in zip(text.to_pylist(), bad.tolist(), strict=True):
                parts = line.split("\r")
                own = ["\r"] * (len(parts) - 1) + ["\n"]
                if len(parts) > 1 and not parts[-1]:
                    parts, own = parts[:-1], [*own[:-2], "\r\n"]
                lines += parts
                ends += own
                flags += [flag] * len(parts)
            return pa.array(lines, pa.large_string()), pa.array(ends), np.array(flags)

        def steps(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """State behind each line if it starts outside, and if it starts inside a quoted cell."""
            behind = {False: np.zeros(len(text), bool), True: np.ones(len(text), bool)}
            some = np.flatnonzero(pc.match_substring(text, '"').to_numpy(zero_copy_only=False))
            if len(some):
                own = text.take(pa.array(some))
                for state, pattern in ends_outside.items():
                    behind[state][some] = ~pc.match_substring_regex(own, pattern).to_numpy(zero_copy_only=False)
            return behind[False], behind[True]

        def states(outside: np.ndarray, inside: np.ndarray, start: bool) -> np.ndarray:
            """State behind each line, given the state before the first: the last line that fixes it, and turns since."""
            place, turns = np.arange(len(outside)), np.cumsum(outside & ~inside)
            last = np.maximum.accumulate(np.where(outside == inside, place, -1))
            known = last >= 0
            base = np.where(known, outside[last], start)
            return base ^ ((turns - np.where(known, turns[last], 0)) % 2 == 1)

        def cut(text: pa.Array, bad: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
            """The cells of lines by column, and which lines were cut; the cells of others are null."""
            plain = r'(?:"(?:[^"]|"")*"|[^",]*)'
            whole = ~bad & ~pc.match_substring(text, '"').to_numpy(zero_copy_only=False)
            some = np.flatnonzero(~bad & ~whole)
            if len(some):
                own = text.take(pa.array(some))
                whole[some] = pc.match_substring_regex(own, rf"^{plain}(?:,{plain})*$").to_numpy(zero_copy_only=False)
            names, place, wrong = [f"c{i}" for i in range(width)], np.flatnonzero(whole), []
            if not len(place):
                return [pa.nulls(len(text), pa.string())] * width, whole
            lines = ("\n".join(text.filter(pa.array(whole)).to_pylist()) + "\n").encode()
            found = pv.read_csv(
                pa.BufferReader(lines),
                read_options=pv.ReadOptions(use_threads=False, block_size=len(lines) + 1, column_names=names),
                parse_options=pv.ParseOptions(ignore_empty_lines=False, invalid_row_handler=lambda row: wrong.append(row.number - 1) or "skip"),
                convert_options=pv.ConvertOptions(check_utf8=False, column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
            )
            whole[place[wrong]] = False
            if len(found) != whole.sum():
                raise ValueError("The lines of a batch were not cut into as many rows.")
            spot = pa.array(np.cumsum(whole) - 1, mask=~whole)
            return [found[name].combine_chunks().take(spot) for name in names], whole

        key, header, number = None, None, 0
        state, count, broken = {}, {}, {}

        def summary() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"file": key[0], "start": key[1], "length": key[2], "out_u": state[False], "out_q": state[True], "n_u": count[False], "n_q": count[True], "broken_u": broken[False], "broken_q": broken[True], "header": "".join(header) if header is not None else None}],
                pa.schema([("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("out_u", pa.bool_()), ("out_q", pa.bool_()), ("n_u", pa.int64()), ("n_q", pa.int64()), ("broken_u", pa.bool_()), ("broken_q", pa.bool_()), ("header", pa.string())]),
            )

        for batch in batches:
            keys = [batch[c] for c in ("file", "start", "length")]
            turns = [pc.not_equal(k.slice(1), k.slice(0, max(len(k) - 1, 0))).to_numpy(zero_copy_only=False) for k in keys]
            edges = [0, *(np.flatnonzero(np.logical_or.reduce(turns)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                now = tuple(k[low].as_py() for k in keys)
                if now != key:
                    if key is not None and not whole:
                        yield summary()
                    key, header, number, closed = now, None, 0, False
                    state, count, broken = {False: False, True: True}, {False: 0, True: 0}, {False: False, True: False}
                text, ends, bad = pieces(batch["value"].slice(low, high - low), key[1] == 0 and number == 0)
                blank = pc.match_substring_regex(text, r"^[ \t]*$").to_numpy(zero_copy_only=False)
                if width is not None:
                    number += len(text)
                    text, bad = text.filter(pa.array(~blank)), bad[~blank]
                    n = len(text)
                    cells, done = cut(text, bad)
                    fields = {"file": pa.repeat(pa.scalar(key[0]), n), "start": pa.repeat(pa.scalar(key[1], pa.int64()), n), "length": pa.repeat(pa.scalar(key[2], pa.int64()), n)}
                    fields |= {"n": np.arange(count[False] + 1, count[False] + 1 + n), "bad": bad}
                    fields |= {"text": pc.if_else(pa.array(done), pa.scalar(None, pa.string()), text.cast(pa.string()))}
                    yield pa.RecordBatch.from_pydict(fields | {f"c{i}": column for i, column in enumerate(cells)})
                    count[False] += n
                    continue
                outside, inside = steps(text)
                columns = {}
                for start in (False, True):
                    after = states(outside, inside, state[start])
                    before = np.concatenate([[state[start]], after[:-1]])
                    rows = count[start] + np.cumsum(~before & ~blank)
                    columns[start] = (before, after, rows)
                    state[start], count[start] = bool(after[-1]), int(rows[-1])
                    broken[start] = broken[start] or bool(before.any() or after.any())
                if not whole and key[1] == 0 and not closed:  # the first row of the file, as far as it stands in this range
                    before, after, rows = columns[False]
                    for i in np.flatnonzero(rows == 1).tolist():
                        if not before[i] and blank[i]:
                            continue
                        header = [*(header or []), text[i].as_py(), ends[i].as_py()]
                        if not after[i]:
                            header, closed = header[:-1], True
                            break
                if whole:
                    n = len(text)
                    fields = {"file": pa.repeat(pa.scalar(key[0]), n), "start": pa.repeat(pa.scalar(key[1], pa.int64()), n), "length": pa.repeat(pa.scalar(key[2], pa.int64()), n)}
                    fields |= {"line": np.arange(number, number + n), "text": text.cast(pa.string()), "ends": ends, "bad": bad, "blank": blank}
                    for start, name in ((False, "u"), (True, "q")):
                        fields |= dict(zip((f"in_{name}", f"out_{name}", f"n_{name}"), columns[start], strict=True))
                    yield pa.RecordBatch.from_pydict(fields)
                number += len(text)
        if key is not None and not whole:
            yield summary()

    return scan


_RANGE = "file string, start long, length long"
_LINES = f"{_RANGE}, line long, text string, ends string, bad boolean, blank boolean, in_u boolean, out_u boolean, n_u long, in_q boolean, out_q boolean, n_q long"
_SUMMARY = f"{_RANGE}, out_u boolean, out_q boolean, n_u long, n_q long, broken_u boolean, broken_q boolean, header string"


def _physical(spark: SparkSession, path: str | list[str], options: dict) -> DataFrame:
    facts = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "start"), ("file_block_length", "length"))]
    return spark.read.options(lineSep="\n", **options).text(path).select(*facts, F.col("value").cast("binary").alias("value"))


def composed(summary: DataFrame) -> DataFrame:
    """Per range: the state it starts in (``quoted``), the rows of its file that start before it (``before``), ``unclosed``: the
    number of the file's last row if that row never ends, and ``broken``: does it hold a line of a row with line breaks?"""
    in_file = Window.partitionBy("file").orderBy("start")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.sum((F.col("out_u") & ~F.col("out_q")).cast("int")).over(in_file.rowsBetween(Window.unboundedPreceding, 0))
    fixes = F.when(F.col("out_u") == F.col("out_q"), F.struct(F.col("out_u").alias("state"), F.col("turned").alias("turned")))
    last = F.last("fixes", ignorenulls=True).over(earlier)
    turns = F.coalesce(F.max("turned").over(earlier), F.lit(0))
    odd = (F.col("turns") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    marked = summary.withColumn("turned", turned).withColumn("fixes", fixes).withColumn("last", last).withColumn("turns", turns)
    marked = marked.withColumn("quoted", F.coalesce(F.col("last.state"), F.lit(False)) != odd)
    marked = marked.withColumn("n", F.when(F.col("quoted"), F.col("n_q")).otherwise(F.col("n_u")))
    marked = marked.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    whole = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = F.last(F.when(F.col("quoted"), F.col("out_q")).otherwise(F.col("out_u"))).over(whole)
    broken = F.when(F.col("quoted"), F.col("broken_q")).otherwise(F.col("broken_u"))
    return marked.select("file", "start", "length", "quoted", "before", "n", F.when(out, F.sum("n").over(whole)).alias("unclosed"), broken.alias("broken"))


# --- rows and cells -------------------------------------------------------------


def _unseen(kind: str) -> Column:
    return F.raise_error(F.lit("The files or their split settings changed while they were read.")).cast(kind)


def _rows(lines: DataFrame, ranges: DataFrame, broken: bool = True) -> DataFrame:
    """file, row (from 1, the header's), text, problem. Without ``broken`` rows, every line is one, and the lines are read once."""
    seen = lines.join(ranges, ["file", "start", "length"], "left")
    seen = seen.withColumn("quoted", F.coalesce("quoted", _unseen("boolean")))
    pick = lambda name: F.when(F.col("quoted"), F.col(f"{name}_q")).otherwise(F.col(f"{name}_u"))
    seen = seen.select(
        "file", "start", "line", "text", "ends", "bad", "blank", pick("in").alias("inside"), pick("out").alias("open"),
        (F.col("before") + pick("n")).alias("row"), "unclosed",
    ).where(~F.col("blank") | F.col("inside"))
    endless = F.coalesce(F.col("row") == F.col("unclosed"), F.lit(False))
    seen = seen.where(~(endless & F.col("inside")))  # of a quoted cell that never ends only the first line is kept
    problem = F.when(endless, F.lit("quote")).when(F.col("bad"), F.lit("encoding"))
    alone = ~F.col("inside") & (~F.col("open") | endless)
    single = seen.where(alone).select("file", "row", "text", problem.alias("problem"))
    if not broken:
        return single
    # A row with line breaks: its lines meet by (file, row), wherever they were read.
    own = F.sort_array(F.collect_list(F.struct("start", "line", "text", "ends")))
    whole = seen.where(~alone).groupBy("file", "row").agg(own.alias("own"), F.max(problem).alias("problem"))
    joined = F.concat_ws("", F.flatten(F.transform("own", lambda x: F.array(x["text"], x["ends"]))))
    last = F.element_at("own", -1)["ends"]
    text = F.expr("substring(joined, 1, length(joined) - length(last))")
    whole = whole.select("file", "row", joined.alias("joined"), last.alias("last"), "problem").select("file", "row", text.alias("text"), "problem")
    return single.unionByName(whole)


def split_cells(text: Column) -> Column:
    """The cells of a row, unquoted. Rows without quotes, the common case, are only cut at commas."""

    def bare(cell: Column) -> Column:
        inner = F.substr(cell, F.lit(2), F.length(cell) - 2)
        regular = cell.endswith('"') & (F.length(cell) > 1) & ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), F.lit('"'))
        body = F.regexp_extract(cell, r'^"((?:[^"]++|"")*+)"', 1)
        tail = F.regexp_replace(cell, r'^"(?:[^"]++|"")*+"', "")
        plain = F.when(regular, F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.concat(F.replace(body, F.lit('""'), F.lit('"')), tail))
        return F.when(cell.startswith('"'), plain).otherwise(cell)

    found = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(f",({_CELL})"), F.lit(1))
    return F.when(~F.contains(text, F.lit('"')), F.split(text, ",", -1)).otherwise(F.transform(found, bare))


def header_cells(text: str) -> list[str]:
    """The cells of a header row, on the driver."""
    cells = []
    for cell in re.findall(f",({_CELL})", "," + text):
        if cell.startswith('"') and (end := re.match(r'"((?:[^"]++|"")*+)"', cell)):
            cell = end[1].replace('""', '"') + cell[end.end() :]
        cells.append(cell)
    return cells


@dataclass
class CsvFiles:
    """The landed ranges of some files, the kind of header of each, the kinds, and the rows as arrays of cells.

    ``cut`` gives, if every line is a row, the rows with so many cells as columns ``c0``, ``c1`` and so on; the array of ``cells`` is
    there only for rows that are not plain ones of that width.
    """

    ranges: DataFrame
    kinds: DataFrame
    headers: list[str]
    rows: DataFrame
    many: bool
    cut: Callable[[int], DataFrame] | None = None

    def spread(self, frame: DataFrame) -> DataFrame:
        """A frame with a row per file or range, broadcast only where those are few."""
        return frame if self.many else F.broadcast(frame)


def read_rows(spark: SparkSession, path: str | list[str], **options) -> CsvFiles:
    """Rows of CSV files, headers left out: file, row (from 2), cells, problem; and one row per kind of header on the driver."""
    try:
        physical = _physical(spark, path, options)
    except AnalysisException as error:
        raise CsvError(fixed.ERR_FILE_MISSING % path) from error
    summary = landed(physical.mapInArrow(scanner(False), _SUMMARY), "csv_ranges")
    found = summary.groupBy("header").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("ranges"))
    found = found.orderBy(F.col("header").isNotNull(), "file").limit(_HEADERS + 2).collect()
    headers = [row["header"] for row in found if row["header"] is not None]
    if len(headers) > _HEADERS:
        raise CsvError(f"The files have more than {_HEADERS} kinds of headers.")
    kinds = summary.where(F.col("header").isNotNull()).select("file", F.col("header").alias("kind"))
    files = CsvFiles(summary, kinds, headers, summary, sum(row["ranges"] for row in found) > _BROADCAST_RANGES)
    ranges = composed(summary).join(kinds.select("file"), "file")
    broken = not ranges.where("broken").isEmpty()
    ranges = files.spread(ranges.select("file", "start", "length", "quoted", "before", "unclosed"))
    in_files = lambda lines: lines.join(files.spread(kinds.select("file")), "file", "left_semi") if headers else lines
    rows = _rows(in_files(physical.mapInArrow(scanner(True), _LINES)), ranges, broken).where(F.col("row") > 1)
    files.rows = rows.select("file", "row", split_cells(F.col("text")).alias("cells"), "problem")

    def cut(width: int) -> DataFrame:
        names = [f"c{i}" for i in range(width)]
        lines = physical.mapInArrow(scanner(True, width), ", ".join([_RANGE, "n long, bad boolean, text string", *[f"{c} string" for c in names]]))
        seen = in_files(lines).join(ranges, ["file", "start", "length"], "left")
        row = F.coalesce(F.col("before") + F.col("n"), _unseen("long"))
        problem = F.when(F.col("bad"), F.lit("encoding"))
        cells = F.when(F.col("text").isNotNull(), split_cells(F.col("text")))
        return seen.select("file", row.alias("row"), cells.alias("cells"), problem.alias("problem"), *names).where(F.col("row") > 1)

    files.cut = None if broken else cut
    return files


def _malformed(width: Column) -> Column:
    """The marker of a row, null on good ones."""
    long_row = F.when(F.size("cells") > width, F.lit("cells"))
    first_cell = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    return F.when(F.coalesce("problem", long_row).isNotNull(), F.concat(F.lit("malformed: "), first_cell))


def read_csv(spark: SparkSession, path: str | list[str], *, columns: list[str] | None = None) -> CsvTable:
    """Raw table of CSV files; lands it.

    Its columns are those of the first file (by name), then those that only later files have; ``columns`` names
    the wanted ones instead.
    """
    files = read_rows(spark, path)
    if not files.headers:
        raise CsvError(fixed.ERR_EMPTY_FILE)
    names = {text: column_names(header_cells(text)) for text in files.headers}
    merged: dict[str, str] = {}
    for own in names.values():
        for name in own:
            merged.setdefault(name.lower(), name)
    every = columns or [*merged.values()]
    refuse_clash(every, SRC, BLK, SEQ, MALFORMED)
    cells = [F.get("own", F.lit(i)) for i in range(len(every))]
    if len(names) == 1 and names[files.headers[0]] == every:
        rows = files.rows
        if files.cut:
            rows = files.cut(len(every))
            cells = [F.coalesce(f"c{i}", own) for i, own in enumerate(cells)]
        cut = rows.withColumns({"width": F.lit(len(every)), "own": F.col("cells")})
    else:
        place = [[text, len(own), [{n.lower(): i for i, n in enumerate(own)}.get(name.lower(), -1) for name in every]] for text, own in names.items()]
        orders = spark.createDataFrame(place, "kind string, width int, places array<int>")
        own = F.transform("places", lambda p: F.when(p >= 0, F.get("cells", p)))
        # One row per file, and a row per kind of header.
        cut = files.rows.join(files.spread(files.kinds.join(F.broadcast(orders), "kind").drop("kind")), "file").withColumn("own", own)
    # The block is the file's number by name: one row per file is the most a task sees.
    numbered = files.kinds.select("file", F.row_number().over(Window.orderBy("file")).cast("bigint").alias("block"))
    folder = land(
        cut.join(files.spread(numbered), "file").select(
            F.col("file").alias(SRC), F.col("block").alias(BLK), (F.col("row") - 2).alias(SEQ),
            *[F.coalesce(cell, F.lit("")).alias(f"c{i}") for i, cell in enumerate(cells)],
            _malformed(F.col("width")).alias(MALFORMED),
        ),
        "csv_rows",
    )
    return open_landed(spark, folder, every, path if isinstance(path, str) else ",".join(path))


def read_each(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """All CSV files below a path, each a table of its own: landed cells (position, ``pos, raw``) and files (``file, columns, row_count,
    malformed``; ``columns`` is null where a file has no header)."""
    files = read_rows(spark, path, recursiveFileLookup=True, pathGlobFilter="*.[cC][sS][vV]")
    place = [[text, column_names(header_cells(text))] for text in files.headers]
    orders = spark.createDataFrame(place, "kind string, columns array<string>")
    # One row per file, and a row per kind of header.
    known = files.spread(files.kinds.join(F.broadcast(orders), "kind").drop("kind"))
    rows = files.rows.join(known, "file").withColumn("mark", _malformed(F.size("columns")))
    rows = landed(
        rows.select(
            F.col("file").alias(SRC), F.lit(0).cast("bigint").alias(BLK), (F.col("row") - 2).alias(SEQ), "mark",
            F.transform("columns", lambda _, i: F.coalesce(F.get("cells", i), F.lit(""))).alias("cells"),
        ),
        "csv_file_rows",
    )
    counts = rows.groupBy(F.col(SRC).alias("file")).agg(F.count(F.lit(1)).alias("row_count"), F.count("mark").alias("malformed"))
    every = files.ranges.select("file").distinct().join(known, "file", "left").join(counts, "file", "left")
    return rows.select(SRC, BLK, SEQ, F.posexplode("cells").alias("pos", "raw")), every.fillna(0, ["row_count", "malformed"])


def open_landed(spark: SparkSession, folder: str, columns: list[str], label: str = "") -> CsvTable:
    """A table that ``read_csv`` landed, without reading its files again."""
    cells = [f"c{i}" for i in range(len(columns))]
    kinds = ", ".join([*[f"{c} string" for c in cells], f"{SRC} string, {BLK} long, {SEQ} long, {MALFORMED} string"])
    rows = spark.read.schema(kinds).parquet(folder)
    positioned = rows.select(*[F.col(c).alias(name) for c, name in zip(cells, columns, strict=True)], SRC, BLK, SEQ, MALFORMED)
    return CsvTable(label, columns, positioned, folder)


def malformed_rows(table: CsvTable) -> DataFrame:
    """Rows, and malformed ones among them, counted per file."""
    return (
        table.positioned.groupBy(F.col(SRC).alias("file"))
        .agg(F.count(F.lit(1)).alias("row_count"), F.count(MALFORMED).alias("malformed"))
        .orderBy("file")
    )
