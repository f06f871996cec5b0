import json
from datetime import datetime

import pytest

from castwright import preview_run, process, process_csv, process_prefix, process_table
from castwright import fixed
from castwright.operators.overrides import OverrideError
from castwright.operators.paging import PageError
from castwright.sources import runs
from castwright.sources.csv import CsvError, column_names, malformed_rows, needs_multiline, read_csv
from castwright.sources.files import FileTypeError, file_type_of, list_supported_files

SAMPLE = (
    "Name,Birthdate,Score,Grade\nAlice,1/01/1990,90,A\nBob,2/02/1991,75,B\nCharlie,3/03/1992,85,A\n"
    "David,4/04/1993,70,B\nEve,5/05/1994,Not Available,A\n"
)


def put(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def cells(table):
    return [tuple(r) for r in table.frame.collect()]


@pytest.mark.parametrize(
    "text, columns, rows",
    [
        ("a,b\n1,2\n\n3,4\n", ["a", "b"], [("1", "2"), ("3", "4")]),
        ("a,a\n1,2\n", ["a", "a.1"], [("1", "2")]),
        ("a,,c\n1,2,3\n", ["a", "Unnamed: 1", "c"], [("1", "2", "3")]),
        ("a,b\n1\n", ["a", "b"], [("1", "")]),
        ('a,b\n"x\ny",2\n', ["a", "b"], [("x\ny", "2")]),
        ('a,b\n"x ""q"" y",2\n', ["a", "b"], [('x "q" y', "2")]),
        ("﻿a,b\n1,2\n", ["a", "b"], [("1", "2")]),
        ("a,b\r\n1,2\r\n", ["a", "b"], [("1", "2")]),
        ("a,b\n", ["a", "b"], []),
        ("a,b\n 1 , NA \n", ["a", "b"], [(" 1 ", " NA ")]),
    ],
)
def test_csv_corners(spark, tmp_path, text, columns, rows):
    table = read_csv(spark, put(tmp_path, "t.csv", text))
    assert table.columns == columns
    assert cells(table) == rows


def test_empty_and_missing_files(spark, tmp_path):
    with pytest.raises(CsvError, match="no columns"):
        read_csv(spark, put(tmp_path, "empty.csv", ""))
    with pytest.raises(CsvError, match="does not exist"):
        read_csv(spark, str(tmp_path / "nope.csv"))


def test_header_names():
    assert column_names(["a", "a", "a.1", "", None, "A"]) == ["a", "a.2", "a.1", "Unnamed: 3", "Unnamed: 4", "A.3"]


def test_lines_decide_whether_a_file_may_be_split(spark, tmp_path):
    assert not needs_multiline(spark, put(tmp_path, "p.csv", 'a,b\n"x, ""y""",2\n,\n"",3\n'))
    assert needs_multiline(spark, put(tmp_path, "q.csv", 'a,b\n"x\ny",2\n'))
    assert needs_multiline(spark, put(tmp_path, "r.csv", 'a,b\n5" pipe,"x\n"\n'))
    long_line = '"' + 'x""' * 200_000 + '",1\n'
    assert not needs_multiline(spark, put(tmp_path, "s.csv", "a,b\n" + long_line))


@pytest.mark.parametrize("row, bad", [("5,6,7", 1), ("5,6,", 1), ("5,,", 1), ("5", 0), ('"a,b",6', 0), ('"a,b",6,7', 1)])
def test_long_rows_fail_the_file(spark, tmp_path, row, bad):
    path = put(tmp_path, "long.csv", f"a,b\n1,2\n{row}\n")
    counted = malformed_rows(read_csv(spark, path)).first()
    assert (counted["row_count"], counted["malformed"]) == (2, bad)
    if bad:
        with pytest.raises(CsvError, match="could not be parsed"):
            process_csv(spark, path)
        assert process_csv(spark, path, allow_malformed=True).row_count == 2
    else:
        assert process_csv(spark, path).row_count == 2


def test_listing(spark, tmp_path):
    for name in ("incoming/notes.txt", "incoming/z-last.xlsx", "incoming/a-first.csv", "incoming/sub/M.CSV", "incoming/old.xls"):
        put(tmp_path, name, "x")
    listed = list_supported_files(spark, str(tmp_path / "incoming")).collect()
    assert [(r["key"].split("incoming/")[1], r["format"]) for r in listed] == [
        ("a-first.csv", "csv"), ("old.xls", "excel"), ("sub/M.CSV", "csv"), ("z-last.xlsx", "excel"),
    ]
    assert all(r["size"] == 1 and isinstance(r["last_modified"], datetime) for r in listed)


def test_file_types():
    assert file_type_of("x/data.CSV") == "csv" and file_type_of("b.xls") == "excel"
    for name in ("notes.txt", "noext", ".csv", "dir.csv/file"):
        with pytest.raises(FileTypeError, match=fixed.ERR_FILE_TYPE):
            file_type_of(name)


def test_sample_file(spark, tmp_path):
    result = process(spark, put(tmp_path, "sample.csv", SAMPLE))
    found = {e["column"]: e for e in result.schema_entries()}
    assert {c: (e["inferred_type"], e["confidence"]) for c, e in found.items()} == {
        "Name": ("text", 0.45), "Birthdate": ("date", 0.92), "Score": ("integer", 0.98), "Grade": ("category", 0.64),
    }
    assert found["Score"]["nullable"] and found["Score"]["null_token_count"] == 1
    assert found["Score"]["sample_values"] == ["90", "75", "85", "70"]
    payload = result.to_dict()
    assert payload["rowCount"] == 5 and payload["previewColumns"] == ["Name", "Birthdate", "Score", "Grade"]
    assert payload["previewRows"][0] == {"Name": "Alice", "Birthdate": "1990-01-01", "Score": 90, "Grade": "A"}
    assert payload["previewRows"][4]["Score"] is None and payload["warnings"] == []
    assert set(payload["processingMetadata"]) == {"durationMs", "previewRowLimit", "chunkSize"}


def test_preview_limit_and_pages(spark, tmp_path):
    text = "Name,Birthdate,Score,Grade\nAlice,1/01/1990,90,A\nBob,2/02/1991,Not Available,B\n"
    result = process_csv(spark, put(tmp_path, "two.csv", text), page_size=1)
    assert result.row_count == 2 and result.preview.count() == 1 and result.preview_page["totalPages"] == 2
    assert {e["column"]: e["inferred_type"] for e in result.schema_entries()}["Score"] == "integer"


def test_date_and_datetime_overrides(spark, tmp_path):
    path = put(tmp_path, "when.csv", "MeetingDay,OccurredAt\n1990-01-01 15:30:00,1990-01-01 15:30:00\n")
    result = process_csv(spark, path, {"MeetingDay": "date", "OccurredAt": "datetime"}, page_size=1)
    assert tuple(result.preview.first()) == ("1990-01-01", "1990-01-01T15:30:00")


def test_override_errors_stop_the_run(spark, tmp_path):
    path = put(tmp_path, "bad.csv", "mixed\n1\ntwo\n")
    with pytest.raises(OverrideError, match="cannot be safely converted"):
        process_csv(spark, path, {"mixed": "integer"})


def test_header_only_file(spark, tmp_path):
    result = process_csv(spark, put(tmp_path, "head.csv", "a,b\n"))
    assert result.row_count == 0 and result.preview.columns == ["a", "b"] and result.preview.collect() == []
    assert result.preview_page["totalPages"] == 1


def test_runs_and_later_pages(spark, tmp_path):
    log = str(tmp_path / "runs")
    path = put(tmp_path, "four.csv", "Name,Score\nAlice,90\nBob,85\nCharlie,80\nDavid,75\n")
    result = process_csv(spark, path, page_size=2)
    row = result.run_row(bucket="demo")
    runs.append_runs(spark, log, [row, runs.run_row(object_key="broken.csv", status="failed")])
    info, rows = preview_run(spark, log, row["run_id"], 2, 2)
    assert info["totalPages"] == 2 and not info["hasNextPage"]
    assert [r.asDict() for r in rows.collect()] == [{"Name": "Charlie", "Score": 80}, {"Name": "David", "Score": 75}]
    with pytest.raises(PageError):
        preview_run(spark, log, row["run_id"], 3, 2)
    with pytest.raises(runs.RunNotFound):
        preview_run(spark, log, "unknown", 1, 2)
    context = {"object_key": path, "row_count": 4, "schema": result.schema_entries()}
    _, stateless = preview_run(spark, log, "unknown", 1, 2, context=context)
    assert [r["Name"] for r in stateless.collect()] == ["Alice", "Bob"]
    failed = runs.search_runs(spark, log, status="failed").collect()
    assert [r["object_key"] for r in failed] == ["broken.csv"]
    with pytest.raises(runs.RunNotFound):
        runs.find_run(spark, log, failed[0]["run_id"])
    assert runs.search_runs(spark, log, text="DEMO").count() == 1
    assert json.loads(runs.read_runs(spark, log).where("status = 'completed'").first()["schema"])[1]["column"] == "Score"


def test_prefix(spark, tmp_path):
    put(tmp_path, "in/a.csv", SAMPLE)
    put(tmp_path, "in/b.csv", "x,y\n1,2\n3,4,5\n")
    put(tmp_path, "in/c.txt", "x")
    put(tmp_path, "in/sub/d.CSV", "Score,Name\n" + "".join(f'{i % 70},"n{i}\n"\n' for i in range(300)))
    put(tmp_path, "in/e.csv", "\n \n")
    log = str(tmp_path / "runs")
    found = process_prefix(spark, str(tmp_path / "in"), log).orderBy("path", "pos").collect()
    assert [(r["column"], r["inferred_type"], r["row_count"]) for r in found if r["status"] == "completed"] == [
        ("Name", "text", 5), ("Birthdate", "date", 5), ("Score", "integer", 5), ("Grade", "category", 5),
        ("Score", "integer", 300), ("Name", "text", 300),
    ]
    assert [r["error"] for r in found if r["status"] == "failed"] == [fixed.ERR_PARSE, fixed.ERR_EMPTY_FILE]
    logged = {r["object_key"].rsplit("/", 1)[1]: r for r in runs.read_runs(spark, log).collect()}
    assert {k: r["status"] for k, r in logged.items()} == {"a.csv": "completed", "b.csv": "failed", "d.CSV": "completed", "e.csv": "failed"}
    # A run of the log is what processing the file alone gives.
    for name, path in (("a.csv", "in/a.csv"), ("d.CSV", "in/sub/d.CSV")):
        alone = process_csv(spark, str(tmp_path / path))
        run = runs.find_run(spark, log, logged[name]["run_id"])
        assert run["schema"] == json.loads(json.dumps(alone.schema_entries())) and run["row_count"] == alone.row_count
        assert run["preview_columns"] == alone.preview_columns and run["warnings"] == alone.warnings
    _, rows = preview_run(spark, log, logged["d.CSV"]["run_id"], 2, 100)
    assert [r["Name"] for r in rows.collect()] == [f"n{i}" for i in range(100, 200)]


def test_split_file_keeps_order(spark, tmp_path):
    body = "".join(f"n{i},{i}\n" for i in range(3000))
    path = put(tmp_path, "big.csv", "Name,Score\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        result = process_csv(spark, path, page_size=500)
        entries = {e["column"]: e for e in result.schema_entries()}
        assert entries["Name"]["sample_values"] == [f"n{i}" for i in range(5)]
        assert [r["Score"] for r in result.preview.collect()] == list(range(500))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_table_jobs(spark):
    rows = [(2, "b", "2"), (1, "a", "1"), (3, "c", "x")]
    frame = spark.createDataFrame(rows, "k int, n string, v string")
    result = process_table(frame, {"n": "category"}, order_by="k", page_size=2)
    assert result.row_count == 3 and [r["n"] for r in result.preview.collect()] == ["a", "b"]
    assert [e["inferred_type"] for e in result.schema_entries()] == ["integer", "category", "text"]
    assert result.converted.columns == ["k", "n", "v"]
    fewer = process_table(frame, order_by="k", columns=["n", "v"])
    assert fewer.converted.columns == ["n", "v"]
