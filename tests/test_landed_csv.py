"""What reading and profiling a landed CSV table does once per cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from castwright.functions import classify
from castwright.local import quoted
from castwright.operators import profile as profiling
from castwright.operators.cells import BLK, SEQ, SRC, Ordered
from castwright.sources.csv import MALFORMED, read_csv, read_rows

LINES = [
    b"a,b,c", b"1,,x", b'"1,5","say ""hi""",', b"short", b"", b" \t", b"one,two,three,four", b'st"ray,"quo"ted,z',
    b"\xff,bad,utf", b'"",NULL, x ', "é,ü,　".encode(), b'"q"', b",,",
]


def held(table):
    rows = table.positioned.orderBy(BLK, SEQ).select(*map(quoted, table.columns), SEQ, MALFORMED).collect()
    return [tuple(row) for row in rows]


def test_lines_cut_while_they_are_read(spark, tmp_path):
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_bytes(b"\n".join(LINES) + b"\n")
    broken.write_bytes(b"\n".join([*LINES, b'"two\nlines",y,z']) + b"\n")
    assert read_rows(spark, str(plain)).cut and not read_rows(spark, str(broken)).cut
    found = held(read_csv(spark, str(plain)))
    assert found == held(read_csv(spark, str(broken)))[:-1]
    assert found[1][:3] == ("1,5", 'say "hi"', "") and found[2][:3] == ("short", "", "")
    assert [row[4] for row in found if row[4]] == ["malformed: one", "malformed: �"]


def test_blocks_number_the_files(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.csv").write_text(f"x,y\n{name},1\n{name},2\n")
    rows = read_csv(spark, str(tmp_path)).positioned.select("x", BLK, SEQ).orderBy(BLK, SEQ).collect()
    assert [tuple(r) for r in rows] == [(n, i, k) for i, n in enumerate("abc", 1) for k in (0, 1)]


def test_plain_short_dates_need_no_pieces(spark):
    day, both = classify.DATETIME, classify.DATETIME | classify.AMBIGUOUS
    expected = {
        "9/3/1995": both, "09-03-1995": both, "13/2/1995": day, "2/13/1995": day, "3/3/1995": day, "2/29/1996": day, "2/29/1995": 0,
        "13/13/1995": 0, "0/5/1995": 0, "9/3-1995": both, "9/3/95": both, "9/3/1699": both, "9/3/1500": 0, "9/3/1995 10:00": both | classify.TIME,
        "1995-09-03": day, "1-URGENT": 0, "1+2j": classify.COMPLEX, "12e5-3e-7j": classify.COMPLEX, "1/2j": 0, "K": 0, "None,": 0,
        "1e-3": classify.NUMBER, "1_": classify.INTEGER | classify.NUMBER, "-inf": classify.NUMBER, "yes": classify.BOOLEAN | classify.ALPHA,
    }
    cells = spark.createDataFrame([(v,) for v in expected], "v string")
    masks = classify.classify(cells, pivot_year=2024).collect()
    assert {row["v"]: row["mask"] for row in masks} == expected
    shorts = cells.select("v", F.expr(classify.dates.short_date("v", "true")).alias("s")).where("s IS NOT NULL")
    assert {row["v"]: row["s"] for row in shorts.collect()}.items() >= {"9/3/1995": 903, "09-03-1995": 903, "13/2/1995": 1302}.items()


def test_samples_read_only_leading_rows(spark):
    rows = spark.createDataFrame([(f"v{i}", "f", i // 100, i % 100) for i in range(400)], f"x string, {SRC} string, {BLK} long, {SEQ} long")
    for keys, source in (([BLK], ""), ([SRC, BLK], "f")):
        ordered = Ordered(rows, ["x"], keys)
        assert profiling._leading_rows(ordered, [(source, 0, 9), (source, 1, 4)]).count() == 105
        evidence = profiling.collect_evidence(profiling.evidence(ordered))
        found = profiling.finish(spark, ["x"], evidence, profiling.values(ordered, evidence)).first()
        assert found["sample_values"] == [f"v{i}" for i in range(5)] and found["unique_count"] == 51
