"""CSV files read by ranges: as pandas reads them, whatever the split settings, and the same rows at the same place in every job."""

import random

import pandas as pd
import pytest

from castwright import process_csv, with_ordinals
from castwright.sources.csv import SEQ, CsvError, header_cells, malformed_rows, read_csv

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def splits(spark):
    """Sets how many bytes a range has."""
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set(SPLIT, str(size))
    spark.conf.unset(SPLIT)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def rows(table):
    return [tuple(r)[: len(table.columns)] for r in table.positioned.orderBy("__src", SEQ).collect()]


def odd_csv(rnd):
    def cell():
        kind = rnd.random()
        if kind < 0.4:
            return rnd.choice(["a", "bc", " ", "1.5", "", "é", "x y", "\t"])
        if kind < 0.65:
            return '"' + rnd.choice(["a", "b,c", "line\nbreak", "l\r\nb", 'q""uote', '""', "", 'x""y', '\n\n"",', "\n"]) + '"'
        return rnd.choice(['st"ray', '"a"tail', '"a"t"ail"', '5" pipe', ' "late"'])

    out = [rnd.choice(["", "\n  \n"]), "a,b,c\n"]
    for _ in range(rnd.randint(1, 60)):
        out.append(",".join(cell() for _ in range(rnd.choice([3, 3, 3, 2, 1]))) + rnd.choice(["\n", "\n", "\r\n"]))
        if rnd.random() < 0.2:
            out.append(rnd.choice(["\n", " \t\n", "\r\n"]))
    return "".join(out)


def test_reads_as_pandas_does_at_any_split(spark, tmp_path, splits):
    rnd = random.Random(7)
    for n in range(3):
        path = put(tmp_path, f"{n}/t.csv", odd_csv(rnd))
        want = pd.read_csv(path, dtype=str, keep_default_na=False, na_filter=False, index_col=False)
        want = [tuple("" if not isinstance(x, str) else x for x in r) for r in want.itertuples(index=False)]
        for size in (10**9, rnd.choice([90, 200])):
            splits(size)
            table = read_csv(spark, path)
            assert rows(table) == want and not table.is_malformed()


def test_a_cell_over_many_ranges(spark, tmp_path, splits):
    splits(40)
    body = "".join(f'{i},"{"x" * (i % 50)}\n\n,""{i}"\n' for i in range(60))
    table = read_csv(spark, put(tmp_path, "t.csv", "k,v\n" + body))
    assert rows(table) == [(str(i), f'{"x" * (i % 50)}\n\n,"{i}') for i in range(60)]


@pytest.mark.parametrize(
    "text, want, bad",
    [
        (b"a,b\r1,2\r3,4\r", [("1", "2"), ("3", "4")], 0),
        (b'a,b\r\n"x\ry",2\r\n', [("x\ry", "2")], 0),
        (b'a,b\nx"1,2"y,z\n', [('x"1', '2"y')], 1),
        (b"a,b\n1,2\n \t \n3,4\n", [("1", "2"), ("3", "4")], 0),
        (b'a,b\n1,2\n" ",3\n', [("1", "2"), (" ", "3")], 0),
        (b'a,b\n1,2\n3,"open\n5,6\n7,8\n', [("1", "2"), ("3", '"open')], 1),
        (b"a,b\n1,\xff\n3,4\n", [("1", "�"), ("3", "4")], 1),
        (b'"a\nb",c\n1,2\n', [("1", "2")], 0),
        (b"a,b\n1,2", [("1", "2")], 0),
    ],
)
def test_corners(spark, tmp_path, text, want, bad):
    table = read_csv(spark, put(tmp_path, "t.csv", text))
    assert rows(table) == want
    assert malformed_rows(table).first()["malformed"] == bad


def test_headers_meet_by_name(spark, tmp_path):
    put(tmp_path, "in/1.csv", "a,b\n1,2\n")
    put(tmp_path, "in/2.csv", "b,a\n3,4\n5\n")
    put(tmp_path, "in/3.csv", '"A",c\n6,7\n8,9,10\n')
    put(tmp_path, "in/4.csv", "")
    table = read_csv(spark, str(tmp_path / "in"))
    assert table.columns == ["a", "b", "c"]
    assert rows(table) == [("1", "2", ""), ("4", "3", ""), ("", "5", ""), ("6", "", "7"), ("8", "", "9")]
    assert malformed_rows(table).select("malformed").collect()[-1][0] == 1
    assert header_cells('a,"b,""c""",,"d"e') == ["a", 'b,"c"', "", "de"]


def test_positions_hold_when_the_split_settings_change(spark, tmp_path, splits):
    """The two passes of a profile, ordinals and pages run under settings of their own."""
    for name in ("b", "a"):
        put(tmp_path, f"in/{name}.csv", "Name,Note\n" + "".join(f'{name}{i},"{i % 7}\n"\n' for i in range(300)))
    path = str(tmp_path / "in")
    splits(900)
    table = read_csv(spark, path)
    numbered = with_ordinals(table.positioned)
    splits(10**9)
    found = sorted((r["ord"], r["Name"]) for r in numbered.collect())
    assert found == [(i, f"a{i}") for i in range(300)] + [(300 + i, f"b{i}") for i in range(300)]
    result = process_csv(spark, path)
    splits(700)
    first = result.profile.collect()[0]
    assert first["sample_values"] == [f"a{i}" for i in range(5)] and first["total_count"] == 600


def test_other_files_are_landed_with_their_positions(spark, tmp_path, splits):
    folder = str(tmp_path / "json")
    spark.range(2000).selectExpr("id", "concat('v', id) AS v").coalesce(1).write.json(folder)
    splits(3000)
    numbered = with_ordinals(spark.read.schema("id long, v string").json(folder))
    splits(10**9)
    assert sorted((r["ord"], r["id"]) for r in numbered.collect()) == [(i, i) for i in range(2000)]


def test_reserved_names_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="reserved"):
        read_csv(spark, put(tmp_path, "t.csv", "a,__seq\n1,2\n"))
    with pytest.raises(ValueError, match="reserved"):
        with_ordinals(spark.createDataFrame([(1, 2)], "k int, cell int"), "k")
    with pytest.raises(CsvError, match="no columns"):
        read_csv(spark, put(tmp_path, "e/empty.csv", "\n\n"))
