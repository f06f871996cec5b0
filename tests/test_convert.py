from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from castwright import category_dictionary, convert, render_rows, violations
from castwright import fixed
from castwright.operators.convert import ConversionError, require_convertible
from castwright.operators.dictionary import encode


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (0, " 1,000 ", "1.5", "Yes", "1990-01-01 15:30:00", "1990-01-01 15:30:00", "1+2j", "b"),
        (1, "N/A", "1e400", "0", "13/02/2020", "2020-01-02T10:00:00.5Z", "2j", " a "),
        (2, "1e400", "x", "maybe", "2020-02-30", "2020-01-02 10:00 +05:30", "12", "b"),
        (3, "1e2", "nan12", None, "", "12:99", "(j)", "NULL"),
    ]
    return spark.createDataFrame(
        rows, "row long, i string, f string, b string, d string, t string, z string, c string"
    )


KINDS = {"i": "integer", "f": "float", "b": "boolean", "d": "date", "t": "datetime", "z": "complex", "c": "category"}


def test_types_and_values(raw):
    out = convert(raw, KINDS, keep=["row"])
    assert [f.dataType.simpleString() for f in out.schema.fields] == [
        "bigint", "bigint", "double", "boolean", "date", "timestamp_ntz", "struct<re:double,im:double>", "string",
    ]
    rows = out.orderBy("row").collect()
    assert [r["i"] for r in rows] == [1000, None, None, 100]
    assert [r["f"] for r in rows] == [1.5, float("inf"), None, None]
    assert [r["b"] for r in rows] == [True, False, None, None]
    assert [r["d"] for r in rows] == [date(1990, 1, 1), date(2020, 2, 13), None, None]
    assert rows[1]["t"] == datetime(2020, 1, 2, 10, 0, 0, 500000) and rows[2]["t"] == datetime(2020, 1, 2, 4, 30)
    assert [tuple(r["z"]) if r["z"] else None for r in rows] == [(1, 2), (0, 2), None, (0, 1)]
    assert [r["c"] for r in rows] == ["b", "a", "b", None]


def test_offset_columns_become_instants(raw):
    schema = [{"column": "t", "inferred_type": "datetime", "has_utc_offset": True}]
    out = convert(raw, schema, keep=["row"])
    assert out.schema["t"].dataType.simpleString() == "timestamp"
    shown = [r["t"] for r in render_rows(out, keep=["row"]).orderBy("row").collect()]
    assert shown == ["1990-01-01T15:30:00+00:00", "2020-01-02T10:00:00.500000+00:00", "2020-01-02T04:30:00+00:00", None]


def test_rendering_distinguishes_date_and_datetime(raw):
    row = render_rows(convert(raw, {"d": "date", "t": "datetime", "z": "complex"})).first()
    assert tuple(row) == ("1990-01-01", "1990-01-01T15:30:00", "(1+2j)")


def test_violations(raw):
    found = {r["column"]: (r["violations"], r["first_value"], r["error"]) for r in violations(raw, KINDS, "row").collect()}
    assert found == {
        "i": (1, "1e400", "Column 'i' contains non-integer values."),
        "f": (1, "x", "Column 'f' contains non-numeric values."),
        "b": (1, "maybe", "Column 'b' contains non-boolean values."),
        "d": (1, "2020-02-30", "Column 'd' contains values that are not valid dates."),
        "t": (1, "12:99", "Column 't' contains values that are not valid dates."),
        "z": (1, "12", fixed.ERR_NOT_COMPLEX % "z"),
        "c": (0, None, None),
    }
    with pytest.raises(ConversionError, match="Column 'i' contains non-integer values."):
        require_convertible(raw, {"c": "text", "i": "integer"}, order_by="row")
    require_convertible(raw, {"c": "text"}, order_by="row")


def test_dictionary_codes_are_dense_and_independent_of_the_cuts(spark):
    cells = [f"v{i % 97:03d}" for i in range(1000)] + ["", "NA", "héllo", "Zed"]
    frame = spark.createDataFrame([(c, str(i % 3)) for i, c in enumerate(cells)], "c string, k string").repartition(5)
    expected = [("c", i, v) for i, v in enumerate(sorted({c for c in cells if c not in ("", "NA")}))]
    expected += [("k", i, str(i)) for i in range(3)]
    for many in (10**6, 40, 7, 1):
        got = category_dictionary(frame, ["c", "k"], values_per_piece=many).orderBy("column", "code").collect()
        assert [tuple(r) for r in got] == expected
    coded = encode(frame, "k", category_dictionary(frame, ["c", "k"]))
    assert coded.where(F.col("k").cast("int") != F.col("k_code")).isEmpty()
