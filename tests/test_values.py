"""Value rules against Python, decimal, complex and pandas."""

import random
import warnings
from datetime import date, datetime
from decimal import Decimal, InvalidOperation

import pandas as pd
import pytest
from pyspark.sql import functions as F

from castwright.functions import classify, complexes, dates, numbers, render, text
from castwright.functions.stages import apply_stages


def values(spark, cells):
    return spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, v string")


def results(frame, *columns):
    return frame.orderBy("i").select(*columns).collect()


def test_null_tokens_and_whitespace(spark):
    cells = ["", " na ", "N/A", "NULL", "None", "not available", "NaN", "　\x1c x \n", "n.a.", "-", None, "​x"]
    frame = values(spark, cells).withColumn("t", text.strip("v")).withColumn("n", text.blank_null_token("t"))
    got = [r[0] for r in results(frame, "n")]
    assert got == [None] * 7 + ["x", "n.a.", "-", None, "​x"]


def test_boolean_tokens(spark):
    cells = ["true", "T", "yes", "Y", "1", "false", "f", "No", "n", "0", "on", "2"]
    got = [r[0] for r in results(values(spark, cells), text.parse_boolean("v"))]
    assert got == [True] * 5 + [False] * 5 + [None] * 2


def python_number(cell):
    cleaned = cell
    groups = cell.lstrip("+-").split(".")[0].lower().split("e")[0].split(",")
    if len(groups) > 1 and 1 <= len(groups[0]) <= 3 and all(len(g) == 3 and g.isdigit() for g in groups[1:]) and groups[0].isdigit():
        cleaned = cell.replace(",", "")
    try:
        number = Decimal(cleaned)
    except InvalidOperation:
        return None
    return None if number.is_snan() else number


NUMBERS = [
    "1.0", "1e5", "100e-2", "5.", "+5", "1,000", "1_000", "1e400", ".5", "1e-2", "12,34", "0x1F", "1d", "Infinity",
    "-inf", "+1,000.50", "sNaN", "--5", "1f", "-nan", "nan12", "0e-5", "0.000", "-0", "1e18", "1e19",
    "9223372036854775807", "9223372036854775808", "-9223372036854775808", "1.5e1", "15e-1", "150e-1", "0.0001e4",
    "00012", "1__0", "_1", ".", "+", "e5", "1e", "1e999999", "1e-999999", "-.0", "1 000",
]


def test_numbers(spark):
    rng = random.Random(5)
    made = [
        rng.choice(["", "+", "-"]) + "".join(rng.choice("0012345") for _ in range(rng.randint(0, 5)))
        + rng.choice(["", ".", ""]) + "".join(rng.choice("0005") for _ in range(rng.randint(0, 4)))
        + rng.choice(["", "e" + rng.choice(["", "+", "-"]) + str(rng.randint(0, 25))])
        for _ in range(1500)
    ]
    cells = NUMBERS + [m for m in made if m]
    frame = apply_stages(values(spark, cells), [numbers.number_stages("v", "")])
    cleaned, parts = "cleaned", "scientific"
    got = results(
        frame, "v", numbers.is_number(cleaned), numbers.is_number(cleaned) & numbers.is_integral(cleaned, parts),
        numbers.to_bigint(cleaned, parts), numbers.to_double(cleaned),
    )
    for cell, is_number, is_whole, whole, real in got:
        x = python_number(cell)
        assert is_number == (x is not None), cell
        finite = x is not None and x.is_finite()
        assert is_whole == (finite and x == x.to_integral_value()), cell
        fits = is_whole and abs(x.adjusted()) < 30 and -(2**63) <= int(x) < 2**63
        assert whole == (int(x) if fits else None), cell
        assert real == (float(x) if x is not None and not x.is_nan() else None), cell


COMPLEX = [
    "1+2j", "(1+2j)", "( 1+2j )", "j", "2j", "-j", "+j", "1+j", "1e3-2J", "nanj", "inf+infj", "1_0+2j", "3 + 4j",
    "1j+2", "12", "1+2", "(1+2j", "1+2j)", "()j", "(j)", "1.5e-3+.5j", "1.+2.j", "1__0j", "-inf-nanj", "+-j",
    "1++2j", "1e5j", "1e+5-1e-5j", "0j", "-0j", "-0-0j", "0-2j", "1jj", "i", "1e16+1e15j", "1e-4-1e-5j",
    "123456789.125+0.001j", "1e22j", "1.5e300-2.25e-300j",
]


def test_complex_literals_and_rendering(spark):
    frame = apply_stages(values(spark, COMPLEX), [complexes.complex_stages("v", "z", "c_")])
    frame = apply_stages(frame, [render.complex_stages("z", "shown", "s_")])
    for cell, z, shown in results(frame, "v", "z", "shown"):
        try:
            expected = complex(cell) if "j" in cell.lower() else None
        except ValueError:
            expected = None
        assert repr(complex(*z) if z else None) == repr(expected), cell
        assert shown == (None if expected is None else str(expected)), cell


DATED = [
    "1/01/1990", "13/02/2020", "2020-1-2", "Jan 5, 2020", "Sept 5, 2020", "31/12/99", "2020-02-30", "2020-13-01",
    "00/00/2020", "1600-01-01", "2262-05-01", "2262-04-11 23:47:16", "2262-04-11 23:47:17", "1677-09-21 00:12:43",
    "1677-09-21 00:12:44", "01/02/2020", "1/2/20", "01/02/2020 10:00", "2020-01-02 10:00", "2020-01-02T10:00:00Z",
    "2020-01-02 10:00:00+05:30", "2020-01-02 10:00:00 -0800", "1990-01-01 3:30 PM", "12:30", "25:00",
    "2020-01-02 24:00", "2020-01-02 10:00:60", "2020-01-02 foo", "call at 12:30", "Foo 5 2020", "Januar 5 2020",
    "Sunday, January 5, 2020", "29/02/2021", "2/29/2020", "12:60", "2020-01-02 12:30 AM", "2020-01-02 13:00 PM",
    "2020-01-02 10:00:05.123456789", "20200102", "5 January 2020", "05-Jan-2020", "T12:30", "Thu 10:00",
    "2020-01-0210:00", "2020-01-02 ", "1/13/75", "1/13/76",
]


def test_dates_agree_with_pandas(spark):
    frame = values(spark, DATED).withColumn("v", F.trim("v"))
    frame = apply_stages(frame, [dates.timestamp_stages("v", "t", "", pivot_year=2026, reference_date=date(2026, 1, 5))])
    no_hint = {"20200102", "5 January 2020", "05-Jan-2020"}
    for cell, t in results(frame, "v", "t"):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            expected = pd.to_datetime(cell, errors="coerce")
        if cell in no_hint or pd.isna(expected):
            assert t is None, cell
            continue
        if expected.tzinfo:
            expected = expected.tz_convert("UTC").tz_localize(None)
        if cell == "12:30":
            expected = expected.replace(year=2026, month=1, day=5)
        if cell in ("1/13/75", "1/13/76"):
            expected = expected.replace(year=2075 if cell.endswith("75") else 1976)
        assert t == expected.floor("us").to_pydatetime(warn=False), cell


def test_generated_dates_agree_with_pandas(spark):
    rng = random.Random(9)

    def made():
        sep = rng.choice("-/")
        y = str(rng.choice([rng.randint(1670, 1690), rng.randint(1900, 2030), rng.randint(2255, 2265)]))
        m, d = str(rng.randint(0, 13)), str(rng.randint(0, 32)).zfill(rng.choice([1, 2]))
        month = rng.choice(["Jan", "FEB", "dec", "Foo"])
        day = rng.choice([f"{y}{sep}{m}{sep}{d}", f"{m}{sep}{d}{sep}{y}", f"{d}{sep}{m}{sep}{y}", f"{month} {d}, {y}"])
        if rng.random() < 0.5 or day[0].isalpha():
            return day
        clock = f"{rng.randint(0, 25)}:{rng.randint(0, 61):02d}" + rng.choice(["", f":{rng.randint(0, 61):02d}", ":07.25"])
        return day + rng.choice([" ", "T"]) + clock + rng.choice(["", "", "Z", "+05:30"])

    # A time after a named month is left out: pandas 2.3 misreads some of those hours.
    cells = sorted({made() for _ in range(1500)})
    frame = apply_stages(values(spark, cells), [dates.timestamp_stages("v", "t", "")])
    for cell, t in results(frame, "v", "t"):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            expected = pd.to_datetime(cell, errors="coerce")
        if pd.isna(expected):
            assert t is None, cell
        else:
            if expected.tzinfo:
                expected = expected.tz_convert("UTC").tz_localize(None)
            assert t == expected.floor("us").to_pydatetime(warn=False), cell


def test_day_first(spark):
    frame = values(spark, ["01/02/2020", "01/13/2020", "13/01/2020"])
    frame = apply_stages(frame, [dates.timestamp_stages("v", "t", "", dayfirst=True)])
    assert [r[0] for r in results(frame, "t")] == [datetime(2020, 2, 1), datetime(2020, 1, 13), datetime(2020, 1, 13)]


@pytest.mark.parametrize(
    "cell, mask",
    [
        ("0", classify.INTEGER | classify.NUMBER | classify.BOOLEAN),
        ("7", classify.INTEGER | classify.NUMBER),
        ("1.5", classify.NUMBER),
        ("Infinity", classify.NUMBER),
        ("Yes", classify.BOOLEAN | classify.ALPHA),
        ("01/02/2020", classify.DATETIME | classify.AMBIGUOUS),
        ("1/01/1990", classify.DATETIME),
        ("13/02/2020 10:00", classify.DATETIME | classify.TIME),
        ("01/02/2020 10:00Z", classify.DATETIME | classify.AMBIGUOUS | classify.TIME | classify.OFFSET),
        ("1+2j", classify.COMPLEX),
        ("hello", 0),
        (None, None),
    ],
)
def test_masks(spark, cell, mask):
    assert results(classify.classify(values(spark, [cell])), "mask")[0][0] == mask


def test_rendered_timestamps_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = spark.sql("SELECT timestamp_ntz'2021-03-14 02:30:00.5' AS wall")
        row = frame.select(
            render.iso_timestamp(F.col("wall")),
            render.iso_timestamp(render.utc_wall(render.utc_instant(F.col("wall"))), utc=True),
        ).first()
        assert row[0] == "2021-03-14T02:30:00.500000"
        assert row[1] == "2021-03-14T02:30:00.500000+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_exponent_with_leading_zeros(spark):
    from castwright.functions import numbers

    for pattern in (numbers.NUMBER, numbers.NUMERIC):
        found = spark.createDataFrame([("1e0000000000000000001",), ("1e" + "0" * 40 + "5",), ("1e" + "9" * 19,)], "v string").selectExpr(f"v RLIKE r'{pattern}' AS ok")
        assert [r.ok for r in found.collect()] == [True, True, False]
