"""Profiles against a plain Python model, and their invariants."""

import random

import pytest
from pyspark.sql import functions as F

from castwright import profile, value_counts, with_ordinals
from castwright import fixed
from castwright.operators.paging import raw_page
from castwright.operators.profile import PROFILE_SCHEMA


def normal(cell):
    if cell is None or cell.strip().lower() in fixed.NULL_TOKENS:
        return None
    return cell.strip()


def counts(cells):
    """Counters, capped unique count and first five distinct values."""
    kept = [v for v in map(normal, cells) if v is not None]
    distinct = list(dict.fromkeys(kept))
    return len(cells), len(kept), min(len(distinct), 51), distinct[:5]


def measured(row):
    return row["total_count"], row["non_null_count"], row["unique_count"], row["sample_values"]


@pytest.fixture(scope="module")
def dirty(spark):
    rng = random.Random(3)
    n = 4000
    columns = {
        "unique": [f"value {i}" for i in range(n)],
        "few": [rng.choice(["a", "b", " a ", "NA", ""]) for _ in range(n)],
        "fifty": [str(rng.randrange(50)) for _ in range(n)],
        "fifty_one": [str(i % 51) for i in range(n)],
        "sixty": [str(i % 60) for i in range(n)],
        "late": [None if i < n - 40 else f"late {i}" for i in range(n)],
        "hot": ["same" if i < 3500 else f"v{i}" for i in range(n)],
        "constant": ["x"] * n,
        "nothing": [rng.choice(["", "none", None]) for _ in range(n)],
    }
    rows = [(i, *cells) for i, cells in enumerate(zip(*columns.values()))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "row long, " + ", ".join(f"{c} string" for c in columns)).repartition(7)
    return columns, frame


def test_counts_uniques_and_samples(dirty):
    columns, frame = dirty
    found = {r["column"]: measured(r) for r in profile(frame, "row", [c for c in frame.columns if c != "row"]).collect()}
    assert found == {name: counts(cells) for name, cells in columns.items()}


def test_same_result_however_partitioned(dirty):
    _, frame = dirty
    order = profile(frame, "row").orderBy("pos").collect()
    assert profile(frame.repartition(3, "few"), "row").orderBy("pos").collect() == order
    assert profile(frame.coalesce(1), "row").orderBy("pos").collect() == order


def test_without_row_order_the_samples_are_reproducible(dirty):
    columns, frame = dirty
    plain = frame.drop("row")
    first = {r["column"]: r for r in profile(plain).collect()}
    again = {r["column"]: r for r in profile(plain.repartition(5)).collect()}
    assert first == again
    for name, cells in columns.items():
        total, kept, unique, _ = counts(cells)
        assert measured(first[name])[:3] == (total, kept, unique)
        samples = first[name]["sample_values"]
        assert len(samples) == len(set(samples)) == min(5, unique)
        assert set(samples) <= {normal(c) for c in cells}


def test_file_order(spark, dirty, tmp_path):
    columns, frame = dirty
    path = str(tmp_path / "t")
    frame.drop("row").withColumn("row", F.lit(0)).drop("row").limit(0).write.mode("overwrite").parquet(path)
    ordered = frame.orderBy("row").coalesce(1).drop("row")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", 900).parquet(path)
    found = {r["column"]: measured(r) for r in profile(spark.read.parquet(path)).collect()}
    assert found == {name: counts(cells) for name, cells in columns.items()}


def test_typed_cells_equal_their_text(spark):
    frame = spark.range(300).select(
        F.col("id").alias("row"),
        (F.col("id") % 2).alias("bit"),
        F.when(F.col("id") % 3 > 0, F.col("id").cast("int")).alias("maybe"),
        (F.col("id") / 2).alias("half"),
        (F.col("id") * 1.0).alias("whole"),
        F.when(F.col("id") == 5, F.lit(float("nan"))).when(F.col("id") == 6, F.lit(float("inf"))).otherwise(1.0).alias("special"),
        F.col("id").cast("decimal(10,2)").alias("money"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
        F.timestamp_seconds(F.col("id") * 1000).alias("stamp"),
        F.when(F.col("id") == 0, F.lit("1600-01-01")).otherwise("2000-01-01").cast("date").alias("early"),
    )
    as_text = frame.select("row", *[F.col(c).cast("string") for c in frame.columns if c != "row"])
    typed = profile(frame, "row").orderBy("pos").collect()
    assert typed == profile(as_text, "row").orderBy("pos").collect()
    flags = {r["column"]: r for r in typed}
    assert flags["whole"]["integer_valid"] and not flags["half"]["integer_valid"]
    assert flags["bit"]["boolean_valid"] and not flags["special"]["integer_valid"]
    assert flags["day"]["datetime_valid"] and not flags["early"]["datetime_valid"]


def test_value_counts(dirty):
    columns, frame = dirty
    found = {(r["column"], r["v"]): r["n"] for r in value_counts(frame, "row", ["few", "nothing"]).collect()}
    expected = {}
    for name in ("few", "nothing"):
        for cell in columns[name]:
            expected[name, normal(cell)] = expected.get((name, normal(cell)), 0) + 1
    assert found == expected


def test_profile_fields(dirty):
    _, frame = dirty
    assert profile(frame, "row").columns == PROFILE_SCHEMA.names + ["unique_count", "sample_values"]


def test_the_key_is_a_column_like_the_others(spark):
    frame = spark.createDataFrame([(3, "a"), (1, "b"), (2, None)], "id int, v string")
    found = {r["column"]: r for r in profile(frame, "id").collect()}
    assert list(found["id"]["sample_values"]) == ["1", "2", "3"] and found["id"]["integer_valid"]
    assert list(found["v"]["sample_values"]) == ["b", "a"]


def test_a_missing_key_comes_last(spark):
    frame = spark.createDataFrame([(None, "z"), (5, "a"), (-(2**62), "b")], "id long, v string")
    assert [r["v"] for r in raw_page(frame, 1, 10, "id").collect()] == ["b", "a", "z"]
    assert sorted((r["ord"], r["v"]) for r in with_ordinals(frame, "id").collect()) == [(0, "b"), (1, "a"), (2, "z")]
    assert list(profile(frame, "id").collect()[1]["sample_values"]) == ["b", "a", "z"]
