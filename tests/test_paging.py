import random

import pytest
from pyspark.sql import functions as F

from castwright import page_metadata, preview_page, with_ordinals
from castwright.operators import paging
from castwright.sources.csv import read_csv

SCHEMA = {"Name": "text", "Score": "integer"}


def small(spark):
    rows = [(0, "Alice", "90"), (1, "Bob", "85"), (2, "Charlie", "80"), (3, "David", "75")]
    return spark.createDataFrame(rows, "row int, Name string, Score string").repartition(3)


def test_second_page(spark):
    rows = preview_page(small(spark), SCHEMA, 2, 2, "row").collect()
    assert [r.asDict() for r in rows] == [{"Name": "Charlie", "Score": 80}, {"Name": "David", "Score": 75}]


def test_page_facts(spark):
    assert paging.page_info(4, 2, 2) == {
        "page": 2, "pageSize": 2, "totalRows": 4, "totalPages": 2, "hasPreviousPage": True, "hasNextPage": False,
    }
    assert paging.page_info(0, 1, 100)["totalPages"] == 1
    with pytest.raises(paging.PageError):
        paging.page_info(4, 3, 2)
    row = page_metadata(spark.range(30), 2, 25).first()
    assert (row["first_row"], row["last_row"], row["total_pages"], row["has_next_page"]) == (26, 30, 2, False)
    assert page_metadata(spark.range(30), 1, 50).first()["last_row"] == 30
    assert page_metadata(spark.range(30), 3, 25).first()["error"] is not None
    with pytest.raises(ValueError):
        paging.check_page(1, 501)


def keyed(spark, n=5000):
    rng = random.Random(1)
    # Clumped, sparse and negative keys.
    keys = sorted(set([rng.randint(-50, 50) for _ in range(80)] + [10**9 + i for i in range(n)] + [10**15 + rng.randint(0, 10**14) for _ in range(300)]))
    rows = [(k, str(i)) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return len(keys), spark.createDataFrame(rows, "k long, i string").repartition(6)


def test_ordinals_of_a_key_are_dense(spark):
    n, frame = keyed(spark)
    for rows_per_cell in (10, 10**6):
        numbered = with_ordinals(frame, "k", rows_per_cell=rows_per_cell)
        assert numbered.where(F.col("ord") != F.col("i").cast("long")).isEmpty()
        assert numbered.count() == n


def test_deep_pages_by_key(spark, monkeypatch):
    n, frame = keyed(spark)
    monkeypatch.setattr(paging, "_TOP_KEYS", 0)
    monkeypatch.setattr(paging, "_ROWS_SORTED", 10)
    for page in (1, 7, n // 100, n // 100 + 1):
        rows = paging.raw_page(frame, page, 100, "k").collect()
        assert [int(r["i"]) for r in rows] == list(range((page - 1) * 100, min(n, page * 100)))
    assert paging.raw_page(frame, 9999, 100, "k").collect() == []


def test_pages_of_files_union_to_the_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    count = 0
    for name in ("b.csv", "a.csv", "c.csv"):
        body = "".join(f"{name}-{i},{i}\n" for i in range(400))
        (folder / name).write_text("Name,Score\n" + body)
        count += 400
    expected = [(f"{n}.csv-{i}", i) for n in "abc" for i in range(400)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        table = read_csv(spark, str(folder))
        seen = []
        for page in range(1, 7):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(900 * page))  # another layout for each job
            rows = paging.raw_page(table.positioned, page, 250).select("Name", "Score").collect()
            seen += [(r["Name"], int(r["Score"])) for r in rows]
        assert seen == expected
        numbered = with_ordinals(table.positioned).orderBy("ord").collect()
        assert [r["ord"] for r in numbered] == list(range(count))
        assert [(r["Name"], int(r["Score"])) for r in numbered] == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_landed_table_pages(spark, tmp_path):
    n, frame = keyed(spark)
    path = str(tmp_path / "numbered")
    paging.write_numbered(frame, path, "k")
    page = paging.numbered_page(spark.read.parquet(path), {"i": "integer"}, 3, 50)
    assert [r["i"] for r in page.collect()] == list(range(100, 150))
