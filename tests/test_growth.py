"""Inputs and scans that grow with their tables."""

import numpy as np
from pyspark.sql import functions as F

from castwright.llm import decontaminate, hnsw
from castwright.sources import csv as csv_source
from workload import inputs


def scans(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_files_grow_with_the_table():
    assert [inputs.pieces(n, 4, 100) for n in (0, 400, 401, 100_000)] == [4, 4, 5, 1000]


def test_orders_are_dealt_before_their_texts_are_made(spark, tmp_path, monkeypatch):
    rows = [(i, i % 7, "O", 1000.5 + i, f"1995-0{1 + i % 9}-11", "1-URGENT") for i in range(300)] + [(5, 1, None, None, None, None)]
    shape = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    spark.createDataFrame(rows, shape).withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(inputs, "ROWS_PER_FILE", 20)
    monkeypatch.setattr(inputs.pieces, "__defaults__", (20,))
    frame = inputs.raw_orders_in_order(spark, str(tmp_path))
    assert frame.rdd.getNumPartitions() == 16
    assert sorted(map(str, frame.collect())) == sorted(map(str, inputs.raw_orders(spark, str(tmp_path)).collect()))
    keys = [row["row_ord"] for row in frame.select("row_ord").collect()]
    assert keys == sorted(keys)


def test_lines_are_read_once_where_no_row_holds_a_line_break(spark, tmp_path):
    (tmp_path / "plain.csv").write_bytes(b'a,b\n1,"x,""y"\n\n2,z\n')
    (tmp_path / "broken.csv").write_bytes(b'a,b\n1,"x\ny"\n2,z\n')
    (tmp_path / "endless.csv").write_bytes(b'a,b\n1,x\n2,"z\n')
    found = {}
    for name in ("plain", "broken", "endless"):
        files = csv_source.read_rows(spark, f"{tmp_path}/{name}.csv")
        found[name] = scans(files.rows), [(r["row"], r["cells"], r["problem"]) for r in files.rows.orderBy("row").collect()]
    assert found["plain"] == (1, [(2, ["1", 'x,"y'], None), (3, ["2", "z"], None)])
    assert found["broken"] == (2, [(2, ["1", "x\ny"], None), (3, ["2", "z"], None)])
    assert found["endless"][1][0] == (2, ["1", "x"], None) and found["endless"][1][1][2] == "quote"


def test_shards_grow_with_the_root_of_the_vectors():
    assert hnsw.shard_size(1_000, 64) == hnsw.SHARD
    visits = [n // 20 * -(-n // hnsw.shard_size(n, 64)) for n in (10_256, 51_282)]
    assert visits[1] < 13 * visits[0]  # shards of one size: 21 times
    assert hnsw.shard_size(10**9, 64) == hnsw.MOST and hnsw.shard_size(10**9, 4096) == hnsw.SHARD


def test_search_scores_only_what_it_has_not_seen(monkeypatch):
    x = np.random.default_rng(0).standard_normal((700, 12)).astype(np.float32)
    levels, scored, einsum = hnsw.build(x), [], np.einsum
    monkeypatch.setattr(hnsw.np, "einsum", lambda how, a, b: (scored.append(b.size // 12) if how == "ij,ij->i" else None, einsum(how, a, b))[1])
    found = hnsw.search(x[:40], x, levels, 64)
    assert 0 < sum(scored) <= 40 * 700
    want = np.argsort(-(x[:40] @ x.T), axis=1)[:, :20]
    assert np.mean([len({*a[:20]} & {*b}) / 20 for a, b in zip(found.tolist(), want.tolist())]) >= 0.95
    assert all(len({*a}) == 64 for a in found.tolist())


def test_terms_are_ordered_by_counting():
    terms = np.random.default_rng(0).integers(0, decontaminate.TERMS, 5000).astype(np.uint32)
    assert decontaminate.TERMS <= 1 << 16 and (decontaminate.by_term(terms) == np.argsort(terms, kind="stable")).all()
