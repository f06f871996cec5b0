from pyspark.sql import functions as F

from castwright import profile, read_csv
from castwright.streaming.incremental import current_profile, start_profile, update_state


def test_batches_equal_one_shot(spark, tmp_path):
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    frame = spark.range(1000).select(
        F.col("id").cast("string").alias("n"),
        F.when(F.col("id") % 7 == 0, "NA").otherwise(F.concat(F.lit("c"), (F.col("id") % 60).cast("string"))).alias("c"),
        F.when(F.col("id") < 900, "yes").otherwise("2020-01-02").alias("m"),
        F.when(F.col("id") > 990, F.col("id").cast("string")).alias("late"),
    )
    frame.repartition(8).write.parquet(folder)
    query = start_profile(spark, folder, frame.schema, state, files_per_batch=3)
    query.awaitTermination()
    assert query.exception() is None
    once = profile(spark.read.parquet(folder)).orderBy("pos").collect()
    assert current_profile(spark, state, frame.columns).orderBy("pos").collect() == once

    # A batch that comes again counts once.
    batch = spark.read.parquet(folder)
    update_state(batch, 99, frame.columns, state)
    update_state(batch, 99, frame.columns, state)
    again = {r["column"]: r for r in current_profile(spark, state, frame.columns).collect()}
    assert again["n"]["total_count"] == 2000 and again["c"]["unique_count"] == 51
    update_state(batch, 100, frame.columns, state)
    later = {r["column"]: r for r in current_profile(spark, state, frame.columns).collect()}
    assert later["n"]["total_count"] == 3000 and later["c"]["sample_values"] == again["c"]["sample_values"]


def test_state_keeps_its_size(spark, tmp_path):
    """Batches bring ever new values; folders, rows and bytes of the state stay as they are."""
    folder, state = str(tmp_path / "in"), str(tmp_path / "state")
    sizes = []
    for batch_id in range(6):
        path = f"{folder}/{batch_id}"
        spark.range(batch_id * 200, batch_id * 200 + 200).selectExpr("cast(id as string) AS n", "concat('v', id % 40) AS c").write.parquet(path)
        update_state(spark.read.parquet(path), batch_id, ["n", "c"], state)
        parts = [spark.read.parquet(f"{state}/{part}-{batch_id % 3}").count() for part in ("evidence", "values")]
        sizes.append((parts, len([p for p in (tmp_path / "state").iterdir()])))
    assert all(rows == 2 and found <= 2 * 51 for (rows, found), _ in sizes) and sizes[-1][1] == 6
    found = {r["column"]: r for r in current_profile(spark, state, ["n", "c"]).collect()}
    assert found["n"]["sample_values"] == [str(i) for i in range(5)] and found["n"]["total_count"] == 1200
    assert found["c"]["unique_count"] == 40 and found["n"]["unique_count"] == 51


def test_csv_files_as_a_stream(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    for name in ("a", "b", "c"):
        (folder / f"{name}.csv").write_text("n,note\n" + "".join(f'{i},"{name}\n{i}"\n' for i in range(50)))
    schema = "n string, note string"
    query = start_profile(spark, str(folder), spark.createDataFrame([], schema).schema, state, file_format="csv", files_per_batch=1)
    query.awaitTermination()
    once = profile(read_csv(spark, str(folder)).positioned, columns=["n", "note"]).orderBy("pos").collect()
    assert current_profile(spark, state, ["n", "note"]).orderBy("pos").collect() == once
