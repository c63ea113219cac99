"""Folders of a collection hold a file or a few, whatever the number of tasks; parts of all batches are stored in one pass."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from collegium.operators import folds
from collegium.sources import files
from collegium.streaming import monitor


def test_a_bucket_gets_one_file(spark, tmp_path):
    path = f"file://{tmp_path}/held"
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 499).alias("owner"), "id")
    files.write_collection(rows, path, folder_rows=400)
    files.write_collection(rows.where("owner < 100 AND id % 2 = 0"), path)
    folders = list(Path(tmp_path, "held").glob("bucket=*/_version=*"))
    assert len(folders) >= 10 and all(len(list(f.glob("*.parquet"))) == 1 for f in folders)
    got = sorted(r.id for r in files.read_collection(spark, path).collect())
    assert got == [i for i in range(4000) if i % 499 >= 100 or i % 2 == 0]


def test_batches_in_one_pass(spark, tmp_path):
    path, counts = f"file://{tmp_path}/parts", {"n": F.col("v") > 1}
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", 3), (2, "b", 0), (3, "b", 5)], "step int, k string, v int")
    folds.store_batches(rows, path, "step", ["k"], counts)
    folds.store_partials(rows.where("step = 3"), path, "3", ["k"], counts)
    folds.store_batches(rows.where("step = 2 AND k = 'b'"), path, "step", ["k"], counts)
    assert {r.k: r.n for r in folds.merged_partials(spark, path, ["k"], ["n"]).collect()} == {"a": 1, "b": 1}


def test_a_capture_in_many_files_is_one_capture(spark, tmp_path):
    path, ledger = f"file://{tmp_path}/in", f"file://{tmp_path}/ledger"
    for day in (1, 2):
        items = spark.range(0, 40 - day, 1, 4).select(F.lit("f").alias("family"), F.col("id").cast("string").alias("item"), F.lit("t").alias("title"), F.lit("b").alias("body"), F.lit(f"2024-01-0{day}T00:00:00Z").alias("captured"))
        items.write.mode("append").json(path)
        monitor.start_monitor(monitor.read_captures(spark, path), ledger, f"file://{tmp_path}/state", parts=2).awaitTermination()
    found = monitor.read_ledger(spark, ledger).groupBy(F.dayofmonth("captured").alias("day"), "change").count().collect()
    assert {(r.day, r.change): r["count"] for r in found} == {(1, "new"): 39, (2, "unchanged"): 38, (2, "removed"): 1}
