"""The log of whole batches: replays, aborts, snapshots, and the objects it describes."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from larder.sources import store


def _rows(spark, path, version=None):
    return sorted(r["i"] for r in store.read_log(spark, path, "i long", version).collect())


def test_batches_replays_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "log")
    assert store.versions(path) == [] and _rows(spark, path) == []
    store.append(spark.range(5).toDF("i"), path, 0)
    store.append(spark.range(10, 12).toDF("i"), path, 1)
    store.append(spark.range(100, 200).toDF("i"), path, 1)  # comes again: nothing changes
    store.append(spark.range(0).toDF("i"), path, 2)
    assert store.versions(path) == [0, 1, 2] and _rows(spark, path) == [0, 1, 2, 3, 4, 10, 11]
    assert _rows(spark, path, 0) == [0, 1, 2, 3, 4]
    pinned = store.read_log(spark, path, "i long", 1)
    store.append(spark.range(7, 8).toDF("i"), path, 3)
    assert pinned.count() == 7 and len(_rows(spark, path)) == 8


def test_a_failed_task_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    store.append(spark.range(3).toDF("i"), path, 0)
    bad = spark.range(0, 100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("i"))
    with pytest.raises(Exception, match="no"):
        store.append(bad, path, 1)
    assert store.versions(path) == [0] and _rows(spark, path) == [0, 1, 2]
    store.append(spark.range(3, 5).toDF("i"), path, 1)
    assert _rows(spark, path) == [0, 1, 2, 3, 4]


def test_a_stream_that_loses_its_commit_logs_once(spark, tmp_path):
    path, source, state = str(tmp_path / "log"), str(tmp_path / "in"), tmp_path / "state"
    schema = "i long"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        store.append_stream(stream, path, f"file://{state}").trigger(availableNow=True).start().awaitTermination()

    for k in range(2):
        spark.range(10 * k, 10 * k + 3).toDF("i").coalesce(1).write.mode("append").parquet(source)
    run()
    assert store.versions(path) == [0, 1]
    shutil.rmtree(state / "commits")  # as if the program had ended between the sink's commit and the stream's own
    os.makedirs(state / "commits")
    spark.range(20, 23).toDF("i").coalesce(1).write.mode("append").parquet(source)
    run()
    assert _rows(spark, path) == [0, 1, 2, 10, 11, 12, 20, 21, 22]


def test_objects_put_forget_clear(spark, tmp_path):
    path = str(tmp_path / "log")
    change = lambda *rows: spark.createDataFrame(rows, store.CHANGES)
    store.append(change(("a", "cup", 1.0, 1.0, "put", 1), ("b", "box", 2.0, 2.0, "put", 2)), path, 0)
    store.append(change(("a", None, None, None, "forget", 3), ("b", "box", 5.0, 2.0, "put", 4)), path, 1)
    store.append(change((None, None, None, None, "clear", 5), ("c", "jar", 0.0, 0.0, "put", 6)), path, 2)
    names = lambda v=None: sorted((r["name"], r["px"]) for r in store.objects(spark, path, v).collect())
    assert names(0) == [("a", 1.0), ("b", 2.0)] and names(1) == [("b", 5.0)] and names() == [("c", 0.0)]
