"""Intermediate folders, and results of streams that are written anew with each batch."""

import os

from pyspark.sql import functions as F

from larder import session
from larder.streaming import windows


def test_intermediate_folders_go(spark):
    kept = session.shared_folder(spark, "kept")
    spark.range(3).write.parquet(kept)
    with session.intermediates():
        made = session.shared_folder(spark, "made")
        spark.range(3).write.parquet(made)
        session.shared_folder(spark, "never-written")
        assert os.path.isdir(made.removeprefix("file://"))
    assert not os.path.exists(made.removeprefix("file://")) and spark.read.parquet(kept).count() == 3


def test_complete_results_are_versioned(spark, tmp_path):
    source, state = str(tmp_path / "in"), f"file://{tmp_path}/state"

    def run():
        stream = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(source).groupBy("k").agg(F.count("*").alias("n"))
        return windows.run_to_end(stream, None, state, "complete")

    for _ in range(2):
        spark.range(4).select((F.col("id") % 2).alias("k")).coalesce(1).write.mode("append").parquet(source)
    first = run()
    assert sorted(map(tuple, first.collect())) == [(0, 4), (1, 4)]
    spark.range(1).select(F.col("id").alias("k")).coalesce(1).write.mode("append").parquet(source)
    assert sorted(map(tuple, run().collect())) == [(0, 5), (1, 4)]
    assert sorted(map(tuple, first.collect())) == [(0, 4), (1, 4)]  # whoever reads the one before still can
    assert sorted(map(tuple, run().collect())) == [(0, 5), (1, 4)]  # nothing new
