"""Event-time and latest-value operators; all work on streams and on batches alike."""

from __future__ import annotations

from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources.files import filesystem


def event_time(df: DataFrame, ts: str = "ts", late: str | None = None) -> DataFrame:
    """The time column as a timestamp with a zone, with a watermark if `late` is given."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if late else out


def _stats(value: str) -> list[Column]:
    return [F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("peak")]


def tumbling(df: DataFrame, size: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, size), *keys).agg(*_stats(value)).select(F.col("window.start").alias("start"), *keys, "n", "total", "mean", "peak")


def sliding(df: DataFrame, size: str, step: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.window(ts, size, step), *keys).agg(*_stats(value)).select(F.col("window.start").alias("start"), *keys, "n", "total", "mean", "peak")


def sessions(df: DataFrame, gap: str, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(F.session_window(ts, gap), *keys).agg(*_stats(value)).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n", "total", "mean", "peak"
    )


def latest(df: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """The last values by key."""
    return df.groupBy(*keys).agg(F.max(F.struct(ts, *values)).alias("x")).select(*keys, F.col(f"x.{ts}").alias(ts), *(F.col(f"x.{v}").alias(v) for v in values))


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """First of each key; on a watermarked stream within its watermark."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def run_to_end(stream: DataFrame, name: str | None, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there; its rows (in `complete` mode those of the last batch) as Parquet beside the checkpoint."""
    out = f"{checkpoint}-rows"
    writer = (stream.writeStream.queryName(name) if name else stream.writeStream).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", out)
    else:  # a folder for each batch, so a reader of the one before is not disturbed
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{number:019d}"))
    writer.start().awaitTermination()
    if mode != "append":
        system, place = filesystem(out)
        done = [f.path for f in system.get_file_info(FileSelector(place, allow_not_found=True, recursive=True)) if f.base_name == "_SUCCESS"]
        out = f"{out}/{max(done).rsplit('/', 2)[-2]}" if done else out
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
