"""Sharding by jump consistent hashing.

The shard follows from the key and the number of shards alone; there is no ring
table, and one more shard takes rows only into itself.  Slots, gapless within a
shard, come from counts of small cells (shard, bucket), not from a sort of a
whole shard: cells are dealt by row, so no key, shard or source makes one large.

Defined results: a null key has a shard like any other; a null text has no
bytes (size 8, checksum 0); repeated rows each have a slot; a very long text is
one row like any other; an empty table gives an empty table.  Other input columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.kernels import U64, mix
from larder.llm.staging import Stage


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, for the whole array at once."""
    key, b, j = keys.astype(U64), np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        b[todo] = j[todo]
        key[todo] = key[todo] * U64(2862933555777941757) + U64(1)
        j[todo] = ((b[todo] + 1) * (float(1 << 31) / ((key[todo] >> U64(33)) + U64(1)).astype(np.float64))).astype(np.int64)
        todo = todo[j[todo] < shards]
    return b.astype(np.int32)


def shard_column(key: F.Column, shards: int) -> F.Column:
    """Struct of the shard and of the shard that one more shard would give."""

    @F.pandas_udf("shard int, grown_shard int")
    def place(keys: pd.Series) -> pd.DataFrame:
        k = mix(keys.to_numpy(dtype=np.int64).view(U64))
        return pd.DataFrame({"shard": jump_hash(k, shards), "grown_shard": jump_hash(k, shards + 1)})

    return place(F.coalesce(key.cast("long"), F.lit(-(1 << 63))))


def shard(docs: DataFrame, stage: Stage, shards: int = 24, doc_id: str = "doc_id", text: str = "text", cell: int = 20_000) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, shard, slot, grown_shard."""
    t = F.col(text).cast("string")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumn("to", shard_column(F.col("doc_id"), shards)).select("doc_id", "size", "text_crc32", "row", "to.shard", "to.grown_shard")
    rows = stage.table(rows, "keys")  # row numbers hold from here on
    buckets = max(8, -(-rows.count() // (cell * shards)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard", "bucket").orderBy("row")
    return (
        rows.withColumn("at", F.row_number().over(own))
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard")
    )


def op9_jump_shards(spark, sf_dir):
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), Stage(spark, "op9"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
