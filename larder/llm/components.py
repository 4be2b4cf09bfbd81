"""Connected components of an edge table by alternating large and small stars.

Every round rereads written tables, so lost executors cost a reread and no
lineage grows.  Minima are aggregated before they are joined back, and both
sides of each join come straight from tables, so a hub's rows can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import Stage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return r[0], r[1]


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(u, v) pairs of longs to (node, component), the smallest node reachable; only nodes with an edge."""
    now = stage.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"large-{k}")
        # now holds u > v: each u is a larger neighbour of v, and goes to the least around v
        large = now.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large = stage.table(large, f"edges-{k}-large")
        least = stage.table(large.groupBy("u").agg(F.min("v").alias("m")), f"small-{k}")
        # smaller neighbours of u, and u itself, go to the least of them
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stage.table(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"edges-{k}")
        new = _state(small)
        for name in (f"large-{k}", f"small-{k}", f"edges-{k}-large", f"edges-{k - 1}"):
            stage.drop(name)
        now, done, state = small, new == state, new
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
