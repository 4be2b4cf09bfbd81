"""A map of vectors in the plane that keeps neighbourhoods: fuzzy neighbour graph, then attraction and repulsion.

Every vector's nearest neighbours get weights that fall with the distance beyond
the nearest, at a scale by which the weights of each vector have the same sum.
A pair's two weights unite to one edge.  The layout starts from the principal components and goes
in rounds: nodes are dealt to blocks by hash, each block meets its edges with the
places of their other ends, and a task moves its own nodes for some epochs,
drawing edges by weight, and pushing them from a bounded sample of all nodes.
What a round moves is written and read by the next, so a lost executor costs a
reread, and nothing but that sample is in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.metric import build_index, metric_topk
from larder.session import shared_folder

SAMPLE = 4096  # nodes that others are pushed from
CLIP = 4.0


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b by which 1 / (1 + a x^2b) is nearest to 1 up to min_dist and exp(-(x - min_dist) / spread) beyond (least squares)."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([0.0, 0.0]), 1e-3  # logarithms of a and b
    error = lambda q: 1 / (1 + np.exp(q[0]) * x ** (2 * np.exp(q[1]))) - y
    for _ in range(200):
        r = error(p)
        j = np.stack([(error(p + h) - r) / 1e-6 for h in np.eye(2) * 1e-6], axis=1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), -j.T @ r)
        better = (error(p + step) ** 2).sum() < (r**2).sum()
        p, damp = (p + step, damp / 3) if better else (p, damp * 3)
    return float(np.exp(p[0])), float(np.exp(p[1]))


def smooth(distances: np.ndarray, k: int) -> np.ndarray:
    """Weights of a vector's neighbours (rows of distances, nearest first, inf where there is none): their sum is log2(k)."""
    real = np.isfinite(distances)
    positive = np.where(real & (distances > 0), distances, np.inf).min(axis=1)
    rho = np.where(np.isfinite(positive), positive, 0)
    beyond = np.where(real, np.maximum(distances - rho[:, None], 0), np.inf)
    lo, hi, sigma = np.zeros(len(rho)), np.full(len(rho), np.inf), np.ones(len(rho))
    for _ in range(64):
        many = np.exp(-beyond / sigma[:, None]).sum(axis=1) > math.log2(k)
        hi, lo = np.where(many, sigma, hi), np.where(many, lo, sigma)
        sigma = np.where(np.isfinite(hi), (lo + hi) / 2, sigma * 2)
    mean = np.where(real, distances, 0).sum(axis=1) / np.maximum(real.sum(axis=1), 1)
    sigma = np.clip(sigma, 1e-3 * np.maximum(mean, 1e-12), 1e6)
    return np.where(real, np.exp(-beyond / sigma[:, None]), 0.0)


def fuzzy_graph(rows: DataFrame, k: int) -> DataFrame:
    """(i, j, w) in both directions: the fuzzy union of every vector's neighbours by cosine; k counts the vector itself."""
    found = metric_topk(build_index(rows), rows.withColumnRenamed("id", "qid"), k - 1, include_self=False)
    lists = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", (F.lit(1.0) - F.col("score")).alias("d")))).alias("n"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, sizes = b.column(1).flatten().to_numpy(), np.diff(b.column(1).offsets.to_numpy())
            d = np.full((b.num_rows, k - 1), np.inf)
            at = np.repeat(np.arange(b.num_rows), sizes), np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            d[at] = np.maximum(b.column(2).flatten().to_numpy(), 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(ids), pa.array(smooth(d, k)[at])], names=["i", "j", "w"])

    one = lists.select("qid", "n.id", "n.d").mapInArrow(weigh, "i long, j long, w double")
    both = one.select("i", "j", "w", F.lit(0.0).alias("v")).unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("w"), F.col("w").alias("v")))
    a, b = F.max("w"), F.max("v")
    return both.groupBy("i", "j").agg((a + b - a * b).alias("w")).where("w > 0")


def _moved(a: float, b: float, seed: int, step: int, epochs: int, first: float, last: float, most: float, pushes: int, shared):
    """One round of a block: its nodes (id, x, y) and its edges with the places of their other ends."""

    def work(key: tuple, nodes: pa.Table, edges: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("id")
        ids, p = nodes["id"].to_numpy(), np.stack([nodes["x"].to_numpy(), nodes["y"].to_numpy()], axis=1)
        sample_ids, sample = shared.value
        rng = np.random.default_rng([seed, step, key[0].as_py()])
        if len(edges):
            edges = edges.sort_by([("i", "ascending"), ("j", "ascending")])
            head, j, w = np.searchsorted(ids, edges["i"].to_numpy()), edges["j"].to_numpy(), edges["w"].to_numpy() / most
            other = np.stack([edges["xj"].to_numpy(), edges["yj"].to_numpy()], axis=1)
            here = np.minimum(np.searchsorted(ids, j), len(ids) - 1)
            own = ids[here] == j  # both ends are in this block: the other one's place of the moment is known
            for e in range(epochs):
                rate = first + (last - first) * e / epochs
                drawn = np.flatnonzero(rng.random(len(w)) < w)
                h, to = head[drawn], np.where(own[drawn, None], p[here[drawn]], other[drawn])
                apart = p[h] - to
                d2 = (apart**2).sum(axis=1)
                pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)
                move = np.clip(pull[:, None] * apart, -CLIP, CLIP)
                away = np.zeros_like(move)
                for _ in range(pushes):
                    s = rng.integers(len(sample), size=len(h))
                    off = p[h] - sample[s]
                    d2 = (off**2).sum(axis=1)
                    push = np.where(ids[h] == sample_ids[s], 0, 2 * b / ((1e-3 + d2) * (1 + a * d2**b)))
                    away += np.clip(push[:, None] * off, -CLIP, CLIP)
                np.add.at(p, h, rate * (move + away))
        return pa.table({"id": ids, "x": p[:, 0], "y": p[:, 1]})

    return work


def layout(df: DataFrame, vec: str = "vec", row_id: str = "id", k: int = 30, min_dist: float = 0.12, rounds: int = 10, epochs: int = 20, pushes: int = 5, seed: int = 0, block_rows: int = 8192) -> DataFrame:
    """(id, x, y) for every vector that is not null; ids are distinct.  The same seed gives the same map."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "layout")
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")

    def kept(some: DataFrame, name: str) -> DataFrame:
        some.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    rows = kept(rows, "rows")
    n = rows.count()
    if n < 3:
        return rows.select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    edges = kept(fuzzy_graph(rows, min(k, n)), "edges")
    most = edges.agg(F.max("w")).first()[0]
    x = rows.withColumn("f", array_to_vector("vec"))
    flat = PCA(k=min(2, len(rows.first()["vec"])), inputCol="f", outputCol="p").fit(x).transform(x).select("id", vector_to_array("p").alias("p"))
    noise = lambda i: (F.pmod(F.xxhash64(F.lit(seed + i), "id"), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-2
    size = flat.agg(F.max(F.greatest(F.abs(F.get("p", F.lit(0))), F.abs(F.coalesce(F.get("p", F.lit(1)), F.lit(0.0)))))).first()[0] or 1.0
    place = lambda i: F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)) * (10 / size)
    # rounded, so that the order in which sums are made does not show
    now = kept(flat.select("id", (F.round(place(0), 3) + noise(0)).alias("x"), (F.round(place(1), 3) + noise(1)).alias("y")), "places-0")
    a, b = curve(min_dist)
    blocks = max(1, -(-n // block_rows))
    block = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.lit(blocks)).alias("block")
    for step in range(rounds):
        h = F.xxhash64(F.lit(seed + step), "id")
        few = now.where(F.pmod(h, F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, 2 * SAMPLE / n))).orderBy(h, "id").limit(SAMPLE).collect()
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in few]), np.array([[r["x"], r["y"]] for r in few])))
        ends = edges.join(now.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")), "j")
        rate = lambda s: 1 - s / rounds
        work = _moved(a, b, seed, step, epochs, rate(step), rate(step + 1), most, pushes, shared)
        moved = now.groupBy(block("id")).cogroup(ends.groupBy(block("i"))).applyInArrow(work, "id long, x double, y double")
        now = kept(moved, f"places-{step + 1}")
        shared.destroy()
    return now


def preserved(df: DataFrame, places: DataFrame, vec: str = "vec", row_id: str = "id", k: int = 15) -> float:
    """The share of the vectors' k nearest neighbours (by cosine) that are among their k nearest in the plane."""
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    # nearest in the plane are nearest by angle on a large sphere that touches it
    far = places.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    flat = places.select("id", F.array("x", "y", F.lit(20.0 * far)).alias("vec"))
    lists = [metric_topk(build_index(x), x.withColumnRenamed("id", "qid"), k, include_self=False).select("qid", "id") for x in (rows, flat)]
    return lists[0].join(lists[1], ["qid", "id"]).count() / max(lists[0].count(), 1)
