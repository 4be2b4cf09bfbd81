"""Mini-batch k-means: centres move by batches, each at a rate that falls with the vectors it has taken.

Batches are parts of the rows by hash, so none is drawn by a sort; the rows of
all batches that will be used are written once, a folder for each.  A batch is
assigned and summed on executors, and only k sums reach the driver.  Starts are
tried as tasks: each seeds centres on a bounded sample, far ones likelier, lets
them settle there, and the one with the least inertia on another sample goes on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import shared_folder


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0)


def seeded(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of x, each drawn in proportion to its squared distance from those before."""
    chosen = [x[rng.integers(len(x))]]
    near = _squares(x, chosen[0][None])[:, 0]
    for _ in range(k - 1):
        total = near.sum()
        at = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        chosen.append(x[at])
        near = np.minimum(near, _squares(x, x[at][None])[:, 0])
    return np.stack(chosen)


def settled(x: np.ndarray, centres: np.ndarray, rounds: int = 5) -> np.ndarray:
    """The centres after a few full rounds on x; those without a row stay."""
    for _ in range(rounds):
        own = _squares(x, centres).argmin(axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _sampled(rows: DataFrame, n: int, total: int, seed: int) -> np.ndarray:
    """About n rows by hash (all, if there are fewer), in the hash's order."""
    h = F.xxhash64(F.lit(seed), "id")
    some = rows.where(F.pmod(h, F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * min(1.0, 2 * n / max(total, 1)))))
    return np.array([r["vec"] for r in some.orderBy(h, "id").limit(n).collect()])


def _partial(shared):
    """Counts, sums and inertia of a batch by centre, a row for each centre and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        n, sums, inertia = np.zeros(len(centres), np.int64), np.zeros_like(centres), np.zeros(len(centres))
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), b.num_rows)
                d = _squares(x, centres)
                own = d.argmin(axis=1)
                n += np.bincount(own, minlength=len(centres))
                np.add.at(sums, own, x)
                inertia += np.bincount(own, d.min(axis=1), len(centres))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.float64())), pa.array(inertia[at])], names=["c", "n", "s", "i"])

    return run


def fit(df: DataFrame, vec: str = "vec", row_id: str = "id", k: int = 12, batch_size: int = 2048, n_init: int = 20, max_batches: int = 60, patience: int = 10, seed: int = 0) -> np.ndarray:
    """Centres of the vectors that are not null.

    `batch_size` rows make a batch and 3 times as many a sample for the starts; at most `max_batches` are taken, fewer
    where the smoothed inertia of a row does not fall for `patience` of them.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    total = rows.count()
    if not total:
        return np.zeros((0, 0))
    k = min(k, total)
    shared = spark.sparkContext.broadcast((_sampled(rows, 3 * batch_size, total, seed), _sampled(rows, 3 * batch_size, total, seed + 1)))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, check = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                c = settled(x, seeded(x, k, np.random.default_rng([seed, i])))
                yield pa.RecordBatch.from_pydict({"i": [i], "inertia": [float(_squares(check, c).min(axis=1).sum())], "c": [c.ravel().tolist()]})

    tried = spark.range(n_init, numPartitions=min(n_init, spark.sparkContext.defaultParallelism)).mapInArrow(start, "i long, inertia double, c array<double>")
    centres = np.array(tried.orderBy("inertia", "i").first()["c"]).reshape(k, -1)
    parts = max(1, round(total / batch_size))  # batches that the rows make
    used = min(parts, max_batches)
    at = shared_folder(spark, "batches")
    numbered = rows.select("vec", F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(parts)).alias("batch")).where(F.col("batch") < used)
    numbered.repartition(min(used, 4 * spark.sparkContext.defaultParallelism), "batch").write.partitionBy("batch").parquet(at)
    batches = spark.read.schema("vec array<double>, batch long").parquet(at)
    taken, smooth, best, waited = np.zeros(k), None, math.inf, 0
    for step in range(max_batches):
        now = spark.sparkContext.broadcast(centres)
        sums = batches.where(F.col("batch") == step % used).select("vec").mapInArrow(_partial(now), "c long, n long, s array<double>, i double").collect()  # k rows a task
        now.destroy()
        n, s = np.zeros(k), np.zeros_like(centres)
        for r in sums:
            n[r["c"]] += r["n"]
            s[r["c"]] += r["s"]
        if not n.sum():
            continue
        before = taken.copy()
        taken += n
        some = n > 0
        centres = centres.copy()
        centres[some] = (centres[some] * before[some, None] + s[some]) / taken[some, None]  # a rate of 1 / taken for each vector
        if step % used == used - 1:
            taken = np.minimum(taken, n.sum())  # what a centre was given before its rows settled is not held for ever
        inertia = sum(r["i"] for r in sums) / n.sum()
        weight = min(1.0, 2 * batch_size / (total + 1))
        smooth = inertia if smooth is None else smooth * (1 - weight) + inertia * weight
        best, waited = (smooth, 0) if smooth < best * (1 - 1e-4) else (best, waited + 1)
        if waited >= patience:
            break
    return centres


def assign(df: DataFrame, centres: np.ndarray, vec: str = "vec") -> DataFrame:
    """The rows with `cluster` (null where the vector is) and `distance` to its centre."""
    names = [c for c in df.columns if c not in ("cluster", "distance")]
    shared = df.sparkSession.sparkContext.broadcast(centres)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                column = b.column(names.index(vec))
                known = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)) if len(c) else np.zeros(0, np.int64)
                own, far = np.full(b.num_rows, -1), np.zeros(b.num_rows)
                if len(known):
                    d = _squares(_matrix(column.take(pa.array(known)), len(known)), c)
                    own[known], far[known] = d.argmin(axis=1), np.sqrt(d.min(axis=1))
                none = own < 0
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32), mask=none), pa.array(far, mask=none)], names=[*names, "cluster", "distance"])

    return df.select(*names).mapInArrow(run, f"{schema}, cluster int, distance double")
