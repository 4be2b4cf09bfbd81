"""Exact nearest vectors through a written index that the triangle inequality prunes.

Vectors are dealt to the nearest of a bounded number of centres, and each
centre's vectors to rings by their angle to it; a ring (split by hash where one
angle is common) is a leaf of bounded size.  Angles between vectors are a metric,
so a query at angle a to a centre is at least as far from all of a ring as a is
outside of the ring's range.

A search first asks each query's most promising leaves, which hold k vectors at
least; the k-th best of these bounds the answer, and only leaves that can be
nearer are asked as well.  Leaves lie together in tiles; a query goes once to
each tile that has leaves for it, with their numbers, and groups of bounded size
meet there on both sides.  Queries are rows like any other: nothing is read again for
more of them, and leaves that no query needs are not multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from larder.session import checkpointed, shared_folder

CENTRES_BYTES = 16 << 20  # of the centres that are broadcast, at most
LEAVES = 200_000  # ranges of rings that are broadcast, at most (besides one for each centre)
SLACK = 1e-6  # of angles, for rounding
TIES = 1e-11  # of scores, beyond their rounding
CELLS = 1 << 20  # queries x leaves, queries x vectors and the like worked on at a time
TILE_BYTES = 8 << 20  # of the vectors of a tile, about; up to four times as much where there would be more than TILES
TILES = 12


@dataclass
class Index:
    table: DataFrame  # tile, leaf, id, vec (of unit length or zero)
    centres: np.ndarray
    leaves: np.ndarray  # leaf (0 on), centre, least angle, largest angle, vectors, tile; a row each


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1, 1))


def build_index(items: DataFrame, item_id: str = "id", item_vec: str = "vec", leaf_rows: int = 1024, centres: int | None = None, path: str | None = None) -> Index:
    """The index of all vectors that are not null, of one length, written below the shared folder or at `path`.

    `centres` defaults to the square root of the number of vectors; they are a sample by hash of the id.
    """
    spark, folder = items.sparkSession, path or shared_folder(items.sparkSession, "metric")
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_vec).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    n, dim = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return Index(spark.createDataFrame([], "tile long, leaf long, id long, vec array<double>"), np.zeros((0, 1)), np.zeros((0, 6)))
    wanted = max(1, min(centres or math.isqrt(n), CENTRES_BYTES // (8 * dim)))
    chosen = rows.where(F.exists("vec", lambda v: v != 0)).orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # of bounded size
    at = _units(np.array([r["vec"] for r in chosen])) if chosen else np.zeros((1, dim))
    at = np.unique(at, axis=0)
    shared = spark.sparkContext.broadcast(at)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                x = _units(_matrix(b.column(1), b.num_rows))
                a = _angles(x, shared.value)
                best = np.where(x.any(axis=1), a.argmin(axis=1), -1)  # zero vectors are as far from everything
                angle = np.where(best < 0, np.pi / 2, a.min(axis=1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64())), pa.array(best), pa.array(angle)], names=["id", "vec", "centre", "angle"])

    rows.mapInArrow(assign, "id long, vec array<double>, centre long, angle double").write.parquet(f"{folder}/assigned")
    assigned = spark.read.parquet(f"{folder}/assigned")
    leaf_rows = max(leaf_rows, -(-n // LEAVES))
    spans = assigned.groupBy("centre").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    spans = spans.withColumn("rings", F.ceil(F.col("n") / leaf_rows))
    ring = F.least(F.floor((F.col("angle") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * F.col("rings")), F.col("rings") - 1)
    dealt = assigned.join(F.broadcast(spans.drop("n")), "centre").withColumn("ring", ring).drop("lo", "hi", "rings")  # a row for each centre
    rings = dealt.groupBy("centre", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
    rings = checkpointed(rings.withColumn("splits", F.ceil(F.col("n") / (2 * leaf_rows))).withColumn("first", F.sum("splits").over(Window.orderBy("centre", "ring")) - F.col("splits")))
    leaf = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("splits"))).alias("leaf")
    # about n / splits of a ring's vectors in each of its leaves, so tiles are of about the same size
    many = max(1, min(max(TILE_BYTES, 8 * dim * n // TILES), 4 * TILE_BYTES) // (8 * dim))
    rows_before = F.sum("n").over(Window.orderBy("centre", "ring")) - F.col("n")
    placed = checkpointed(rings.withColumn("tile", F.floor((rows_before + F.col("n") / 2) / many)))
    known = F.broadcast(placed.select("centre", "ring", "splits", "first", "tile"))  # LEAVES and centres at most
    dealt.join(known, ["centre", "ring"]).select("tile", leaf, "id", "vec").repartitionByRange("tile", "leaf").sortWithinPartitions("tile").write.parquet(f"{folder}/leaves")
    table = spark.read.parquet(f"{folder}/leaves")
    sizes = table.groupBy("leaf").count()
    of = placed.select("centre", "lo", "hi", "tile", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("splits") - 1)).alias("leaf")).join(sizes, "leaf", "left")
    found = of.select("leaf", "centre", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count"), "tile").orderBy("leaf").collect()  # a bounded number of ranges
    return Index(table, at, np.array([tuple(map(float, r)) for r in found]).reshape(-1, 6))


def _reach(x: np.ndarray, centres: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """The least angle that each leaf leaves open, for each query."""
    angle = np.where(x.any(axis=1)[:, None], _angles(x, centres), np.pi / 2)
    zero = leaves[:, 1] < 0
    a = np.where(zero, np.pi / 2, angle[:, leaves[:, 1].astype(np.int64)])
    reach = np.maximum(np.maximum(leaves[:, 2] - a, a - leaves[:, 3]), 0)
    reach[:, zero] = np.pi / 2
    reach[~x.any(axis=1)] = np.pi / 2
    return reach


ASKED = "tile long, qid {kind}, vec array<double>, leaves array<long>, low double"


def _asked(shared, k: int, more: bool):
    """Rows (tile, qid, vec, leaves, low): leaves to ask.  At first the nearest that hold k + 1 vectors; then the others within `bound`.

    No score below `low` is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, leaves = shared.value
        tiles = leaves[:, 5].astype(np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, step := max(1, CELLS // (len(leaves) + 8 * len(centres[0])))):
                b = whole.slice(lo, step)
                x = _units(_matrix(b.column(1), b.num_rows))
                reach = _reach(x, centres, leaves)
                order = np.argsort(reach, axis=1, kind="stable")
                before = np.cumsum(leaves[order, 4], axis=1) - leaves[order, 4]
                first = np.zeros(reach.shape, dtype=bool)
                np.put_along_axis(first, order, before < k + 1, axis=1)
                if more:
                    bound = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                    first = ~first & (reach <= bound[:, None] + SLACK)
                q, at = np.nonzero(first)
                starts = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (tiles[at[1:]] != tiles[at[:-1]]))) if len(q) else np.zeros(0, np.int64)
                rows = max(1, CELLS // max(1, len(centres[0])))
                for i in range(0, len(starts), rows):
                    some, upto = starts[i : i + rows], starts[i + rows] if i + rows < len(starts) else len(q)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(some, upto).astype(np.int32) - int(some[0])), pa.array(at[some[0] : upto]))
                    own = pa.array(q[some])
                    low = b.column(3).take(own) if more else pa.array(np.full(len(own), -2.0))
                    yield pa.RecordBatch.from_arrays([pa.array(tiles[at[some]]), b.column(0).take(own), b.column(1).take(own), lists, low], names=["tile", "qid", "vec", "leaves", "low"])

    return run


def _multiplied(kind: str, k: int, include_self: bool):
    """Each leaf of a tile with the queries that ask it; the best k of each query in the tile.

    Scores are compared with the least that still counts, and only those that pass are kept and sorted.
    """

    def work(key: tuple, queries: pa.Table, items: pa.Table) -> pa.Table:
        qs, ids, scores, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], 0
        if len(queries) and len(items):
            items = items.sort_by("leaf")
            leaf, every = items["leaf"].to_numpy(), items["id"].to_numpy()
            q, x = (_units(_matrix(t["vec"].combine_chunks(), len(t))) for t in (queries, items))
            asked, low = queries["leaves"].combine_chunks(), queries["low"].to_numpy().copy()
            row = np.repeat(np.arange(len(q)), np.diff(asked.offsets.to_numpy()))
            wanted = asked.flatten().to_numpy()
            order = np.argsort(wanted, kind="stable")
            row, wanted = row[order], wanted[order]
            own = queries["qid"].to_numpy() if kind == "long" and not include_self else None
            most = k if own is None else k + 1  # one of them may be the query itself
            for l in np.unique(wanted):
                a, b = np.searchsorted(leaf, [l, l + 1])
                who = row[np.searchsorted(wanted, l) : np.searchsorted(wanted, l + 1)]
                if a == b:
                    continue
                for lo in range(0, len(who), step := max(1, CELLS // (b - a))):
                    some = who[lo : lo + step]
                    s = q[some] @ x[a:b].T
                    near = s >= low[some, None] - TIES
                    if b - a > most and np.count_nonzero(near) > 4 * most * len(some):
                        low[some] = np.maximum(low[some], np.partition(s, b - a - most, axis=1)[:, b - a - most])
                        near = s >= low[some, None] - TIES
                    i, c = np.nonzero(near)
                    if own is not None:
                        other = own[some[i]] != every[a + c]
                        i, c = i[other], c[other]
                    qs.append(some[i])
                    ids.append(every[a + c])
                    scores.append(np.round(s[i, c], 12))
                    held += len(i)
                    if held > min(CELLS, max(1 << 16, 3 * k * len(q))):
                        qs, ids, scores = ([z] for z in _first(k, *map(np.concatenate, (qs, ids, scores))))
                        held, last = len(qs[0]), np.arange(k - 1, len(qs[0]))
                        last = last[qs[0][last] == qs[0][last - k + 1]]  # the k-th of those that have as many
                        low[qs[0][last]] = np.maximum(low[qs[0][last]], scores[0][last])
        at, i, s = _first(k, *map(np.concatenate, (qs, ids, scores)))
        return pa.table([queries["qid"].take(pa.array(at)), pa.array(i), pa.array(s)], names=["qid", "id", "score"])

    return work


def _first(k: int, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[rank < k], scores[rank < k]


GROUP = 4096  # queries that a tile is asked at a time; of many, up to four times as many


def _met(index: Index, asked: DataFrame, kind: str, k: int, include_self: bool) -> DataFrame:
    """The best k of every tile for every query that asks it."""
    counts = asked.groupBy("tile").agg(F.ceil(F.count("*") / F.greatest(F.lit(GROUP), F.least(F.lit(4 * GROUP), F.count("*") / 32))).cast("int").alias("groups"))
    group = F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int").alias("part")
    left = asked.join(F.broadcast(counts), "tile").select("tile", group, "qid", "vec", "leaves", "low")  # a row for each tile
    right = index.table.join(F.broadcast(counts), "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "leaf", "id", "vec")
    both = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part"))
    return both.applyInArrow(_multiplied(kind, k, include_self), f"qid {kind}, id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def metric_topk(index: Index, queries: DataFrame, k: int, query_id: str = "qid", query_vec: str = "vec", include_self: bool = True, least: float | None = None, report: dict | None = None) -> DataFrame:
    """The k vectors with the largest cosine for each query: qid, id, score, rank (from 1); ties go to the smaller id.

    With `least` only those with such a cosine.  `report` is given the number of `pairs` of queries and vectors and how
    many of them were `multiplied`.
    """
    spark, kind = queries.sparkSession, queries.schema[query_id].dataType
    kind = "long" if isinstance(kind, IntegralType) else "string"
    q = queries.select(F.col(query_id).cast(kind).alias("qid"), F.col(query_vec).cast("array<double>").alias("vec")).where("qid IS NOT NULL AND vec IS NOT NULL")
    if not len(index.leaves):
        return spark.createDataFrame([], f"qid {kind}, id long, score double, rank int")
    q = checkpointed(q)
    shared = spark.sparkContext.broadcast((index.centres, index.leaves))
    asked = q.mapInArrow(_asked(shared, k, False), ASKED.format(kind=kind))
    first = checkpointed(_best(_met(index, asked, kind, k, include_self), k).drop("rank"))
    last = first.groupBy("qid").agg(F.min("score").alias("last"), F.count("*").alias("n"))
    bound = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(F.col("n") >= k, F.col("last")).otherwise(-1.0))))
    if least is not None:
        bound = F.least(bound, F.lit(math.acos(max(-1.0, min(1.0, least)))))
    low = F.greatest(F.when(F.col("n") >= k, F.col("last")).otherwise(-2.0), F.lit(-2.0 if least is None else least - 1e-12))
    bounded = q.join(last, "qid", "left").select("qid", "vec", F.coalesce(bound, F.lit(math.pi)).alias("bound"), low.alias("low"))
    others = bounded.mapInArrow(_asked(shared, k, True), ASKED.format(kind=kind))
    if report is not None:
        sizes = spark.createDataFrame([(int(r[0]), int(r[4])) for r in index.leaves], "leaf long, n long")
        done = asked.unionByName(others).select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().join(sizes, "leaf").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
        report |= {"pairs": q.count() * int(index.leaves[:, 4].sum()), "multiplied": done or 0}
    found = first.unionByName(_met(index, others, kind, k, include_self))
    return _best(found if least is None else found.where(F.col("score") >= least - 1e-12), k)
