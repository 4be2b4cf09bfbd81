"""Near-duplicate embeddings through navigable small-world graphs per shard.

Equal vectors (by 128 bits of hash) are one node that counts for all their ids,
so a group of copies is one point of one graph.  Nodes are dealt to shards by a
hash of their id; every shard has a graph, and every node queries every shard: a
task holds one shard and reads slices of another's vectors.  All queries start
on the graph.  A query whose beam is full of links, or not filled, is asked again
with twice the beam until the beam reaches beyond them or, with the neighbours of
its nodes, would look at the whole shard, which then is scanned.
Each task audits a sample of its queries against brute force and doubles all
beams until the mean recall of the audited queries that have links (to other ids)
reaches `recall`.  Where the samples of all tasks hold few such queries, they are
made larger; and where their pooled recall at the first beams is too low, all
tasks start with wider ones.  Cosines are verified in double precision.  A task
returns link counts and the edges of a spanning forest, never all its pairs;
components unite the forests.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are kept; vectors of different lengths do not
link; repeated rows are one vector, and different vectors under one id never
link with each other; a null id is kept, unlinked, without a component; an
empty table gives an empty table.  Other input columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.hnsw import Hnsw, pack, unpack
from larder.llm.kernels import U64, mix
from larder.llm.sstable import filesystem
from larder.llm.staging import Stage

NEIGHBOURS = 16  # of a node, which a beam looks at for each node in it
CHUNK = 1 << 21  # numbers in a table that a task works on at a time: pairs x dimensions, queries x nodes, queries x beam


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision, safe for very large and very small components."""
    a, b = (v / np.abs(v).max(axis=1, keepdims=True) for v in (a, b))
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def build_shards(vectors: DataFrame, root: str, shards: dict[int, int], width: int, ef: int) -> list[dict]:
    """vectors: id, dim, shard, vector, weight.  Two files per shard: its graph with ids, weights and vectors, and these alone for queries."""
    spark = vectors.sparkSession
    places = {(d, s): i for i, (d, s) in enumerate((d, s) for d in sorted(shards) for s in range(shards[d]))}
    table = spark.createDataFrame([(d, s, i) for (d, s), i in places.items()], "dim int, shard int, part int")
    dealt = vectors.join(F.broadcast(table), ["dim", "shard"]).repartitionById(len(places), "part").select("id", "dim", "shard", "vector", "weight")  # a row per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights, parts, where = [], [], [], None
        for batch in batches:
            if batch.num_rows:
                where = (batch.column(1)[0].as_py(), batch.column(2)[0].as_py())
                ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                weights.append(batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64))
                parts.append(_matrix(batch.column(3), where[0]))
        if not ids:
            return
        i, w, x = np.concatenate(ids), np.concatenate(weights), np.concatenate(parts)
        order = np.lexsort((*x.T[:1], i))
        i, w, x = i[order], w[order], x[order]
        index = Hnsw.build(_unit(x), mix(i.view(U64) ^ (np.arange(len(i), dtype=U64) << U64(40))), width, ef)
        system, folder = filesystem(root)
        system.create_dir(folder, recursive=True)
        name = f"{where[0]}-{where[1]}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{folder}/{name}.npz", compression=None) as f:
            f.write(pack({"ids": i, "weights": w, "vectors": x} | index.to_arrays()))
        with system.open_output_stream(f"{folder}/{name}.raw", compression=None) as f:
            f.write(i.astype("<i8").tobytes())
            f.write(x.astype("<f8").tobytes())
        yield pa.RecordBatch.from_pydict({"dim": pa.array([where[0]], pa.int32()), "path": [f"{root}/{name}"], "count": pa.array([len(i)], pa.int64())})

    return [r.asDict() for r in dealt.mapInArrow(run, "dim int, path string, count long").collect()]  # a row per shard


def _slice(path: str, count: int, dim: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors lo to hi of a shard; nothing else is read."""
    system, place = filesystem(f"{path}.raw")
    with system.open_input_file(place) as f:
        f.seek(8 * lo)
        ids = np.frombuffer(f.read(8 * (hi - lo)), "<i8")
        f.seek(8 * (count + lo * dim))
        return ids, np.frombuffer(f.read(8 * dim * (hi - lo)), "<f8").reshape(-1, dim)


class _Shard:
    def __init__(self, path: str):
        system, place = filesystem(f"{path}.npz")
        with system.open_input_file(place) as f:
            a = unpack(f.read())
        self.ids, self.weights, self.x = a.pop("ids"), a.pop("weights"), a.pop("vectors")
        self.unit = _unit(self.x)
        self.index = Hnsw.from_arrays(self.unit, a)

    def links(self, q: np.ndarray, unit: np.ndarray, ids: np.ndarray, least: float, ef: int, recall: float, audit: int) -> tuple[np.ndarray, np.ndarray, int, float, float]:
        """As `gather`, with all pairs (query, node) at once: for shards and slices of few links."""
        into, *audited = self.gather(q, unit, ids, least, ef, recall, audit, _Pairs)
        return *into.all(), *audited

    def gather(self, q: np.ndarray, unit: np.ndarray, ids: np.ndarray, least: float, ef: int, recall: float, audit: int, sink) -> tuple:
        """Puts pairs (query, node) with cosine >= least into a new sink, chunk by chunk.

        Returns it, and how many audited queries have links here, and their mean recall at `ef` and at the end.
        """
        n, near, first = len(self.ids), least - 1e-5, None
        sample = np.argsort(mix(ids.view(U64) ^ U64(0x5EED)))[:audit]
        truth = self._exact(q, unit, ids, sample, least)
        linked = sample[truth[sample] > 0]
        while True:
            into, got = sink(), np.zeros(len(ids), dtype=np.int64)
            for a, b in self._verified(q, self._search(unit, near, ef), least):
                got += np.bincount(a[ids[a] != self.ids[b]], minlength=len(ids))
                into.add(a, b)
            measured = float(np.mean(got[linked] / truth[linked])) if len(linked) else 1.0
            first = measured if first is None else first
            if measured >= recall or ef >= n:
                return into, len(linked), first, measured
            ef *= 2

    def _verified(self, q: np.ndarray, candidates: Iterator[tuple[np.ndarray, np.ndarray]], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs whose cosine is verified, so many at a time that their vectors take a few MB."""
        step = max(256, CHUNK // q.shape[1])
        for a, b in candidates:
            for lo in range(0, len(a), step):
                x, y = a[lo : lo + step], b[lo : lo + step]
                sure = _cosines(q[x], self.x[y]) >= least
                yield x[sure], y[sure]

    def _whole(self, unit: np.ndarray, rows: np.ndarray, near: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates of some queries among all nodes, so many queries at a time that their products take a few MB."""
        step = max(1, CHUNK // len(self.ids))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            a, b = np.nonzero(unit[part] @ self.unit.T >= near)
            yield part[a], b

    def _exact(self, q: np.ndarray, unit: np.ndarray, ids: np.ndarray, rows: np.ndarray, least: float) -> np.ndarray:
        """True links of each of `rows` with other ids, as counts over all queries."""
        out = np.zeros(len(ids), dtype=np.int64)
        for a, b in self._verified(q, self._whole(unit, rows, least - 1e-5), least):
            out += np.bincount(a[ids[a] != self.ids[b]], minlength=len(ids))
        return out

    def _search(self, unit: np.ndarray, near: float, ef: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate pairs; beams that are full of links, or not filled, are asked again."""
        n, todo, grown = len(self.ids), np.arange(len(unit)), False
        while len(todo):
            if ef >= n or (grown and NEIGHBOURS * ef >= n):  # a beam whose nodes' neighbours would be (most of) the shard
                yield from self._whole(unit, todo, near)
                return
            again, step = [], max(16, CHUNK // ef)
            for at in range(0, len(todo), step):
                part = todo[at : at + step]
                ids, sims = self.index.search(unit[part], ef)
                wider = (sims[:, -1] >= near) | (sims[:, -1] == -np.inf)  # full of links, or not filled: parts of the graph are out of reach
                a, b = np.nonzero((sims >= near) & ~wider[:, None])
                yield part[a], ids[a, b]
                again.append(part[wider])
            todo, ef, grown = np.concatenate(again), 2 * ef, True


class _Pairs:
    """A sink that keeps all pairs."""

    def __init__(self) -> None:
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pairs.append((a, b))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(c) for c in zip(*self.pairs))


class _Counts:
    """A sink that keeps the links of each query and a spanning forest, whatever the number of pairs."""

    def __init__(self, ids: np.ndarray, to: _Shard):
        self.ids, self.to, self.links = ids, to, np.zeros(len(ids))
        self.edges = (np.zeros(0, np.int64),) * 2

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        u, v = self.ids[a], self.to.ids[b]
        other = u != v
        self.links += np.bincount(a[other], self.to.weights[b[other]], len(self.ids))
        if other.any():
            self.edges = _forest(np.concatenate([self.edges[0], u[other]]), np.concatenate([self.edges[1], v[other]]))

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids with links, their number, and the forest's edges."""
        some = self.links > 0
        who, back = np.unique(self.ids[some], return_inverse=True)
        return who, np.bincount(back, self.links[some], len(who)).astype(np.int64), *self.edges


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) of the components of an edge list."""
    nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = back[: len(u)], back[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new[label]]
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]


FOUND = "id long, other long, links long, asked long, audited long, first double, recall double"


def similar_vectors(spark, index: list[dict], least: float, ef: int, recall: float, slice_rows: int, audit: int, slices: int = 8) -> DataFrame:
    """Rows (id, null, links): links of a node into one shard; rows (id, other, null): forest edges; rows of audits.

    A task has one shard to ask and up to `slices` slices of another's vectors, read one after the other.
    """
    shards = spark.createDataFrame([(m["dim"], m["path"], m["count"]) for m in index], "dim int, path string, count long")
    step = slices * slice_rows
    from_to = F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(step).cast("long"))
    asking = shards.select("dim", F.col("path").alias("queries"), "count", F.explode(from_to).alias("at"))
    tasks = asking.join(shards.select("dim", F.col("path").alias("target")), "dim").select("queries", "count", "dim", "at", "target")  # names of files only
    of_dim: dict[int, int] = {}
    for m in index:
        of_dim[m["dim"]] = of_dim.get(m["dim"], 0) + 1
    n_tasks = sum(-(-m["count"] // step) * of_dim[m["dim"]] for m in index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, count, dim, at, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                to = _Shard(target)
                for lo in range(at, min(at + step, count), slice_rows):
                    ids, x = _slice(queries, count, dim, lo, min(lo + slice_rows, count))
                    into, audited, first, measured = to.gather(x, _unit(x), ids, least, ef, recall, audit, lambda: _Counts(ids, to))  # noqa: B023
                    yield _found(*into.result(), min(audit, len(ids)), audited, first, measured)

    return tasks.repartition(max(1, min(n_tasks, 65_536))).mapInArrow(run, FOUND)


def _found(who: np.ndarray, links: np.ndarray, x: np.ndarray, y: np.ndarray, asked: int, audited: int, first: float, measured: float) -> pa.RecordBatch:
    """Rows of counts, of edges, and one of the audit."""
    k, e = len(who), len(x)
    long, double, empty = pa.int64(), pa.float64(), pa.nulls
    columns = [
        [pa.array(who, long), pa.array(x, long), empty(1, long)], [empty(k, long), pa.array(y, long), empty(1, long)], [pa.array(links, long), empty(e + 1, long)],
        *([empty(k + e, long), pa.array([c], long)] for c in (asked, audited)), *([empty(k + e, double), pa.array([c], double)] for c in (first, measured)),
    ]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["id", "other", "links", "asked", "audited", "first", "recall"])


def _audited(
    spark, index: list[dict], stage: Stage, least: float, ef: int, recall: float, slice_rows: int, audit: int, report: dict, enough: int = 64,
    most: int = 1_000_000
) -> DataFrame:
    """The links, once the audits of all tasks together say that beams of `ef` reach `recall`.

    A task whose sample has no link learns nothing from it, so it relies on the recall of the others' first beams.
    """
    largest = max(m["count"] for m in index)
    while True:
        name = f"found-{ef}-{audit}"
        found = stage.table(similar_vectors(spark, index, least, ef, recall, slice_rows, audit), name)
        pooled = lambda c: F.coalesce(F.try_divide(F.sum(F.col("audited") * F.col(c)), F.sum("audited")), F.lit(1.0))
        r = found.where("recall IS NOT NULL").agg(
            F.sum("asked").alias("asked"), F.sum("audited").alias("audited"), pooled("first").alias("first"), pooled("recall").alias("recall")
        ).first()
        few = r["audited"] < enough and r["asked"] < most and audit < min(slice_rows, largest)
        if ef >= largest or not few and r["first"] >= recall:
            report |= r.asDict() | {"ef": ef}
            return found
        stage.drop(name)
        ef, audit = (ef, 4 * audit) if few else (2 * ef, audit)


HOT = 4096  # fewer groups than this are spread over several tasks when nodes are joined back to ids
SALTS = 64


def near_vectors(
    vectors: DataFrame, stage: Stage, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, shards: int = 8, shard_rows: int = 65_536, width: int = 16, ef_build: int = 48, ef: int = 64, recall: float = 0.99,
    slice_rows: int = 2048, audit: int = 64, report: dict | None = None,
) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept.  At least `shards` shards (fewer of tables with under 128 vectors a shard), each of about `shard_rows`.

    `report` is given what the audits measured: how many queries were asked and had links, their recall and the beam.
    """
    spark = vectors.sparkSession
    x = F.col(embedding).cast("array<double>")
    prints = {"p": F.xxhash64("vector"), "q": F.xxhash64(F.lit(1), "vector")}
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), x.alias("vector")).withColumns(prints)
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    fine = F.size("vector").between(1, 1 << 30) & finite & F.exists("vector", lambda e: e != 0) & F.col("id").isNotNull()
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    ids = stage.table(rows.select("id", "p", "q", "fine"), "ids")
    good = stage.table(rows.where("fine").select("id", "p", "q", "vector").dropDuplicates(["id", "p", "q"]), "vectors")
    several = stage.table(good.groupBy("id").count().where("count > 1").select("id"), "several")  # ids of different vectors are nodes by themselves
    groups = good.join(several, "id", "left_anti").groupBy("p", "q").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    groups = stage.table(groups, "groups")
    own = good.join(several, "id", "left_semi").select("id", "vector", F.lit(1).cast("long").alias("weight"))
    nodes = stage.table(groups.select("id", "vector", "weight").unionByName(own).withColumn("dim", F.size("vector")), "nodes")
    counts = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}  # a row per length of vectors
    if not counts:
        return _result(ids.withColumns({"links": F.lit(0), "component": F.lit(None).cast("long")}))
    parts = {d: max(1, min(shards, n // 128), -(-n // shard_rows)) for d, n in counts.items()}
    shard = F.pmod(F.xxhash64("id"), F.element_at(F.create_map(*(F.lit(v) for d, n in parts.items() for v in (d, n))), F.col("dim"))).cast("int")
    index = build_shards(nodes.withColumn("shard", shard), stage.path("index"), parts, width, ef_build)
    found = _audited(spark, index, stage, least, ef, recall, slice_rows, audit, {} if report is None else report)
    links = found.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v")), stage).withColumnRenamed("node", "id")

    def known(df: DataFrame) -> DataFrame:
        """Links and component of the nodes in `df`."""
        return df.join(links, "id", "left").join(joined, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))

    large = max(1024, ids.count() // HOT)
    hot = groups.where(F.col("weight") > large).select("p", "q", F.lit(SALTS).alias("salts"))  # of all ids, so fewer than HOT
    of_group = known(groups.select("p", "q", "id", "weight")).select(
        "p", "q", (F.col("links") + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component")
    )
    spread = of_group.join(F.broadcast(hot), ["p", "q"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    salted = ids.where("fine").join(several, "id", "left_anti").join(F.broadcast(hot), ["p", "q"], "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
    grouped = salted.join(spread, ["p", "q", "salt"]).select("id", "links", "component")
    alone = known(ids.where("fine").join(several, "id", "left_semi").select("id")).select("id", "links", "component")
    rest = ids.where("NOT fine").select("id", F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("component"))
    return _result(grouped.unionByName(alone).unionByName(rest))


def _result(ids: DataFrame) -> DataFrame:
    component = F.coalesce("component", "id")
    return ids.select(
        F.col("id").alias("vec_id"), F.col("links").cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def op8_embedding_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Stage(spark, "op8"))
