"""Near-duplicate documents by bottom-k sketches.

One hash function orders the distinct word shingles of a document; its k
smallest are the sketch.  Documents with equal sets (size and 128-bit
fingerprint) go through the rest as one.

1. Inverted lists of the first `heads` retained values.  Of the union of two
   sets that link, each of its smallest values is shared with at least the
   threshold's probability; `heads` is the least number with a chance below
   1e-6 of sharing none (8 at 85%, 9 at 80%).
2. Long lists are first thinned: all members are compared, exactly, with one
   member of the list's largest component and one from outside it; those that
   link join, and the rest goes on to the next round, until comparing what is
   left outside with all others costs little more than the list itself or a round
   unites less than a quarter of it.  Within a
   component nothing is compared any more, so a cloud of near copies costs a few
   comparisons a document, not all its pairs.
   What is left of long lists is cut into tiles: by size class (sets that link
   have sizes within the threshold of each other) and by hash within a class.  A
   tile is a bounded block; every pair of a list that could link and is not in
   one component already meets in one tile.
3. Within a tile, retained values in common bound the overlap, and the sketch
   of the union estimates the similarity; pairs go whose estimate has a chance
   below 1e-6 at the threshold (binomial tail; of 64 values, 39 shared pass at
   85% and 34 at 80%).  Documents left with a partner stay in the tile.
4. Full sets of those are made again from the texts, and all pairs of a tile
   are verified exactly, as products of 0/1 matrices or by intersection.  A
   tile returns the edges of a spanning forest only, never all its pairs.
5. Components unite the tiles' forests.

Nothing is capped: rounds end when they no longer pay, and the tiles decide
whatever is left.

Defined results: a null, empty or word-less text has an empty set, links with
nothing and is its own component; rows that repeat an id are one node (their
links unite); a null id is kept, has no component and is not linked; a very long
text has its whole set; an empty table gives an empty table.  Other input columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import bloom
from larder.llm.components import components
from larder.llm.kernels import SPACE_WORD, U64, Words, chunks, fresh, grams, mix, string_views, trim
from larder.llm.staging import Stage, send, spread

PAD = np.uint32(0xFFFFFFFF)


def shingle_sets(w: Words, k: int, rows: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each text (or each of `rows`): its number and the sorted distinct hashes of its k-word shingles."""
    h, _ = grams(w, k)
    for i in range(len(w.n)) if rows is None else rows.tolist():
        a, n = int(w.first[i]), int(w.n[i])
        if n >= k:
            yield i, np.unique(h[a : a + n - k + 1])
        elif n:
            total = np.array([n], dtype=U64)
            for x in w.hash[a : a + n]:
                total = mix(total * U64(0x9E3779B97F4A7C15) + x)
            yield i, total
        else:
            yield i, np.zeros(0, dtype=U64)


SIGNATURE = "doc_id long, n long, f1 long, f2 long, heads array<bigint>, sketch binary"


def signatures(docs: DataFrame, shingle: int = 5, k: int = 64, heads: int = 8, lower: bool = True) -> DataFrame:
    """docs: doc_id, text.  A row per document: size and fingerprint of its set, first retained values, and the high halves of all k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            data, offsets, _ = string_views(batch.column(1))
            for lo, hi in chunks(offsets):
                w = Words(data, offsets, lo, hi, SPACE_WORD, lower)
                n, f1, f2, first, sketch = [], [], [], [], []
                for _, s in shingle_sets(w, shingle):
                    n.append(len(s))
                    m = mix(s ^ U64(0x1234567))
                    f1.append(int(s.sum(dtype=U64).view(np.int64)))
                    f2.append(int(m.sum(dtype=U64).view(np.int64)))
                    first.append(s[:heads].view(np.int64))
                    sketch.append((s[:k] >> U64(32)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()),
                        pa.array(first, pa.list_(pa.int64())), pa.array(sketch, pa.binary())
                    ],
                    names=["doc_id", "n", "f1", "f2", "heads", "sketch"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURE)


def _tiles(long: DataFrame, tile: int) -> DataFrame:
    """long: v, rep, n, class, g (component so far), of long lists.  Deals them to tiles of at most about 2 x `tile` members.

    The members of a list's largest component, if it would fill a good part of a tile, meet the others, not each other.
    """
    main = long.groupBy("v", "g").agg(F.count("*").alias("c")).groupBy("v").agg(F.max(F.struct("c", "g")).alias("m"))
    main = main.select("v", F.when(F.col("m.c") >= tile / 4, F.col("m.g")).alias("main"))
    long = long.join(main, "v").withColumn("inside", F.coalesce(F.col("g") == F.col("main"), F.lit(False)).cast("int"))
    size = long.groupBy("v", "class", "inside").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    key = (2 * F.col("class") + F.col("inside")).cast("int")
    parts = size.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), "parts"))).alias("parts"))  # a few classes per list
    long = long.join(parts, "v")
    count = lambda k: F.coalesce(F.try_element_at(F.col("parts"), k.cast("int")), F.lit(0))
    code = lambda k, p: k.cast("long") * (1 << 24) + p.cast("long")
    me = code(key, F.pmod(F.xxhash64("rep"), count(key)))
    none = F.array().cast("array<struct<a: bigint, b: bigint>>")

    def meets(step: int, inside: int) -> F.Column:
        """Tiles of this entry and of each part of the class `step` away, inside the component or outside; smaller code first."""
        k = 2 * (F.col("class") + step) + inside
        pair = lambda p: F.struct(F.least(me, code(k, p)).alias("a"), F.greatest(me, code(k, p)).alias("b"))
        several = F.transform(F.sequence(F.lit(0), F.greatest(count(k) - 1, F.lit(0))), pair)
        asked = (count(k) > 0) & ((F.col("inside") == 0) | F.lit(inside == 0))
        if step == 0 and inside == 0:  # a class of one part meets itself in the tile with a neighbouring class
            beside = (count(2 * (F.col("class") - 1)) > 0) | (count(2 * (F.col("class") + 1)) > 0)
            asked &= ~((F.col("inside") == 0) & (count(k) == 1) & beside)
        return F.when(asked, several).otherwise(none)

    split = F.concat(*(meets(step, inside) for step in (0, -1, 1) for inside in (0, 1)))
    return long.withColumn("t", F.explode(split)).select(F.xxhash64("v", "t.a", "t.b").alias("tile"), "v", "rep", "n", "g")


def _star(percent: int):
    """From rows (tile, lead, rep, set), leaders first in their tile: the links of leaders with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            tiles, lead, reps = (table.column(i).to_numpy() for i in range(3))
            sets = [np.frombuffer(x, "<u8") for x in table.column(3).to_pylist()]
            us, vs = [], []
            edge = np.flatnonzero(np.diff(tiles, prepend=tiles[0] - 1, append=tiles[-1] + 1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                first = a + int(lead[a:b].sum())
                own = [i for i in range(first, b) if len(sets[i])]
                if not own:
                    continue
                size = np.array([len(sets[i]) for i in own])
                values, start = np.concatenate([sets[i] for i in own]), np.cumsum(size) - size
                for i in range(a, first):
                    if not len(sets[i]):
                        continue
                    at = np.minimum(np.searchsorted(sets[i], values), len(sets[i]) - 1)
                    both = np.add.reduceat((sets[i][at] == values).astype(np.int64), start)
                    linked = np.flatnonzero(100 * both >= percent * (size + len(sets[i]) - both))
                    us.append(reps[own][linked])
                    vs.append(np.full(len(linked), reps[i]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])
        trim()

    return run


def _thinned(long: DataFrame, sets_of, stage: Stage, percent: int, tile: int, parts: int, pays: int = 4, most: int = 30) -> tuple[DataFrame | None, DataFrame]:
    """Unites what few comparisons can within long lists (rows v, rep, list): (u, v) links, if any, and (rep, g) components.

    sets_of: from a table of `rep` to their full sets (rep, set).
    """
    own = long.groupBy("rep").agg(F.max(F.struct("list", "v"))["v"].alias("v"))  # of each document its longest list
    own = stage.table(own, "longest")
    sets = stage.table(own.select("rep").join(sets_of(own.select("rep")), "rep"), "long-sets")
    labels, links, left = own.select("rep", F.col("rep").alias("g")), None, None
    for turn in range(most):
        now = stage.table(own.join(labels, "rep"), f"turn-{turn}")
        main = now.groupBy("v", "g").agg(F.count("*").alias("c")).groupBy("v").agg(F.max(F.struct("c", "g")).alias("m"), F.sum("c").alias("all"))
        main = stage.table(main.select("v", F.col("m.g").alias("main"), (F.col("all") - F.col("m.c")).alias("out"), "all"), f"main-{turn}")
        cost = main.agg(F.sum(F.col("out") * F.col("all") / tile).alias("rows"), F.sum("all").alias("all"), F.sum("out").alias("out")).first()
        if cost["rows"] <= pays * cost["all"] or left is not None and cost["out"] > 0.75 * left:  # cheap enough, or the rounds unite too little
            break
        left = cost["out"]
        marked = now.join(main, "v").withColumn("inside", F.col("g") == F.col("main"))
        drawn = F.struct(F.xxhash64("rep", F.lit(turn)), "rep")
        drawn = marked.groupBy("v").agg(F.min(F.when(F.col("inside"), drawn))["rep"].alias("a"), F.min(F.when(~F.col("inside"), drawn))["rep"].alias("b"))
        chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.col("out") / tile)).cast("int")
        pairs = marked.where(~F.col("inside")).join(drawn, "v").select("v", "rep", chunk.alias("chunk"), F.explode(F.array_compact(F.array("a", "b"))).alias("leader")).where("rep <> leader")
        dealt = pairs.select(F.xxhash64("v", "leader", "chunk").alias("tile"), "rep", "leader")
        rows = dealt.select("tile", F.lit(0).alias("lead"), "rep").unionByName(dealt.select("tile", F.lit(1).alias("lead"), F.col("leader").alias("rep")).distinct())
        rows = rows.join(sets, "rep").select("tile", "lead", "rep", "set").repartition(parts, "tile").sortWithinPartitions("tile", F.desc("lead"))
        found = stage.table(rows.mapInArrow(_star(percent), "u long, v long"), f"star-{turn}")
        links = found if links is None else links.unionByName(found)
        known = stage.table(components(links, stage), f"known-{turn}")
        labels = own.select("rep").join(known, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("g"))
        for name in (f"main-{turn}", f"turn-{turn}", *([f"known-{turn - 1}"] if turn else [])):
            stage.drop(name)
    stage.drop("long-sets")
    return links, labels


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole tiles from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], "left")) if len(keys) else 0
        if held and len(keys) and held[-1].column(0)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif len(keys):
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of retained values (padded): shared ones among the k smallest of each union, how many those are, and all shared ones."""
    z = np.sort(np.concatenate([a, b], axis=1), axis=1)
    real = z != PAD
    twin = np.zeros_like(real)
    twin[:, 1:] = (z[:, 1:] == z[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~twin, axis=1, dtype=np.int32)
    return (twin & (rank <= k)).sum(axis=1), np.minimum(rank[:, -1], k), twin.sum(axis=1)


def _overlaps(sets: list[np.ndarray], least_n: int = 2, width: int = 2048) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over the values that two sets have at least."""
    m = len(sets)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    keep = counts[inverse] >= least_n
    new = np.cumsum(counts >= least_n) - 1
    column, who = new[inverse[keep]], who[keep]
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[order]
    out = np.zeros((m, m), dtype=np.float32)
    for at in range(0, int(new[-1]) + 1 if len(new) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[who[a:b], column[a:b] - at] = 1
        out += x @ x.T
    return out


CHANCE = 1e-6  # of missing a pair at the threshold, for the inverted lists and for the filter each


def heads_for(threshold: float) -> int:
    """How many retained values need inverted lists, so that a linked pair shares one."""
    return next(h for h in range(1, 65) if (1 - threshold) ** h < CHANCE)


def least_shared(k: int, threshold: float) -> np.ndarray:
    """For each size of a union's sketch up to k: the shared values from which a pair passes."""
    out = np.zeros(k + 1, dtype=np.int64)
    for n in range(1, k + 1):
        below = 0.0
        for x in range(n + 1):
            below += math.comb(n, x) * threshold**x * (1 - threshold) ** (n - x)
            if below >= CHANCE:
                out[n] = x
                break
    return out


def _sieve(k: int, heads: int, threshold: float):
    least = least_shared(k, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            tiles, lists, reps, sizes = (table.column(i).to_numpy() for i in range(4))
            raw, joined = table.column(4).to_pylist(), table.column(5).to_numpy()
            s = np.full((len(raw), k), PAD, dtype=np.uint32)
            for i, x in enumerate(raw):
                s[i, : len(x) // 4] = np.frombuffer(x, "<u4")
            full = sizes <= k
            edge = np.flatnonzero(np.diff(tiles, prepend=tiles[0] - 1 if len(tiles) else 0, append=tiles[-1] + 1))
            stays = np.zeros(len(raw), dtype=bool)

            def test(i: np.ndarray, j: np.ndarray) -> None:
                """Marks both of each pair that may link and has this list as its first in common."""
                close = np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9
                close &= (reps[i] != reps[j]) & (joined[i] != joined[j])  # what is in one component is not asked again
                i, j = i[close], j[close]
                for at in range(0, len(i), 8192):
                    a, b = i[at : at + 8192], j[at : at + 8192]
                    shared, union, in_common = union_estimate(s[a], s[b], k)
                    exact = full[a] & full[b]  # both sketches are the whole sets
                    both = np.where(exact, in_common >= (threshold - 1e-9) * (sizes[a] + sizes[b] - in_common), shared >= least[union])
                    a, b = a[both], b[both]
                    if not len(a):
                        continue
                    x, y = s[a, :heads], s[b, :heads]
                    common = np.where((x[:, :, None] == y[:, None, :]).any(axis=2) & (x != PAD), x, PAD).min(axis=1)
                    first = common == (lists[a].view(U64) >> U64(32)).astype(np.uint32)
                    stays[a[first]] = True
                    stays[b[first]] = True

            small_i, small_j = [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                m = b - a
                if m <= 24:
                    i, j = np.triu_indices(m, 1)
                    small_i.append(i + a)
                    small_j.append(j + a)
                    continue
                overlap = _overlaps([s[r][s[r] != PAD] for r in range(a, b)])
                n = np.minimum(sizes[a:b], k).astype(np.float32)
                exact = full[a:b]
                for at in range(0, m, 256):  # rows of the table of pairs, so that few are held at once
                    some = slice(at, min(at + 256, m))
                    # shared values among the union's k smallest are at most the shared values
                    both, most = n[some, None] + n[None, :], np.maximum(n[some, None], n[None, :])
                    need = np.where(exact[some, None] & exact[None, :], np.float32((threshold - 1e-6) / (1 + threshold)) * both, least[most.astype(np.int64)].astype(np.float32))
                    i, j = np.nonzero(overlap[some] >= need - np.float32(1e-3))
                    i += at
                    test(i[i < j] + a, j[i < j] + a)
            if small_i:
                test(np.concatenate(small_i), np.concatenate(small_j))
            if stays.any():
                yield pa.RecordBatch.from_arrays([pa.array(tiles[stays]), pa.array(reps[stays])], names=["tile", "rep"])
        trim()

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches):
            tiles, reps = table.column(0).to_numpy(), table.column(1).to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in table.column(2).to_pylist()]
            edge = np.flatnonzero(np.diff(tiles, prepend=tiles[0] - 1, append=tiles[-1] + 1))
            us, vs = [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                m = b - a
                own = sets[a:b]
                size = np.array([len(x) for x in own], dtype=np.int64)
                group = np.arange(m)
                if m <= 12:
                    for i in range(m):
                        for j in range(i + 1, m):
                            lo, hi = min(size[i], size[j]), max(size[i], size[j])
                            if group[i] != group[j] and 100 * lo >= percent * hi:
                                shared = len(np.intersect1d(own[i], own[j], assume_unique=True))
                                if 100 * shared >= percent * (lo + hi - shared):
                                    group[group == group[j]] = group[i]
                else:
                    overlap = _overlaps(own)
                    linked = np.zeros((m, m), dtype=bool)
                    for at in range(0, m, 256):
                        shared = np.rint(overlap[at : at + 256]).astype(np.int64)
                        linked[at : at + 256] = 100 * shared >= percent * (size[at : at + 256, None] + size[None, :] - shared)
                    group[:] = -1
                    for i in range(m):
                        if group[i] < 0:
                            reach = np.zeros(m, dtype=bool)
                            new = np.zeros(m, dtype=bool)
                            new[i] = True
                            while new.any():
                                reach |= new
                                new = linked[new].any(axis=0) & ~reach
                            group[reach] = i
                for g in np.unique(group):
                    own_reps = np.sort(reps[a:b][group == g])
                    us.append(own_reps[1:])
                    vs.append(np.full(len(own_reps) - 1, own_reps[0]))
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        trim()

    return run


def near_duplicates(
    docs: DataFrame, stage: Stage, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, k: int = 64,
    heads: int | None = None, tile: int = 1024
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Links: 100 * |intersection| >= percent * |union| of the shingle sets of lower-cased (A-Z) texts.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    heads = heads or heads_for(threshold)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = stage.table(signatures(docs, shingle, k, heads), "signatures")
    groups = stage.table(
        signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("heads").alias("heads"), F.first("sketch").alias("sketch")),
        "groups"
    )

    entries = groups.select("rep", "n", F.explode("heads").alias("v"))
    lists = stage.table(entries.groupBy("v").agg(F.count("*").alias("list")).where("list > 1"), "lists")

    def sets_of(reps: DataFrame) -> DataFrame:
        """Full sets of the documents in `reps`, made again from their texts (and of a few others)."""
        likely = send(spark, bloom.build(reps, "rep", reps.count()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh()
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(likely.value.has(ids.astype(np.int64))))
                data, offsets, _ = string_views(batch.column(1))
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                for lo, hi in chunks(offsets):
                    w = Words(data, offsets, lo, hi, SPACE_WORD, True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[lo:hi]), pa.array([s.astype("<u8").tobytes() for _, s in shingle_sets(w, shingle)], pa.binary())],
                        names=["rep", "set"]
                    )

        return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "rep long, set binary")

    short, links = entries.join(lists.where(F.col("list") <= tile), "v"), None
    tiles = short.select(F.xxhash64("v").alias("tile"), "v", "rep", "n", F.col("rep").alias("g"))
    if lists.where(F.col("list") > tile).limit(1).count():
        size_class = F.floor(F.log("n") / -math.log(threshold)).cast("int")  # sets that link are of one class or of neighbouring ones
        long = stage.table(entries.join(lists.where(F.col("list") > tile), "v").withColumn("class", size_class), "long")
        links, labels = _thinned(long, sets_of, stage, percent, tile, parts)
        tiles = tiles.unionByName(_tiles(long.join(labels, "rep"), tile))
    tiles = stage.table(tiles, "tiles")
    packed = tiles.join(groups.select("rep", "sketch"), "rep").select("tile", "v", "rep", "n", "sketch", "g")
    active = packed.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_sieve(k, heads, threshold), "tile long, rep long")
    active = stage.table(active.distinct(), "active")
    wanted = stage.table(active.select("rep").distinct(), "wanted")
    joined = active.join(sets_of(wanted), "rep").select("tile", "rep", "set")
    edges = joined.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_verify(percent), "u long, v long")
    if links is not None:
        edges = edges.unionByName(links)
    # rows of one id with different sets are one node: it links the representatives of its sets
    several = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(*(f(c).alias(f"{k}_{c}") for c in ("n", "f1", "f2") for k, f in (("a", F.min), ("b", F.max))))
    several = stage.table(several.where("a_n <> b_n OR a_f1 <> b_f1 OR a_f2 <> b_f2").select("doc_id"), "several")
    same = signed.select("doc_id", "n", "f1", "f2").join(several, "doc_id").join(groups.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"])
    found = components(edges.unionByName(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))), stage)
    for name in ("lists", "tiles", "active", "wanted", "several"):  # the edges are written
        stage.drop(name)
    named = groups.select("n", "f1", "f2", "rep").join(found, F.col("rep") == F.col("node"), "left")
    named = stage.table(named.select("n", "f1", "f2", F.coalesce("component", "rep").alias("component")), "named")
    out = signed.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_near_dup(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return near_duplicates(docs, Stage(spark, "op1"), percent=85)
