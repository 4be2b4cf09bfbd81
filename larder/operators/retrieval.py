"""Vector, lexical and hybrid search.  Vectors are keyed by id; scores are in double precision; ties go by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from larder.functions import scores
from larder.functions.vectors import dot, norm, unit
from larder.session import checkpointed, dealt, shared_folder

QUERY_BLOCK_BYTES = 32 << 20  # queries of one pass over the items, at most


CELLS = 1 << 20  # scores that a task holds at once
ITEMS = 4096  # items of one product


Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]  # values of queries and of items to a table of scores


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _offer(best_s: np.ndarray, best_i: np.ndarray, rows: np.ndarray, s: np.ndarray, ids: np.ndarray, rounds: bool) -> None:
    """Puts scores (of `rows` with the items `ids`) among the best of those rows, which are in order; only what can stay is sorted."""
    k = best_s.shape[1]
    bar = best_s[rows, -1] - 1e-11
    keep = s >= bar[:, None]
    if k < s.shape[1] and np.count_nonzero(keep) > 2 * k * len(rows):
        keep &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] - 1e-11
    r, c = np.nonzero(keep & (s > -np.inf))
    if not len(r):
        return
    new = s[r, c]
    some, r = np.unique(r, return_inverse=True)
    at = rows[some]
    row = np.concatenate([np.repeat(np.arange(len(some)), k), r])
    score, item = np.concatenate([best_s[at].ravel(), np.round(new, 12) if rounds else new]), np.concatenate([best_i[at].ravel(), ids[c]])
    order = np.lexsort((item, -score, row))
    first = np.searchsorted(row[order], np.arange(len(some)))
    order = order[(first[:, None] + np.arange(k)).ravel()]
    best_s[at], best_i[at] = score[order].reshape(-1, k), item[order].reshape(-1, k)


def vector_topk(
    items: DataFrame, queries: DataFrame, k: int, item_id: str = "id", item_vec: str = "vec", query_id: str = "qid", query_vec: str = "vec", include_self: bool = True, least: float | None = None, normalise: bool = True,
    unlike: tuple[str, str] | None = None, extra: tuple[str, str, Kernel] | None = None, alike: tuple[str, str] | None = None,
) -> DataFrame:
    """The k items with the largest cosine (dot product if not `normalise`) for each query: qid, id, score, rank (from 1).

    Queries go out in blocks of bounded size; each task multiplies its items with a block and passes on its own best k
    of every query, so what is ranked is at most tasks x queries x k.  Of scores a task holds a bounded number at once,
    however large the block.  Zero vectors score 0.  `unlike` names a column of items and one of queries: pairs with
    equal values do not count; with `alike` only those count, and no others are multiplied.  `extra` names two array
    columns and a function of both that is added to the score.  Of more than one block the driver holds one at a time,
    and the passes' results are written to the shared folder.
    """
    spark = items.sparkSession
    kind = queries.schema[query_id].dataType
    kind = "long" if isinstance(kind, IntegralType) else kind.simpleString()

    def columns(df: DataFrame, key: str, vec: str, side: int) -> DataFrame:
        same = unlike or alike
        group = F.xxhash64(same[side]) if same else F.lit(0).cast("long")
        values = F.col(extra[side]).cast("array<double>") if extra else F.array(F.lit(0.0))
        return df.select(
            F.col(key).cast(kind if side else "long").alias("id"), F.col(vec).cast("array<double>").alias("vec"), group.alias("g"), values.alias("x")
        ).where(F.col("vec").isNotNull() & (F.col(alike[side]).isNotNull() if alike else F.lit(True)))

    if unlike and alike:
        raise ValueError("either unlike or alike")
    rows = dealt(columns(items, item_id, item_vec, 0))

    def blocks() -> Iterator[tuple[np.ndarray, ...]]:
        held: list[tuple] = []
        size = 0
        for r in columns(queries, query_id, query_vec, 1).toLocalIterator():
            held.append((r["id"], r["g"], np.array(r["vec"]), np.array(r["x"])))
            size += 8 * (len(r["vec"]) + len(r["x"]))
            if size >= QUERY_BLOCK_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> tuple[np.ndarray, ...]:
        ids, groups, vecs, values = zip(*held, strict=True)
        return np.array(ids), np.array(groups), np.stack(vecs), np.stack(values)

    def one_pass(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, groups, q, values = shared.value
            q = _units(q) if normalise else q
            best_s, best_i = np.full((len(qid), k), -np.inf), np.zeros((len(qid), k), dtype=np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, ITEMS):
                    b = whole.slice(at, ITEMS)
                    ids, own = b.column(0).to_numpy(), b.column(2).to_numpy()
                    x = _matrix(b.column(1), len(ids))
                    x = _units(x) if normalise else x
                    more = _matrix(b.column(3), len(ids)) if extra else None
                    for rows_of, columns_of in sides(groups, own):
                        step = max(1, CELLS // len(columns_of))
                        for lo in range(0, len(rows_of), step):
                            some = rows_of[lo : lo + step]
                            s = q[some] @ x[columns_of].T
                            if extra:
                                s = np.round(s, 12) + extra[2](values[some], more[columns_of])
                            if np.isnan(s).any():
                                s[np.isnan(s)] = -np.inf
                            if not include_self and kind == "long":
                                s[qid[some][:, None] == ids[columns_of][None, :]] = -np.inf
                            if unlike:
                                s[groups[some][:, None] == own[columns_of][None, :]] = -np.inf
                            _offer(best_s, best_i, some, s, ids[columns_of], not extra)
            a, c = np.nonzero(best_s > (-np.inf if least is None else least - 1e-12))
            for lo in range(0, len(a), 1 << 16):
                i, j = a[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(best_i[i, j]), pa.array(best_s[i, j])], names=["qid", "id", "score"])

        def sides(groups: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Queries and items that meet: all, or those of each group."""
            if not alike:
                yield np.arange(len(groups)), np.arange(len(own))
                return
            for g in np.unique(own):
                if len(some := np.flatnonzero(groups == g)):
                    yield some, np.flatnonzero(own == g)

        return rows.mapInArrow(run, f"qid {kind}, id long, score double")

    several = blocks()
    first, second = next(several, None), next(several, None)
    if first is None:
        out = spark.createDataFrame([], f"qid {kind}, id long, score double")
    elif second is None:
        out = one_pass(spark.sparkContext.broadcast(first))
    else:
        at = shared_folder(spark, "topk")
        for block in chain((first, second), several):
            shared = spark.sparkContext.broadcast(block)
            one_pass(shared).write.mode("append").parquet(at)
            shared.destroy()
        out = spark.read.parquet(at)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def best_match(items: DataFrame, queries: DataFrame, least: float, **names: str) -> DataFrame:
    """The best item of each query, if its cosine is at least `least`."""
    return vector_topk(items, queries, 1, least=least, **names).drop("rank")


def hybrid_score(text_sim: Column, graph_sim: Column, alpha: float, structured: Column | None = None, weight: float = 0.0) -> Column:
    """alpha * graph + (1 - alpha) * text + weight * structured; where one similarity is missing the other has all the weight."""
    base = F.when(graph_sim.isNull(), text_sim).when(text_sim.isNull(), graph_sim).otherwise(alpha * graph_sim + (1 - alpha) * text_sim)
    return base if structured is None else base + weight * F.coalesce(structured, F.lit(0.0))


Pairwise = tuple[str, str, Kernel, Callable[[Column, Column], Column]]


def hybrid_rank(
    candidates: DataFrame, queries: DataFrame, alpha: float, k: int, where: Column | None = None, structured: Column | None = None, weight: float = 0.0, pool: DataFrame | None = None, pairwise: Pairwise | None = None, alike: tuple[str, str] | None = None,
) -> DataFrame:
    """candidates: id, text_vec, graph_vec, more columns.  queries: qid, q_text, q_graph.

    `where` is a hard filter before scoring.  With a `pool` (qid, id) each query has those candidates only, by joins; with
    `alike` (a column of candidates, one of queries) those of equal values, and no table of pairs is made.
    Without one, the weighted sum is a dot product of joined vectors, so queries meet items in blocks and no product of
    the tables is made; `structured` may then use candidates' columns only, and `pairwise` says what depends on both: a
    column of candidates, one of queries, and the score as a function of arrays and as one of columns.
    """
    scored = hybrid_scores(candidates, queries, alpha, pool, where, structured, weight, pairwise, k, alike)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("total"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid_scores(
    candidates: DataFrame, queries: DataFrame, alpha: float, pool: DataFrame | None, where: Column | None = None, structured: Column | None = None, weight: float = 0.0, pairwise: Pairwise | None = None, k: int = 0, alike: tuple[str, str] | None = None,
) -> DataFrame:
    """As hybrid_rank, without ranks: all rows of the pool, or without one the best k of every kind of candidate at least."""
    c = (candidates if where is None else candidates.where(where)).withColumns({"text_vec": unit(F.col("text_vec")), "graph_vec": unit(F.col("graph_vec"))})
    q = queries.withColumns({"q_text": unit(F.col("q_text")), "q_graph": unit(F.col("q_graph"))})
    struct = F.lit(0.0) if structured is None else structured
    if pool is None:
        own = (weight * F.coalesce(struct, F.lit(0.0))).alias("s")
        both = [*([pairwise[0]] if pairwise else []), *([alike[0]] if alike else [])]
        pairs = _blocked(c.select("id", "text_vec", "graph_vec", own, *both), q, alpha, k, weight, pairwise, alike).join(c, "id").join(q, "qid")
    else:
        pairs = c.join(pool, "id").join(q, "qid")
    if pairwise:
        struct = struct + pairwise[3](F.col(pairwise[1]), F.col(pairwise[0]))
    scored = pairs.withColumns({"text_sim": dot(F.col("text_vec"), F.col("q_text")), "graph_sim": dot(F.col("graph_vec"), F.col("q_graph"))})
    scored = scored.withColumn("structured", struct).withColumn("total", F.round(hybrid_score(F.col("text_sim"), F.col("graph_sim"), alpha, F.col("structured"), weight), 12))
    return scored.where("total IS NOT NULL").drop("text_vec", "graph_vec", "q_text", "q_graph")


def _blocked(c: DataFrame, q: DataFrame, alpha: float, k: int, weight: float = 0.0, pairwise: Pairwise | None = None, alike: tuple[str, str] | None = None) -> DataFrame:
    """The best k (qid, id) of each kind of item: with both vectors, with text only, with graph only."""
    times = lambda v, w: F.transform(v, lambda x: x * w)
    one = F.array(F.lit(1.0))
    t, g = F.col("text_vec").isNotNull(), F.col("graph_vec").isNotNull()
    some = lambda x: F.max(F.when(x, 1))
    kinds = c.agg(
        F.max(F.when(t & g, F.size("graph_vec"))).alias("gd"), F.max(F.when(t & g, F.size("text_vec"))).alias("td"), some(t & ~g).alias("text_vec"),
        some(g & ~t).alias("graph_vec")
    ).first()
    item_side, query_side = ([pairwise[0]], [pairwise[1]]) if pairwise else ([], [])
    if alike:
        item_side, query_side = [*item_side, alike[0]], [*query_side, alike[1]]
    extra = (pairwise[0], pairwise[1], lambda a, b: weight * pairwise[2](a, b)) if pairwise else None
    out = []
    if kinds["gd"]:
        a = F.when(F.col("q_graph").isNull(), 0.0).when(F.col("q_text").isNull(), 1.0).otherwise(F.lit(float(alpha)))
        zeros = [F.array_repeat(F.lit(0.0), kinds[d]) for d in ("gd", "td")]
        joined = F.concat(times(F.coalesce("q_graph", zeros[0]), a), times(F.coalesce("q_text", zeros[1]), 1 - a), one)
        asked = q.where("q_text IS NOT NULL OR q_graph IS NOT NULL").select("qid", joined.alias("v"), *query_side)
        out.append((c.where(t & g).select("id", F.concat("graph_vec", "text_vec", F.array("s")).alias("vec"), *item_side), asked))
    for own, only, asked in (("text_vec", t & ~g, "q_text"), ("graph_vec", g & ~t, "q_graph")):
        if kinds[own]:
            found = c.where(only).select("id", F.concat(own, F.array("s")).alias("vec"), *item_side)
            out.append((found, q.where(F.col(asked).isNotNull()).select("qid", F.concat(asked, one).alias("v"), *query_side)))
    found = [vector_topk(x, y, k, query_vec="v", normalise=False, extra=extra, alike=alike).select("qid", "id") for x, y in out]
    if not found:
        return c.join(q).select("qid", "id").limit(0)
    return reduce(lambda a, b: a.unionByName(b), found)


def _macro_fit(target: np.ndarray, food: np.ndarray) -> np.ndarray:
    """scores.macro_match of every target with every food."""
    t, f = np.maximum(target, 0), np.maximum(food, 0)
    total_t, total_f = t.sum(axis=1, keepdims=True), f.sum(axis=1, keepdims=True)
    t, share = t / np.where(total_t == 0, 1, total_t), f / np.where(total_f == 0, 1, total_f)
    apart = sum(np.abs(t[:, None, i] - share[None, :, i]) for i in range(3))
    return np.where(total_f[:, 0] <= 0, 0.0, np.clip(1 - apart / 2, 0, 1))


def hybrid_macro_rank(items: DataFrame, queries: DataFrame, alpha: float, weight: float, k: int) -> DataFrame:
    """Hybrid search with `weight` times the macro fit of each pair.  items: macros, queries: q_macros (protein, fat, carbohydrate)."""
    three = lambda c: tuple(F.get(c, F.lit(i)) for i in range(3))
    fit = ("macros", "q_macros", _macro_fit, lambda q, x: scores.macro_match(three(q), three(x)))
    return hybrid_rank(items, queries, alpha, k, weight=weight, pairwise=fit)


def hybrid_neighbours(items: DataFrame, seeds: DataFrame, k: int = 5, alpha: float = 0.5, available: DataFrame | None = None) -> DataFrame:
    """The best k neighbours of each seed (qid, an item's id) by its own text and graph vectors, itself left out.

    A seed that lacks a vector or has a graph vector of zeros has no neighbours.  `available` (id) restricts what is found.
    """
    own = items.where(F.col("text_vec").isNotNull() & (norm(F.col("graph_vec")) > 0)).select(
        F.col("id").alias("qid"), F.col("text_vec").alias("q_text"), F.col("graph_vec").alias("q_graph")
    )
    asked = seeds.select("qid").distinct().join(own, "qid")
    pool = items if available is None else items.join(available.select("id").distinct(), "id", "left_semi")
    found = hybrid_rank(pool, asked, alpha, k + 1).where("qid <> id").drop("rank")  # of k + 1 at most one is the seed
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("total"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def pseudo_anchor(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Gives each query (qid, q_text) the graph vector of its best text match as q_graph."""
    top = vector_topk(items, queries, 1, item_vec="text_vec", query_vec="q_text")
    anchor = top.join(items.select("id", "graph_vec"), "id").select("qid", F.col("graph_vec").alias("q_graph"))
    return queries.select("qid", "q_text").join(anchor, "qid", "left")


def search(items: DataFrame, queries: DataFrame, mode: str = "hybrid", k: int = 3, alpha: float = 0.5) -> DataFrame:
    """Text, graph or hybrid search from text queries; the graph side starts from the best text match."""
    if mode not in ("text", "graph", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "text":
        return vector_topk(items, queries, k, item_vec="text_vec", query_vec="q_text")
    return hybrid_rank(items, pseudo_anchor(items, queries), 1.0 if mode == "graph" else alpha, k)


def mean_vector(df: DataFrame, keys: list[str], vec: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean of vectors by key, of unit length; a zero mean stays zero.  Sums by position, so any number of vectors fits."""
    w = F.lit(1.0) if weight is None else weight
    parts = df.select(*keys, w.alias("w"), F.posexplode(vec).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("x"))
    whole = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return whole.select(*keys, unit(F.col("v.x")).alias(vec))


def pool_anchor(items: DataFrame, queries: DataFrame, pool: DataFrame | tuple[str, str]) -> DataFrame:
    """Gives each query (qid, q_text) the graph vector of the best text match in its pool (as in search_pool) as q_graph."""
    if isinstance(pool, tuple):
        top = vector_topk(items, queries, 1, item_vec="text_vec", query_vec="q_text", alike=pool)
        anchor = top.join(items.select("id", "graph_vec"), "id").select("qid", F.col("graph_vec").alias("q_graph"))
        return queries.select("qid", "q_text", pool[1]).join(anchor, "qid", "left")
    rows = pool.select("qid", "id").join(items.select("id", "text_vec", "graph_vec"), "id").join(queries.select("qid", "q_text"), "qid")
    score = F.round(dot(unit(F.col("text_vec")), unit(F.col("q_text"))), 12)
    best = rows.where(score.isNotNull()).groupBy("qid").agg(F.max_by("graph_vec", F.struct(score, -F.col("id"))).alias("q_graph"))
    return queries.select("qid", "q_text").join(best, "qid", "left")


def search_pool(items: DataFrame, queries: DataFrame, pool: DataFrame | tuple[str, str], mode: str, lam: float, k: int) -> DataFrame:
    """Ranks each query's pool by (1 - lam) text + lam graph; lam <= 0 is text only.

    A pool is a table (qid, id), or a column of items and one of queries: the items with the query's value.  Those pools
    are never written out as pairs.
    The graph side is the query's own vector (`external`), that of the pool's best text match (`hybrid`), or the pool's
    centroid (`centroid`).
    """
    if mode == "external":
        q = queries
    elif mode == "hybrid":
        q = pool_anchor(items, queries, pool)
    elif mode == "centroid" and isinstance(pool, tuple):
        group = items.select(F.col(pool[0]).alias(pool[1]), "graph_vec").where(F.col(pool[1]).isNotNull())
        means = mean_vector(group.join(queries.select(pool[1]).distinct(), pool[1], "left_semi"), [pool[1]], "graph_vec")
        q = queries.select("qid", "q_text", pool[1]).join(means.withColumnRenamed("graph_vec", "q_graph"), pool[1], "left")
    elif mode == "centroid":
        q = queries.select("qid", "q_text").join(
            mean_vector(pool.join(items.select("id", "graph_vec"), "id"), ["qid"], "graph_vec").withColumnRenamed("graph_vec", "q_graph"), "qid",
            "left"
        )
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if lam <= 0:
        q = q.withColumn("q_graph", F.lit(None).cast("array<double>"))
    return hybrid_rank(items, q, lam, k, alike=pool) if isinstance(pool, tuple) else hybrid_rank(items, q, lam, k, pool=pool)


def search_foods(items: DataFrame, queries: DataFrame, macro_count: DataFrame, k: int = 3, graph: bool = False) -> DataFrame:
    """The best k foods of each text query: 5 k text matches (with graph neighbours of the best ones, if `graph`), those with more macros first.

    items: id, description, text_vec, graph_vec.  queries: qid, q_text.  macro_count: id, macro_count.
    """
    found = search(items, queries, "text", 5 * k).join(items.select("id", "description"), "id")
    if graph:
        found = expand(items, queries, found)
    return rank_by_macros(found.select("qid", "id", "score"), macro_count, k)


def expand(items: DataFrame, queries: DataFrame, found: DataFrame, seeds: int = 5, neighbours: int = 5) -> DataFrame:
    """Adds graph neighbours of each query's best distinct seeds, scored by text; those found already are left out.

    found: qid, id, score, rank, description.  An item may come from several parents.
    """
    first = Window.partitionBy("qid", "description").orderBy("rank")
    unique = found.withColumn("n", F.row_number().over(first)).where("n = 1")
    parents = unique.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("n") <= seeds).select("qid", F.col("id").alias("parent"))
    some = parents.select(F.col("parent").alias("p")).distinct().join(items.select(F.col("id").alias("p"), F.col("graph_vec").alias("v")), "p")
    near = vector_topk(items, some, neighbours, item_vec="graph_vec", query_id="p", query_vec="v", include_self=False).select(F.col("qid").alias("parent"), "id")
    new = parents.join(near, "parent").join(found.select("qid", "id"), ["qid", "id"], "left_anti")
    new = new.join(items.select("id", "text_vec", "description"), "id").join(queries.select("qid", "q_text"), "qid")
    score = F.round(dot(unit(F.col("text_vec")), unit(F.col("q_text"))), 12)
    return found.select("qid", "id", "description", "score").unionByName(new.select("qid", "id", "description", score.alias("score")))


def target_vectors(targets: DataFrame, nutrient_vectors: DataFrame, macros: dict[str, str]) -> DataFrame:
    """Macro-weighted mean of nutrient vectors for each target row (qid and a column per macro); all zero: equal weights."""
    weights = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("w")) for c, name in macros.items()))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x["w"])
    rows = targets.select("qid", total.alias("t"), F.inline(weights)).select("qid", "name", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(1.0 / len(macros)).alias("w"))
    few = nutrient_vectors.where(F.col("name").isin(list(macros.values())))  # a few names
    return mean_vector(rows.join(F.broadcast(few), "name"), ["qid"], "vec", F.col("w"))


WORD = r"[a-z0-9]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def bm25(
    docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, least: float | None = None, doc_id: str = "id", text: str = "text",
    query_id: str = "qid", query_text: str = "text", stem: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Okapi BM25 of each (query, document) that share a term: qid, id, score.

    Postings are filtered by the queries' terms before anything is joined, so only matching documents move; they are
    written once and read twice.  With `stem` (of an array of words) every distinct word is stemmed once, not each occurrence.
    """
    words = docs.select(F.col(doc_id).alias("id"), tokens(F.col(text)).alias("words"))
    sized = words.select("id", "words", F.size("words").alias("len"))
    stats = sized.where("len > 0").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    stemmed = lambda c: c if stem is None else F.get(stem(F.array(c)), F.lit(0))
    asked = queries.select(F.col(query_id).alias("qid"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("word"))
    asked = asked.select("qid", stemmed(F.col("word")).alias("term")).distinct()
    terms = asked.select("term").distinct()
    each = sized.select("id", "len", F.explode("words").alias("term"))
    if stem is None:
        each = each.join(terms, "term", "left_semi")
    else:
        known = each.select(F.col("term").alias("word")).distinct().withColumn("term", stemmed(F.col("word"))).join(terms, "term", "left_semi")
        each = each.withColumnRenamed("term", "word").join(known, "word").drop("word")
    # dealt by document, so counting terms and summing scores need no further exchange
    postings = checkpointed(each.repartition("id").groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighted = postings.join(df, "term").join(F.broadcast(stats)).select("term", "id", part.alias("part"))  # one row of statistics; once per posting, not per query
    out = asked.join(weighted, "term").groupBy("qid", "id").agg(F.sum("part").alias("score"))
    return out if least is None else out.where(F.col("score") >= least)


def rank_by_macros(scored: DataFrame, macro_count: DataFrame, k: int) -> DataFrame:
    """Best k per query by (macro_count, score)."""
    rows = scored.join(macro_count, "id", "left").withColumn("macro_count", F.coalesce("macro_count", F.lit(0)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("macro_count"), F.desc("score"), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def resolve_labels(labels: DataFrame, foods: DataFrame, embed, blocked: list[str], least: float = 0.58, override: str = "") -> DataFrame:
    """The best food of each label that is not blocked, from `least` on.  `override` adds blocked labels, separated by commas."""
    blocked = [*blocked, *(x.strip() for x in override.split(",") if x.strip())]
    free = ~F.lower(F.trim("label")).isin([x.lower() for x in blocked])
    asked = labels.where(free).select(F.xxhash64("label").alias("qid"), "label").distinct().withColumn("v", embed(F.col("label")))
    found = best_match(foods, asked, least, query_vec="v")
    return asked.select("qid", "label").join(found, "qid").select("label", "id", "score")
