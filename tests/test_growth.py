"""What must not grow faster than the input."""

import numpy as np


def test_tiles_of_a_long_list(spark):
    """Sets of one or of neighbouring size classes meet in a tile, and no entry goes to more tiles than it needs."""
    from pyspark.sql import functions as F

    from larder.llm.near_dup import _tiles

    rows = spark.range(600).select(F.lit(7).cast("long").alias("v"), F.col("id").alias("rep"), F.lit(1).cast("long").alias("n"), (F.col("id") % 6).cast("int").alias("class"), F.col("id").alias("g"))
    tiles: dict[int, set] = {}
    for r in _tiles(rows, 500).collect():
        tiles.setdefault(r["tile"], set()).add(r["rep"])
    assert sum(map(len, tiles.values())) <= 2 * 600
    for step in (0, 1):
        for c in range(6 - step):
            assert any({c, c + 6, c + step} <= t for t in tiles.values())
    small = _tiles(rows.where("class IN (0, 3)"), 500).collect()  # classes without a neighbour meet themselves
    assert len(small) == 200 and len({r["tile"] for r in small}) == 2


def test_scores_at_once(spark):
    """However many queries a block holds, a task has a bounded table of scores, and finds what all pairs say."""
    from pyspark.sql import functions as F

    from larder.operators import retrieval

    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(4000, 4)), rng.normal(size=(900, 4))
    items = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, vec array<double>, g int").coalesce(1)
    queries = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(q)], "qid long, vec array<double>, g int")

    def none(a, b):
        if len(a) * len(b) > 1 << 20:
            raise MemoryError(f"{len(a)} x {len(b)} scores")
        return np.zeros((len(a), len(b)))

    with_extra = [d.withColumn("x", F.array(F.lit(0.0))) for d in (items, queries)]
    found = retrieval.vector_topk(*with_extra, 3, extra=("x", "x", none)).collect()
    cos = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 12)
    best = lambda s: {(i, int(j), r + 1) for i in range(len(q)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:3])}
    assert {(r["qid"], r["id"], r["rank"]) for r in found} == best(cos)
    own = np.where(np.arange(len(q))[:, None] % 3 == np.arange(len(x))[None, :] % 3, cos, -np.inf)
    found = retrieval.vector_topk(items, queries, 3, alike=("g", "g")).collect()
    assert {(r["qid"], r["id"], r["rank"]) for r in found} == best(own)


def test_pools_by_group(spark):
    """Pools that are groups give what the same pools as pairs give."""
    from pyspark.sql import functions as F

    from larder.operators import retrieval

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist(), rng.normal(size=3).tolist(), i % 4) for i in range(200)]
    items = spark.createDataFrame(rows, "id long, text_vec array<double>, graph_vec array<double>, g int")
    queries = items.where("id < 12").select(F.col("id").alias("qid"), F.col("text_vec").alias("q_text"), F.col("graph_vec").alias("q_graph"), ((F.col("g") + 1) % 4).alias("other"))
    pairs = queries.join(items, F.col("g") == F.col("other")).select("qid", "id")
    for mode in ("external", "hybrid", "centroid"):
        get = lambda pool: {(r["qid"], r["id"], r["rank"], round(r["total"], 9)) for r in retrieval.search_pool(items, queries, pool, mode, 0.6, 5).collect()}  # noqa: B023, E731
        assert get(("g", "other")) == get(pairs)


def test_texts_are_dealt_and_read_once(spark, tmp_path):
    """A small input goes to all cores, and no filter parses a text before it is parsed."""
    from larder.plans import evaluate_queries  # noqa: F401
    from larder.plans.registry import QUERIES
    from larder.session import dealt

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = dealt(spark.read.parquet(str(tmp_path / "one")))
    assert rows.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and rows.count() == 100
    for name in ("meal_quantity_places", "meal_parse"):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "size(filter" not in plan and "Repartition" in plan


def test_index_holds_few_texts_and_postings(spark, monkeypatch):
    """A task counts some texts at a time, whatever the size of its batches, and shards are bounded by postings too."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from larder.operators import lexical

    texts = [f"{i} " + "word " * 20_000 for i in range(60)] + [None, "", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(63)), pa.array([0] * 63), pa.array(texts, pa.string())], names=["id", "tier", "text"])
    parts = list(lexical._counted(lexical.words)(iter([batch.slice(1)])))
    assert max(p.num_rows for p in parts) <= 13 and [i for p in parts for i in p.column(0).to_pylist()] == list(range(1, 63))
    assert [n for p in parts for n in p.column(4).to_pylist()] == [20_001] * 59 + [0, 0, 1]
    docs = spark.range(600).select("id", F.concat_ws(" ", *(F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(90)).cast("string") for i in range(25))).alias("text"), (F.col("id") % 3).alias("level")).coalesce(1)
    queries = docs.where("id % 50 = 0").select(F.col("id").alias("qid"), "text")
    found = lambda index: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 9)) for r in lexical.search(index, queries, 5).collect())
    whole = found(lexical.build_index(docs, tier="level"))
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 700)
    index = lexical.build_index(docs, tier="level")
    held = index.table.where("term IS NOT NULL").groupBy("shard").agg(F.sum("n").alias("n"))
    assert held.agg(F.max("n")).first()[0] <= 700 and held.count() >= 18
    assert found(index) == whole


def test_scores_that_are_kept(monkeypatch):
    """A tile keeps and sorts the scores that can still count, not all of them, and finds what all pairs say."""
    import pyarrow as pa

    from larder.operators import metric

    rng = np.random.default_rng(5)
    x, k, looked = rng.normal(size=(3000, 8)), 5, []
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[40], ids = x[41], np.arange(3000)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -np.inf)
    want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
    items = pa.table({"tile": [0] * 3000, "leaf": ids // 100, "id": ids, "vec": list(x)})
    sort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, **a: looked.append(np.size(keys[0])) or sort(keys, **a))
    for low in (np.full(3000, -2.0), np.take_along_axis(s, want, 1)[:, -1] - 1e-13):  # nothing known; the last that counts
        looked.clear()
        queries = pa.table({"qid": ids, "vec": list(x), "leaves": [list(range(30))] * 3000, "low": low})
        got = metric._multiplied("long", k, False)((0, 0), queries, items)
        assert (got["qid"].to_numpy() == np.repeat(ids, k)).all() and (got["id"].to_numpy() == want.ravel()).all()
        assert sum(looked) < 3000 * 3000 / 4
