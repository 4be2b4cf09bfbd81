"""The typed property graph: node numbers, edges, splits, samples, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import checkpointed


def number_nodes(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Contiguous numbers over node tables in their order, by id within each: type, node_id, index.

    A table is numbered through range partitions and their sizes, so no task sorts a whole table.
    """
    out, base = None, 0
    for kind, df, key in parts:
        rows = checkpointed(df.select(F.col(key).cast("long").alias("node_id")).distinct().repartitionByRange("node_id").withColumn("p", F.spark_partition_id()))
        n = rows.count()
        before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        sizes = rows.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
        own = F.row_number().over(Window.partitionBy("p").orderBy("node_id"))
        part = rows.withColumn("i", own).join(F.broadcast(sizes), "p").select(
            F.lit(kind).alias("type"), "node_id", (F.col("base") + F.col("i") - 1 + base).cast("long").alias("index")
        )
        out = part if out is None else out.unionByName(part)
        base += n
    return out


def edge_table(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, str], keys: tuple[str, str], name: str, weight: Column | None = None) -> DataFrame:
    """Both directions of one edge type between numbered nodes: src, dst, attr, etype.  Edges without both ends go."""
    ends = [nodes.where(F.col("type") == k).select(F.col("node_id").alias(c), F.col("index").alias(i)) for k, c, i in zip(kinds, ("a", "b"), ("src", "dst"), strict=True)]
    attr = F.lit(1.0) if weight is None else weight
    one = edges.select(
        F.col(keys[0]).cast("long").alias("a"), F.col(keys[1]).cast("long").alias("b"), attr.cast("double").alias("attr")
    ).join(ends[0], "a").join(ends[1], "b").select("src", "dst", "attr")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "attr")).withColumn("etype", F.lit(name))


def log_weight(amount: str = "amount") -> Column:
    return F.log1p(F.greatest(F.coalesce(F.col(amount), F.lit(0.0)), F.lit(0.0)))


def adjacency(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(key).agg(F.sort_array(F.collect_set(other)).alias("neighbours"))


def substitution_edges(pairs: DataFrame, foods: DataFrame, offset: int = 1_000_000) -> DataFrame:
    """Pairs uri#number to food ids; both ends must exist."""
    ids = pairs.select(
        (F.split_part("food", F.lit("#"), F.lit(2)).try_cast("long") + offset).alias("a"),
        (F.split_part("substitute", F.lit("#"), F.lit(2)).try_cast("long") + offset).alias("b")
    )
    known = foods.select(F.col("fdc_id").alias("a")).distinct()
    return ids.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")


def negative_edges(edges: DataFrame, left: DataFrame, right: DataFrame, n: int, seed: int = 82, over: float = 1.5) -> DataFrame:
    """About `over` x n random pairs (a, b), without repeats and without real edges, cut to n by hash.

    left, right: numbered nodes (i from 0, id).  Pairs are drawn by number, so no product of the sides is made.
    """
    na, nb = left.count(), right.count()
    if not na or not nb:
        return edges.select("a", "b").limit(0)
    draw = lambda salt, size: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(salt), F.lit(seed), "k")), 1, 8), 16, 10).cast("long"), F.lit(size))
    picks = left.sparkSession.range(int(over * n) + 16).select(F.col("id").alias("k")).select(draw("a", na).alias("ia"), draw("b", nb).alias("ib")).distinct()
    pairs = picks.join(left.select(F.col("i").alias("ia"), F.col("id").alias("a")), "ia").join(right.select(F.col("i").alias("ib"), F.col("id").alias("b")), "ib").select("a", "b")
    return pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti").orderBy(F.md5(F.concat_ws("-", "a", "b")), "a", "b").limit(n)


def _running_total(rows: DataFrame, number: str, value: str, block: int = 65_536) -> DataFrame:
    """Adds `before`, the sum of `value` over smaller numbers (dense, from 0): within blocks, and over the blocks' sums."""
    rows = rows.withColumn("_block", F.floor(F.col(number) / block))
    sums = rows.groupBy("_block").agg(F.sum(value).alias("_s"))
    sums = sums.select("_block", (F.sum("_s").over(Window.orderBy("_block")) - F.col("_s")).alias("_start"))  # a row for each block
    own = F.sum(value).over(Window.partitionBy("_block").orderBy(number)) - F.col(value)
    return rows.withColumn("_own", own).join(F.broadcast(sums), "_block").withColumn("before", F.col("_own") + F.col("_start")).drop("_block", "_own", "_start")


def exact_negative_edges(edges: DataFrame, left: DataFrame, right: DataFrame, n: int, seed: int = 82) -> DataFrame:
    """Exactly n different pairs (a, b) that are no edges, or all there are if they are fewer.

    left, right: numbered nodes (i from 0 on, id).  The pairs that are no edges, in order of both numbers, are cut into n
    stretches of nearly equal length and one is drawn from each.  Where a place falls is found by selection: a node on
    the left owns as many places as it has no edges, by running totals, and within its places the r-th free node on
    the right is r plus the count of its neighbours that come before it.  No product of the sides is made.
    """
    na, nb = left.count(), right.count()
    numbered = edges.select("a", "b").distinct().join(left.select(F.col("id").alias("a"), F.col("i").cast("long").alias("ia")), "a").join(right.select(F.col("id").alias("b"), F.col("i").cast("long").alias("ib")), "b").select("ia", "ib")
    degrees = numbered.groupBy("ia").agg(F.count("*").alias("d"))
    free = left.select(F.col("i").cast("long").alias("ia")).join(degrees, "ia", "left").select("ia", (F.lit(nb) - F.coalesce("d", F.lit(0))).alias("free"))
    total = free.agg(F.sum("free")).first()[0] or 0
    n = min(n, total)
    if not n:
        return left.select(F.col("id").alias("a")).join(right.select(F.col("id").alias("b"))).limit(0)
    q, r = divmod(total, n)
    start = lambda x: F.expr(f"{x} * {q}L + {x} * {r}L div {n}L")
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit("n"), F.lit(seed), "id")), 1, 8), 16, 10).cast("long")
    places = left.sparkSession.range(n).select((start("id") + F.pmod(draw, start("(id + 1)") - start("id"))).alias("place"))
    width = -(-total // na)  # of the cells by which places meet the nodes that own them
    owners = _running_total(free.where("free > 0"), "ia", "free").withColumn("cell", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("free") - 1) / width))))
    drawn = places.withColumn("cell", F.floor(F.col("place") / width)).join(owners, "cell").where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("free")))
    drawn = drawn.select("ia", (F.col("place") - F.col("before")).alias("at"), F.lit(0).alias("taken"))
    by = Window.partitionBy("ia")
    met = numbered.join(drawn.select("ia").distinct(), "ia", "left_semi").select("ia", (F.col("ib") - F.row_number().over(by.orderBy("ib")) + 1).alias("at"), F.lit(1).alias("taken"))
    both = drawn.unionByName(met).withColumn("ib", F.col("at") + F.sum("taken").over(by.orderBy("at", F.desc("taken")).rowsBetween(Window.unboundedPreceding, 0))).where("taken = 0")
    named = both.join(left.select(F.col("i").cast("long").alias("ia"), F.col("id").alias("a")), "ia").join(right.select(F.col("i").cast("long").alias("ib"), F.col("id").alias("b")), "ib")
    return named.select("a", "b")


def hash_share(*keys: str, seed: int = 82) -> Column:
    """A number in [0, 1) from the keys, the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), *keys)), 1, 8), 16, 10).cast("double") / 4294967296.0


def split_edges(edges: DataFrame, keys: list[str], train: float = 0.85, valid: float = 0.07) -> DataFrame:
    h = hash_share(*keys)
    return edges.withColumn("part", F.when(h < train, "train").when(h < train + valid, "valid").otherwise("test"))


def hold_out(pairs: DataFrame, sources: int, source: str = "a", other: str = "b") -> DataFrame:
    """One pair of each of some sources that have two or more; the rest is for training (column held_out)."""
    h = F.md5(F.concat_ws("-", source, other))
    several = pairs.groupBy(source).agg(F.count("*").alias("n"), F.min(F.struct(h.alias("h"), F.col(other).alias("o"))).alias("first")).where("n >= 2")
    chosen = several.orderBy(F.md5(F.col(source).cast("string")), source).limit(sources).select(source, F.col("first.o").alias(other), F.lit(True).alias("held_out"))
    return pairs.join(F.broadcast(chosen), [source, other], "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def diverse_pick(rows: DataFrame, combo: list[str], key: str, n: int) -> DataFrame:
    """n rows: first one of each combination, then second ones, in hash order."""
    h = F.md5(F.col(key).cast("string"))
    turn = F.row_number().over(Window.partitionBy(*combo).orderBy(h, key))
    return rows.withColumn("turn", turn).orderBy("turn", h, key).limit(n)


def _product(matrix: list[list[float]], vec: Column) -> Column:
    """A matrix of literals times a vector."""
    row = lambda r: F.aggregate(F.zip_with(F.array(*map(F.lit, r)), vec, lambda x, y: x * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.array(*map(row, matrix))


def attention_layer(
    nodes: DataFrame, edges: DataFrame, w_src: list[list[float]], w_dst: list[list[float]], a: list[float], slope: float = 0.2,
    w_edge: list[float] | None = None
) -> DataFrame:
    """One head of graph attention by joins: sum over neighbours of softmax(a . leaky(Ws x_src + Wd x_dst + We attr)) Ws x_src.

    nodes: id, vec.  edges: src, dst (and attr).  The weights are small literals; each node is transformed once, before the joins.
    """
    h = nodes.select("id", _product(w_src, F.col("vec")).alias("hs"), _product(w_dst, F.col("vec")).alias("hd"))
    rows = edges.join(h.select(F.col("id").alias("src"), "hs"), "src").join(h.select(F.col("id").alias("dst"), "hd"), "dst")
    both = F.zip_with("hs", "hd", lambda x, y: x + y)
    if w_edge is not None:
        both = F.zip_with(both, F.array(*map(F.lit, w_edge)), lambda x, w: x + w * F.col("attr"))
    leaky = F.transform(both, lambda x: F.when(x > 0, x).otherwise(slope * x))
    score = F.aggregate(F.zip_with(leaky, F.array(*map(F.lit, a)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("e", score)
    top = rows.groupBy("dst").agg(F.max("e").alias("top"))
    rows = rows.join(top, "dst").withColumn("w", F.exp(F.col("e") - F.col("top")))
    sums = rows.select("dst", "w", F.posexplode("hs").alias("pos", "x")).groupBy("dst", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return sums.groupBy("dst").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).select(F.col("dst").alias("id"), F.col("v.x").alias("vec"))


def layer_norm(vec: Column, scale: list[float], shift: list[float], eps: float = 1e-5) -> Column:
    """To mean 0 and variance 1, then scaled and shifted by position."""
    n = float(len(scale))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    mean = total(vec) / n
    var = total(F.transform(vec, lambda x: x * x)) / n - mean * mean
    unit = F.transform(vec, lambda x: (x - mean) / F.sqrt(F.greatest(var, F.lit(0.0)) + eps))
    scaled = F.zip_with(unit, F.array(*map(F.lit, scale)), lambda x, g: x * g)
    return F.zip_with(scaled, F.array(*map(F.lit, shift)), lambda x, b: x + b)


def attention_block(nodes: DataFrame, edges: DataFrame, block: dict) -> DataFrame:
    """Heads side by side, a bias, ELU, a residual projection and layer normalisation; nodes without edges keep the residual.

    block: heads (list of keyword arguments of attention_layer), bias, residual (matrix), scale and shift.
    """
    out = nodes.select("id", "vec")
    for i, head in enumerate(block["heads"]):
        own = attention_layer(nodes, edges, **head).withColumnRenamed("vec", f"head{i}")
        empty = F.array_repeat(F.lit(0.0), len(head["w_src"]))
        out = out.join(own, "id", "left").withColumn(f"head{i}", F.coalesce(f"head{i}", empty))
    both = F.concat(*(F.col(f"head{i}") for i in range(len(block["heads"]))))
    biased = F.zip_with(both, F.array(*map(F.lit, block["bias"])), lambda x, b: x + b)
    elu = F.transform(biased, lambda x: F.when(x > 0, x).otherwise(F.exp(x) - 1))
    summed = F.zip_with(elu, _product(block["residual"], F.col("vec")), lambda x, y: x + y)
    return out.select("id", layer_norm(summed, block["scale"], block["shift"]).alias("vec"))


def attention_encoder(nodes: DataFrame, edges: DataFrame, blocks: list[dict]) -> DataFrame:
    """Blocks of graph attention one after the other, as inference with given weights; each block's result is written before the next."""
    for i, block in enumerate(blocks):
        nodes = attention_block(nodes, edges, block)
        if i + 1 < len(blocks):
            nodes = checkpointed(nodes)
    return nodes


def link_scores(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sigmoid of the dot product of both ends."""
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    rows = pairs.join(vectors.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
    return rows.withColumn("p", 1 / (1 + F.exp(-dot))).drop("va", "vb")


def area_under_curve(rows: DataFrame, score: str, label: str) -> DataFrame:
    """ROC area from counts by distinct score.  Scores are ordered in range partitions and their negatives added up, so no task sorts them all."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    by = checkpointed(by.repartitionByRange("s").withColumn("p", F.spark_partition_id()))  # partition numbers hold from here on
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    bases = by.groupBy("p").agg(F.sum("neg").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per partition
    inner = F.sum("neg").over(Window.partitionBy("p").orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    below = by.withColumn("inner", F.coalesce(inner, F.lit(0))).join(F.broadcast(bases), "p").withColumn("below", F.col("base") + F.col("inner"))
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return below.agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))
