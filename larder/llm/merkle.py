"""A Merkle manifest of a dataset: a leaf per row, a tree per group of rows, a root over the trees.

Rows are leaves, ordered within their tree; every `FAN` consecutive nodes of a
level become their digest until one node, the subroot, remains.  Subroots,
ordered by tree, likewise give the root.  A row's proof is the digests beside
its path, level by level, from which its leaf leads to the root again.

Leaves are hashed before anything moves, so texts are not shuffled.  Positions
come from a range partitioning and the sizes of its pieces, never from one
sorted task, so neither a tree with a third of all rows nor a group of equal
rows makes a large one.  Consecutive rows of a tree form buckets of FAN ** LEVELS,
aligned to runs of every level below; executors hand each bucket as an Arrow
table to DuckDB, where one ordered string_agg and sha256 for each level give the
bucket's root.  Bucket roots are the rows of the next tier, so tiers shrink by
that factor until one node remains.  On the way back each bucket is joined with
the proof of its root, one row, and DuckDB puts the levels inside before it.

Defined results: null fields are leaves' "-", apart from any value; rows with a
null tree form one, which comes first; null order values come first in their
tree, ties by leaf (equal leaves are interchangeable); repeated rows are leaves
each; a very long text is hashed as it is; a tree of one row is that leaf; an
empty table has no rows.  Columns not named are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.staging import Stage, partitions_for

FAN, LEVELS = 8, 4
SPAN = FAN**LEVELS  # rows in a bucket
STEPS = "array<struct<left:string,right:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of a row: each field as "-" if null, else its length in bytes, a colon, and its text."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf leads to along a proof."""
    return F.aggregate(proof, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof in order, as one string."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "")


@functools.cache
def _engine() -> duckdb.DuckDBPyConnection:
    """The worker's block engine: one thread, bounded memory, no files."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def _levels(n: int) -> int:
    """Levels that a bucket adds in a tree of n nodes."""
    k = 0
    while n > 1 and k < LEVELS:
        n, k = -(-n // FAN), k + 1
    return k


def _runs(k: int) -> str:
    """A query for each of k levels: the runs r0.. with their digests in order, and the nodes n1.. that they become."""
    parts = ["n0 AS (SELECT pos, h FROM nodes)"]
    for i in range(k):
        parts.append(f"r{i} AS MATERIALIZED (SELECT pos // {FAN} AS pos, string_agg(h, '' ORDER BY pos) AS run FROM n{i} GROUP BY 1)")
        parts.append(f"n{i + 1} AS (SELECT pos, sha256(run) AS h FROM r{i})")
    return "WITH " + ", ".join(parts)


def _ask(sql: str, schema: pa.Schema, **tables: pa.Table) -> pa.Table:
    con = _engine()
    for name, t in tables.items():
        con.register(name, t)
    try:
        return con.sql(sql).to_arrow_table().select(schema.names).cast(schema)
    finally:
        for name in tables:
            con.unregister(name)


def _bucket_root(nodes: pa.Table) -> pa.Table:
    """The node that a bucket becomes."""
    n = nodes["n"][0].as_py()
    sql = f"{_runs(_levels(n))} SELECT any_value(tree) AS tree, any_value(pos) // {SPAN} AS pos, ({n} + {SPAN - 1}) // {SPAN} AS n, (SELECT h FROM n{_levels(n)}) AS h FROM nodes"
    return _ask(sql, pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("h", pa.string())]), nodes=nodes)


def _proofs(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a bucket's nodes and the one row of its root: the nodes with their proofs, inner levels first."""

    def work(nodes: pa.Table, above: pa.Table) -> pa.Table:
        k = _levels(nodes["n"][0].as_py()) if nodes.num_rows else 0
        at = [f"64 * (nodes.pos // {FAN**i} % {FAN})" for i in range(k)]
        steps = ", ".join(f"{{'left': substr(r{i}.run, 1, {a}), 'right': substr(r{i}.run, {a} + 65)}}" for i, a in enumerate(at))
        joins = " ".join(f"JOIN r{i} ON r{i}.pos = nodes.pos // {FAN ** (i + 1)}" for i in range(k))
        proof = f"list_concat([{steps}], above.proof)" if k else "above.proof"
        own = ", ".join(f"nodes.{c}" for c in nodes.column_names)
        return _ask(f"{_runs(k)} SELECT {own}, {proof} AS proof, above.subroot, above.root FROM nodes {joins}, above", schema, nodes=nodes, above=above)

    return work


def _ranked(rows: DataFrame, tree: Sequence[str], order: Sequence[str], stage: Stage, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with `pos` (from 0) and `n` within their tree, and the trees with `n`."""
    keys = [*tree, *order, "salt"]  # the salt parts equal rows
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(partitions_for(rows), *keys).sortWithinPartitions(*keys)
    dealt = stage.table(dealt.drop("salt").withColumn("at", F.monotonically_increasing_id()), name).withColumn("piece", F.shiftright("at", 33))
    pieces = dealt.groupBy("piece", *tree).agg(F.count("*").alias("rows"), F.min("at").alias("from"))
    own = Window.partitionBy(*tree)
    before = own.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("start", F.sum("rows").over(before) - F.col("rows") - F.col("from")).withColumn("n", F.sum("rows").over(own))
    pieces = stage.table(pieces, f"{name}-pieces")
    other = pieces.select(F.col("piece").alias("p"), *(F.col(c).alias(f"{c}_") for c in tree), "start", "n")
    same = functools.reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"{c}_")), tree, F.col("piece") == F.col("p"))
    out = dealt.join(other, same).withColumn("pos", F.col("at") + F.col("start")).drop("at", "piece", "p", "start", *(f"{c}_" for c in tree))
    return out, pieces.groupBy(*tree).agg(F.sum("rows").alias("n"))


def _bucket() -> Column:
    return F.floor(F.col("pos") / SPAN).alias("bucket")


def _up(nodes: DataFrame, stage: Stage, name: str) -> list[DataFrame]:
    """The tiers: `nodes`, then bucket roots, until every tree is one node."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n")).first()[0] or 1) > 1:
        some = tiers[-1].select("tree", "pos", "n", "h").groupBy("tree", _bucket())
        tiers.append(stage.table(some.applyInArrow(_bucket_root, "tree long, pos long, n long, h string"), f"{name}-{len(tiers)}"))
    return tiers


def _down(tiers: list[DataFrame], top: DataFrame, stage: Stage, name: str) -> DataFrame:
    """Proofs of the lowest tier's nodes, from those of the highest (tree, pos, proof, subroot, root)."""
    for k in reversed(range(len(tiers) - 1)):
        nodes = tiers[k]
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
        steps = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        arrow = pa.schema([(c, kinds[t]) for c, t in nodes.dtypes] + [("proof", steps), ("subroot", pa.string()), ("root", pa.string())])
        ddl = ", ".join(f"{c} {t}" for c, t in nodes.dtypes) + f", proof {STEPS}, subroot string, root string"
        above = top.select("tree", F.col("pos").alias("bucket"), "proof", "subroot", "root")
        below = nodes.groupBy("tree", _bucket()).cogroup(above.groupBy("tree", "bucket")).applyInArrow(_proofs(arrow), ddl)
        top = stage.table(below, f"{name}-{k}") if k else below
    return top


def manifest(docs: DataFrame, stage: Stage, fields: Sequence[str], tree: str, order: str, other: Column | None = None) -> DataFrame:
    """A row per document: the order column, leaf, other_leaf, tree, pos, subroot, root, proof.

    `fields` make the leaf, `tree` names the column of the groups, `order` the
    one (of whole numbers) by which leaves ascend.  `other` may give the leaf of
    another version of the row, to be held against the proof.
    """
    rows = docs.select(F.col(tree).cast("string").alias("name"), F.col(order).cast("long").alias("key"), leaf([F.col(c) for c in fields]).alias("h"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    rows = stage.table(rows, "leaves")
    leaves, trees = _ranked(rows, ["name"], ["key", "h"], stage, "order")
    numbered, _ = _ranked(trees.select("name"), [], ["name"], stage, "trees")
    numbered = numbered.select(F.col("name").alias("of"), F.col("pos").alias("tree"), F.col("n").alias("trees"))
    leaves = leaves.join(numbered.drop("trees"), F.col("name").eqNullSafe(F.col("of"))).select("tree", "pos", "n", "h", "name", "key", "other")
    inner = _up(stage.table(leaves, "tier-0"), stage, "tier")
    subroots = inner[-1].join(numbered.select("tree", "trees"), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("n"), "h")
    outer = _up(stage.table(subroots, "outer-0"), stage, "outer")
    none = F.array().cast(STEPS).alias("proof")
    top = outer[-1].select("tree", "pos", "h", none, F.col("h").alias("subroot"), F.col("h").alias("root"))
    top = _down(outer, top, stage, "outer-down")
    top = stage.table(top.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "proof", F.col("h").alias("subroot"), "root"), "subroots")
    if len(inner) == 1:  # every tree is one leaf
        found = inner[0].join(top.drop("pos"), "tree")
    else:
        found = _down(inner, top, stage, "down")
    return found.select(F.col("key").alias(order), F.col("name").alias("tree"), "pos", F.col("h").alias("leaf"), F.col("other").alias("other_leaf"), "subroot", "root", "proof")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spoilt = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    text = F.when(spoilt, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    out = manifest(docs, Stage(spark, "op11"), FIELDS, "lang", "doc_id", leaf([text if c == "text" else F.col(c) for c in FIELDS]))
    folded = out.withColumn("folded_root", fold(F.col("other_leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
