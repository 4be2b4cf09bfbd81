"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept; its result is written as Parquet and read again.  All stages but
the last return the columns of documents.

Defined results: columns besides doc_id and text pass through unchanged, whatever
their names (n_chars, where there is one, follows the text).  A null or empty
text has the quality of no lines, is no duplicate, and is packed as its end id.
Every row counts by itself, so rows that repeat an id stay unless their texts
are near-duplicates; of those the row with the smallest id stays, then the one
whose text hashes lowest.  Null ids come last; their rows lose no passages.  Very
long texts go through whole.  An empty table gives an empty table.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.decontaminate import decontaminate
from larder.llm.near_dup import near_duplicates
from larder.llm.packing import pack
from larder.llm.quality_crf import fit_quality, score_quality
from larder.llm.staging import Scope, Stage
from larder.llm.substring_dedup import dedup_substrings

QUALITY = 0.3  # documents with a lower score go
SIMILARITY = 80  # percent of shared five-word shingles from which documents are near-duplicates


_owner = Scope()


def _stage(f):
    """A stage; as it begins, the work tables and broadcasts of the one before go, whose result is written by then."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _owner.close()
        with _owner.active():
            return f(spark, docs, sf_dir)

    return run


def _apart(docs: DataFrame) -> DataFrame:
    """The documents with id, text and all other columns (as a struct) under names that no operator uses for its own."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *others).alias("other_columns"))


def _own(docs: DataFrame, name: str) -> Column:
    """A column of the documents, of what `_apart` made of them."""
    return F.col(name) if name in ("doc_id", "text") else F.col(f"other_columns.c{docs.columns.index(name)}")


def _back(out: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of the documents again."""
    return out.select(*((changed[c] if c in changed else _own(docs, c)).alias(c) for c in docs.columns))


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF accepts."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(score_quality(_apart(docs), model).where(F.col("score") >= QUALITY), docs)


@_stage
def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of each group of near-duplicates: that with the smallest id (null ids come last).  Every row counts by itself, whatever its id."""
    stage = Stage(spark, "pipeline-near")
    rows = stage.table(_apart(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")  # written, so the numbers hold
    found = near_duplicates(rows, stage, doc_id="_row", percent=SIMILARITY).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "_row")
    stays = rows.select("_row", order.alias("o")).join(found, "_row").groupBy("component_id").agg(F.min("o")["_row"].alias("_row"))
    return _back(rows.join(stays.select("_row"), "_row", "left_semi"), docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that a document with a smaller id has as well."""
    out = dedup_substrings(_apart(docs), Stage(spark, "pipeline-substring"))
    if "n_chars" not in docs.columns:
        return _back(out, docs)
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(_own(docs, "n_chars"))
    return _back(out, docs, n_chars=chars)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    out = decontaminate(_apart(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)
    return _back(out.where("n_hit = 0"), docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: a row per piece, with its ids."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("near_dup", near_dup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs, before = Stage(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, f in STAGES[:-1]:
        docs = stage.table(f(spark, docs, sf_dir), name)
        if before:
            stage.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
