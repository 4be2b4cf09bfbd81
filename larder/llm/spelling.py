"""Spelling variants: words that one inserted, deleted or replaced letter parts, and the common form of each.

Candidates come from two sorted dictionaries, one of the words and one of the
words read backwards.  One edit leaves the first or the last half of a word
intact (of the shorter word's length, rounded down), so near words lie together
in a block of a shared prefix, or in the other dictionary in a block of a shared
suffix.  A block of more than `block` words is subdivided: what lies between its
shared ends is one edit apart as well, so again a half of it is shared, and the
block's words go to blocks of a longer prefix and of a longer suffix.  Where one
letter is left between the ends, a block holds no more words than the alphabet
allows.  Blocks are ranges of a sorted table; tasks scan them, compare each word
with those after it in its block, drop most by a signature of their letters and
verify the rest.  Only verified links leave a task.

A word's form is its most frequent near word, if that is `ratio` times as
frequent; forms are followed by pointer doubling.  Frequencies grow with every
step by that ratio, so there are no cycles and few rounds.

Defined results: null texts have no words; a document with a null id has no
letters deleted by `spoilt`; repeated rows count each; ties of form go to the
word that is smallest in code-point order; very long texts are read whole, very
long words are words; an empty table, or no frequent word, gives an empty table.
Columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.staging import Stage, partitions_for

RUNS = "[A-Za-zÀ-ÿ]+"
BLOCK = 64  # words in a block that is compared
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of letters of whole texts, A-Z in lower case."""
    found = F.regexp_extract_all(F.translate(F.col(text).cast("string"), _UPPER, _LOWER), F.lit(RUNS), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("run"))


def spoilt(rows: DataFrame, every: int = 199) -> Column:
    """The run with one letter deleted where `every` divides the checksum of its document and itself."""
    h, n = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary")), F.length("run")
    at = (h % n).cast("int")
    return F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, n))).otherwise(F.col("run"))


def dictionary(words: DataFrame, least: int = 6, often: int = 5) -> DataFrame:
    """(word, n): words of `least` letters or more that occur `often` times or more."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def near(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced between the two."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) > len(a) + 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _signature(word: str) -> int:
    """A bit for each letter (modulo 64) that occurs an odd number of times: one edit changes at most two."""
    s = 0
    for c in word:
        s ^= 1 << (ord(c) & 63)
    return s


def _links(block: np.ndarray, words: np.ndarray, shorter: np.ndarray) -> Iterator[tuple[str, str]]:
    """Near pairs within blocks, stretches of equal `block` (should two adjacent ones share a hash, they are compared as one).  Pairs of two longer words are left to another block."""
    marks = np.fromiter(map(_signature, words), dtype=np.uint64, count=len(words))
    step, at = 1, np.arange(len(words))
    while len(at := at[at + step < len(words)]) and len(at := at[block[at] == block[at + step]]):
        to = at + step
        ok = (shorter[at] | shorter[to]) & (np.bitwise_count(marks[at] ^ marks[to]) <= 2)
        yield from ((words[i], words[j]) for i, j in zip(at[ok], to[ok]) if near(words[i], words[j]))
        step += 1


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a sorted stretch of blocks; the last block of a batch waits for the next."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        ids = t["block"].to_numpy()
        ends = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        cut = int(ends[-1]) if len(ends) else 0
        yield from _found(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None:
        yield from _found(rest)


def _found(t: pa.Table) -> Iterator[pa.RecordBatch]:
    pairs = list(_links(t["block"].to_numpy(), np.array(t["word"].to_pylist(), dtype=object), t["shorter"].to_numpy())) if len(t) else []
    for i in range(0, len(pairs), 1 << 16):
        some = pairs[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in some], pa.string()), pa.array([b for _, b in some], pa.string())], ["a", "b"])


def _core() -> Column:
    """Letters between a block's shared ends, in its shorter words."""
    return F.col("s") - F.col("pre") - F.col("suf")


def _halved(rows: DataFrame) -> DataFrame:
    """The rows in the two blocks that lie within theirs: one of a longer prefix, one of a longer suffix."""
    half = F.floor(_core() / 2).cast("int")
    ends = F.array(F.struct((F.col("pre") + half).alias("pre"), F.col("suf").alias("suf")), F.struct(F.col("pre").alias("pre"), (F.col("suf") + half).alias("suf")))
    return rows.select("word", "s", F.explode(ends).alias("e")).select("word", "s", "e.pre", "e.suf")


def _keyed(rows: DataFrame) -> DataFrame:
    """Blocks by length of the shorter words, length and letters of the shared ends; the suffix is read backwards."""
    ends = F.struct("s", "pre", "suf", F.substring("word", F.lit(1), F.col("pre")).alias("prefix"), F.substring(F.reverse("word"), F.lit(1), F.col("suf")).alias("suffix"))
    return rows.select("word", "s", "pre", "suf", ends.alias("ends"))


def links(words: DataFrame, stage: Stage, block: int = BLOCK) -> DataFrame:
    """(a, b): every pair of near words, in both directions; `words` has distinct words."""
    n = F.length("word")
    lengths = words.select("word", F.explode(F.array(n, n - 1)).alias("s")).where("s > 0")
    now = stage.table(_halved(lengths.withColumn("pre", F.lit(0)).withColumn("suf", F.lit(0))), "blocks-0")
    found, k = [], 0
    while now is not None:
        k += 1
        rows = _keyed(now)
        sizes = rows.groupBy("ends").agg(F.count("*").alias("size")).where("size > 1")
        # a block of one letter between its ends is as small as it can be
        sizes = stage.table(sizes.withColumn("large", (F.col("size") > block) & (F.col("ends.s") - F.col("ends.pre") - F.col("ends.suf") > 1)), f"sizes-{k}")
        sized = rows.join(sizes, "ends")
        small = sized.where("NOT large").select("ends", "word", (F.length("word") == F.col("s")).alias("shorter"))
        # the sorted dictionary of this round, whole blocks in ranges; a hash tells a block from the next
        ranges = small.repartitionByRange(partitions_for(now), "ends").sortWithinPartitions("ends", "word")
        scanned = ranges.select(F.xxhash64("ends").alias("block"), "word", "shorter").mapInArrow(_scan, "a string, b string")
        found.append(stage.table(scanned, f"links-{k}"))
        large = sizes.where("large")
        now = None if large.isEmpty() else stage.table(_halved(sized.where("large").select("word", "s", "pre", "suf")).distinct(), f"blocks-{k}")
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    return both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def variants(words: DataFrame, stage: Stage, ratio: int = 5, block: int = BLOCK) -> DataFrame:
    """A row per word of (word, n): word, form, root, n, n_near, form_n."""
    words = stage.table(words.select("word", "n"), "words")
    pairs = links(words.select("word"), stage, block).join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = pairs.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("b").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").withColumn("takes", -F.col("best.less") >= ratio * F.col("n"))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("takes"), F.col("best.form")).alias("form"), F.when(F.col("takes"), -F.col("best.less")).alias("form_n"))
    rows = stage.table(rows, "forms")
    ends, k = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    ends = stage.table(ends, "roots-0")
    while not ends.alias("x").join(ends.alias("y"), F.col("x.root") == F.col("y.word"), "left_semi").isEmpty():
        k += 1
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = stage.table(ends.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{k}")
    out = rows.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir):
    rows = runs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return variants(dictionary(rows.select(spoilt(rows).alias("word"))), Stage(spark, "op12"))
