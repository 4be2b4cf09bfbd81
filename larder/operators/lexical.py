"""Ranked text search over an index of impact-ordered postings, with dynamic pruning.

Every task turns its documents into shards of a bounded number of them and of
their postings; nothing is shuffled for that.  The index has a row per shard and term: the shard's
documents with that term (by number) and how often each has it, ordered by what
the term adds to their score (without its weight), largest first.  Cut every
`BLOCK` postings, the first entry of a block bounds all in it and behind it.  A
term that is in a third of all documents is many rows of bounded size.  Rows are
dealt by term (salted) and sorted, so a search reads the files of its terms only.

Every shard finds its own best k of each query, and those are ranked.  Within a
shard, terms are taken rarest first,
and once k documents have a score, blocks whose bound plus all that later terms
can add stays below the k-th are not opened; when that holds for whole terms,
only documents met before are looked up in them.  Scores are those of the full sum.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.session import shared_folder

BLOCK = 128
SHARD_DOCS = 8192
SHARD_POSTINGS = 1 << 21  # of a shard, unless one document has more
TEXTS = 1 << 20  # bytes of texts that a task counts at a time, about
QUERIES = 2048  # queries of one pass over the index
EPS = 1e-9  # scores that differ by less are ties


@dataclass(frozen=True)
class Analyse:
    """Splits a text into words; a word's term may be another, or none."""

    split: Callable[[str], list[str]]
    term: Callable[[str], str | None] | None = None

    def __call__(self, text: str) -> list[str]:
        found = self.split(text)
        return found if self.term is None else [t for t in map(self.term, found) if t]

    def count(self, text: str) -> Counter:
        """How often each term occurs; every distinct word is looked at once."""
        found = Counter(self.split(text))
        if self.term is None:
            return found
        out: Counter = Counter()
        for w, n in found.items():
            if t := self.term(w):
                out[t] += n
        return out


def _alphanumeric(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


words = Analyse(_alphanumeric)  # runs of letters and digits, in lower case


def plain(text: str) -> str:
    """In lower case, without accents."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _letters(text: str) -> list[str]:
    return re.findall("[a-z]+", plain(text))


def english(stop: Iterable[str] | None = None, stem: Callable[[str], str] | None = None) -> tuple[Analyse, Analyse]:
    """Analysers of documents and of queries: no accents, letters only, stop words left out of documents, then stems.

    `stop` defaults to Spark's English list.  A query's stop words match nothing, unless their stem is another word's.
    """
    out = frozenset(StopWordsRemover.loadDefaultStopWords("english") if stop is None else stop)
    return Analyse(_letters, lambda w: None if w in out else stem(w) if stem else w), Analyse(_letters, stem)


@dataclass
class Index:
    table: DataFrame | None  # shard, tier, term, n, docs, tfs, ids, lengths; a row with a null term has its shard's ids and lengths
    n_docs: int
    mean: float
    k1: float = 1.2
    b: float = 0.75

    def impacts(self, tfs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return tfs * (self.k1 + 1) / (tfs + self.k1 * (1 - self.b + self.b * lengths / (self.mean or 1.0)))


def _some(sizes: np.ndarray, most: int, first: int = 0) -> int:
    """How many of the rows hold no more than `most` together, with `first` before them; one at least where `first` is 0."""
    return max(int(np.searchsorted(np.cumsum(sizes, dtype=np.int64), most - first, side="right")), 0 if first else 1)


def _counted(analyse: Analyse):
    """Documents as their distinct terms, how often each occurs, and the number of words; few texts are looked at together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, lo = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False), 0
            while lo < b.num_rows:
                some = b.slice(lo, _some(sizes[lo : lo + SHARD_DOCS], TEXTS))
                lo += some.num_rows
                found = [analyse.count(t or "") for t in some.column(2).to_pylist()]
                lists = pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *lists, pa.array([sum(c.values()) for c in found], pa.int32())], names=["id", "tier", "terms", "tfs", "length"])

    return run


ROW = "shard long, tier long, term string, n int, docs array<int>, tfs array<int>, ids array<long>, lengths array<int>"


def _inverted(index: Index, shard_docs: int, most: int = SHARD_POSTINGS):
    """Documents to the rows of shards, of `most` postings each."""

    def shard(number: int, tier: int, parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts).combine_chunks()
        ids, lengths = t["id"].to_numpy(), t["length"].to_numpy()
        tfs = t["tfs"].combine_chunks()
        of = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(tfs.offsets.to_numpy()))
        coded = t["terms"].combine_chunks().flatten().dictionary_encode()
        names, term, tf = coded.dictionary, coded.indices.to_numpy(), tfs.flatten().to_numpy()
        order = np.lexsort((of, -index.impacts(tf, lengths[of]), term))
        n = np.bincount(term, minlength=len(names)).astype(np.int32)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        docs, often = (pa.ListArray.from_arrays(ends, pa.array(x[order].astype(np.int32))) for x in (of, tf))
        k, no, empty = len(names), pa.nulls, pa.list_(pa.int32())
        both = lambda first, kind: pa.concat_arrays([no(k, kind), pa.array([first], kind)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(k + 1, number)), pa.array(np.full(k + 1, tier)), pa.concat_arrays([names, no(1, pa.string())]), pa.array(np.append(n, len(ids)).astype(np.int32)),
                pa.concat_arrays([docs, no(1, empty)]), pa.concat_arrays([often, no(1, empty)]), both(ids.tolist(), pa.list_(pa.int64())), both(lengths.tolist(), empty),
            ],
            names=["shard", "tier", "term", "n", "docs", "tfs", "ids", "lengths"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        docs, postings = Counter(), Counter()
        number = TaskContext.get().partitionId() << 32

        def full(tier: int) -> pa.RecordBatch:
            nonlocal number
            del docs[tier], postings[tier]
            number += 1
            return shard(number - 1, tier, held.pop(tier))

        for b in batches:
            t = pa.Table.from_batches([b])
            for tier in np.unique(t["tier"].to_numpy()).tolist():
                own = t.filter(pa.array(t["tier"].to_numpy() == tier))
                sizes = np.diff(own["tfs"].combine_chunks().offsets.to_numpy())
                while len(own):
                    n = min(_some(sizes, most, postings[tier]), shard_docs - docs[tier])
                    if n:
                        held.setdefault(tier, []).append(own.slice(0, n))
                        docs[tier] += n
                        postings[tier] += int(sizes[:n].sum())
                        own, sizes = own.slice(n), sizes[n:]
                    if len(own) or docs[tier] >= shard_docs:
                        yield full(tier)
                while postings.total() > most and len(held) > 1:  # of all tiers no more than of one
                    yield full(max(postings, key=postings.get))
        for tier in list(held):
            yield full(tier)

    return run


def build_index(docs: DataFrame, analyse: Analyse = words, k1: float = 1.2, b: float = 0.75, shard_docs: int = SHARD_DOCS, doc_id: str = "id", text: str = "text", tier: str | None = None, path: str | None = None) -> Index:
    """The index of all documents, written below the shared folder or at `path`.

    Documents with a null id are left out; empty ones count in the mean length.  `tier` names a column of whole numbers
    by which documents are ranked before their score: each tier has shards of its own.
    """
    spark, folder = docs.sparkSession, path or shared_folder(docs.sparkSession, "bm25")
    level = F.lit(0) if tier is None else F.coalesce(F.col(tier), F.lit(0))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), level.cast("long").alias("tier"), F.col(text).cast("string").alias("text"))
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    rows.mapInArrow(_counted(analyse), "id long, tier long, terms array<string>, tfs array<int>, length int").write.parquet(f"{folder}/documents")
    counted = spark.read.parquet(f"{folder}/documents")
    n, mean = counted.agg(F.count("*"), F.avg("length")).first()
    index = Index(counted, n, mean or 0.0, k1, b)
    lists = counted.mapInArrow(_inverted(Index(None, n, mean or 0.0, k1, b), shard_docs, SHARD_POSTINGS), ROW)
    # a common term's rows go to several files; the salt follows from the shard, so each row has one place
    salted = lists.repartition("term", F.pmod(F.xxhash64("shard"), F.lit(16))).sortWithinPartitions("term")
    salted.write.parquet(f"{folder}/postings")
    index.table = spark.read.parquet(f"{folder}/postings")
    return index


class _Postings:
    """A term's postings in a shard, by impact; in the order of documents when they are first looked up."""

    def __init__(self, at: np.ndarray, impacts: np.ndarray):
        self.at, self.impacts, self.order = at, impacts, None

    def look(self, docs: np.ndarray) -> np.ndarray:
        if self.order is None:
            self.order = np.argsort(self.at, kind="stable")
            self.sorted = self.at[self.order]
        i = np.minimum(np.searchsorted(self.sorted, docs), len(self.sorted) - 1)
        return np.where(self.sorted[i] == docs, self.impacts[self.order[i]], 0.0)


class _List:
    """A term's postings with the term's weight in a query."""

    def __init__(self, weight: float, own: _Postings):
        self.weight, self.own, self.at, self.impacts = weight, own, own.at, own.impacts

    def most(self) -> float:
        return self.weight * self.impacts[0]

    def look(self, docs: np.ndarray) -> np.ndarray:
        """What the term adds to documents (their places in the shard)."""
        return self.weight * self.own.look(docs)


def best_of(lists: list[_List], n_docs: int, k: int, least: float = 0.0) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of documents, among them the best k from `least` on with all ties of the last, and postings opened."""
    lists = sorted(lists, key=lambda x: len(x.at) / x.most())  # much score for few postings first
    rest = np.append(np.cumsum([x.most() for x in lists][::-1])[::-1], 0.0)
    score, met, opened, bar = np.zeros(n_docs), np.zeros(0, dtype=np.int64), 0, least - EPS
    for i, one in enumerate(lists):
        # new documents can still reach the bar by blocks whose first entry plus all later terms does
        upto = int(np.searchsorted(-one.impacts, -(bar - rest[i + 1]) / one.weight, side="right")) if bar > rest[i + 1] else len(one.at)
        upto = min(len(one.at), -(-upto // BLOCK) * BLOCK)
        new = one.at[:upto]
        opened += upto
        fresh = new[~np.isin(new, met, assume_unique=True)] if len(met) else new
        met = met[score[met] + rest[i] >= bar] if bar > 0 else met
        score[met] += one.look(met)
        score[fresh] += one.look(fresh) if len(fresh) < upto else one.weight * one.impacts[:upto]
        met = np.concatenate([met, fresh])
        if len(met) >= k:
            bar = max(bar, float(np.partition(score[met], len(met) - k)[len(met) - k]) - 2 * EPS)
    met = met[score[met] >= bar]
    return met, score[met], opened


FOUND = "qid long, tier long, id long, score double, opened long, postings long"


def _search(shared, like: Index, k: int, least: float, report: bool):
    def work(key: tuple, t: pa.Table, docs: pa.Table) -> pa.Table:
        out = [[], [], [], [], [], []]
        if len(t) and len(docs):
            by_term, qids = shared.value
            ids, lengths = (docs[c].combine_chunks().flatten().to_numpy() for c in ("ids", "lengths"))
            at, tfs = (t[c].combine_chunks().flatten().to_numpy() for c in ("docs", "tfs"))
            impacts, ends, sizes = like.impacts(tfs, lengths[at]), np.cumsum(t["n"].to_numpy()), t["n"].to_numpy()
            lists: dict[int, list[_List]] = {}
            for term, end, n in zip(t["term"].to_pylist(), ends, sizes):
                own = _Postings(at[end - n : end], impacts[end - n : end])
                for q, weight in by_term.get(term, ()):
                    lists.setdefault(q, []).append(_List(weight, own))
            tier = key[1].as_py()
            for q, own in lists.items():
                found, score, opened = best_of(own, len(ids), k, least)
                order = np.lexsort((ids[found], -np.round(score, 9)))[:k]
                rows = ids[found[order]], score[order], [0] * len(order), [0] * len(order)
                if report:
                    rows = [0], [0.0], [opened], [sum(len(x.at) for x in own)]
                for column, some in zip(out, ([qids[q]] * len(rows[0]), [tier] * len(rows[0]), *rows)):
                    column.extend(some)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, kind) for c, kind in zip(out, kinds)], names=["qid", "tier", "id", "score", "opened", "postings"])

    return work


def _passes(index: Index, queries: DataFrame, analyse: Analyse, k: int, least: float, report: bool) -> DataFrame:
    """Every shard's best of every query; of the queries the driver holds one block at a time."""
    spark, like = index.table.sparkSession, Index(None, index.n_docs, index.mean, index.k1, index.b)
    postings = index.table.where("term IS NOT NULL").select("shard", "tier", "term", "n", "docs", "tfs")
    docs = index.table.where("term IS NULL").select(F.col("shard").alias("of_shard"), F.col("tier").alias("of_tier"), "ids", "lengths")

    def blocks() -> Iterator[list]:
        held = []
        for r in queries.select(F.col("qid").cast("long").alias("qid"), F.col("text").cast("string").alias("text")).where("qid IS NOT NULL").toLocalIterator():
            held.append((r["qid"], list(dict.fromkeys(analyse(r["text"] or "")))))
            if len(held) == QUERIES:
                yield held
                held = []
        if held:
            yield held

    found = []
    for block in blocks():
        asked = sorted({w for _, ws in block for w in ws})
        some = postings.where(F.col("term").isin(asked)) if len(asked) <= 1000 else postings.join(spark.createDataFrame([(w,) for w in asked], "term string"), "term", "left_semi")
        df = dict(tuple(r) for r in some.groupBy("term").agg(F.sum("n")).collect())  # of one block's terms
        weights: dict[str, list] = {}
        for i, (_, ws) in enumerate(block):
            for w in ws:
                if w in df:
                    weights.setdefault(w, []).append((i, float(np.log((index.n_docs - df[w] + 0.5) / (df[w] + 0.5) + 1))))
        shared = spark.sparkContext.broadcast((weights, [q for q, _ in block]))
        both = some.groupBy("shard", "tier").cogroup(docs.groupBy("of_shard", "of_tier"))
        found.append(both.applyInArrow(_search(shared, like, k, least, report), FOUND))
    if not found:
        return spark.createDataFrame([], FOUND)
    if len(found) == 1:
        return found[0]
    at = shared_folder(spark, "bm25-found")
    for f in found:
        f.write.mode("append").parquet(at)
    return spark.read.parquet(at)


def search(index: Index, queries: DataFrame, k: int, analyse: Analyse = words, least: float = 0.0) -> DataFrame:
    """The best k documents of each query (qid, text) from `least` on: qid, id, tier, score, rank (from 1).

    A higher tier comes first, then a higher score (in nine places), then a smaller id.
    """
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("tier"), F.desc(F.round("score", 9)), "id"))
    found = _passes(index, queries, analyse, k, least, False).where(F.col("score") >= least)
    return found.select("qid", "id", "tier", "score").withColumn("rank", rank).where(F.col("rank") <= k)


def work(index: Index, queries: DataFrame, k: int, analyse: Analyse = words, least: float = 0.0) -> DataFrame:
    """What a search opens: qid, opened, postings."""
    return _passes(index, queries, analyse, k, least, True).groupBy("qid").agg(F.sum("opened").alias("opened"), F.sum("postings").alias("postings"))
