"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the word windows of the benchmark items, grouped by length (whole
items where they are shorter than a window).  For each length a shift table
over hashed blocks of two words says how far a search may jump; a block that
ends a pattern has shift 0, and its suffix-hash bucket lists the patterns to
test.  A candidate is compared word hash by word hash and then byte by byte.
The search runs in many lanes of a chunk at once; lanes jump independently.

The benchmark is cut into blocks of at most `block_windows` windows; each block
is a broadcast of bounded size and one narrow pass over the documents.  Of more
than one block the driver holds one at a time: every pass is written to the
shared folder and its block released before the next is made.  Tables are made
once for each Python worker.  Documents are not shuffled.

Defined results: null and word-less texts have no words and no hits; null or
word-less items match nothing; very long texts are searched whole; an item with a null id is dropped, or with
`unnamed` counts like any other and is a null among the items (as in SQL: one
of `n_items`, nothing in the joined names); repeated items and rows are harmless; an empty benchmark leaves all
documents clean.  Extra document columns pass through; the operator's own
column names replace columns of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.kernels import ALNUM_WORD, U64, Words, chunks, fresh, mix, string_views
from larder.llm.staging import Stage, send, spread

_A = U64(0x9FB21C651E98DF25)


def _blocks(prev: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mix(prev * _A + last)


class Patterns:
    """Tables of all patterns of one length."""

    def __init__(self, hashes: np.ndarray, texts: list[bytes], items: list[list[str | None]]):
        self.n, self.length = hashes.shape
        self.hashes, self.texts, self.items = hashes, texts, items
        self.block = min(2, self.length)
        self.bits = U64(64 - max(12, int(np.ceil(np.log2(16 * self.n * self.length + 1)))))
        most = self.length - self.block + 1
        self.shift = np.full(1 << (64 - int(self.bits)), min(most, 255), dtype=np.uint8)
        for q in range(self.block - 1, self.length):
            np.minimum.at(self.shift, self._bucket(hashes[:, q - 1] if self.block == 2 else None, hashes[:, q]), min(self.length - 1 - q, 255))
        suffix = self._bucket(hashes[:, -2] if self.block == 2 else None, hashes[:, -1])
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _bucket(self, prev: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return ((_blocks(prev, last) if prev is not None else mix(last)) >> self.bits).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Last word and pattern of each occurrence."""
        h, n, m = words.hash, len(words.hash), self.length
        if n < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lane = max(64, n // 4096)
        at = np.arange(m - 1, n, lane)
        stop = np.minimum(at + lane, n)
        found = []
        while len(at):
            shift = self.shift[self._bucket(h[at - 1] if self.block == 2 else None, h[at])]
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        ends = np.concatenate(found)
        ends = ends[words.doc[ends - m + 1] == words.doc[ends]]
        bucket = self._bucket(h[ends - 1] if self.block == 2 else None, h[ends])
        left, right = np.searchsorted(self.suffix, bucket, "left"), np.searchsorted(self.suffix, bucket, "right")
        got_end, got_pattern = [], []
        while len(ends):
            more = left < right
            ends, left, right = ends[more], left[more], right[more]
            if not len(ends):
                break
            p = self.order[left]
            same = np.ones(len(ends), dtype=bool)
            for q in range(m):
                same &= h[ends - m + 1 + q] == self.hashes[p, q]
            got_end.append(ends[same])
            got_pattern.append(p[same])
            left = left + 1
        if not got_end:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends, pattern = np.concatenate(got_end), np.concatenate(got_pattern)
        sure = np.fromiter(
            (b" ".join(words.text(i) for i in range(e - m + 1, e + 1)) == self.texts[p] for e, p in zip(ends.tolist(), pattern.tolist(), strict=True)),
            dtype=bool, count=len(ends)
        )
        return ends[sure], pattern[sure]


def _in_order(items: Iterable[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is not None, x or ""))


def pattern_blocks(
    items: Iterator[tuple[object, str | None]], window: int, block_windows: int, unnamed: bool = False
) -> Iterator[dict[int, tuple[np.ndarray, list[bytes], list[list[str | None]]]]]:
    """Windows of the items by length, in blocks of about `block_windows` windows."""
    held: dict[int, dict[bytes, tuple[np.ndarray, set[str | None]]]] = defaultdict(dict)
    count = 0

    def done() -> dict:
        return {m: (np.stack([h for h, _ in x.values()]), list(x), [_in_order(i) for _, i in x.values()]) for m, x in held.items()}

    for item, text in items:
        if (item is None and not unnamed) or not text:
            continue
        raw = text.encode()
        w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), 0, 1, ALNUM_WORD, True)
        n = len(w.hash)
        if not n:
            continue
        m = min(n, window)
        words = [w.text(i) for i in range(n)]
        for i in range(n - m + 1):
            held[m].setdefault(b" ".join(words[i : i + m]), (w.hash[i : i + m], set()))[1].add(None if item is None else str(item))
            count += 1
        if count >= block_windows:
            yield done()
            held.clear()
            count = 0
    if count:
        yield done()


class Block:
    """Windows of one block by length; their tables are made where they are first asked for and stay there."""

    def __init__(self, windows: dict):
        self.windows, self.made = windows, None

    def __getstate__(self) -> dict:
        return {"windows": self.windows, "made": None}

    def tables(self) -> list[Patterns]:
        if self.made is None:
            self.made = [Patterns(*x) for _, x in sorted(self.windows.items())]
        return self.made


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_windows: int = 250_000, unnamed: bool = False
) -> DataFrame:
    """The documents with n_words, hit_spans (array of first and last hit word), n_hit and items (sorted as strings)."""
    spark = docs.sparkSession
    own = ["n_words", "n_hit", "hit_spans", "items"]
    docs = docs.drop(*own)
    names = docs.columns
    at = names.index(doc_text)
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema
    ) + ", n_words long, n_hit long, hit_spans array<struct<first: bigint, last: bigint>>, items array<string>"

    def one_pass(df: DataFrame, shared) -> DataFrame:
        first = len(df.columns) == len(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh()
            tables = shared.value.tables()
            for whole in batches:
                _, cuts, _ = string_views(whole.column(at))
                for lo, hi in chunks(cuts):
                    batch = whole.slice(lo, hi - lo)
                    data, offsets, nulls = string_views(batch.column(at))
                    w = Words(data, offsets, 0, len(nulls), ALNUM_WORD, True)
                    edge = np.zeros(len(w.hash) + 1, dtype=np.int64)
                    items: dict[int, set[str | None]] = defaultdict(set)
                    if not first:
                        for i, (s, x) in enumerate(zip(batch.column(len(names) + 2).to_pylist(), batch.column(len(names) + 3).to_pylist(), strict=True)):
                            items[i].update(x)
                            for y in s:
                                edge[w.first[i] + y["first"]] += 1
                                edge[w.first[i] + y["last"] + 1] -= 1
                    for t in tables:
                        ends, pattern = t.search(w)
                        np.add.at(edge, ends - t.length + 1, 1)
                        np.add.at(edge, ends + 1, -1)
                        for e, p in zip(ends.tolist(), pattern.tolist(), strict=True):
                            items[int(w.doc[e])].update(t.items[p])
                    hit = np.cumsum(edge[:-1]) > 0
                    total = np.concatenate([[0], np.cumsum(hit)])
                    places: list[list[dict]] = [[] for _ in range(len(nulls))]
                    for i in items:
                        own_hits = hit[w.first[i] : w.first[i + 1]].astype(np.int8)
                        d = np.diff(np.concatenate([[0], own_hits, [0]]))
                        places[i] = [{"first": a, "last": b - 1} for a, b in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *batch.columns[: len(names)], pa.array(w.n, pa.int64()), pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()),
                            pa.array(places, spans), pa.array([_in_order(items.get(i, ())) for i in range(len(nulls))], pa.list_(pa.string()))
                        ],
                        names=[*names, *own],
                    )

        return df.mapInArrow(run, schema)

    rows = benchmark.select(F.col(item_id), F.col(item_text).cast("string")).distinct().toLocalIterator()  # a partition at a time
    blocks = pattern_blocks(((r[0], r[1]) for r in rows), window, block_windows, unnamed)
    now, ahead = next(blocks, {}), next(blocks, None)
    if ahead is None:
        return one_pass(docs, send(spark, Block(now)))
    stage, out, n = Stage(spark, "decontaminate"), docs, 0
    while now is not None:
        shared = send(spark, Block(now))
        out = stage.table(one_pass(out, shared), f"pass-{n}")
        shared.destroy()
        if n:
            stage.drop(f"pass-{n - 1}")
        now, ahead, n = ahead, next(blocks, None) if ahead is not None else None, n + 1
    return out


def op4_decontaminate(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
