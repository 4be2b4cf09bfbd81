"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn by hashing the letter and
the coordinate, so any alphabet has vectors and none are stored.  An n-gram is
bound: the vector of its k-th letter is rotated by k places (a permutation) and
the n vectors are multiplied.  A text is the bundle (sum) of its n-grams, a
language the bundle of the texts in it; a text is in the language whose
prototype has the largest cosine with it, after the mean of all prototypes, what
languages have in common, is taken off the prototypes.

Texts are read as letters in lower case, in words with a space at both ends;
what is no letter parts words.  Distinct n-grams are counted before they are
bound, so a letter's cost is that of counting it; bundles come from a product of
counts and n-gram vectors, block by block.  All sums are of whole numbers, so
prototypes do not depend on how rows are dealt.

Each task bundles its rows by language and passes on one vector for each; these
are added in two steps of bounded groups.  Prototypes go out in blocks of
`BLOCK` languages, each block in a pass of its own, so what is broadcast at a
time has a fixed size, however many languages there are.

Defined results: null texts and texts without a letter are `und` with score 0,
and are not learned from; nor are rows with a null language.  Where nothing is
learned, every text is `und`.  Ties go to the language that is smallest in code-point
order.  Repeated rows count each.  Very long texts are read whole, in parts.  An
empty table gives an empty table.  Other columns pass through `predict`
unchanged, but for those it adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.kernels import mix
from larder.llm.staging import Stage, send, spread

DIMENSIONS, ORDER = 1024, 3
BLOCK = 1024  # languages whose prototypes are broadcast at a time
PART = 1 << 20  # letters of a text that are read at a time
HELD = 1 << 16  # distinct n-grams (of a language) counted before they are bound
UNDETERMINED = "und"
_U = np.uint64


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """A row of +1 and -1 for each code point."""
    seeds = mix(codes.astype(_U) + _U(0x51ED270B7F4A7C15))
    words = mix(seeds[:, None] + np.arange(-(-dimensions // 64), dtype=_U) * _U(0x9E3779B97F4A7C15))
    bits = np.unpackbits(words.view(np.uint8), axis=1)[:, :dimensions]
    return (bits.astype(np.int8) << 1) - 1


def gram_vectors(grams: np.ndarray, dimensions: int, order: int) -> np.ndarray:
    """Bound vectors of n-grams, given as numbers of 21 bits for each letter, the first one highest."""
    out = None
    for k in range(order):
        codes, which = np.unique((grams >> _U(21 * (order - 1 - k))) & _U((1 << 21) - 1), return_inverse=True)
        turned = np.roll(letter_vectors(codes, dimensions), order - 1 - k, axis=1)[which]
        out = turned if out is None else out * turned
    return out


class _Letters:
    """Code points to lower case letters; what is no letter becomes a space.  Answers are kept for the code points met."""

    def __init__(self) -> None:
        self.to = np.full(0x110000, -1, dtype=np.int32)

    def fold(self, codes: np.ndarray) -> np.ndarray:
        out = self.to[codes]
        if (out < 0).any():
            for c in np.unique(codes[out < 0]):
                low = chr(c).lower()
                self.to[c] = (ord(low) if len(low) == 1 else c) if chr(c).isalpha() else 32
            out = self.to[codes]
        return out


def grams(text: str, letters: _Letters, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of a text and their counts, for each part of it; parts overlap so that no n-gram is lost."""
    rest = np.full(1, 32, dtype=np.int32)
    for at in range(0, len(text), PART):
        some = letters.fold(np.frombuffer(text[at : at + PART].encode("utf-32-le", "replace"), dtype=np.uint32))
        last = at + PART >= len(text)
        codes = np.concatenate([rest, some, [32]] if last else [rest, some])
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]  # one space between words
        rest = codes[-(order - 1) :]
        if len(codes) >= order:
            packed = np.zeros(len(codes) - order + 1, dtype=_U)
            for k in range(order):
                packed = (packed << _U(21)) | codes[k : k + len(packed)].astype(_U)
            own, n = np.unique(packed, return_counts=True)
            yield own, n


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    n = np.zeros(len(own), dtype=np.int64)
    np.add.at(n, at, np.concatenate([c for _, c in parts]))
    return own, n


class Bundler:
    """Bundles of counted n-grams; vectors of n-grams met are kept, of `held` at most."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, held: int = 1 << 14):
        self.dimensions, self.order, self.held = dimensions, order, held
        self.known, self.vectors = np.zeros(0, dtype=_U), np.zeros((0, dimensions), dtype=np.float32)

    def _look(self, own: np.ndarray) -> np.ndarray:
        """Rows of `vectors` for the n-grams (sorted, at most `held`)."""
        new = np.setdiff1d(own, self.known, assume_unique=True)
        if len(new):
            if len(self.known) + len(new) > self.held:
                self.known, self.vectors, new = self.known[:0], self.vectors[:0], own
            joined = np.concatenate([self.known, new])
            order = np.argsort(joined)
            self.vectors = np.concatenate([self.vectors, gram_vectors(new, self.dimensions, self.order).astype(np.float32)])[order]
            self.known = joined[order]
        return np.searchsorted(self.known, own)

    def bundle(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """A vector for each row of n-grams and counts, in whole numbers."""
        out = np.zeros((len(rows), self.dimensions))
        filled = [i for i, (g, _) in enumerate(rows) if len(g)]
        if not filled:
            return out
        every = np.unique(np.concatenate([rows[i][0] for i in filled]))
        for lo in range(0, len(every), self.held):
            some = every[lo : lo + self.held]
            at = self._look(some)
            exact = np.float32 if max(int(rows[i][1].sum()) for i in filled) < 1 << 24 else np.float64
            counts = np.zeros((len(rows), len(some)), dtype=exact)
            for i in filled:
                g, n = rows[i]
                a, b = np.searchsorted(g, some[0]), np.searchsorted(g, some[-1], side="right")
                counts[i, np.searchsorted(some, g[a:b])] = n[a:b]
            out += counts @ self.vectors[at].astype(exact, copy=False)
        return out


def _counted(texts: Iterable[str | None], letters: _Letters, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    none = np.zeros(0, dtype=_U), np.zeros(0, dtype=np.int64)
    for t in texts:
        parts = list(grams(t, letters, order)) if t else []
        if len(parts) > 1:
            parts = [_merge(parts)]
        yield parts[0] if parts and parts[0][0][-1] > _U(0) and _lettered(parts[0][0], order) else none


def _lettered(own: np.ndarray, order: int) -> bool:
    """Whether an n-gram has a letter."""
    space = _U(sum(32 << (21 * k) for k in range(order)))
    return bool((own != space).any())


def _bundled(dimensions: int, order: int):
    """Bundles of a task's rows by language: (lang, piece, vector as int64)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, bundler = _Letters(), Bundler(dimensions, order)
        counts: dict[str, list] = {}
        sums: dict[str, np.ndarray] = {}

        def close(lang: str) -> None:
            v = bundler.bundle([_merge(counts.pop(lang))])[0].astype(np.int64)
            sums[lang] = sums[lang] + v if lang in sums else v

        def out() -> pa.RecordBatch:
            for lang in list(counts):
                close(lang)
            b = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "vector"])
            sums.clear()
            return b

        for batch in batches:
            for lang, (own, n) in zip(batch.column("lang").to_pylist(), _counted(batch.column("text").to_pylist(), letters, order)):
                if len(own):
                    held = counts.setdefault(lang, [])
                    held.append((own, n))
                    if sum(len(g) for g, _ in held) > HELD:
                        counts[lang] = [_merge(held)]
                        if len(counts[lang][0][0]) > HELD // 2:
                            close(lang)
            if len(counts) + len(sums) > BLOCK:
                yield out()
        yield out()

    return work


def _added(key: tuple, t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(v, dtype=np.int64) for v in t["vector"].to_pylist())
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "vector": pa.array([total.tobytes()], pa.binary())})


def fit(docs: DataFrame, stage: Stage, dimensions: int = DIMENSIONS, order: int = ORDER, text: str = "text", lang: str = "lang") -> DataFrame:
    """Prototypes (lang, vector) of all rows: exact sums, as bytes of int64."""
    rows = spread(docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")))
    tasks = rows.mapInArrow(_bundled(dimensions, order), "lang string, vector binary").withColumn("piece", F.spark_partition_id())
    wide = max(1, math.isqrt(rows.rdd.getNumPartitions()))  # pieces are added by about this many at a time
    some = tasks.groupBy("lang", (F.col("piece") % wide).alias("share")).applyInArrow(_added, "lang string, vector binary")
    return stage.table(some.groupBy("lang").applyInArrow(_added, "lang string, vector binary"), "prototypes")


def _centred(vectors: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Unit vectors of what sets each prototype apart."""
    apart = vectors - mean
    size = np.linalg.norm(apart, axis=1, keepdims=True)
    return apart / np.where(size > 0, size, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _scored(block: Broadcast, columns: list[str], dimensions: int, order: int, rows: int = 64):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, bundler = _Letters(), Bundler(dimensions, order)
        langs, vectors = block.value
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                counted = list(_counted(part.column("text").to_pylist(), letters, order))
                cosines = _unit(bundler.bundle(counted)) @ vectors.T
                best = cosines.argmax(axis=1)
                old_lang, old_cosine = part.column("lang_pred").to_pylist(), part.column("cosine").to_pylist()
                lang, cosine = [], []
                for i, (own, _) in enumerate(counted):
                    c = float(cosines[i, best[i]])
                    keep = not len(own) or (old_cosine[i] is not None and old_cosine[i] >= c)
                    lang.append(old_lang[i] if keep else langs[best[i]])
                    cosine.append(old_cosine[i] if keep else c)
                arrays = {c: part.column(c) for c in columns} | {"lang_pred": pa.array(lang, pa.string()), "cosine": pa.array(cosine, pa.float64())}
                yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return work


def predict(docs: DataFrame, prototypes: DataFrame, dimensions: int = DIMENSIONS, order: int = ORDER, text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows with lang_pred, cosine (with the best prototype; null where undetermined) and score."""
    spark, others = docs.sparkSession, [c for c in docs.columns if c != text and c.lower() not in ("lang_pred", "cosine", "score")]
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    out = spread(docs).select(F.col(text).cast("string").alias("text"), F.struct(F.lit(0).alias("none"), *named).alias("others"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("cosine"))
    total, n, bounds = np.zeros(dimensions), 0, []
    ordered = prototypes.orderBy("lang")
    for k, r in enumerate(ordered.toLocalIterator()):  # one at a time: the mean, and where blocks begin
        total, n = total + _unit(np.frombuffer(r["vector"], dtype=np.int64)[None].astype(float))[0], n + 1
        if k % block == 0:
            bounds.append(r["lang"])
    for i, lo in enumerate(bounds):
        some = prototypes.where(F.col("lang") >= lo)
        some = (some.where(F.col("lang") < bounds[i + 1]) if i + 1 < len(bounds) else some).orderBy("lang").collect()  # `block` rows
        vectors = _unit(np.stack([np.frombuffer(r["vector"], dtype=np.int64) for r in some]).astype(float))
        value = [r["lang"] for r in some], _centred(vectors, total / n if n > 1 else np.zeros(dimensions))
        out = out.mapInArrow(_scored(send(spark, value), out.columns[:2], dimensions, order), out.schema)
    kept = [F.col(f"others.c{i}").alias(c) for i, c in enumerate(others)]
    score = F.when(F.col("cosine") > 0, F.least(F.lit(1.0), F.col("cosine"))).otherwise(0.0).alias("score")
    return out.select(*kept, F.col("text").alias(text), F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"), "cosine", score)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op13_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), Stage(spark, "op13"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
