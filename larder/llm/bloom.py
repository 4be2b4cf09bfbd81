"""A Bloom filter of 64-bit keys with a bounded size, built in slices on the executors.

The driver joins the slices (`most_bytes` in all, whatever the input) and
broadcasts them.  It only spares work: past its bound it answers yes more often,
and the exact step that follows decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.kernels import U64, mix

HASHES = 4


class Filter:
    def __init__(self, slices: list[bytes], slice_bits: int):
        self.bits = np.frombuffer(b"".join(slices), dtype=np.uint8)
        self.slice_bits, self.count = slice_bits, len(slices)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """keys: any 64-bit integers."""
        if not self.count or not len(keys):
            return np.zeros(len(keys), dtype=bool)
        k = keys.view(U64)
        out = np.ones(len(k), dtype=bool)
        base = slice_of(k, self.count).astype(U64) * U64(self.slice_bits)
        for place in _places(k, self.slice_bits):
            p = base + place
            out &= (self.bits[(p >> U64(3)).astype(np.int64)] >> (p & U64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return (mix(keys ^ U64(0xA5A5A5A5)) % U64(slices)).astype(np.int64)


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    a = mix(keys)
    b = (a >> U64(32)) | U64(1)
    for i in range(HASHES):
        yield (a + U64(i) * b) % U64(bits)


def build(keys: DataFrame, column: str, count: int, most_bytes: int = 64 << 20) -> Filter:
    """A filter of the distinct values of a long column; about 12 bits for each key up to the bound."""
    if not count:
        return Filter([], 8)
    slices = max(1, min(4096, count // 50_000))
    slice_bits = 8 * max(64, min(12 * count // 8, most_bytes) // slices)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            s = slice_of(k, slices)
            for i in np.unique(s).tolist():
                bits = own.setdefault(i, np.zeros(slice_bits // 8, dtype=np.uint8))
                for p in _places(k[s == i], slice_bits):
                    np.bitwise_or.at(bits, (p >> U64(3)).astype(np.int64), (1 << (p & U64(7)).astype(np.int64)).astype(np.uint8))
        if own:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(own), pa.int32()), "bits": pa.array([b.tobytes() for b in own.values()], pa.binary())})

    # keys of a slice meet in one partition, so each slice is made once
    dealt = keys.select(F.col(column).cast("long").alias("k"))
    if slices > 1:
        tagged = dealt.mapInArrow(
            lambda it: (
                pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(slice_of(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64), slices), pa.int32())],
                    names=["k", "slice"]
                ) for b in it
            ),
            "k long, slice int"
        )
        made = tagged.repartition(slices, "slice").select("k").mapInArrow(part, "slice int, bits binary").collect()
    else:
        made = dealt.coalesce(1).mapInArrow(part, "slice int, bits binary").collect()
    bits = {r["slice"]: bytes(r["bits"]) for r in made}
    return Filter([bits.get(i, bytes(slice_bits // 8)) for i in range(slices)], slice_bits)
