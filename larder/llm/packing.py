"""Packing by minimum bin slack.

A document's ids (with an end id) are cut every `window` ids; whole windows are
sequences of their own.  What remains of each document is an item.  For every
sequence the longest item is placed first and a bitset dynamic programme over
the multiset of remaining lengths finds the sum closest to the space left;
walking the kept bitsets back gives how many items of each length to take.
Where no sum fills the window and items remain, the longest is cut to fit, so
only a task's last sequence could need padding; that one is cut into sequences
whose lengths are powers of two, which need none.

Tasks pack apart and hold at most `pool` items.  No shuffle, nothing gathered.

Defined results: a null or empty text is its end id alone; a null document id
is kept as null; repeated rows and ids are packed once per row; a very long text
is encoded part by part and fills whole sequences; an empty table gives an empty
table.  Input columns other than the two named are not read, so clashing names
do not matter.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.kernels import trim
from larder.llm.staging import spread
from larder.llm.tokens import default_path, encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long"


class Slack:
    """A pool of items by length; takes out the multiset that fills a capacity best."""

    def __init__(self) -> None:
        self.items: dict[int, deque] = defaultdict(deque)
        self.count = 0

    def add(self, length: int, item: object) -> None:
        self.items[length].append(item)
        self.count += 1

    def take(self, length: int) -> object:
        own = self.items[length]
        item = own.popleft()
        if not own:
            del self.items[length]
        self.count -= 1
        return item

    def longest(self) -> int:
        return max(self.items)

    def best(self, capacity: int) -> dict[int, int]:
        """How many items of each length to take: the sum is the largest not over `capacity`."""
        mask, bits, steps = (1 << (capacity + 1)) - 1, 1, []
        for length in sorted((x for x in self.items if x <= capacity), reverse=True):
            left, k = min(len(self.items[length]), capacity // length), 1
            while left > 0 and not bits >> capacity:
                some = min(k, left)
                steps.append((bits, length, some))
                bits |= (bits << (some * length)) & mask
                left -= some
                k *= 2
            if bits >> capacity:
                break
        at, counts = bits.bit_length() - 1, defaultdict(int)
        for before, length, some in reversed(steps):
            if not before >> at & 1:
                at -= some * length
                counts[length] += some
        return counts


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs one task's documents; yields (doc_id, start, ids, doc_tokens, sequence, offset, padded length)."""

    def __init__(self, window: int, pool: int):
        self.window, self.limit, self.pool, self.sequence = window, pool, Slack(), 0

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        n, w = len(ids) // 4, self.window
        for at in range(0, n - n % w, w):
            yield doc_id, at, ids[4 * at : 4 * (at + w)], n, self._next(), 0, w
        if n % w:
            self.pool.add(n % w, (doc_id, n - n % w, ids[4 * (n - n % w) :], n))
        if self.pool.count >= self.limit:
            while self.pool.count > self.limit // 2:
                yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.pool.count:
            yield from self._fill()

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _fill(self) -> Iterator[tuple]:
        first = self.pool.longest()
        chosen = [self.pool.take(first)]
        space = self.window - first
        if space and self.pool.count:
            for length, k in self.pool.best(space).items():
                chosen += [self.pool.take(length) for _ in range(k)]
                space -= k * length
            if space and self.pool.count:  # every item left is longer than the space
                length = self.pool.longest()
                doc_id, start, ids, n = self.pool.take(length)
                chosen.append((doc_id, start, ids[: 4 * space], n))
                self.pool.add(length - space, (doc_id, start + space, ids[4 * space :], n))
                space = 0
        if not space:
            yield from self._lay(chosen, [self.window])
        else:
            yield from self._lay(chosen, powers_of_two(self.window - space))

    def _lay(self, pieces: list[tuple], lengths: list[int]) -> Iterator[tuple]:
        todo = deque(pieces)
        for room in lengths:
            sequence, offset = self._next(), 0
            while offset < room:
                doc_id, start, ids, n = todo.popleft()
                k = min(len(ids) // 4, room - offset)
                yield doc_id, start, ids[: 4 * k], n, sequence, offset, room
                if 4 * k < len(ids):
                    todo.appendleft((doc_id, start + k, ids[4 * k :], n))
                offset += k


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = 2048, end_id: int = 1, pool: int = 8192) -> DataFrame:
    """One row per piece: its ids as little-endian unsigned 32-bit integers and its place in a sequence."""
    path = tokenizer or default_path()
    end = int(end_id).to_bytes(4, "little")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, packer = encoder(path), Packer(window, pool)
        base = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            c = list(zip(*held, strict=True))
            long = pa.int64()
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(c[0], long), pa.array(c[1], long), pa.array([len(x) // 4 for x in c[2]], long), pa.array(c[2], pa.binary()),
                    pa.array(c[3], long), pa.array([base + x for x in c[4]], long), pa.array(c[5], long), pa.array(c[6], long)
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"],
            )
            held, size = [], 0
            return out

        for batch in batches:
            for lo, hi, found, cuts in enc.column(batch.column(1)):
                whole, at = found.astype("<u4", copy=False).tobytes(), (4 * cuts).tolist()
                for key, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), at[:-1], at[1:], strict=True):
                    for piece in packer.add(key, whole[a:b] + end):
                        held.append(piece)
                        size += len(piece[2])
                if size > 4 << 20:
                    yield flush()
        for piece in packer.finish():
            held.append(piece)
            size += len(piece[2])
            if size > 4 << 20:
                yield flush()
        trim()
        if held:
            yield flush()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def op10_pack(spark, sf_dir):
    pieces = pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")
