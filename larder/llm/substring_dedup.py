"""Substring deduplication by relative Lempel-Ziv factors.

Documents are parsed against reference blocks that together hold every document
with a smaller id.  A block holds passages of text around anchors: the anchor of
a window of 50 words is the least hash of its 10-word grams, so equal windows
have the same anchor at the same place, and all of them meet in one block.

1. Anchors of all windows are counted over the corpus.  Those in one document
   only cannot lie in a repeated window; a Bloom filter of bounded size tells the
   rest in the next passes.  For very common anchors the windows themselves are
   counted, too, and only repeated ones go on.
2. Runs: neighbouring windows with one anchor, as text.  Each task first
   compares its own: of equal runs only those of the smallest document travel,
   the others are factors already.  So a passage that stands in every document
   travels once for each task's buffer, not once for each document.
3. Blocks are dealt by anchor.  A block's windows are indexed as a suffix array
   over the runs.  The longest match of a position with a smaller document is
   with the nearest such suffix before or after it in the array.  Runs are parsed
   greedily: the longest match at a position is a factor, then the parse goes on
   with the first window that the factor does not hold, so windows across the
   factor's end are looked up as well; where nothing matches it steps on.
4. Every factor is compared with its source word by word.  Should hashes have
   deceived, the block is parsed again with the windows' words in their place.
5. Factors return to their documents, and those that continue each other (same
   source, same distance) are joined.

Defined results: null and short texts have no windows and keep everything; a
very long text is cut in parts of its own only where it is stored; a document
with a null id neither loses words nor serves as a reference; rows that repeat
an id are one document (no smaller id: they keep what they share); an empty
table gives an empty table.  Extra columns pass through; the operator's own
column names replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import bloom
from larder.llm.kernels import SPACE_WORD, U64, Words, chunks, fresh, grams, mix, sliding_min, string_views, trim
from larder.llm.staging import Stage, partitions_for, send, spread

GRAM = 10
BUFFER_BYTES = 16 << 20  # text of runs that a task holds before it compares and sends them
_POSITION_BITS = 24
OWN = ["n_words", "n_removed", "factors"]
FACTOR = "array<struct<start: bigint, words: bigint, source: bigint, source_start: bigint>>"
_NONE = np.zeros(0, dtype=np.int64)


def _anchored(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within one text, the word their anchor starts at, and the hash of all grams."""
    h, _ = grams(w, GRAM)
    n = len(h)
    if n < window:
        return _NONE, _NONE, h
    bits = U64(max(_POSITION_BITS, n.bit_length()))
    mask = (U64(1) << bits) - U64(1)
    least = sliding_min((h[: n - GRAM + 1] & ~mask) | np.arange(n - GRAM + 1, dtype=U64), window - GRAM + 1)
    starts = np.flatnonzero(w.doc[: n - window + 1] == w.doc[window - 1 :])
    return starts, (least[starts] & mask).astype(np.int64), h


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, Words]]:
    data, offsets, _ = string_views(batch.column(at))
    for lo, hi in chunks(offsets):
        yield lo, hi, Words(data, offsets, lo, hi, SPACE_WORD, False)


def _numbers(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return batch.column(at).to_numpy(zero_copy_only=False)


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """anchor, doc: the distinct anchors of each document (once per chunk of texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            ids = _numbers(batch, 0)
            for lo, hi, w in _texts(batch, 1):
                _, at, h = _anchored(w, window)
                at = np.unique(at)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(ids[lo:hi][w.doc[at]])], names=["anchor", "doc"])

    return docs.select("id", "text").mapInArrow(run, "anchor long, doc long")


def _ends(windows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows with their least and their greatest document."""
    order = np.lexsort((docs, windows))
    windows, docs = windows[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]])) if len(windows) else _NONE
    last = np.append(first[1:], len(windows))[: len(first)] - 1
    return windows[first], docs[first], docs[last]


def _repeated_windows(docs: DataFrame, window: int, hot, parts: int) -> DataFrame:
    """Hashes of the windows with a common anchor that stand in several documents.

    A task sends each window with its least and greatest document only, packed by the window's partition.
    """

    def packed(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        windows, least, most = _ends(*(np.concatenate(c) for c in zip(*found, strict=True)))
        rows = []
        for part, own in _by_part((mix(windows) % U64(parts)).astype(np.int64)):
            own_two = own[most[own] != least[own]]
            rows.append((part, np.concatenate([windows[own], windows[own_two]]).tobytes(), np.concatenate([least[own], most[own_two]]).astype("<i8").tobytes()))
        yield from _packed(rows, ["part", "windows", "docs"], [pa.int32(), pa.binary(), pa.binary()])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, held, size = hot.value, [], 0
        for batch in batches:
            ids = _numbers(batch, 0)
            for lo, hi, w in _texts(batch, 1):
                starts, at, h = _anchored(w, window)
                starts = starts[np.isin(h[at], common)] if len(at) else starts
                if len(starts):
                    held.append((grams(w, window)[0][starts], ids[lo:hi][w.doc[starts]]))
                    size += len(starts)
                if size > 1 << 20:
                    yield from packed(held)
                    held, size = [], 0
        yield from packed(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.frombuffer(w, U64), np.frombuffer(d, "<i8")) for batch in batches for w, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if found:
            windows, least, most = _ends(*(np.concatenate(c) for c in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(windows[least != most].view(np.int64))], names=["window"])

    dealt = docs.select("id", "text").mapInArrow(collect, "part int, windows binary, docs binary").repartitionById(parts, "part")
    return dealt.mapInArrow(compare, "window long")


def _equal(a: bytes, b: bytes) -> bool:
    """Whether two texts have the same words."""
    return a == b or a.split() == b.split()


def _packed(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        some = list(zip(*rows[i : i + 256], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(some, kinds, strict=True)], names=names)


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number in `part` with the rows that have it."""
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(part[order[a]]), order[a:b]


def _joined(factors: np.ndarray) -> np.ndarray:
    """Factors (rows: uid, start, windows, source, source start) in order, those joined that continue each other."""
    uid, start, count, source, source_start = factors
    order = np.lexsort((start, source_start - start, source, uid))
    uid, start, count, source, source_start = (x[order] for x in factors)
    same = (uid[1:] == uid[:-1]) & (source[1:] == source[:-1]) & (source_start[1:] - start[1:] == source_start[:-1] - start[:-1])
    group = np.concatenate([[0], np.cumsum(~same)]) if len(uid) else _NONE
    end = start + count
    # ends so far within a group: groups are kept apart by a number larger than any end
    apart = group * (int(end.max()) + 1 if len(end) else 1)
    reach = np.maximum.accumulate(end + apart) - apart if len(end) else end
    new = np.concatenate([[True], ~same | (start[1:] > reach[:-1])]) if len(uid) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    stop = reach[np.append(at[1:], len(uid)) - 1] if len(at) else _NONE
    out = np.stack([uid[at], start[at], stop - start[at], source[at], source_start[at]]) if len(at) else np.zeros((5, 0), np.int64)
    return out[:, np.lexsort((out[1], out[0]))]


BLOCK = "part int, uids binary, ids binary, position binary, count binary, size binary, texts binary, found binary"
_BLOCK_NAMES = ["part", "uids", "ids", "position", "count", "size", "texts", "found"]
_BLOCK_KINDS = [pa.int32(), *[pa.binary()] * 7]


class _Buffer:
    """Runs of a task: uid, id, position, windows, anchor, first and last window, text."""

    def __init__(self, parts: int):
        self.parts, self.columns, self.texts, self.bytes = parts, [[] for _ in range(7)], [], 0

    def add(self, columns: list[np.ndarray], texts: list[bytes]) -> None:
        for own, c in zip(self.columns, columns, strict=True):
            own.append(c)
        self.texts += texts
        self.bytes += sum(map(len, texts)) + 200 * len(texts)

    def flush(self) -> list[tuple]:
        """Rows for the blocks, and for the documents the factors that are known already."""
        if not self.texts:
            return []
        uid, doc, position, count, anchor, first, last = (np.concatenate(c) for c in self.columns)
        texts = self.texts
        self.__init__(self.parts)
        order = np.lexsort((position, doc, last, first, count))
        new = np.ones(len(order), dtype=bool)
        for c in (count, first, last):
            new[1:] &= c[order][1:] == c[order][:-1]
        new[1:] = ~new[1:]
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the run of the smallest document that looks the same
        later = np.flatnonzero(doc[order] > doc[head])
        sure = np.fromiter((_equal(texts[a], texts[b]) for a, b in zip(order[later].tolist(), head[later].tolist(), strict=True)), dtype=bool, count=len(later))
        known, source = order[later][sure], head[later][sure]
        rows = []
        if len(known):
            found = _joined(np.stack([uid[known], position[known], count[known], doc[source], position[source]]))
            rows += [(part, *[b""] * 6, found[:, own].astype("<i8").tobytes()) for part, own in _by_part(found[0] % self.parts)]
        rest = np.ones(len(doc), dtype=bool)
        rest[known] = False
        left = np.flatnonzero(rest)
        for part, own in _by_part((mix(anchor[left]) % U64(self.parts)).astype(np.int64)):
            own = left[own]
            own_texts = [texts[i] for i in own.tolist()]
            numbers = [uid[own].astype("<i8"), doc[own].astype("<i8"), position[own].astype("<i8"), count[own].astype("<i4"), np.array([len(x) for x in own_texts], dtype="<i4")]
            rows.append((part, *(x.tobytes() for x in numbers), b"".join(own_texts), b""))
        return rows


def _runs(docs: DataFrame, window: int, shared, hot, repeated, parts: int) -> DataFrame:
    """Runs of windows that may be repeated, dealt to blocks by their anchor; and what a task's own runs tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, common, buffer = shared.value, hot.value, _Buffer(parts)
        for batch in batches:
            uids, ids = _numbers(batch, 0), _numbers(batch, 1)
            for lo, hi, w in _texts(batch, 2):
                starts, at, h = _anchored(w, window)
                if not len(at):
                    continue
                once, back = np.unique(at, return_inverse=True)
                keep = seen.has(h[once])[back]
                starts, at = starts[keep], at[keep]
                if not len(starts):
                    continue
                wide = grams(w, window)[0]
                if repeated is not None:
                    often = np.flatnonzero(np.isin(h[at], common))
                    keep = np.ones(len(at), dtype=bool)
                    keep[often] = repeated.value.has(wide[starts[often]])
                    starts, at = starts[keep], at[keep]
                    if not len(starts):
                        continue
                first = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (at[1:] != at[:-1])]))
                count = np.diff(np.append(first, len(starts)))
                begin = starts[first]
                doc = w.doc[begin]
                raw = w.data.tobytes()
                texts = [raw[a:b] for a, b in zip(w.start[begin].tolist(), w.end[begin + count + window - 2].tolist(), strict=True)]
                buffer.add([uids[lo:hi][doc], ids[lo:hi][doc], begin - w.first[doc], count, h[at[first]], wide[begin], wide[begin + count - 1]], texts)
                if buffer.bytes > BUFFER_BYTES:
                    yield from _packed(buffer.flush(), _BLOCK_NAMES, _BLOCK_KINDS)
        yield from _packed(buffer.flush(), _BLOCK_NAMES, _BLOCK_KINDS)
        trim()

    return docs.select("uid", "id", "text").mapInArrow(run, BLOCK)


def _nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each value the nearest place before it with a smaller one, or -1.  What lies between is never smaller, so pointers may be followed."""
    p, at = np.arange(len(x)) - 1, np.arange(len(x))
    while len(at := at[(p[at] >= 0) & (x[p[at]] >= x[at])]):
        p[at] = p[p[at]]
    return p


def longest_matches(group: np.ndarray, left: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window the length (in windows) of the longest match that starts there in a smaller document, and where that starts.

    group: equal windows have equal numbers; left: windows from here to the run's end; doc: document.
    """
    n, ranks, k = len(group), [group], 1
    top = int(left.max()) if n else 0
    while k < top:  # ranks by the next 2 k windows from those by k
        ahead = np.zeros(n, dtype=np.int64)
        more = np.flatnonzero(left > k)
        ahead[more] = ranks[-1][more + k] + 1
        ranks.append(np.unique(ranks[-1] * (n + 1) + ahead, return_inverse=True)[1])
        k *= 2
    order = np.argsort(ranks[-1], kind="stable")  # the suffix array

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Windows that suffixes a and b (or none, -1) have in common."""
        total, some = np.zeros(len(a), dtype=np.int64), np.flatnonzero(b >= 0)
        a, b = a[some], b[some]
        room, got = np.minimum(left[a], left[b]), np.zeros(len(a), dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            fits = np.flatnonzero(room - got >= 1 << level)
            fits = fits[ranks[level][a[fits] + got[fits]] == ranks[level][b[fits] + got[fits]]]
            got[fits] += 1 << level
        total[some] = got
        return total

    d = doc[order]
    before, after = _nearest_smaller(d), n - 1 - _nearest_smaller(d[::-1])[::-1]
    one = np.where(before >= 0, order[before], -1)
    two = np.where(after < n, order[np.minimum(after, n - 1)], -1)
    a, b = common(order, one), common(order, two)
    length, source = np.zeros(n, dtype=np.int64), np.full(n, -1)
    length[order], source[order] = np.maximum(a, b), np.where(a >= b, one, two)
    return length, source


def greedy_factors(length: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Where the factors of each run (windows start to stop) begin: the longest match, then on behind it."""
    n = len(length)
    ahead = np.where(length > 0, np.arange(n), n)
    ahead = np.append(np.minimum.accumulate(ahead[::-1])[::-1], n)  # the next window that matches
    at, found = ahead[start], []
    while len(inside := np.flatnonzero(at < stop)):
        at, stop = at[inside], stop[inside]
        found.append(at)
        at = ahead[at + length[at]]
    return np.concatenate(found) if found else _NONE


class _Block:
    """The runs of one block: their numbers and texts."""

    def __init__(self, columns: list[list[bytes]], window: int):
        self.uid, self.doc, self.position = (np.frombuffer(b"".join(c), "<i8") for c in columns[:3])
        self.count, size = (np.frombuffer(b"".join(c), "<i4").astype(np.int64) for c in columns[3:5])
        self.text, self.window = b"".join(columns[5]), window
        self.edge = np.concatenate([[0], np.cumsum(size)])

    def hashes(self) -> np.ndarray:
        """Hashes of all windows, run by run."""
        data, parts = np.frombuffer(self.text, np.uint8), []
        for lo, hi in chunks(self.edge):
            h, ok = grams(Words(data, self.edge, lo, hi, SPACE_WORD, False), self.window)
            parts.append(h[ok])
        return np.concatenate(parts)

    def words(self, run: int) -> list[bytes]:
        return self.text[self.edge[run] : self.edge[run + 1]].split()

    def exact(self) -> np.ndarray:
        """Numbers of all windows by their words."""
        known: dict[tuple, int] = {}
        out = []
        for run, count in enumerate(self.count.tolist()):
            words = self.words(run)
            out += [known.setdefault(tuple(words[i : i + self.window]), len(known)) for i in range(count)]
        return np.array(out, dtype=np.int64)

    def factors(self, bits: int = 64) -> np.ndarray:
        """The factors of all runs: rows uid, start, windows, source, source start."""
        group = np.unique(self.hashes() >> U64(64 - bits), return_inverse=True)[1]
        found = self._parse(group)
        return self._parse(self.exact(), False) if found is None else found

    def _parse(self, group: np.ndarray, verify: bool = True) -> np.ndarray | None:
        run = np.repeat(np.arange(len(self.count)), self.count)
        first = np.cumsum(self.count) - self.count
        place = np.arange(len(run)) - first[run]
        doc = self.doc[run]
        order = np.lexsort((doc, group))
        edge = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
        several = np.repeat(doc[order[edge[:-1]]] != doc[order[edge[1:] - 1]], np.diff(edge))  # windows of more than one document
        alive = np.zeros(len(run), dtype=bool)
        alive[order] = several
        at = np.flatnonzero(alive)
        if not len(at):
            return np.zeros((5, 0), np.int64)
        run, place, doc, group = run[at], place[at], doc[at], np.unique(group[at], return_inverse=True)[1]
        start = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1])]))
        stop = np.append(start[1:], len(at))
        length, source = longest_matches(group, np.repeat(stop, stop - start) - np.arange(len(at)), doc)
        here = greedy_factors(length, start, stop)
        there, n = source[here], length[here]
        if verify and not self._verified(run[here], place[here], run[there], place[there], n):
            return None
        return np.stack([self.uid[run[here]], self.position[run[here]] + place[here], n, doc[there], self.position[run[there]] + place[there]])

    def _verified(self, run: np.ndarray, place: np.ndarray, other: np.ndarray, other_place: np.ndarray, count: np.ndarray) -> bool:
        """Whether the words of all factors are those of their sources."""
        whole = (place == 0) & (other_place == 0) & (count == self.count[run]) & (count == self.count[other])
        edge, last, words = self.edge.tolist(), -1, []
        for r, p, o, q, n, w in zip(run.tolist(), place.tolist(), other.tolist(), other_place.tolist(), count.tolist(), whole.tolist(), strict=True):
            if w and self.text[edge[r] : edge[r + 1]] == self.text[edge[o] : edge[o + 1]]:
                continue
            if r != last:
                last, words = r, self.words(r)
            m = n + self.window - 1
            if words[p : p + m] != self.words(o)[q : q + m]:
                return False
        return True


def _parse(blocks: DataFrame, window: int, parts: int, bits: int) -> DataFrame:
    """The factors found in each block, packed by the partition their document goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[bytes]] = [[] for _ in range(6)]
        names, kinds = ["part", "found"], [pa.int32(), pa.binary()]
        for batch in batches:
            part, *rest, found = (batch.column(i).to_pylist() for i in range(8))
            yield from _packed([(p, f) for p, f in zip(part, found, strict=True) if f], names, kinds)
            for own, c in zip(columns, rest, strict=True):
                own += c
        if any(columns[0]):
            block = _Block(columns, window)
            columns.clear()
            out = block.factors(bits)
            del block
            yield from _packed([(p, out[:, own].astype("<i8").tobytes()) for p, own in _by_part(out[0] % parts)], names, kinds)
        trim()

    return blocks.repartitionById(parts, "part").mapInArrow(run, "part int, found binary")


def _cut(docs: DataFrame, found: DataFrame, names: list[str], schema: str, text: str, window: int, parts: int) -> DataFrame:
    """Joins factors and documents: both are dealt alike, and a partition's factors come first."""
    row = docs.select(
        F.pmod("uid", F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "uid",
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.lit(None).cast("binary").alias("found")
    )
    kind = dict(row.dtypes)["row"]
    facts = found.select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("uid"), F.lit(None).cast(kind).alias("row"), "found")
    both = facts.unionByName(row).repartitionById(parts, "part").sortWithinPartitions("kind").select("kind", "uid", "row", "found")
    at = names.index(text)
    factor = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "words", "source", "source_start")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        table = None
        for batch in batches:
            kinds = batch.column(0).to_numpy(zero_copy_only=False)
            k = int((kinds == 0).sum())
            held += [np.frombuffer(x, "<i8").reshape(5, -1) for x in batch.column(3).slice(0, k).to_pylist()]
            if k == len(kinds):
                continue
            if table is None:
                table = _joined(np.concatenate(held, axis=1) if held else np.zeros((5, 0), np.int64))
                held.clear()
            uids = batch.column(1).slice(k).to_numpy(zero_copy_only=False)
            row = batch.column(2).slice(k)
            columns = row.flatten()
            data, offsets, nulls = string_views(columns[at])
            left, right = np.searchsorted(table[0], uids, "left"), np.searchsorted(table[0], uids, "right")
            for lo, hi in chunks(offsets):
                w = Words(data, offsets, lo, hi, SPACE_WORD, False, hashes=False)
                texts = columns[at].slice(lo, hi - lo)
                removed = np.zeros(hi - lo, dtype=np.int64)
                facts: list[list] = [[] for _ in range(hi - lo)]
                changed: dict[int, str] = {}
                base = int(offsets[lo])
                for i in np.flatnonzero(right[lo:hi] > left[lo:hi]).tolist():
                    own = table[:, left[lo + i] : right[lo + i]]
                    m = int(w.n[i])
                    edge = np.zeros(m + 1, dtype=np.int64)
                    np.add.at(edge, own[1], 1)
                    np.add.at(edge, own[1] + own[2] + window - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed[i] = int(gone.sum())
                    facts[i] = [{"start": s, "words": c + window - 1, "source": d, "source_start": e} for s, c, d, e in own[1:].T.tolist()]
                    begin = np.append(w.start[w.first[i] : w.first[i + 1]], int(offsets[lo + i + 1]) - base)
                    text_from = int(offsets[lo + i]) - base
                    turns = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    pieces, last = [], text_from
                    for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
                        pieces.append(w.data[last : begin[a]].tobytes())
                        last = int(begin[b])
                    pieces.append(w.data[last : begin[-1]].tobytes())
                    changed[i] = b"".join(pieces).decode()
                if changed:
                    values = texts.to_pylist()
                    for i, x in changed.items():
                        values[i] = x
                    texts = pa.array(values, pa.string())
                own_columns = [texts if j == at else c.slice(lo, hi - lo) for j, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*own_columns, pa.array(w.n, pa.int64()), pa.array(removed), pa.array(facts, factor)], names=[*names, *OWN])

    return both.mapInArrow(run, f"{schema}, n_words long, n_removed long, factors {FACTOR}")


def dedup_substrings(docs: DataFrame, stage: Stage, doc_id: str = "doc_id", text: str = "text", window: int = 50, hash_bits: int = 64) -> DataFrame:
    """The documents without the words of repeated windows, with n_words (of the input), n_removed and the factors.

    `hash_bits` of the windows' hashes find matches in a block; fewer make them deceive more often, which costs time only.
    """
    spark = docs.sparkSession
    docs = docs.drop(*OWN)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    t = F.col(f"`{text}`").cast("string")
    uid = F.xxhash64(F.col(f"`{doc_id}`").cast("long"), t).bitwiseAND(F.lit((1 << 63) - 1))
    refs = docs.select(uid.alias("uid"), F.col(f"`{doc_id}`").cast("long").alias("id"), t.alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    parts = partitions_for(docs.select(F.col(f"`{text}`")))

    found = _anchors(refs, window).groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor", "n")
    found = stage.table(found, "anchors")
    total = found.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    often = max(64, total["n"] // (8 * parts))  # so there are fewer than 8 `parts` of these
    hot = send(spark, np.array([r["anchor"] for r in found.where(F.col("n") > often).select("anchor").collect()], dtype=np.int64).view(U64))
    shared, repeated = send(spark, bloom.build(found, "anchor", total["k"])), None
    if len(hot.value):
        own = stage.table(_repeated_windows(refs, window, hot, parts), "windows")
        repeated = send(spark, bloom.build(own, "window", own.count()))
    blocks = _runs(refs, window, shared, hot, repeated, parts)
    rows = docs.select(uid.alias("uid"), *(F.col(f"`{c}`") for c in names))
    return _cut(rows, _parse(blocks, window, parts, hash_bits), names, schema, text, window, parts)


def op5_substring_dedup(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = dedup_substrings(docs, Stage(spark, "op5"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))
