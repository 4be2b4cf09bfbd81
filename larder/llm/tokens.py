"""Exact byte-level BPE encoding with a table of pieces, in NumPy.

The tokenizer's pre-tokenizer (the regular expression of byte-level BPE) always
breaks a text at certain places, whatever stands around them:

* between a character that is not white space and the white space after it;
* before the last character of a run of white space that text follows (a last
  space belongs to that text, any other last character is a piece of its own);
* between an ASCII letter and an ASCII character that is no letter.

So a text may be cut there and its pieces encoded apart; the ids, joined, are
those of the whole text.  Every id comes from the `tokenizers` library.  A table
keyed by the pieces' own bytes (up to 23 of them and their number, compared in
full) avoids encoding a piece twice; a chunk's pieces are looked up together.
The table outlives tasks of one kind; its size is bounded (some 50 MB), and when
it is full it keeps the pieces met again since they came.

As in the plain library call, strings of the tokenizer's added tokens inside a
text become those tokens; with `specials=False` they are ordinary text.  A
tokenizer of another kind, or with added tokens that strip or hold white space,
encodes every text whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from larder.llm.kernels import CHUNK_BYTES, U64, caches, chunks, mix, string_views

LONGEST = 23  # bytes of a piece that the table holds
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)
_SPACE, _LETTER, _OTHER = 1, 2, 3  # kinds of ASCII bytes; 0 for bytes of longer characters
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[:128] = _OTHER
_KIND[[*range(9, 14), 32]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
#: An optional space, Latin letters, then ASCII punctuation: the pre-tokenizer makes exactly these two pieces.
_WORD = re.compile("( ?[A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-ɏ]+)([!-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _white(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space (Unicode's White_Space, what the pre-tokenizer's \\s matches)."""
    white = kind == _SPACE
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        after = np.append(data, np.zeros(2, np.uint8))
        a, b, c = data[lead], after[lead + 1], after[lead + 2]
        two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
        three = lead[general | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
        for at, size in ((two, 2), (three, 3)):
            for i in range(size):
                white[at + i] = True
    return white


def piece_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pieces of a chunk start; `edges` are the starts of its texts and its end."""
    n = len(data)
    kind = _KIND[data]
    white = _white(data, kind)
    cut = np.zeros(n + 1, dtype=bool)
    cut[1:n] = (kind[:-1] == _LETTER) & (kind[1:] == _OTHER)
    cut[1:n] |= white[1:] & ~white[:-1]
    edge = np.zeros(n + 1, dtype=bool)
    edge[edges] = True
    after = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    after = after[~edge[after]]
    spaced = data[after - 1] == 0x20
    cut[after[spaced] - 1] = True
    other = after[~spaced]
    cut[other] = True
    last = other - 1
    while len(inside := np.flatnonzero((data[last] & 0xC0) == 0x80)):
        last[inside] -= 1
    cut[last] = True
    cut |= edge
    return np.flatnonzero(cut[:n])


class Table:
    """Ids of pieces of up to 23 bytes: open addressing over three words that hold a piece's bytes and length."""

    def __init__(self, entries: int):
        self.most, self.bits = entries, max(6, (2 * entries - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys = [np.zeros(1024, dtype=U64) for _ in range(3)]
        self.place, self.count = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.uint8)
        self.again = np.zeros(1024, dtype=bool)
        self.pool = np.zeros(4096, dtype=np.uint32)
        self.n, self.used = 1, 0  # entry 0 stands for no piece and has no ids

    @staticmethod
    def key(view: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """view: the little-endian word at each byte of the padded chunk."""
        a = view[start] & _MASKS[np.minimum(size, 8)]
        b = view[start + 8] & _MASKS[np.clip(size - 8, 0, 8)]
        c = size.astype(U64) << U64(56)
        long = np.flatnonzero(size > 16)
        c[long] |= view[start[long] + 16] & _MASKS[size[long] - 16]
        return [a, b, c]

    @staticmethod
    def hash(key: list[np.ndarray]) -> np.ndarray:
        a, b, c = key
        return mix(a * U64(0x9FB21C651E98DF25) ^ b * U64(0xD6E8FEB86659FD93) ^ c * U64(0xA0761D6478BD642F))

    def _same(self, entry: np.ndarray, key: list[np.ndarray]) -> np.ndarray:
        return (self.keys[0][entry] == key[0]) & (self.keys[1][entry] == key[1]) & (self.keys[2][entry] == key[2])

    def find(self, key: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = (hashes >> U64(64 - self.bits)).astype(np.int64)
        entry = self.slots[slot]
        apart = np.flatnonzero((entry >= 0) & ~self._same(entry, key))
        while len(apart):
            slot[apart] = (slot[apart] + 1) & (len(self.slots) - 1)
            entry[apart] = there = self.slots[slot[apart]]
            apart = apart[(there >= 0) & ~self._same(there, [k[apart] for k in key])]
        return entry

    def _grow(self, more: int, ids: int) -> None:
        if self.n + more > len(self.place):
            size = max(self.n + more, len(self.place) * 5 // 4)
            old = self.n
            for name in ("place", "count", "again"):
                a = np.zeros(size, dtype=getattr(self, name).dtype)
                a[:old] = getattr(self, name)[:old]
                setattr(self, name, a)
            self.keys = [np.concatenate([k[:old], np.zeros(size - old, dtype=U64)]) for k in self.keys]
        if self.used + ids > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(ids, self.used // 4, 4096), dtype=np.uint32)])

    def add(self, key: list[np.ndarray], hashes: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """New, different keys with their ids, one after the other."""
        self._grow(len(hashes), len(ids))
        new = np.arange(self.n, self.n + len(hashes))
        for own, k in zip(self.keys, key, strict=True):
            own[new] = k
        self.count[new] = count
        self.place[new] = self.used + np.cumsum(count, dtype=np.int64) - count
        self.again[new] = False
        self.pool[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(hashes), self.used + len(ids)
        self._settle(new, hashes)

    def _settle(self, entry: np.ndarray, hashes: np.ndarray) -> None:
        if 10 * self.n > 6 * len(self.slots):
            while 10 * self.n > 6 << self.bits:
                self.bits += 1
            self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
            entry = np.arange(1, self.n)
            hashes = self.hash([k[1 : self.n] for k in self.keys])
        slot = (hashes >> U64(64 - self.bits)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & (len(self.slots) - 1)

    def bound(self) -> None:
        """To be called between chunks: a full table keeps what was found again since it came, the oldest half of its size at most."""
        if self.n <= self.most:
            return
        kept = np.flatnonzero(self.again[1 : self.n])[: self.most // 2] + 1
        key, count, place = [k[kept] for k in self.keys], self.count[kept], self.place[kept]
        ids = self.pool[_spread(place, count)]
        self.__init__(self.most)
        if len(kept):
            self.add(key, self.hash(key), count, ids)


def _spread(place: np.ndarray, count: np.ndarray) -> np.ndarray:
    """place, place + 1, ... of each, `count` of them, one after the other."""
    ends = np.cumsum(count, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(place - (ends - count), count) + np.arange(total)


class Encoder:
    """Encodes texts to arrays of ids."""

    def __init__(self, path: str, entries: int = 1 << 19, specials: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.model = self.tokenizer.model
        self.table = Table(entries)
        self.longer: dict[bytes, np.ndarray] = {}
        self.tails: dict[str, list[int]] = {"": []}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        added = made.get("added_tokens") or []
        before = made.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"]) and not re.search(r"\s", t["content"]) for t in added)
        self.by_piece = byte_level and plain and not made.get("normalizer") and not made.get("truncation")
        marks = [t["content"].encode() for t in added if specials or not t["special"]]
        self.marks = re.compile(b"|".join(map(re.escape, sorted(marks, key=len, reverse=True)))) if marks else None

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(array("I", e.ids), dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tail(self, marks: str) -> list[int]:
        ids = self.tails.get(marks)
        if ids is None:
            if len(self.tails) > 10_000:
                self.tails = {"": []}
            ids = self.tails[marks] = self.raw([marks])[0].tolist()
        return ids

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and the ids of pieces that the table lacks."""
        ids, count, rest = array("I"), [], []
        tokenize, add = self.model.tokenize, ids.append
        letters = b"\0".join(pieces).decode("latin-1").translate(_LETTERS).split(_LETTERS[0])
        if len(letters) != len(pieces):  # a piece holds a zero byte
            letters = [p.decode("latin-1").translate(_LETTERS) for p in pieces]
        for p, word in zip(pieces, letters, strict=True):
            before = len(ids)
            if p.isalpha() or (p[0] == 32 and p[1:].isalpha()):  # ASCII letters
                for t in tokenize(word):
                    add(t.id)
            elif (m := _WORD.fullmatch(p.decode())) is not None:
                for t in tokenize(word[: len(word) - len(m[2])]):
                    add(t.id)
                ids.extend(self._tail(m[2]))
            else:
                rest.append((len(count), before, p))
            count.append(len(ids) - before)
        out = np.frombuffer(ids, dtype=np.uint32)
        counts = np.array(count, dtype=np.uint8)
        if rest:
            own = self.raw([p.decode() for *_, p in rest])
            out = np.insert(out, np.repeat([at for _, at, _ in rest], [len(x) for x in own]), np.concatenate(own))
            counts[[i for i, *_ in rest]] = [len(x) for x in own]
        return counts, out

    def _long(self, raw: bytes) -> np.ndarray:
        ids = self.longer.get(raw)
        if ids is None:
            ids = self.raw([raw.decode()])[0]
            if len(raw) <= 64:
                if len(self.longer) >= 50_000:
                    self.longer.clear()
                self.longer[raw] = ids
        return ids

    def _chunk(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between `edges` (from 0 to the data's length), and where those of each text begin and end."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(edges), np.int64)
        inner, spans = edges, []
        raw = data.tobytes()
        if self.marks is not None:
            ends = np.unique(edges)
            for m in self.marks.finditer(raw):
                a, b = m.span()
                if ends[np.searchsorted(ends, a, "right")] >= b:  # within one text
                    spans.append((a, b))
            inner = np.concatenate([edges, *map(np.array, spans)]) if spans else edges
        start = piece_starts(data, inner)
        for a, b in spans:
            start = start[(start <= a) | (start >= b)]
        size = np.diff(start, append=n)
        padded = np.concatenate([data, np.zeros(32, np.uint8)])
        view = np.ndarray(n + 24, dtype="<u8", buffer=padded, strides=(1,))
        held = np.minimum(size, LONGEST)
        key = Table.key(view, start, held)
        long = np.flatnonzero(size > LONGEST)
        hashes = Table.hash(key)
        table = self.table
        table.bound()
        entry = table.find(key, hashes)
        entry[long] = 0
        table.again[entry[entry >= 0]] = True
        while len(miss := np.flatnonzero(entry < 0)):
            self._learn(raw, start, size, key, hashes, miss)
            entry[miss] = table.find([k[miss] for k in key], hashes[miss])
        count, place = table.count[entry].astype(np.int64), table.place[entry]
        own = [self._long(raw[a : a + s]) for a, s in zip(start[long].tolist(), size[long].tolist(), strict=True)]
        count[long], place[long] = [len(x) for x in own], 0
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.repeat(place - ends[:-1], count) + np.arange(ends[-1])
        out = table.pool[np.minimum(at, len(table.pool) - 1) if own else at]
        for i, ids in zip(long.tolist(), own, strict=True):
            out[ends[i] : ends[i + 1]] = ids
        return out, ends[np.searchsorted(start, edges)]

    def _learn(self, raw: bytes, start: np.ndarray, size: np.ndarray, key: list[np.ndarray], hashes: np.ndarray, miss: np.ndarray) -> None:
        _, first = np.unique(hashes[miss], return_index=True)  # of different pieces with one hash, one now and the rest in the next round
        one = miss[np.sort(first)]
        count, ids = self._encode([raw[a : a + s] for a, s in zip(start[one].tolist(), size[one].tolist(), strict=True)])
        self.table.add([k[one] for k in key], hashes[one], count, ids)

    def column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For chunks of rows: their range, all their ids, and where those of each row begin and end.  Nulls are empty."""
        data, offsets, _ = string_views(column)
        for lo, hi in chunks(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            if not self.by_piece:
                ids = self.raw([x or "" for x in column.slice(lo, hi - lo).to_pylist()])
                yield lo, hi, np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            elif b - a <= 2 * CHUNK_BYTES:
                ids, cuts = self._chunk(data[a:b], offsets[lo : hi + 1] - a)
                yield lo, hi, ids, cuts
            else:  # one long text
                parts = [self._chunk(data[c:d], np.array([0, d - c]))[0] for c, d in _segments(data, a, b)]
                ids = np.concatenate(parts)
                yield lo, hi, ids, np.array([0, len(ids)], dtype=np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for _, _, ids, cuts in self.column(pa.array(texts, pa.large_string())):
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return out


def _segments(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Parts of about a chunk of one long text, cut before a space between ASCII characters that are not white space."""
    at, look = lo, CHUNK_BYTES
    while hi - at > look + 2:
        part = _KIND[data[at + look // 2 : at + look + 2]]
        good = np.flatnonzero((data[at + look // 2 + 1 : at + look + 1] == 0x20) & (part[:-2] >= _LETTER) & (part[2:] >= _LETTER))
        if len(good):
            to = at + look // 2 + 1 + int(good[-1])
            yield at, to
            at, look = to, CHUNK_BYTES
        else:
            look *= 2
    yield at, hi


_made: dict[str, Encoder] = {}
caches.append(_made)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")
