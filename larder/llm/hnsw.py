"""Hierarchical navigable small-world graphs over unit vectors, many queries at a time.

Layers are built from the top: a node of a layer is linked to the nodes found
by a beam search that starts where the layers above lead.  Neighbours are
chosen for diversity (a candidate nearer to a chosen neighbour than to the node
itself waits) and lists that overflow are chosen anew.
"""

from __future__ import annotations

import io

import numpy as np


def _choose(sims: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """sims: (n, c) falling, -inf for none; between: (n, c, c).  Mask of the chosen, at most `most` a row."""
    n, c = sims.shape
    kept = np.zeros((n, c), dtype=bool)
    count = np.zeros(n, dtype=np.int64)
    nearest = np.full((n, c), -np.inf, dtype=np.float32)  # of each candidate to what is chosen
    for j in range(c):
        ok = (sims[:, j] > nearest[:, j]) & (sims[:, j] > -np.inf) & (count < most)
        kept[:, j] = ok
        count += ok
        if ok.any():
            nearest[ok] = np.maximum(nearest[ok], between[ok, j])
    spare = ~kept & (sims > -np.inf)
    room = most - count
    kept |= spare & (np.cumsum(spare, axis=1) <= room[:, None])
    return kept


class Layer:
    def __init__(self, x: np.ndarray, width: int):
        self.x, self.width = x, width
        self.graph = np.full((len(x), width), -1, dtype=np.int32)

    def beam(self, q: np.ndarray, starts: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best `ef` nodes found for each query, best first (-1 and -inf for none)."""
        out_i, out_s = np.full((len(q), ef), -1, dtype=np.int32), np.full((len(q), ef), -np.inf, dtype=np.float32)
        block = max(16, min(512, (32 << 20) // max(1, len(self.x))))
        for at in range(0, len(q), block):
            out_i[at : at + block], out_s[at : at + block] = self._beam(q[at : at + block], starts[at : at + block], ef, step)
        return out_i, out_s

    def _beam(self, q: np.ndarray, starts: np.ndarray, ef: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        m, n = len(q), len(self.x)
        seen = np.zeros((m, n), dtype=bool)
        ids = np.full((m, ef), -1, dtype=np.int32)
        sims = np.full((m, ef), -np.inf, dtype=np.float32)
        done = np.ones((m, ef), dtype=bool)

        def merge(rows: np.ndarray, new: np.ndarray) -> None:
            """new: (rows, k) nodes, -1 for none."""
            k = new.shape[1]
            flat = np.where(new >= 0, rows[:, None] * n + new, -1).ravel()
            _, first = np.unique(flat, return_index=True)
            fresh = np.zeros(len(flat), dtype=bool)
            fresh[first] = True
            fresh &= flat >= 0
            fresh[fresh] = ~seen.ravel()[flat[fresh]]
            seen.ravel()[flat[fresh]] = True
            fresh = fresh.reshape(-1, k)
            near = np.full(new.shape, -np.inf, dtype=np.float32)
            r, c = np.nonzero(fresh)
            near[r, c] = np.einsum("ij,ij->i", self.x[new[r, c]], q[rows[r]])
            all_s = np.concatenate([sims[rows], near], axis=1)
            all_i = np.concatenate([ids[rows], new], axis=1)
            all_d = np.concatenate([done[rows], ~fresh], axis=1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef] if all_s.shape[1] > ef else np.tile(np.arange(ef), (len(rows), 1))
            sims[rows] = np.take_along_axis(all_s, top, 1)
            ids[rows] = np.where(sims[rows] > -np.inf, np.take_along_axis(all_i, top, 1), -1)
            done[rows] = np.take_along_axis(all_d, top, 1) | (sims[rows] == -np.inf)

        merge(np.arange(m), starts.astype(np.int32))
        step = min(step, ef)
        while True:
            rows = np.flatnonzero(~done.all(axis=1))
            if not len(rows):
                break
            open_s = np.where(done[rows], -np.inf, sims[rows])
            pick = np.argpartition(-open_s, step - 1, axis=1)[:, :step]
            picked = np.take_along_axis(open_s, pick, 1) > -np.inf
            node = np.where(picked, np.take_along_axis(ids[rows], pick, 1), -1)
            flags = done[rows]
            np.put_along_axis(flags, pick, True, 1)
            done[rows] = flags
            merge(rows, np.where(node[:, :, None] >= 0, self.graph[node], -1).reshape(len(rows), -1))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def _link(self, nodes: np.ndarray, candidates: np.ndarray, sims: np.ndarray) -> None:
        """Chooses neighbours of new nodes from candidates (-1, -inf for none) and links back."""
        x, c = self.x, candidates
        order = np.argsort(-sims, axis=1, kind="stable")
        c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
        v = x[c]
        kept = _choose(sims, np.einsum("nid,njd->nij", v, v, optimize=True), max(2, self.width // 2))
        r, j = np.nonzero(kept)
        place = np.cumsum(kept, axis=1)[r, j] - 1
        self.graph[nodes[r], place] = c[r, j]
        self._back(c[r, j], nodes[r])

    def _back(self, to: np.ndarray, new: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        have = (self.graph[target] >= 0).sum(axis=1)
        fits = have + count <= self.width
        at = np.arange(len(to)) - np.repeat(first, count)
        easy = np.repeat(fits, count)
        self.graph[to[easy], np.repeat(have, count)[easy] + at[easy]] = new[easy]
        full = np.flatnonzero(~fits)
        for lo in range(0, len(full), 1024):
            f = full[lo : lo + 1024]
            wide = self.width + int(count[f].max())
            c = np.full((len(f), wide), -1, dtype=np.int32)
            c[:, : self.width] = self.graph[target[f]]
            for i, k in enumerate(f.tolist()):
                c[i, self.width : self.width + count[k]] = new[first[k] : first[k] + count[k]]
            s = np.where(c >= 0, np.einsum("ncd,nd->nc", self.x[c], self.x[target[f]]), -np.inf).astype(np.float32)
            order = np.argsort(-s, axis=1, kind="stable")[:, : self.width + 32]
            c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
            v = self.x[c]
            kept = _choose(s, np.einsum("nid,njd->nij", v, v, optimize=True), self.width)
            r, j = np.nonzero(kept)
            fresh = np.full((len(f), self.width), -1, dtype=np.int32)
            fresh[r, np.cumsum(kept, axis=1)[r, j] - 1] = c[r, j]
            self.graph[target[f]] = fresh

    def build(self, starts, ef: int = 48, first: int = 512, batch: int = 512) -> None:
        """starts(lo, hi): where the layers above lead for nodes lo..hi; those are nodes before any of them."""
        n = len(self.x)
        lo = 0
        while lo < n:
            hi = min(n, max(first, lo + min(batch, max(lo, 1))))
            nodes = np.arange(lo, hi)
            q = self.x[lo:hi]
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            k = min(ef, hi - lo)
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            c, s = (near + lo).astype(np.int32), np.take_along_axis(own, near, 1).astype(np.float32)
            c = np.where(s > -np.inf, c, -1)
            if lo:
                i, t = self.beam(q, np.minimum(starts(lo, hi), lo - 1), ef)
                c, s = np.concatenate([c, i], axis=1), np.concatenate([s, t], axis=1)
            self._link(nodes, c, s)
            lo = hi


class Hnsw:
    """An index of unit vectors.  Nodes are in the order given to `build`, by falling level inside."""

    def __init__(self, layers: list[Layer], order: np.ndarray):
        self.layers, self.order = layers, order

    @classmethod
    def build(cls, x: np.ndarray, keys: np.ndarray, width: int = 16, ef: int = 48) -> Hnsw:
        """keys: 64-bit hashes of the vectors' ids; they give the levels."""
        u = ((keys >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
        level = np.minimum((-np.log(u) / np.log(width)).astype(np.int64), 12)
        order = np.lexsort((keys, -level))
        x, level = np.ascontiguousarray(x[order], dtype=np.float32), level[order]
        out = cls([], order)
        top = int(level[0]) if len(level) else 0
        for l in range(top, -1, -1):
            layer = Layer(x[: int((level >= l).sum())], width if l else 2 * width)
            layer.build(lambda lo, hi, x=layer.x: out._lead(x[lo:hi]), ef)
            out.layers.append(layer)
        return out

    def _lead(self, q: np.ndarray, ef: int = 8) -> np.ndarray:
        """Starting nodes for the layer below those built; layers share one order, so numbers hold in all."""
        starts = np.zeros((len(q), 1), dtype=np.int32)
        for layer in self.layers:
            starts = layer.beam(q, starts, min(ef, len(layer.x)))[0]
        return np.where(starts >= 0, starts, 0)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (in the order given to `build`) and similarities of the best `ef` found for each query."""
        q = np.ascontiguousarray(q, dtype=np.float32)
        starts = np.zeros((len(q), 1), dtype=np.int32)
        for layer in self.layers[:-1]:
            starts = np.maximum(layer.beam(q, starts, min(8, len(layer.x)))[0], 0)
        base = self.layers[-1]
        ids, sims = base.beam(q, starts, min(ef, len(base.x)))
        return np.where(ids >= 0, self.order[ids], -1), sims

    def to_arrays(self) -> dict[str, np.ndarray]:
        return {"order": self.order} | {f"graph{i}": layer.graph for i, layer in enumerate(self.layers)}

    @classmethod
    def from_arrays(cls, x: np.ndarray, a: dict[str, np.ndarray]) -> Hnsw:
        order = a["order"]
        x = np.ascontiguousarray(x[order], dtype=np.float32)
        layers = []
        for i in range(sum(k.startswith("graph") for k in a)):
            layer = Layer.__new__(Layer)
            layer.graph = a[f"graph{i}"]
            layer.x, layer.width = x[: len(layer.graph)], layer.graph.shape[1]
            layers.append(layer)
        return cls(layers, order)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}
