"""Document quality from a linear-chain conditional random field over lines.

Each non-empty line is good or bad.  Its features are properties of its bytes
(case, marks, separators, digits, word lengths, repetition within the text) and
those of the lines before and after it; a chain of two states with learned
transitions labels the lines of a document together.  Forward-backward gives
each line's marginal; their length-weighted mean is the document's quality,
which a fitted logistic curve turns into a probability.

Only documents have labels; those of lines are latent.  Fitting climbs the
likelihood of the documents' labels through forward-backward: the gradient of a
weighted sum of marginals is the change of all expectations as the weights are
added to the lines' scores.  So a line that stands in good documents as well
stays good, whatever the document it is in.  It starts from lines labelled as
their documents are, apart and by their own features.

The model is fitted on the driver from at most `sample` labelled documents
(those whose ids hash lowest), each of at most `sample_lines` lines and all of
at most `sample_total` lines (the first in that order); that bounds what is
gathered.  Scoring is one narrow pass over whole texts.

Defined results: a null, empty or blank text has no lines and the score of
quality 0; null labels and labels without a document are ignored, contradicting
labels of one id count as bad; of texts that share an id one is fitted on;
repeated rows score alike; a very long text is scored whole; with no labels at
all the score is a fixed, unfitted one; an empty table gives an empty table.
Extra columns pass through; the operator's own column names replace columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.kernels import _BYTES, _LETTER, U64, chunks, fresh, mix, string_views
from larder.llm.staging import Stage, send, spread

N_OWN = 20
N_FEATURES = 3 * N_OWN + 3
OWN = ["score", "n_lines", "bad_lines"]


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    for a, b in ranges:
        t[a : b + 1] = 1
    return t


_UPPER, _LOWER, _DIGIT = _class((0x41, 0x5A)), _class((0x61, 0x7A), (0x80, 0xFF)), _class((0x30, 0x39))
_SPACE = _class((0x20, 0x20), (0x09, 0x0D))
_STOP = np.zeros(256, dtype=np.uint8)
_STOP[[ord(c) for c in ".,;:'\"-()"]] = 1
_MARK = (1 - (_UPPER | _LOWER | _DIGIT | _SPACE | _STOP)).astype(np.uint8)
_BAR, _BANG = _class((0x7C, 0x7C)), _class((0x21, 0x21))
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\":"]] = True


def line_features(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all non-empty lines of a chunk, their document, number within it (from 0, empty ones counted) and length in bytes."""
    n, docs = len(data), len(edge) - 1
    breaks = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([edge[:-1], breaks + 1]))
    start = start[start < n]
    doc = np.searchsorted(edge, start, "right") - 1
    end = np.minimum(np.append(breaks, n)[np.searchsorted(breaks, start, "left")], edge[doc + 1])
    first = np.searchsorted(doc, np.arange(docs), "left")
    number = np.arange(len(start)) - first[doc] if len(start) else start
    full = end > start
    start, end, doc, number = start[full], end[full], doc[full], number[full]
    m = len(start)
    if not m:
        return np.zeros((0, N_OWN), np.float32), doc, number, start
    cuts = np.stack([start, end], axis=1).ravel()
    padded = np.append(data, np.uint8(0x20))

    def count(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[padded], cuts, dtype=np.int64)[::2].astype(np.float64)

    size = (end - start).astype(np.float64)
    upper, lower, digit, stops, mark, bar, bang = (count(t) for t in (_UPPER, _LOWER, _DIGIT, _STOP, _MARK, _BAR, _BANG))
    inner = _SPACE[data] == 0
    cut = np.zeros(n + 1, dtype=bool)
    cut[edge] = True
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1] | cut[1:n]
    ends[:-1] &= ~inner[1:] | cut[1:n]
    at, to = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words = np.maximum(np.add.reduceat(np.append(begins, False).astype(np.uint8), cuts, dtype=np.int64)[::2], 1).astype(np.float64)
    up, down = _BYTES.get(n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(_LETTER[data] * up[:n], out=total[1:])
    same = mix((total[end] - total[start]) * down[start]) ^ (doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(same, return_inverse=True, return_counts=True)
    line, word = np.searchsorted(start, at, "right") - 1, mix((total[to] - total[at]) * down[at])
    again = np.zeros(len(at), dtype=bool)
    for back_by in (1, 2, 3):  # equal to a word shortly before it in the line
        again[back_by:] |= (word[back_by:] == word[:-back_by]) & (line[back_by:] == line[:-back_by])
    again = np.bincount(line[again], minlength=m)[:m] / words
    u, s, b, e = upper / (upper + lower + 1), mark / size, bar / words, bang / words
    x = np.stack([
        u, u > 0.3, s, s > 0.02, s > 0.1, b, b > 0.2, e, e > 0.2, digit / size, np.log1p(words) / 5,
        np.minimum(size / words / 10, 3), _END[data[end - 1]], data[start] < 0x5B, times[back] > 1, stops / words, words <= 2, again, again > 0.2, again > 0.6,
    ], axis=1).astype(np.float32)
    return x, doc, number, (end - start)


class Chains:
    """Lines of many documents in the order (number, document by falling length), so one step serves all documents."""

    def __init__(self, doc: np.ndarray, docs: int):
        self.counts = np.bincount(doc, minlength=docs)
        rank = np.empty(docs, dtype=np.int64)
        rank[np.argsort(-self.counts, kind="stable")] = np.arange(docs)
        first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        step = np.arange(len(doc)) - first[doc]
        self.order = np.lexsort((rank[doc], step))
        self.size = np.bincount(step) if len(doc) else np.zeros(0, np.int64)  # documents that have a line at each step
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.step = step

    def marginals(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(state) of each line, the expected transitions and the sum of log Z."""
        e, at, size = emit[self.order], self.at, self.size
        a, b = np.zeros_like(e), np.zeros_like(e)
        pairs, z = np.zeros((2, 2)), np.zeros(int(size[0]) if len(size) else 0)
        for t in range(len(size)):
            if t == 0:
                a[at[0] : at[1]] = e[at[0] : at[1]]
            else:
                prev = a[at[t - 1] : at[t - 1] + size[t]]
                a[at[t] : at[t + 1]] = e[at[t] : at[t + 1]] + np.logaddexp(prev[:, :1] + move[0], prev[:, 1:] + move[1])
            stops = slice(int(size[t + 1]) if t + 1 < len(size) else 0, int(size[t]))
            last = a[at[t] : at[t + 1]][stops]
            z[stops] = np.logaddexp(last[:, 0], last[:, 1])
        for t in range(len(size) - 2, -1, -1):
            k = size[t + 1]
            ahead = e[at[t + 1] : at[t + 2]] + b[at[t + 1] : at[t + 2]]
            joint = a[at[t] : at[t] + k][:, :, None] + move[None] + ahead[:, None, :]
            pairs += np.exp(joint - z[:k, None, None]).sum(axis=0)
            b[at[t] : at[t] + k] = np.logaddexp(move[None, :, 0] + ahead[:, :1], move[None, :, 1] + ahead[:, 1:])
        zs = np.concatenate([z[:k] for k in size]) if len(size) else z
        p = np.empty_like(e)
        p[self.order] = np.exp(a + b - zs[:, None])
        return p, pairs, float(z.sum())


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same text (else 0), whether it is first or last, and 1."""
    m = len(x)
    out = np.zeros((m, N_FEATURES), dtype=np.float32)
    out[:, :N_OWN] = x
    out[:, -1] = 1
    if m:
        same = doc[1:] == doc[:-1]
        out[1:, N_OWN : 2 * N_OWN][same] = x[:-1][same]
        out[:-1, 2 * N_OWN : 3 * N_OWN][same] = x[1:][same]
        out[0, -3] = out[-1, -2] = 1
        out[1:, -3] = ~same
        out[:-1, -2] = ~same
    return out


SOFT = 1e-3  # keeps the log-odds of a quality finite


def _adam(theta: np.ndarray, gradient, rounds: int, rate: float) -> np.ndarray:
    """Climbs by gradients (a function of theta), with Adam's steps."""
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return theta


class LineCrf:
    """weights: of state good against bad; move: transition scores; curve: quality to probability; cut: P(good) below which a line is bad."""

    def __init__(self) -> None:
        self.weights, self.move, self.curve, self.cut = np.zeros(N_FEATURES), np.eye(2) * 0.5, np.array([0.0, 1.0]), 0.5

    def _emit(self, f: np.ndarray) -> np.ndarray:
        half = (f @ self.weights.astype(np.float32)).astype(np.float64) / 2
        return np.stack([-half, half], axis=1)

    @staticmethod
    def _quality(p: np.ndarray, doc: np.ndarray, size: np.ndarray, docs: int) -> np.ndarray:
        weight = np.bincount(doc, size, docs)
        return np.where(weight > 0, np.bincount(doc, p * size, docs) / np.maximum(weight, 1), 0.0)

    @staticmethod
    def _logit(q: np.ndarray) -> np.ndarray:
        q = SOFT + (1 - 2 * SOFT) * q
        return np.log(q / (1 - q))

    def likelihood(self, f: np.ndarray, chains: Chains, doc: np.ndarray, size: np.ndarray, good: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean log-likelihood of the documents' labels, and its gradient by weights and transitions (in a row)."""
        docs, emit = len(good), self._emit(f)
        weight = size / np.maximum(np.bincount(doc, size, docs), 1)[doc]
        q = np.bincount(doc, chains.marginals(emit, self.move)[0][:, 1] * weight, docs)
        z = self.curve[0] + self.curve[1] * self._logit(q)
        value = -np.logaddexp(0, np.where(good == 1, -z, z)).mean()
        soft = SOFT + (1 - 2 * SOFT) * q
        by_quality = (good - 1 / (1 + np.exp(-z))) * self.curve[1] * (1 - 2 * SOFT) / (soft * (1 - soft)) / docs
        pull = by_quality[doc] * weight  # of each line's marginal
        step = 1e-3 / max(np.abs(pull).max(), 1e-300)
        sides = []
        for sign in (1, -1):
            moved = emit.copy()
            moved[:, 1] += sign * step * pull
            p, pairs, _ = chains.marginals(moved, self.move)
            sides.append((p[:, 1], pairs))
        by_line, by_move = ((a - b) / (2 * step) for a, b in zip(*sides, strict=True))
        return float(value), np.concatenate([f.T @ by_line, by_move.ravel()])

    def _fit_curve(self, q: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Newton steps of a logistic fit."""
        z, c = np.stack([np.ones(len(q)), self._logit(q)], axis=1), np.array([0.0, 0.5])
        for _ in range(50):
            s = 1 / (1 + np.exp(-z @ c))
            h = (z * (s * (1 - s))[:, None]).T @ z + 1e-2 * np.eye(2)
            c = c + np.linalg.solve(h, z.T @ (good - s) - 1e-2 * c)
        return c

    def fit(
        self, x: np.ndarray, doc: np.ndarray, size: np.ndarray, good: np.ndarray, first: int = 80, rounds: int = 20, turns: int = 4, l2: float = 1e-3, around: float = 2.0
    ) -> LineCrf:
        """doc: document of each line, 0 on; good: label of each document.

        Labels are those of whole documents, so what a line has its neighbours seem to have too: `around` times the
        penalty on their weights keeps a bad line from spoiling those beside it.
        """
        docs = len(good)
        if not docs or good.min() == good.max() or not len(x):
            return self
        f, y = with_neighbours(x, doc), good[doc].astype(np.float64)
        penalty = np.full(N_FEATURES, l2)
        penalty[N_OWN : 3 * N_OWN] *= around

        def apart(w: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(-(f @ w.astype(np.float32)).astype(np.float64)))
            return f.T @ (y - p) / len(x) - penalty * w

        self.weights = _adam(self.weights, apart, first, 0.1)
        chains, start = Chains(doc, docs), self.move.copy()

        def through(theta: np.ndarray) -> np.ndarray:
            self.weights, self.move = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
            away = np.concatenate([penalty * self.weights, l2 * (self.move - start).ravel()])
            return self.likelihood(f, chains, doc, size, good)[1] - away

        for _ in range(turns):
            self._calibrate(chains.marginals(self._emit(f), self.move)[0][:, 1], doc, size, good)
            theta = _adam(np.concatenate([self.weights, self.move.ravel()]), through, rounds, 0.03)
            self.weights, self.move = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        self._calibrate(chains.marginals(self._emit(f), self.move)[0][:, 1], doc, size, good)
        return self

    def _calibrate(self, p: np.ndarray, doc: np.ndarray, size: np.ndarray, good: np.ndarray, rare: float = 0.002) -> None:
        """The curve from quality to probability, and the marginal below which a line is bad.

        That is halfway, in log-odds, between the `rare` least of good documents' lines and the upper quartile of bad ones'.
        """
        self.curve = self._fit_curve(self._quality(p, doc, size, len(good)), good)
        low, high = (self._logit(np.quantile(p[good[doc] == y], at)) if (good[doc] == y).any() else 0.0 for y, at in ((0, 0.75), (1, rare)))
        self.cut = float(np.clip(1 / (1 + np.exp(-(min(low, high) + high) / 2)), 0.05, 0.95))

    def score(self, x: np.ndarray, doc: np.ndarray, size: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Score of each document and P(good) of each line."""
        p = Chains(doc, docs).marginals(self._emit(with_neighbours(x, doc)), self.move)[0][:, 1] if len(x) else np.zeros(0)
        z = np.stack([np.ones(docs), self._logit(self._quality(p, doc, size, docs))], axis=1) @ self.curve
        return 1 / (1 + np.exp(-z)), p


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 6000, sample_lines: int = 2000, sample_total: int = 200_000,
) -> LineCrf:
    """Fits on labelled documents that are not held out."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("good").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most `sample` pairs of numbers, in this order
    good = {r[0]: int(r[1] > 0) for r in chosen.collect()}
    if not good:
        return LineCrf()
    spark = docs.sparkSession
    few = spark.createDataFrame(list(good), "long").toDF("doc_id")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(few), "doc_id", "left_semi").where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = string_views(batch.column(1))
            for lo, hi in chunks(offsets):
                x, doc, _, size = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                first = np.searchsorted(doc, np.arange(hi - lo + 1))
                own = [i for i in range(hi - lo) if 0 < first[i + 1] - first[i] <= sample_lines]
                ids = batch.column(0).slice(lo, hi - lo).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in own], pa.int64()), pa.array([int(first[i + 1] - first[i]) for i in own], pa.int64()),
                        pa.array([x[first[i] : first[i + 1]].tobytes() for i in own], pa.binary()), pa.array(
                            [size[first[i] : first[i + 1]].astype(np.int64).tobytes() for i in own], pa.binary()
                        ),
                    ],
                    names=["doc_id", "lines", "x", "size"],
                )

    found = rows.mapInArrow(run, "doc_id long, lines long, x binary, size binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct("lines", "x", "size")).alias("f")).select("doc_id", "f.*")  # rows may repeat an id
    stage = Stage(spark, "quality")
    one = stage.table(one, "sample")
    lines = {r[0]: r[1] for r in one.select("doc_id", "lines").collect()}  # at most `sample` pairs
    total, ids = 0, []
    for i in good:
        total += lines.get(i, 0)
        if i in lines and total <= sample_total:
            ids.append(i)
    got = {r["doc_id"]: r for r in one.where(F.col("doc_id").isin(ids)).collect()} if ids else {}
    stage.drop("sample")
    if not got:
        return LineCrf()
    xs = [np.frombuffer(got[i]["x"], np.float32).reshape(-1, N_OWN) for i in ids]
    sizes = np.concatenate([np.frombuffer(got[i]["size"], np.int64) for i in ids]).astype(np.float64)
    return LineCrf().fit(np.concatenate(xs), np.repeat(np.arange(len(xs)), [len(a) for a in xs]), sizes, np.array([good[i] for i in ids]))


def score_quality(docs: DataFrame, model: LineCrf, text: str = "text") -> DataFrame:
    """The documents with score, n_lines (non-empty) and bad_lines (numbers of the lines labelled bad)."""
    docs = docs.drop(*OWN)
    names = docs.columns
    at = names.index(text)
    shared = send(docs.sparkSession, model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            data, offsets, _ = string_views(batch.column(at))
            for lo, hi in chunks(offsets):
                x, doc, number, size = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                score, p = shared.value.score(x, doc, size, hi - lo)
                bad = p < shared.value.cut
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc[bad], minlength=hi - lo))]).astype(np.int32)
                bad_lines = pa.ListArray.from_arrays(pa.array(cuts), pa.array(number[bad].astype(np.int32)))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(np.bincount(doc, minlength=hi - lo).astype(np.int64)), bad_lines], names=[*names, *OWN])

    return docs.mapInArrow(run, f"{schema}, score double, n_lines long, bad_lines array<int>")


def op3_quality_crf(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines",
        F.size("bad_lines").alias("n_bad_lines")
    )
