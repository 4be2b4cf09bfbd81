"""Stateful streams with a state entry for each thing that is remembered, so what does not change is not written again.

They need the RocksDB state store (`with_rocksdb`).  Rows of a micro-batch are taken in the order given; those of an
earlier batch come before those of a later one, whatever their time.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside use the RocksDB state store."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(order, kind="stable")


class _LastOfTwo(StatefulProcessor):
    """Remembers the last value of the right side; older ones are dropped as newer ones come."""

    def __init__(self, order: list[str], kind: str, left: str, right: str, value: str, id_: str, value_type: str):
        self.order, self.kind, self.left, self.right, self.value, self.id, self.type = order, kind, left, right, value, id_, value_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", f"value {self.type}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value = self.last.get()[0] if self.last.exists() else None
        new, out = False, []
        for kind, v, i in in_order(rows, self.order)[[self.kind, self.value, self.id]].itertuples(index=False):
            if kind == self.right and not pd.isna(v):
                value, new = v, True
            elif kind == self.left:
                out.append((key[0], i, value))
        if new:
            self.last.update((value,))
        yield pd.DataFrame({"key": [r[0] for r in out], "id": [r[1] for r in out], "paired": pd.Series([r[2] for r in out], dtype=object)})

    def close(self) -> None:
        pass


def latest_pair(events: DataFrame, by: str, order: list[str], kind: str, left: str, right: str, value: str, id_: str) -> DataFrame:
    """For each row of kind `left` the last value of kind `right` that came before it: key, id, paired (null if none did)."""
    types = dict(events.dtypes)
    step = _LastOfTwo(order, kind, left, right, value, id_, types[value])
    return events.groupBy(by).transformWithStateInPandas(step, f"key {types[by]}, id {types[id_]}, paired {types[value]}", "append", "None")


class _CountWindow(StatefulProcessor):
    """Counts frames; hits and sums of each label of the window are entries of their own, and go when it closes."""

    def __init__(self, n: int, least: int, order: str):
        self.n, self.least, self.order = n, least, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "number long, frames int")
        self.labels = handle.getMapState("labels", "label string", "hits long, x double, y double, z double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, frames = self.place.get() if self.place.exists() else (0, 0)
        known, changed, emptied, out = {}, set(), False, []
        for found in in_order(rows, [self.order])["detections"]:
            for d in found if found is not None else []:
                label, p = d["label"], (d["cam_x"], d["cam_y"], d["cam_z"])
                if label is None or any(v is None or v != v for v in p):
                    continue
                if label not in known:
                    stored = None if emptied or not self.labels.containsKey((label,)) else self.labels.getValue((label,))
                    known[label] = tuple(stored) if stored else (0, 0.0, 0.0, 0.0)
                known[label] = (known[label][0] + 1, *(a + b for a, b in zip(known[label][1:], p)))
                changed.add(label)
            frames += 1
            if frames == self.n:
                if not emptied:  # what earlier batches left of this window
                    known = {k[0]: tuple(v) for k, v in self.labels.iterator()} | known
                out += [(key[0], number, a, h, x / h, y / h, z / h) for a, (h, x, y, z) in sorted(known.items()) if h >= self.least]
                number, frames, known, changed, emptied = number + 1, 0, {}, set(), True
        if emptied:
            self.labels.clear()
        for label in changed:
            self.labels.updateValue((label,), known[label])
        self.place.update((number, frames))
        yield pd.DataFrame(out, columns=["stream_id", "window", "label", "hits", "cam_x", "cam_y", "cam_z"])

    def close(self) -> None:
        pass


WINDOWS = "stream_id string, window long, label string, hits long, cam_x double, cam_y double, cam_z double"


def count_windows(frames: DataFrame, n: int, least: int, order: str = "frame_seq") -> DataFrame:
    """frames: stream_id (string), frame_seq, detections (label, cam_x, cam_y, cam_z).  Every n frames of a stream, the labels with `least` hits or more in them and their mean position; a window that is not full says nothing yet."""
    return frames.groupBy("stream_id").transformWithStateInPandas(_CountWindow(n, least, order), WINDOWS, "append", "None")
