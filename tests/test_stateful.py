"""Keyed state of the detection streams: what a batch writes, against plain versions, over batches and a restart."""

import math
import random

import pandas as pd
import pytest

from larder.streaming import keyed, stateful, windows


class Map:
    """A map state in memory that notes its writes."""

    def __init__(self):
        self.held, self.writes = {}, []

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key] = value
        self.writes.append(key)

    def removeKey(self, key):
        self.held.pop(key, None)
        self.writes.append(key)

    def clear(self):
        self.held = {}


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):
        return self.maps.setdefault(name, Map())

    def getValueState(self, name, *_):
        return Value()

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def listTimers(self):
        return iter(self.timers)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _step(processor, rows, columns, now=0):
    """A batch of one key, after a new start of the process: only the state lives on."""
    found = processor.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=columns)]), Clock(now))
    return [tuple(r) for df in found for r in df.itertuples(index=False)]


def _sight(*labels):
    return [{"label": a, "confidence": 0.9, "cam_x": 1.0, "cam_y": 0.0, "cam_z": 0.0} for a in labels]


def test_stability_writes_what_was_seen():
    handle = Handle()
    gate = stateful._Stable(3, 0.5, None, None)
    gate.init(handle)
    labels = handle.maps["labels"]
    _step(gate, [(i, _sight(*(f"thing {j}" for j in range(200)), "cup")) for i in range(2)], ["frame_seq", "detections"])
    assert len(labels.held) == 201
    labels.writes.clear()
    assert _step(gate, [(2, _sight("cup"))], ["frame_seq", "detections"]) == [("k", "cup", 2, 3, 1.0, 0.0, 0.0)]
    assert labels.writes == [("cup",)]  # the 200 others were away and are not touched
    assert _step(gate, [(3, _sight("cup")), (4, None), (5, _sight("thing 1"))], ["frame_seq", "detections"]) == []
    assert ("cup",) not in labels.held and labels.held[("thing 1",)][1] == 1  # a new run begins at one
    bad = [{"label": None, "confidence": 1.0, "cam_x": 1.0, "cam_y": 0.0, "cam_z": 0.0}, {"label": "cup", "confidence": None, "cam_x": 1.0, "cam_y": 0.0, "cam_z": 0.0}, {"label": "cup", "confidence": 1.0, "cam_x": float("nan"), "cam_y": 0.0, "cam_z": 0.0}]
    assert _step(gate, [(6, bad)] * 4, ["frame_seq", "detections"]) == [] and ("cup",) not in labels.held


def test_registry_writes_one_object():
    handle = Handle()
    store = stateful._Registry(0.5, ["seq"])
    store.init(handle)
    columns = ["request_id", "label", "px", "py", "op", "seq"]
    _step(store, [(1, "cup", float(i), 0.0, "put", i) for i in range(300)], columns)
    for m in handle.maps.values():
        m.writes.clear()
    assert _step(store, [(2, "cup", 7.2, 0.0, "put", 0), (2, "cup", 0.5, 9.0, "put", 1)], columns) == [("k", "detected_cup_300", "cup", 0.5, 9.0)]
    assert [len(m.writes) for m in handle.maps.values()] == [1, 1, 1]


def _registry(rows, radius):
    """The plain version: all stored objects in a list."""
    stored, before, request, out = [], [], None, []
    for r, label, x, y, op, _ in rows:
        if r != request:
            request, before = r, list(stored)
        kind = (label or "").replace(" ", "_")
        if op == "clear":
            stored, before = [], []
        elif op == "forget":
            stored, before = ([o for o in s if o[1] != kind and o[0] != (label or "")] for s in (stored, before))
        elif x is not None and y is not None and not any(o[1] == kind and math.hypot(o[2] - x, o[3] - y) < radius for o in before):
            used, i = {o[0] for o in stored}, 0
            while f"detected_{kind}_{i}" in used:
                i += 1
            stored.append((f"detected_{kind}_{i}", kind, x, y))
            out.append(stored[-1])
    return out


def _requests(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choices(["put", "forget", "clear"], [20, 3, 0.3])[0]
        label = rng.choice(["cup", "tea pot", "", None, "a_1"])
        if op == "forget" and rng.random() < 0.7:  # one object, known or not
            label = f"detected_{(label or '').replace(' ', '_')}_{rng.randrange(6)}"
        rows.append((i // 4, label, rng.choice([None, *(rng.uniform(-2, 2) for _ in range(9))]), rng.choice([-0.5, 0.0, 0.5]), op, i))
    return rows


@pytest.mark.parametrize("seed, radius", [(1, 0.5), (2, 0.5), (3, 0.0), (4, 1.7)])
def test_registry_equals_a_list(seed, radius):
    rows, got = _requests(seed, 400), []
    store = stateful._Registry(radius, ["seq"])
    store.init(Handle())
    for a in range(0, 400, 40):
        part = rows[a : a + 40]
        random.Random(seed).shuffle(part)
        got += [r[1:] for r in _step(store, part, ["request_id", "label", "px", "py", "op", "seq"])]
    assert got == _registry(rows, radius) and got


SCHEMA = "map_id string, request_id long, label string, px double, py double, op string, seq long"


def test_registry_stream_over_a_restart(spark, tmp_path):
    rows = _requests(5, 120)
    for part in range(3):
        spark.createDataFrame([("m", *r) for r in rows[part * 40 : part * 40 + 40]], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part:  # the second run begins where the first ended
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            with keyed.with_rocksdb(spark):
                out = windows.run_to_end(stateful.registry(stream, 0.5, ["seq"]), None, f"file://{tmp_path}/state")
    assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(_registry(rows, 0.5))


def test_watchdog_state_and_timer():
    handle = Handle()
    dog = stateful._Watchdog(0.5, 0.05, 15.0, 120.0, True)
    dog.init(handle)
    assert _step(dog, [(0.0, 3.0)], ["t", "distance"], 1000) == [] and handle.timers == [16000]
    assert _step(dog, [(5.0, 2.0), (4.0, 2.5)], ["t", "distance"], 6000) == [] and handle.timers == [21000]  # one timer at a time
    ended = [tuple(r) for df in dog.handleExpiredTimer(("k",), Clock(21000), None) for r in df.itertuples(index=False)]
    assert ended == [("k", "failed", 5.0)]
    assert _step(dog, [(6.0, 0.1)], ["t", "distance"], 22000) == []  # it has ended


def test_registry_asks_for_known_labels_only():
    """Of a label that state does not know no cell is read, and what is stored is still found in a later batch."""
    handle = Handle()
    store = stateful._Registry(0.5, ["seq"])
    store.init(handle)
    reads = []
    for m in handle.maps.values():
        m.getValue = lambda key, held=m: reads.append(key) or held.held.get(key)
    columns = ["request_id", "label", "px", "py", "op", "seq"]
    rows = [(i // 2, "cup", float(i % 20), 0.0, "put", i) for i in range(60)]
    assert len(_step(store, rows, columns)) == 20 and reads == [("cup",)]
    reads.clear()
    assert _step(store, [(90, "cup", 3.2, 0.0, "put", 0), (91, "tea", 3.2, 0.0, "put", 1), (92, "cup", 0.0, 0.0, "forget", 2), (93, "cup", 3.2, 0.0, "put", 3)], columns) == [("k", "detected_tea_0", "tea", 3.2, 0.0), ("k", "detected_cup_0", "cup", 3.2, 0.0)]
    assert ("cup", 3, 0) in reads and [r for r in reads if r[0] == "tea"] == [("tea",)]
    assert len(handle.maps["places"].held) == 2
