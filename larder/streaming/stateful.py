"""Stateful streams of detections: the stability gate, the object registry, watchdogs.

Each thing that is remembered has a state entry of its own, so a batch writes what it changed and nothing else.  They
need the RocksDB state store (`keyed.with_rocksdb`).
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.streaming.keyed import in_order


class Entries:
    """The entries of a map in state: each is read once for a batch, and `flush` writes those that changed.

    Every read and write is a message to the JVM; of keys that begin with one of `absent` the state has none to ask for.
    """

    def __init__(self, state, absent: set[str] | None = None):
        self.state, self.held, self.changed, self.emptied, self.absent = state, {}, set(), False, set() if absent is None else absent

    def get(self, key: tuple) -> tuple | None:
        if key not in self.held:
            found = None if self.emptied or key[0] in self.absent else self.state.getValue(key)
            self.held[key] = None if found is None else tuple(found)
        return self.held[key]

    def put(self, key: tuple, value: tuple | None) -> None:
        """A value of None removes the entry."""
        self.held[key] = value
        self.changed.add(key)

    def clear(self) -> None:
        self.held, self.changed, self.emptied = {}, set(), True

    def flush(self) -> None:
        if self.emptied:
            self.state.clear()
        for key in self.changed:
            if self.held[key] is not None:
                self.state.updateValue(key, self.held[key])
            elif not self.emptied and key[0] not in self.absent:
                self.state.removeKey(key)


READY = "stream_id string, label string, frame_seq long, streak long, cam_x double, cam_y double, cam_z double"


class _Stable(StatefulProcessor):
    """A label's entry says in which frame it was last seen; one from before the last frame counts as none."""

    def __init__(self, n: int, least: float, targets: list[str] | None, ttl_ms: int | None):
        self.n, self.least, self.targets, self.ttl = n, least, targets, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getValueState("frames", "n long")
        self.labels = handle.getMapState("labels", "label string", "frame long, streak long, sent boolean, x double, y double, z double", self.ttl)

    def _qualifies(self, d) -> bool:
        p = (d["cam_x"], d["cam_y"], d["cam_z"])
        return d["label"] is not None and d["confidence"] is not None and d["confidence"] >= self.least and all(v is not None and v == v for v in p) and (not self.targets or d["label"] in self.targets)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = self.frames.get()[0] if self.frames.exists() else 0
        known, out = Entries(self.labels), []
        batch = in_order(rows, ["frame_seq"])
        for seq, found in zip(batch["frame_seq"], batch["detections"], strict=True):
            frame += 1
            seen = set()
            for d in found if found is not None else []:
                if not self._qualifies(d):
                    continue
                old = known.get((d["label"],))
                if old is None or old[0] < frame - 1:
                    old = (frame, 0, False, 0.0, 0.0, 0.0)
                known.put((d["label"],), (frame, old[1] + 1, old[2], old[3] + d["cam_x"], old[4] + d["cam_y"], old[5] + d["cam_z"]))
                seen.add(d["label"])
            for label in sorted(seen):
                at, streak, sent, *sums = known.get((label,))
                if streak >= self.n and not sent:
                    known.put((label,), (at, streak, True, *sums))
                    out.append((key[0], label, int(seq), streak, *(v / streak for v in sums)))
        for label in list(known.changed):
            if known.get(label)[0] < frame:  # its run has ended
                known.put(label, None)
        known.flush()
        self.frames.update((frame,))
        yield pd.DataFrame(out, columns=["stream_id", "label", "frame_seq", "streak", "cam_x", "cam_y", "cam_z"])

    def close(self) -> None:
        pass


def stable(frames: DataFrame, n: int = 8, least: float = 0.5, targets: list[str] | None = None, ttl_ms: int | None = None) -> DataFrame:
    """frames: stream_id, frame_seq, detections (label, confidence, cam_x, cam_y, cam_z), one row per frame.

    A label is reported once when its run of frames without a gap reaches n detections, and again only after it was away.
    Frames of a batch are taken in their order.  Labels that are not seen are not touched in state; with `ttl_ms` they
    leave it after that time by the clock, and a pause as long in a whole stream ends its runs.
    """
    return frames.groupBy("stream_id").transformWithStateInPandas(_Stable(n, least, targets, ttl_ms), READY, "append", "ProcessingTime" if ttl_ms else "None")


OBJECT = "map_id string, name string, label string, px double, py double"


class _Registry(StatefulProcessor):
    """By label the first number never used and the freed ones; by label and number the cell; by cell the objects in it."""

    def __init__(self, radius: float, order: Sequence[str]):
        self.radius, self.order = radius, ["request_id", *order]
        self.side = radius * 1.001 if radius > 0 else 1.0  # so that nearer than the radius is never two cells away

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.number_state = handle.getMapState("numbers", "label string", "next int, freed array<int>")
        self.place_state = handle.getMapState("places", "label string, number int", "cx long, cy long")
        self.cell_state = handle.getMapState("cells", "label string, cx long, cy long", "numbers array<int>, xs array<double>, ys array<double>")

    def _count(self, label: str) -> tuple | None:
        """The label's entry; a label without one has no objects in state."""
        if (label,) not in self.numbers.held and self.numbers.get((label,)) is None:
            self.absent.add(label)
        return self.numbers.get((label,))

    def _near(self, label: str, x: float, y: float, cx: int, cy: int, fresh: set[tuple[str, int]]) -> bool:
        if self._count(label) is None:
            return False
        for key in ((label, cx + i, cy + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            for number, ox, oy in zip(*(self.cells.get(key) or ((), (), ())), strict=True):
                if (label, number) not in fresh and math.hypot(ox - x, oy - y) < self.radius:
                    return True
        return False

    def _put(self, label: str, x: float, y: float, cx: int, cy: int) -> int:
        following, freed = self._count(label) or (0, [])
        if len(freed):
            number, freed = int(freed[0]), list(freed)[1:]
        else:
            number, following = following, following + 1
        self.numbers.put((label,), (following, list(freed)))
        self.places.put((label, number), (cx, cy))
        numbers, xs, ys = self.cells.get((label, cx, cy)) or ([], [], [])
        self.cells.put((label, cx, cy), ([*numbers, number], [*xs, x], [*ys, y]))
        return number

    def _drop(self, label: str, number: int) -> bool:
        place = self.places.get((label, number))
        if place is None:
            return False
        left = [o for o in zip(*self.cells.get((label, *place)), strict=True) if o[0] != number]
        self.cells.put((label, *place), tuple(list(c) for c in zip(*left, strict=True)) if left else None)
        self.places.put((label, number), None)
        return True

    def _forget(self, said: str, fresh: set[tuple[str, int]]) -> None:
        label = said.replace(" ", "_")
        following, freed = self._count(label) or (0, [])
        for number in set(range(following)) - set(freed):
            self._drop(label, number)
            fresh.discard((label, number))
        if following:
            self.numbers.put((label,), None)
        name = re.fullmatch(r"detected_(.*)_(0|[1-9]\d*)", said)
        if name and self._drop(name[1], int(name[2])):
            fresh.discard((name[1], int(name[2])))
            following, freed = self.numbers.get((name[1],))
            freed = list(freed)
            bisect.insort(freed, int(name[2]))
            self.numbers.put((name[1],), (following, freed))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.absent: set[str] = set()
        self.numbers, self.places, self.cells = (Entries(s, self.absent) for s in (self.number_state, self.place_state, self.cell_state))
        out, request, fresh = [], None, set()
        for r in in_order(rows, self.order).itertuples():
            if r.request_id != request:
                request, fresh = r.request_id, set()
            said = r.label if isinstance(r.label, str) else ""
            if r.op == "clear":
                for entries in (self.numbers, self.places, self.cells):
                    entries.clear()
                fresh = set()
            elif r.op == "forget":
                self._forget(said, fresh)
            elif not pd.isna(r.px) and not pd.isna(r.py) and math.isfinite(r.px) and math.isfinite(r.py):
                label, x, y = said.replace(" ", "_"), float(r.px), float(r.py)
                cx, cy = math.floor(x / self.side), math.floor(y / self.side)
                if not self._near(label, x, y, cx, cy, fresh):
                    number = self._put(label, x, y, cx, cy)
                    fresh.add((label, number))
                    out.append((key[0], f"detected_{label}_{number}", label, x, y))
        for entries in (self.numbers, self.places, self.cells):
            entries.flush()
        yield pd.DataFrame(out, columns=["map_id", "name", "label", "px", "py"])

    def close(self) -> None:
        pass


def registry(requests: DataFrame, radius: float = 0.5, order: Sequence[str] = ()) -> DataFrame:
    """requests: map_id, request_id, label, px, py, op (put, forget or clear).  Emits each object as it is registered.

    Objects of one request (in a batch) are compared with what was stored before it, not with each other; a new one takes
    the first free number of its label.  `forget` names a label or one object.  Requests of a batch are taken by
    request_id, rows of one by `order`.  A null label is an empty one; a put without a finite position does nothing.
    """
    return requests.groupBy("map_id").transformWithStateInPandas(_Registry(radius, order), OBJECT, "append", "None")


class _Watchdog(StatefulProcessor):
    def __init__(self, near: float, step_m: float, patience_s: float, limit_s: float, timer: bool):
        self.near, self.step, self.patience, self.limit, self.timer = near, step_m, patience_s, limit_s, timer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.drive = handle.getValueState("drive", "start double, best double, last double, done boolean")

    def _ended(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["goal_id", "state", "t"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, best, last, done = self.drive.get() if self.drive.exists() else (None, None, None, False)
        if done:  # what comes after the end changes nothing
            yield self._ended([])
            return
        out = []
        for t, d in in_order(rows, ["t", "distance"])[["t", "distance"]].itertuples(index=False):
            start = t if start is None else start
            if best is None or d <= best - self.step:
                best, last = d, t
            end = "success" if d <= self.near else "failed" if t - last >= self.patience else "timeout" if t - start >= self.limit else None
            if end:
                out.append((key[0], end, float(t)))
                break
        self.drive.update((float(start), float(best), float(last), bool(out)))
        if self.timer:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if not out:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.patience))
        yield self._ended(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, best, last, done = self.drive.get()
        if not done:
            self.drive.update((start, best, last, True))
        yield self._ended([] if done else [(key[0], "failed", last)])

    def close(self) -> None:
        pass


def watchdog(track: DataFrame, near: float = 0.5, step_m: float = 0.05, patience_s: float = 15.0, limit_s: float = 120.0, timer: bool = False) -> DataFrame:
    """track: goal_id, t (seconds), distance.  Emits once how each drive ended: success, failed or timeout.

    Rows without a time or a distance count for nothing.  With `timer`, for live streams, a drive that says nothing for
    `patience_s` of the clock has failed as well.
    """
    rows = track.where("t IS NOT NULL AND distance IS NOT NULL")
    step = _Watchdog(near, step_m, patience_s, limit_s, timer)
    return rows.groupBy("goal_id").transformWithStateInPandas(step, "goal_id string, state string, t double", "append", "ProcessingTime" if timer else "None")
