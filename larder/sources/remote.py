"""Python data sources for request/response services and header streams.

`larder_objects` asks a service for its objects once and gives rows; a service
that does not answer gives none.  `larder_frames` is a stream of frame headers.
The transport is an option: `file:<path>` (a JSON file, for tests), or
`zmq:<address>` where the client library is installed.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader


def _ask(address: str, command: str, timeout_ms: int) -> dict:
    kind, _, place = address.partition(":")
    try:
        if kind == "file":
            with open(place) as f:
                return json.load(f)
        if kind == "zmq":
            import zmq

            socket = zmq.Context.instance().socket(zmq.REQ)
            socket.setsockopt(zmq.RCVTIMEO, timeout_ms)
            socket.setsockopt(zmq.LINGER, 0)
            socket.connect(place)
            try:
                socket.send_json({"command": command})
                return socket.recv_json()
            finally:
                socket.close()
    except Exception:
        return {}
    raise ValueError(f"unknown transport {kind!r}")


class ObjectsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "larder_objects"

    def schema(self) -> str:
        return "name string, px double, py double, label string"

    def reader(self, schema) -> DataSourceReader:
        return _ObjectsReader(self.options)


class _ObjectsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.address, self.timeout = options["address"], int(options.get("timeout_ms", "2000"))

    def read(self, partition) -> Iterator[tuple]:
        reply = _ask(self.address, "get_objects", self.timeout)
        found = reply.get("objects", reply) if isinstance(reply, dict) else {}
        for name, o in found.items():
            if isinstance(o, dict):
                yield name, _number(o.get("px")), _number(o.get("py")), o.get("label", name)


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


class FramesSource(DataSource):
    """Frame headers appended to a JSON-lines file, from where the last batch ended; at most `depth` of a batch are kept, the newest."""

    @classmethod
    def name(cls) -> str:
        return "larder_frames"

    def schema(self) -> str:
        return "topic string, frame_seq long, ts double, width int, height int"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _FramesReader(self.options)


class _FramesReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.depth = options["path"], int(options.get("depth", "0"))

    def initialOffset(self) -> dict:
        return {"at": 0}

    def _rows(self, start: int, end: int | None) -> tuple[list[tuple], int]:
        if not os.path.exists(self.path):
            return [], start
        with open(self.path, "rb") as f:
            f.seek(start)
            raw = f.read() if end is None else f.read(end - start)
        raw = raw[: raw.rfind(b"\n") + 1]
        rows = []
        for line in raw.splitlines():
            try:
                h = json.loads(line)
                rows.append((str(h.get("topic", "")), int(h["frame_seq"]), float(h.get("ts", time.time())), h.get("width"), h.get("height")))
            except (ValueError, KeyError, TypeError):
                continue
        return (rows[-self.depth :] if self.depth else rows), start + len(raw)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._rows(start["at"], None)
        return iter(rows), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["at"], end["at"])[0])


def register(spark) -> None:
    spark.dataSource.register(ObjectsSource)
    spark.dataSource.register(FramesSource)
