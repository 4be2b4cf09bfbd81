"""Files on any file system that both the driver and the workers reach (local, HDFS, S3 or GCS)."""

from __future__ import annotations

import contextlib

import numpy as np


def filesystem(uri: str):
    """The file system and path of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:///{uri.removeprefix('file:').lstrip('/')}")


class Matrix:
    """A .npy file of one or two dimensions, of which rows are read by their numbers; nothing else is loaded."""

    def __init__(self, uri: str):
        system, place = filesystem(uri)
        self.file = system.open_input_file(place)
        version = np.lib.format.read_magic(self.file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, by_column, self.dtype = read(self.file)
        if self.dtype.hasobject or by_column and len(self.shape) > 1:
            raise ValueError(f"{uri} holds objects or is stored by column")
        self.start = self.file.tell()
        self.row = self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=np.int64))

    def __len__(self) -> int:
        return self.shape[0]

    def rows(self, lo: int, hi: int) -> np.ndarray:
        self.file.seek(self.start + lo * self.row)
        return np.frombuffer(self.file.read((hi - lo) * self.row), self.dtype).reshape(-1, *self.shape[1:])

    def close(self) -> None:
        with contextlib.suppress(OSError):
            self.file.close()
