"""Matrices in .pt files (a zip of a pickle and of raw storages), read by rows and without the library that wrote them.

The pickle is read with nothing allowed but tensors of plain numbers and the
containers around them; anything else in it is refused.  Storages are never
loaded whole: rows come from their places in the file, whatever the strides.
"""

from __future__ import annotations

import collections
import pickle
import struct
import zipfile
from dataclasses import dataclass
from typing import Any

import numpy as np

from larder.sources.files import filesystem

# Storages of the format and their numbers; the last has the upper half of a four-byte float.
STORAGES = {"DoubleStorage": "f8", "FloatStorage": "f4", "HalfStorage": "f2", "LongStorage": "i8", "IntStorage": "i4", "ShortStorage": "i2", "CharStorage": "i1", "ByteStorage": "u1", "BFloat16Storage": "u2"}


@dataclass
class Tensor:
    kind: str
    storage: str
    offset: int
    size: tuple[int, ...]
    stride: tuple[int, ...]


def _tensor(storage: tuple, offset: int, size: tuple, stride: tuple, *rest: Any) -> Tensor:
    return Tensor(*storage, offset, tuple(size), tuple(stride))


class _Unpickler(pickle.Unpickler):
    def find_class(self, module: str, name: str) -> Any:
        if (module, name) == ("collections", "OrderedDict"):
            return collections.OrderedDict
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _tensor
        if (module, name) == ("torch._utils", "_rebuild_parameter"):
            return lambda data, *rest: data
        if module == "torch" and name in STORAGES:
            return name
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a matrix file")

    def persistent_load(self, pid: tuple) -> tuple[str, str]:
        if not isinstance(pid, tuple) or len(pid) < 3 or pid[0] != "storage" or pid[1] not in STORAGES:
            raise pickle.UnpicklingError("unknown storage")
        return pid[1], str(pid[2])


class TensorFile:
    """A tensor of one or two dimensions in a .pt file, by `key` where the file has several; rows are read by their numbers."""

    def __init__(self, uri: str, key: str | None = None):
        system, place = filesystem(uri)
        self.file = system.open_input_file(place)
        with zipfile.ZipFile(self.file) as z:
            names = {n.split("/", 1)[-1]: n for n in z.namelist()}
            if "data.pkl" not in names:
                raise ValueError(f"{uri} is no matrix file")
            with z.open(names["data.pkl"]) as f:
                found = _Unpickler(f).load()
            if key is not None:
                found = found[key]
            if not isinstance(found, Tensor) or not 1 <= len(found.size) <= 2:
                raise ValueError(f"{uri} holds no matrix" + (f" at {key!r}" if key else "; name one by key"))
            order = z.read(names["byteorder"]) if "byteorder" in names else b"little"
            info = z.getinfo(names[f"data/{found.storage}"])
            if info.compress_type != zipfile.ZIP_STORED:
                raise ValueError(f"{uri} has compressed storages")
        self.tensor, self.shape = found, found.size
        self.dtype = np.dtype(STORAGES[found.kind]).newbyteorder(">" if order == b"big" else "<")
        self.file.seek(info.header_offset)
        head = self.file.read(30)
        self.start = info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30]))
        last = found.offset + sum((n - 1) * s for n, s in zip(found.size, found.stride)) if all(found.size) else -1
        if min(found.offset, *found.size, *found.stride) < 0 or (last + 1) * self.dtype.itemsize > info.file_size:
            raise ValueError(f"{uri}: the matrix does not fit its storage")

    def __len__(self) -> int:
        return self.shape[0]

    def _read(self, at: int, count: int) -> np.ndarray:
        self.file.seek(self.start + at * self.dtype.itemsize)
        x = np.frombuffer(self.file.read(count * self.dtype.itemsize), self.dtype)
        return (x.astype(np.uint32) << 16).view(np.float32) if self.tensor.kind == "BFloat16Storage" else x

    def rows(self, lo: int, hi: int) -> np.ndarray:
        """Rows lo to hi: one stretch of the storage, or one for each column where columns lie further apart than rows."""
        t, n = self.tensor, hi - lo
        first = t.offset + lo * t.stride[0]
        if n <= 0 or len(t.size) == 2 and not t.size[1]:
            return np.zeros((max(n, 0), *t.size[1:]), np.float32)
        down = np.arange(n) * t.stride[0]
        if len(t.size) == 1:
            return self._read(first, int(down[-1]) + 1)[down]
        if t.stride[1] > t.stride[0] and n > 1:
            return np.stack([self._read(first + j * t.stride[1], int(down[-1]) + 1)[down] for j in range(t.size[1])], axis=1)
        across = np.arange(t.size[1]) * t.stride[1]
        return self._read(first, int(down[-1] + across[-1]) + 1)[down[:, None] + across]

    def close(self) -> None:
        self.file.close()
