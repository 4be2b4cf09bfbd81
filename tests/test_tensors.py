"""Matrix files in the zip-and-pickle format, written here without the library they come from."""

import collections
import io
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest

from larder.sources import readers
from larder.sources.tensors import TensorFile


@pytest.fixture
def write(tmp_path, monkeypatch):
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    monkeypatch.setitem(sys.modules, "torch", torch)
    monkeypatch.setitem(sys.modules, "torch._utils", utils)

    def _rebuild_tensor_v2(*a):
        raise AssertionError

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = _rebuild_tensor_v2
    kinds = {}
    for name in ("FloatStorage", "DoubleStorage", "HalfStorage", "LongStorage", "BFloat16Storage"):
        kinds[name] = type(name, (), {"__module__": "torch"})
        setattr(torch, name, kinds[name])

    class Storage:
        def __init__(self, kind, number, n):
            self.pid = ("storage", kinds[kind], str(number), "cpu", n)

    class Rebuilt:
        def __init__(self, *a):
            self.a = a

        def __reduce__(self):
            return _rebuild_tensor_v2, self.a

    class Pickler(pickle.Pickler):
        def persistent_id(self, obj):
            return obj.pid if isinstance(obj, Storage) else None

    def run(name, tensors, compress=zipfile.ZIP_STORED, extra=None):
        """tensors: key to (kind, flat numbers, offset, size, stride); one without a name is the file's object."""
        built = {k: Rebuilt(Storage(kind, i, len(flat)), off, size, stride, False, collections.OrderedDict()) for i, (k, (kind, flat, off, size, stride)) in enumerate(tensors.items())}
        whole = built[None] if None in built else collections.OrderedDict(built | (extra or {}))
        out = io.BytesIO()
        Pickler(out, 2).dump(whole)
        with zipfile.ZipFile(tmp_path / name, "w", compress) as z:
            z.writestr("m/data.pkl", out.getvalue())
            for i, (_, flat, *_) in enumerate(tensors.values()):
                z.writestr(f"m/data/{i}", np.ascontiguousarray(flat).tobytes())
        return str(tmp_path / name)

    return run


@pytest.mark.parametrize("kind, dtype", [("FloatStorage", "<f4"), ("DoubleStorage", "<f8"), ("HalfStorage", "<f2"), ("LongStorage", "<i8")])
def test_rows_of_a_matrix(spark, write, kind, dtype):
    x = np.arange(60).reshape(20, 3).astype(dtype)
    path = write("a.pt", {None: (kind, x.ravel(), 0, (20, 3), (3, 1))})
    got = {r["id"]: r["vec"] for r in readers.vector_file(spark, path, rows=7).collect()}
    assert got == {i: x[i].astype(float).tolist() for i in range(20)}


def test_strides(write):
    flat = np.arange(100, dtype=np.float32)
    every = np.lib.stride_tricks.as_strided
    for size, stride, offset in (((6, 4), (1, 10), 3), ((5, 3), (7, 2), 1), ((4, 3), (0, 1), 5), ((4, 3), (3, 0), 5), ((9,), (4,), 2), ((1, 4), (1, 20), 0)):
        want = every(flat[offset:], size, [4 * s for s in stride])
        x = TensorFile(write("s.pt", {None: ("FloatStorage", flat, offset, size, stride)}))
        assert len(x) == size[0] and (x.rows(0, size[0]) == want).all()
        assert all((x.rows(i, i + 1) == want[i : i + 1]).all() for i in range(size[0]))


def test_named_matrices_ids_and_short_floats(spark, write, tmp_path):
    short = (np.array([1.5, -2.0, 0.0, 3.0], np.float32).view(np.uint32) >> 16).astype("<u2")
    path = write("b.pt", {"w": ("BFloat16Storage", short, 0, (2, 2), (2, 1)), "b": ("DoubleStorage", np.ones(3), 0, (3,), (1,))}, extra={"epoch": 3, "name": "x"})
    np.save(tmp_path / "ids.npy", np.array([7, 9]))
    got = sorted((r["id"], r["vec"]) for r in readers.vector_file(spark, path, str(tmp_path / "ids.npy"), key="w").collect())
    assert got == [(7, [1.5, -2.0]), (9, [0.0, 3.0])]
    with pytest.raises(ValueError, match="name one"):
        TensorFile(path)


class Harm:
    def __reduce__(self):
        return print, ("harm",)


def test_what_is_refused(write, tmp_path):
    x = ("FloatStorage", np.zeros(6, np.float32), 0, (2, 3), (3, 1))
    with pytest.raises(pickle.UnpicklingError, match="print"):
        TensorFile(write("c.pt", {"w": x}, extra={"h": Harm()}), "w")
    with pytest.raises(ValueError, match="compressed"):
        TensorFile(write("d.pt", {None: x}, zipfile.ZIP_DEFLATED))
    with pytest.raises(ValueError, match="fit"):
        TensorFile(write("e.pt", {None: ("FloatStorage", np.zeros(5, np.float32), 0, (2, 3), (3, 1))}))
    with zipfile.ZipFile(tmp_path / "f.pt", "w") as z:
        z.writestr("m/other", b"")
    with pytest.raises(ValueError, match="no matrix file"):
        TensorFile(str(tmp_path / "f.pt"))
