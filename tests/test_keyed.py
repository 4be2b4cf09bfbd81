"""Streams with keyed state: several micro-batches, a restart, and the batch forms."""

import random

import pytest

from larder.operators import spatial
from larder.streaming import keyed, windows

EVENTS = "user long, t long, id long, kind string, value double"


def _stream(spark, at, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(at))


def _run(spark, at, make, tmp_path, schema):
    with keyed.with_rocksdb(spark):
        return windows.run_to_end(make(_stream(spark, at, schema)), None, f"file://{tmp_path}/state")


def test_latest_pair_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(4), t, t, rng.choice("ab"), None if t % 13 == 0 else float(t)) for t in range(120)]
    make = lambda s: keyed.latest_pair(s, "user", ["t", "id"], "kind", "a", "b", "value", "id")
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40][::-1], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if part:  # the second run begins where the first ended
            out = _run(spark, tmp_path / "in", make, tmp_path, EVENTS)
    want = spatial.latest_pair(spark.createDataFrame(rows, EVENTS), "user", "t", "kind", "a", "b", "value", "id").select("user", "id", "paired")
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and sorted(got, key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_either_side_may_be_late(spark, tmp_path):
    make = lambda s: keyed.latest_pair(s, "user", ["t", "id"], "kind", "a", "b", "value", "id")
    for row in ((1, 10, 1, "a", 0.0), (1, 5, 2, "b", 7.0), (1, 3, 3, "a", 0.0), (2, 1, 4, "b", 1.0)):  # in order of arrival
        spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = _run(spark, tmp_path / "in", make, tmp_path, EVENTS)
    assert sorted(map(tuple, out.collect())) == [(1, 1, None), (1, 3, 7.0)]


FRAMES = "stream_id string, frame_seq long, detections array<struct<label:string,cam_x:double,cam_y:double,cam_z:double>>"


def _windows(rows, n, least):
    out = []
    for stream in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == stream)
        for w in range(len(own) // n):
            hits = {}
            for _, _, found in own[w * n : w * n + n]:
                for label, *p in found or []:
                    if label is not None and None not in p:
                        hits.setdefault(label, []).append(p)
            out += [(stream, w, a, len(h), *(round(sum(c) / len(h), 9) for c in zip(*h))) for a, h in hits.items() if len(h) >= least]
    return sorted(out)


@pytest.mark.parametrize("n, least", [(4, 2), (1, 1)])
def test_count_windows_over_batches(spark, tmp_path, n, least):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        found = [(rng.choice(["cup", "box", None]), float(i), rng.choice([1.0, None]), 0.0) for _ in range(rng.randrange(3))]
        rows.append((rng.choice("xy"), i, found if i % 11 else None))
    for part in range(4):
        spark.createDataFrame(rows[part * 15 : part * 15 + 15], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = _run(spark, tmp_path / "in", lambda s: keyed.count_windows(s, n, least), tmp_path, FRAMES)
    got = sorted((*tuple(r)[:4], *(round(v, 9) for v in tuple(r)[4:])) for r in out.collect())
    assert got == _windows(rows, n, least)
