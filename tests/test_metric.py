"""Pruned vector search against brute force."""

import numpy as np
import pytest

from larder.operators import metric
from larder.operators.metric import build_index, metric_topk


def _frame(spark, x, name="id"):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in x], f"{name} long, vec array<double>")


def _brute(items, queries, k, include_self=True, least=None):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    out = []
    for q, v in queries:
        if v is None:
            continue
        scored = sorted((-round(float(unit(v) @ unit(x)), 12) + 0.0, i) for i, x in items if x is not None and i is not None and (include_self or i != q))
        out += [(q, i, r + 1) for r, (s, i) in enumerate(scored[:k]) if least is None or -s >= least - 1e-12]
    return sorted(out)


@pytest.fixture(scope="module")
def items():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, centres[i % 12] + 0.1 * rng.normal(size=16)) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [(2000, np.zeros(16)), (2001, np.zeros(16)), (2002, None), (None, rows[0][1])]  # copies, zeros, nulls
    return rows


@pytest.mark.parametrize("k, include_self, least", [(1, True, None), (1, False, None), (10, True, None), (10, False, None), (5, True, 0.95), (900, True, None)])
def test_equals_brute_force(spark, items, k, include_self, least):
    index = build_index(_frame(spark, items), leaf_rows=32)
    queries = [(i, v) for i, v in items if i is not None and i % 10 == 0] + [(5000, np.random.default_rng(2).normal(size=16)), (5001, np.zeros(16))]
    report = {}
    got = metric_topk(index, _frame(spark, queries, "qid"), k, include_self=include_self, least=least, report=report).collect()
    assert sorted((r["qid"], r["id"], r["rank"]) for r in got) == _brute(items, queries, k, include_self, least)
    assert report["pairs"] >= report["multiplied"] > 0


def test_most_vectors_are_not_multiplied(spark, items):
    index = build_index(_frame(spark, items), leaf_rows=32)
    report = {}
    queries = [(i, v) for i, v in items[:100]]
    metric_topk(index, _frame(spark, queries, "qid"), 1, report=report)
    assert report["multiplied"] < 0.3 * report["pairs"]


def test_leaves_are_bounded_and_read_again(spark, items, tmp_path):
    index = build_index(_frame(spark, items), leaf_rows=32, path=str(tmp_path / "index"))
    assert index.leaves[:, 4].max() < 150 and index.leaves[:, 4].sum() == 852  # copies are split by hash
    assert spark.read.parquet(str(tmp_path / "index" / "leaves")).count() == 852


def test_groups_of_queries(spark, items, monkeypatch):
    index = build_index(_frame(spark, items), leaf_rows=200, centres=3)
    queries = [(i, v) for i, v in items[:120]]
    whole = sorted(map(tuple, metric_topk(index, _frame(spark, queries, "qid"), 3).collect()))
    monkeypatch.setattr(metric, "GROUP", 7)
    assert sorted(map(tuple, metric_topk(index, _frame(spark, queries, "qid"), 3).collect())) == whole
    named = spark.createDataFrame([("a", [float(x) for x in items[0][1]])], "qid string, vec array<double>")
    assert metric_topk(index, named, 1).first()["id"] == 0


def test_empty(spark, items):
    index = build_index(_frame(spark, items).limit(0))
    assert metric_topk(index, _frame(spark, items[:3], "qid"), 2).count() == 0
    assert metric_topk(build_index(_frame(spark, items[:5])), _frame(spark, items[:3], "qid").limit(0), 2).count() == 0
    assert metric_topk(build_index(_frame(spark, [(1, np.zeros(3)), (2, np.zeros(3))])), _frame(spark, [(1, np.ones(3))], "qid"), 3).count() == 2
