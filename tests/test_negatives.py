"""Pairs that are no edges: exactly as many as asked for, all different."""

import random

import pytest

from larder.operators.graph import exact_negative_edges


def _frames(spark, pairs, na, nb):
    nodes = lambda n, p: spark.createDataFrame([(i, f"{p}{i}") for i in range(n)], "i long, id string")
    return spark.createDataFrame([(f"l{a}", f"r{b}") for a, b in pairs], "a string, b string"), nodes(na, "l"), nodes(nb, "r")


@pytest.mark.parametrize("share, n", [(0.0, 10), (0.3, 50), (0.9, 10_000), (0.97, 20), (1.0, 5)])
def test_exactly_n_different_non_edges(spark, share, n):
    rng, na, nb = random.Random(int(100 * share)), 23, 17
    every = [(a, b) for a in range(na) for b in range(nb)]
    pairs = [p for p in every if rng.random() < share] + [(0, b) for b in range(nb)]  # one node has all edges
    free = {(f"l{a}", f"r{b}") for a, b in set(every) - set(pairs)}
    got = [tuple(r) for r in exact_negative_edges(*_frames(spark, pairs + pairs[:3], na, nb), n).collect()]
    assert len(got) == len(set(got)) == min(n, len(free)) and set(got) <= free


def test_spread_and_empty_sides(spark):
    edges, left, right = _frames(spark, [(0, 0)], 40, 50)
    got = exact_negative_edges(edges, left, right, 400).collect()
    assert len({r["a"] for r in got}) == 40 and len({r["b"] for r in got}) > 45
    assert exact_negative_edges(edges, left.limit(0), right, 5).count() == 0 and exact_negative_edges(edges, left, right.limit(0), 5).count() == 0
