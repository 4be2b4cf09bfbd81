"""Mini-batch clusters and the map of neighbourhoods."""

import math

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from larder.operators import clusters, layout, models


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(3)
    centres = 2 * rng.normal(size=(8, 12))
    x = np.concatenate([c + rng.normal(size=(50, 12)) for c in centres])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").cache()


def _inertia(x, centres):
    return clusters._squares(x, centres).min(axis=1).sum()


def test_mini_batches_come_close_to_full_ones(spark, groups):
    x, df = groups
    full = min(KMeans(k=8, seed=s, maxIter=30).fit(df.withColumn("features", array_to_vector("vec"))).summary.trainingCost for s in range(2))
    one = clusters.fit(df, k=8, batch_size=80, max_batches=40)
    assert _inertia(x, one) <= 1.02 * full
    assert (clusters.fit(df, k=8, batch_size=80, max_batches=40) == one).all()  # the same seed, the same centres


def test_assignment(spark, groups):
    x, df = groups
    rows = df.unionByName(spark.createDataFrame([(900, None)], "id long, vec array<double>")).withColumn("cluster", F.lit("mine"))
    centres = clusters.fit(rows, k=3, batch_size=500, n_init=2, max_batches=3)
    got = {r["id"]: r for r in clusters.assign(rows, centres).collect()}
    assert len(got) == 401 and got[900]["cluster"] is None and got[900]["distance"] is None
    d = clusters._squares(x, centres)
    assert all(got[i]["cluster"] == d[i].argmin() and math.isclose(got[i]["distance"], math.sqrt(d[i].min()), abs_tol=1e-6) for i in range(400))


def test_clusters_of_few(spark, groups):
    _, df = groups
    assert clusters.fit(df.limit(0)).shape == (0, 0)
    assert clusters.assign(df.limit(2), clusters.fit(df.limit(0))).where("cluster IS NULL").count() == 2
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, vec array<double>")
    assert (clusters.fit(same, k=3, n_init=2, max_batches=2) == [1.0, 2.0]).all()


def test_curve_and_weights():
    a, b = layout.curve(0.1)
    assert a == pytest.approx(1.577, abs=2e-3) and b == pytest.approx(0.895, abs=2e-3)  # known values of the published method
    d = np.sort(np.random.default_rng(1).uniform(0.1, 2, (20, 14)), axis=1)
    w = layout.smooth(d, 15)
    assert np.allclose(w.sum(axis=1), math.log2(15), atol=1e-3) and (w[:, 0] == 1).all() and (np.diff(w, axis=1) <= 0).all()
    w = layout.smooth(np.array([[0.0, 0.0, np.inf], [0.0, 1.0, 2.0]]), 4)
    assert w[0, 2] == 0 and (w[0, :2] == 1).all() and w[1, 1] == 1


def test_graph_is_a_fuzzy_union(spark, groups):
    _, df = groups
    some = df.where("id % 8 = 0")
    w = {(r["i"], r["j"]): r["w"] for r in layout.fuzzy_graph(some, 6).collect()}
    assert all(math.isclose(w[j, i], x) and 0 < x <= 1 for (i, j), x in w.items()) and all(i != j for i, j in w)
    assert {i for i, _ in w} == {r["id"] for r in some.collect()}


def test_map_keeps_neighbourhoods(spark, groups):
    _, df = groups
    some = df.where("id % 2 = 0")
    places = layout.layout(some, k=12, rounds=5, epochs=15, block_rows=80)  # three blocks
    flat = models.project(some).select("id", F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))
    assert places.count() == 200
    assert layout.preserved(some, places, k=10) > 1.1 * layout.preserved(some, flat, k=10)


def test_map_of_few_and_seeds(spark, groups):
    _, df = groups
    assert layout.layout(df.limit(0)).count() == 0 and layout.layout(df.limit(2)).count() == 2
    some = df.where("id % 20 = 0")
    a, b = (sorted(map(tuple, layout.layout(some, k=5, rounds=2, epochs=5).collect())) for _ in range(2))
    assert a == b and len(a) == 20
