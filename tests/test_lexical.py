"""Pruned search against the full sum, the analyser, exact quantiles, numbers of objects."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import lexical, models, retrieval, spatial


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 20, 200]))), i % 3) for i in range(2500)]
    rows += [(9000 + i, rows[0][1], 1) for i in range(12)] + [(9100, "", 0), (9101, None, 0), (None, "w5", 0)]  # ties, nothing
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 30])))) for i in range(25)] + [(50, rows[0][1]), (51, ""), (52, None), (53, "unknown")]
    return spark.createDataFrame(rows, "id long, text string, level int").cache(), spark.createDataFrame(asked, "qid long, text string")


def _full(docs, queries, k, least=0.0):
    """The plain way: every score, with empty documents in the mean length."""
    n = docs.where("id IS NOT NULL").count()
    words = docs.where("id IS NOT NULL").select("id", "level", F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), F.array().cast("array<string>")).alias("w"))
    mean = words.agg(F.avg(F.size("w"))).first()[0]
    tf = words.select("id", "level", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("id", "level", "len", "term").count()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    asked = queries.select("qid", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), 0))).alias("term"))
    part = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("count") * 2.2 / (F.col("count") + 1.2 * (0.25 + 0.75 * F.col("len") / mean))
    scored = asked.join(tf, "term").join(df, "term").groupBy("qid", "id", "level").agg(F.sum(part).alias("score")).where(F.col("score") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("level"), F.desc(F.round("score", 9)), "id"))).where(F.col("rank") <= k)


def _rows(df, level):
    return sorted((r["qid"], r["rank"], r["id"], r[level], round(r["score"], 7)) for r in df.collect())


@pytest.mark.parametrize("k, least, shard_docs", [(1, 0.0, 8192), (10, 0.0, 100), (3, 6.0, 8192)])
def test_search_equals_the_full_sum(spark, corpus, k, least, shard_docs):
    docs, queries = corpus
    flat = docs.withColumn("level", F.lit(0))
    index = lexical.build_index(flat, shard_docs=shard_docs)
    assert _rows(lexical.search(index, queries, k, least=least), "tier") == _rows(_full(flat, queries, k, least), "level")
    tiers = lexical.build_index(docs, shard_docs=shard_docs, tier="level")
    assert _rows(lexical.search(tiers, queries, k, least=least), "tier") == _rows(_full(docs, queries, k, least), "level")


def test_several_blocks_of_queries(spark, corpus, monkeypatch):
    docs, queries = corpus
    index = lexical.build_index(docs)
    whole = _rows(lexical.search(index, queries, 5), "tier")
    many = queries.unionByName(spark.createDataFrame([(99, " ".join(f"w{i}" for i in range(2000)))], queries.schema))  # more terms than a filter lists
    assert [r for r in _rows(lexical.search(index, many, 5), "tier") if r[0] != 99] == whole
    monkeypatch.setattr(lexical, "QUERIES", 7)
    assert _rows(lexical.search(index, queries, 5), "tier") == whole


def test_search_skips_postings(spark, corpus):
    docs, queries = corpus
    opened, postings = lexical.work(lexical.build_index(docs.coalesce(1)), queries, 1).agg(F.sum("opened"), F.sum("postings")).first()
    assert 0 < opened < 0.8 * postings


def test_skipping_is_exact_and_large_on_skewed_lists():
    rng = np.random.default_rng(7)
    n = 20_000
    for trial in range(30):
        lists, full = [], np.zeros(n)
        for df in rng.choice([5, 60, 900, 15_000], 6):
            at = rng.choice(n, df, replace=False)
            impacts = np.sort(np.round(rng.uniform(0.3, 2.2, df), 2))[::-1]
            weight = float(np.log((n - df + 0.5) / (df + 0.5) + 1))
            lists.append(lexical._List(weight, lexical._Postings(at, impacts)))
            np.add.at(full, at, weight * impacts)
        found, score, opened = lexical.best_of(lists, n, 10)
        best = np.lexsort((np.arange(n), -np.round(full, 9)))[:10]
        mine = found[np.lexsort((found, -np.round(score, 9)))[:10]]
        assert (mine == best).all() and np.allclose(np.sort(score)[-10:], np.sort(full)[-10:])
        assert opened <= sum(len(x.at) for x in lists)
    rare = lexical._List(7.0, lexical._Postings(np.arange(40), np.linspace(2.2, 1.0, 40)))
    common = lexical._List(0.3, lexical._Postings(np.arange(n), np.linspace(2.0, 0.5, n)))
    _, _, opened = lexical.best_of([common, rare], n, 10)
    assert opened == 40  # the common term is only looked up


def test_empty_index(spark, corpus):
    docs, queries = corpus
    index = lexical.build_index(docs.limit(0))
    assert lexical.search(index, queries, 3).count() == 0
    assert lexical.search(lexical.build_index(docs), queries.limit(0), 3).count() == 0


def test_english_analyser():
    of_document, of_query = lexical.english("the and of 's".split(), models.stem_word)
    assert of_document("The Crème-brûlée and 2 EGGS of Jalapeño, naïve; x86") == ["creme", "brule", "egg", "jalapeno", "naiv", "x"]
    assert of_query("the nutritional values") == ["the", "nutrit", "valu"]
    assert of_document("straße øl") == ["stra", "e", "l"]


def test_english_default_stop_words(spark):
    of_document, _ = lexical.english()
    assert of_document("what is the matter with your soup") == ["matter", "soup"]


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50, list(range(1000)), [1.0] * 990 + [float(i) for i in range(10)]])
def test_padded_range(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    (lo, hi), p = np.quantile(values, [0.005, 0.995]), None
    p = 0.06 * (hi - lo + 1e-9)
    got = models.padded_range(df, "x").first()
    assert got["lo"] == pytest.approx(lo - p, abs=1e-9) and got["hi"] == pytest.approx(hi + p, abs=1e-9)


def test_quantiles_in_brackets(spark):
    values = np.random.default_rng(1).lognormal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = models.order_statistics(df, "x", [0.1, 0.5, 0.99], accuracy=100).first()
    assert np.allclose(tuple(got), np.quantile(values, [0.1, 0.5, 0.99]))
    assert tuple(models.padded_range(df.where("x < 0"), "x").first()) == (None, None)


def test_numbers_fill_gaps(spark):
    stored = spark.createDataFrame([(f"detected_a_{i}",) for i in (1, 2, 5, 5)] + [("detected_a_03",), ("other",), ("detected_b_0",)], "name string")
    found = spark.createDataFrame([(i, "a") for i in range(6)] + [(9, "b"), (10, "c d")], "i int, label string")
    names = {r["i"]: r["name"] for r in spatial.name_objects(found, stored, "i").collect()}
    assert [names[i] for i in range(6)] == [f"detected_a_{i}" for i in (0, 3, 4, 6, 7, 8)] and names[9] == "detected_b_1" and names[10] == "detected_c_d_0"


def test_full_sum_operator_still_agrees(spark, corpus):
    docs, queries = corpus
    full = docs.where("length(text) > 0 AND id IS NOT NULL")
    a = retrieval.bm25(full, queries.where("qid = 3"))
    b = lexical.search(lexical.build_index(full), queries.where("qid = 3"), 5000)
    assert sorted((r["id"], round(r["score"], 7)) for r in a.collect()) == sorted((r["id"], round(r["score"], 7)) for r in b.collect())
