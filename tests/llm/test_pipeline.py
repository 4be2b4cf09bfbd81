import os
import random

import pytest
from brute import contamination, near_duplicates, removed

import corpus_pipeline as pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, out = docs.columns, {}
    for name, f in pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        f(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out[name] = (before, docs)
    for name, _ in pipeline.STAGES[:-1]:
        assert out[name][1].columns == columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in out["quality"][1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert all(i in kept for i in good) and sum(i in kept for i in bad) <= 0.25 * len(bad)  # few labels at this size

    before, after = out["near_dup"]
    comp = near_duplicates(list(before.items()), 80)
    assert {r["doc_id"] for r in after.collect()} == {i for i, c in comp.items() if i == c}

    before, after = out["substring_dedup"]
    want = {i: " ".join(x for x, g in zip(w, gone, strict=True) if not g) for i, w, gone in removed(list(before.items()))}
    rows = after.collect()
    assert {r["doc_id"]: " ".join(r["text"].split()) for r in rows} == {i: " ".join(t.split()) for i, t in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    before, after = out["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r[0] for r in contamination(list(before.items()), items) if not r[5]}
    assert {r["doc_id"] for r in after.collect()} == clean

    before, after = out["packing"]
    assert {r["doc_id"] for r in after.collect()} == set(before)
    assert pipeline.run(spark, DATA).count() == after.count()


ODD = "doc_id long, text string, score string, n_lines double, bad_lines string, n_words array<int>, n_hit string, items string, hit_spans int, n_removed string, factors string, uid string, `key` int, row string, part int, kind string, `a col-umn` string, lang string"


def test_odd_columns_rows_and_texts(spark, tmp_path):
    """Columns named as the operators' own pass unchanged; nulls, empty and very long texts, repeated rows and an empty table."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    long = text(190_000)
    texts = [(1, text(80)), (2, None), (3, ""), (4, long), (5, text(40) + "\n" + " ".join(long.split()[500:700])), (None, text(30)), (7, " \n ")]
    texts += [texts[0], texts[0], (8, texts[0][1]), texts[5], (1, text(50))]
    rows = [(i, t, f"s{n}", 0.5, "b", [n], "h", "i", n, "r", "f", "u", n, "w", n, "k", "odd", "en") for n, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, ODD)
    spark.createDataFrame([(1, 1), (9, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[5][1]), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = {r["doc_id"]: r for r in df.collect()}
    kept = {}
    for name, f in pipeline.STAGES[:-1]:
        out = f(spark, df, str(tmp_path))
        assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
        kept[name] = out.collect()
        for r in kept[name]:
            assert any(r[c] == given[r["doc_id"]][c] for c in ("score", "n_lines")) and r["lang"] == "en" and r["bad_lines"] == "b" and r["factors"] == "f"
        assert f(spark, df.limit(0), str(tmp_path)).collect() == []
    assert len(long) > 1 << 20 and {r["doc_id"] for r in kept["near_dup"]} == {None, 1, 2, 3, 4, 5, 7} and len(kept["near_dup"]) == len(texts) - 4
    assert [len(r["text"].split()) for r in kept["substring_dedup"] if r["doc_id"] == 5] == [40]
    assert sorted(r["doc_id"] or 0 for r in kept["decontamination"]) == [1, 1, 1, 1, 2, 3, 4, 5, 7, 8]
    assert all(r["score"] is not None for r in kept["quality"])
    packed = pipeline.packing(spark, df, str(tmp_path))
    assert packed.select("doc_id", "doc_tokens", "start").where("start = 0").count() == len(texts) and pipeline.packing(spark, df.limit(0), "").count() == 0


def test_work_tables_go_with_their_scope(spark):
    import urllib.parse

    from larder.llm.staging import Scope, Stage, send

    owner = Scope()
    with owner.active():
        s, b = Stage(spark, "t"), send(spark, [1])
        s.table(spark.range(3), "x")
    folder = urllib.parse.urlparse(s.root).path
    assert os.path.isdir(folder) and b.value == [1] and Stage(spark, "u") not in owner.stages
    owner.close()
    assert not os.path.isdir(folder) and not owner.broadcasts


def test_guard():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "op1_near_dup" in entry.queries()


@pytest.mark.parametrize("name", ["op1_near_dup", "op2_chat_format", "op4_decontaminate", "op5_substring_dedup", "op8_embedding_dedup"])
def test_sql(spark, name):
    import duckdb

    from larder.llm.queries import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(str(sorted(zip(names, r, strict=True))) for r in result.fetchall())
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(str(sorted(r.asDict().items())) for r in df.collect()) == want


def test_items_without_an_id_contaminate(spark, tmp_path):
    """As the SQL has it, by the operator's query; and the pipeline drops such documents."""
    import duckdb

    from larder.llm.queries import ORACLE_SQL, QUERIES

    item = " ".join(f"q{i}" for i in range(14))
    docs = [(1, f"a b {item} c"), (2, "x y z"), (3, f"{item} named words here"), (4, "named words here"), (5, None)]
    items = [(None, item), (None, "y z"), (7, "named words here"), (8, item), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = QUERIES["op4_decontaminate"](spark, str(tmp_path))
    result = duck.execute(ORACLE_SQL["op4_decontaminate"])
    assert [d[0] for d in result.description] == df.columns
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(result.fetchall()) and [r[2] for r in got] == [14, 2, 17, 3, 0]
    assert [r["doc_id"] for r in pipeline.decontamination(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()] == [5]


def test_near_dup_keeps_a_row_of_each_group(spark):
    """Repeated ids, null ids and two texts under one id: a copy of every text stays, and one only."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    docs = [(1, "a"), (2, "b"), (2, "b"), (3, "a"), (3, "c"), (9, "c"), (None, "d"), (None, "d"), (None, "b"), (None, "e")]
    df = spark.createDataFrame([(i, text[k]) for i, k in docs], "doc_id long, text string").repartition(3)
    got = sorted((r["text"][0], r["doc_id"]) for r in pipeline.near_dup(spark, df, "").collect())
    assert got == [("a", 1), ("b", 2), ("c", 3), ("d", None), ("e", None)]
