"""The manifest, spelling variants and language profiles against brute force, and their edge cases."""

import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import language, merkle, queries, spelling
from larder.llm.staging import Stage

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(r, lower=False):
    doc_id, text, lang, source, n_chars = r
    text = text if not lower or text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def _steps(levels, pos):
    for nodes in levels[:-1]:
        lo = pos // 8 * 8
        yield "".join(nodes[lo:pos]), "".join(nodes[pos + 1 : lo + 8])
        pos //= 8


def _manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    inner = {k: _levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in names}
    outer = _levels([inner[k][-1][0] for k in names])
    out = []
    for i, k in enumerate(names):
        for pos, (_, _, own, r) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            spoilt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h, proof = _leaf(r, spoilt), ""
            for left, right in [*_steps(inner[k], pos), *_steps(outer, i)]:
                h, proof = _sha(left + h + right), proof + left + right
            out.append((r[0], own, inner[k][-1][0], outer[-1][0], _sha(proof), h, h == outer[-1][0]))
    return sorted(out, key=repr)


def _op11(spark, rows, tmp_path, columns=COLUMNS):
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path)).collect()), key=repr)


def test_manifest_edges(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, f"Text {i} É", rng.choice(["en", "de", None, "", "é", "zz"]), rng.choice(["a", None]), i % 7 or None) for i in range(150)]
    rows += [(3, "other", "en", "a", 1), (3, "other", "en", "a", 1), (3, "Another", "en", "a", 1)]  # ties and repeats
    rows += [(None, None, None, None, None)] * 3 + [(None, "X", "en", "a", 1), (7, None, "de", None, None), (-5, "", "one", "", 0)]
    rows += [(9001, "Long W " * 40_000, "en", "s", 1)]
    assert _op11(spark, rows, tmp_path) == _manifest(rows)


def test_manifest_of_several_tiers(spark, tmp_path):
    rows = [(i * 3 % 10_007, f"T{i}", "en" if i % 3 else ("de" if i % 2 else "fr"), "s", i) for i in range(9_000)] + [(1, "same", "en", "s", 1)] * 200
    assert len([r for r in rows if r[2] == "en"]) > merkle.SPAN
    assert _op11(spark, rows, tmp_path) == _manifest(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s", 1)], [(i, "A", f"l{i:03}", "s", 1) for i in range(70)]])
def test_manifest_of_few(spark, tmp_path, rows):
    assert _op11(spark, rows, tmp_path) == _manifest(rows)


def test_manifest_general(spark):
    df = spark.range(50).selectExpr("id", "id % 3 AS tree", "'x' AS h", "id AS pos", "id AS n", "'y' AS leaf", "1 AS bucket", "2 AS proof", "3 AS name")
    out = merkle.manifest(df, Stage(spark, "t"), ["id", "h"], "tree", "id")
    out = out.withColumn("folds", merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root"))
    assert out.count() == 50 and out.where("NOT folds").count() == 0 and out.where("other_leaf IS NOT NULL").count() == 0
    wrong = out.where(merkle.fold(F.sha2(F.lit("no"), 256), F.col("proof")) == F.col("root"))
    assert wrong.count() == 0


def _distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def test_near_is_distance_one():
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    assert all(spelling.near(a, b) == _distance_one(a, b) for a in words for b in words)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_links_of_subdivided_blocks(spark, block):
    rng = random.Random(2)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(150)}
    words |= {f"prefix{''.join(rng.choice('abc') for _ in range(4))}" for _ in range(60)} | {f"{''.join(rng.choice('abc') for _ in range(4))}suffix" for _ in range(60)}
    words |= {"é" * 6, "é" * 7, "q" * 3000, "q" * 3001, "q" * 1500 + "z" + "q" * 1499}
    got = {tuple(r) for r in spelling.links(spark.createDataFrame([(w,) for w in words], "word string"), Stage(spark, "t"), block).collect()}
    small = [w for w in words if len(w) < 100]
    want = {(a, b) for a in small for b in small if _distance_one(a, b)}
    a, b, c = "q" * 3000, "q" * 3001, "q" * 1500 + "z" + "q" * 1499
    assert got == want | {(a, b), (b, a), (a, c), (c, a), (b, c), (c, b)} - ({(b, c), (c, b)} if not spelling.near(b, c) else set())


def _op12(rows):
    n = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                at = h % len(run)
                n[run[:at] + run[at + 1 :] if h % 199 == 0 and doc_id is not None else run] += 1
                run = ""
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    out, form = {}, {}
    for w, k in words.items():
        close = sorted((-words[x], x) for x in words if _distance_one(w, x))
        ok = close and -close[0][0] >= 5 * k
        form[w] = close[0][1] if ok else None
        out[w] = (form[w], k, len(close), -close[0][0] if ok else None)
    rows = []
    for w, (f, k, near, m) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, f, root, k, near, m))
    return sorted(rows)


def test_spelling(spark, tmp_path):
    rng = random.Random(3)
    base = ["kitchen", "chicken", "École".lower() + "s", "tomatoes", "ÉTÉÉTÉ"]
    rows = []
    for i in range(400):
        rows.append((i if i % 50 else None, " ".join(rng.choice(base).upper() if rng.random() < 0.1 else rng.choice(base) for _ in range(40)) + ", x1y"))
    chain = ["aaaaaaa"] * 200 + ["aaaaaab"] * 40 + ["aaaaabb"] * 8 + ["kichten"] * 5 + ["kitchem"] * 5 + ["ties" * 2 + "x"] * 5 + ["ties" * 2 + "y"] * 25 + ["ties" * 2 + "z"] * 25
    rows += [(1000, " ".join(chain)), (1001, None), (1002, ""), (1003, "word " * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in spelling.op12_spelling(spark, str(tmp_path)).collect())
    assert got == _op12(rows)
    assert ("aaaaabb", "aaaaaab", "aaaaaaa", 8, 1, 40) in got and ("tiestiesx", "tiestiesy", "tiestiesy", 5, 2, 25) in got


def test_spelling_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert spelling.op12_spelling(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle", "op12_spelling"])
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_against_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    columns = ", ".join(sorted(df.columns))
    want = c.execute(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def _letter(c, dimensions):
    return language.letter_vectors(np.array([ord(c)]), dimensions)[0].astype(int)


def _text_vector(text, dimensions=256):
    words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
    s, out = " " + " ".join(words) + " ", np.zeros(dimensions, dtype=int)
    for i in range(len(s) - 2 if words else 0):
        out += np.roll(_letter(s[i], dimensions), 2) * np.roll(_letter(s[i + 1], dimensions), 1) * _letter(s[i + 2], dimensions)
    return out


def test_letters_and_bundles(monkeypatch):
    v = language.letter_vectors(np.arange(97, 123), 4096).astype(int)
    assert set(np.unique(v)) == {-1, 1} and np.abs(v @ v.T - 4096 * np.eye(26)).max() < 5 * 64  # nearly orthogonal
    texts = ["", "a", "The cat, sat!", "Éé ñandú 12 straße", "x" * 50, "東京 都", "one two three four five six seven"]
    for part in (1 << 20, 3, 1):
        monkeypatch.setattr(language, "PART", part)
        for held in (1 << 14, 2):
            got = language.Bundler(256, 3, held).bundle(list(language._counted(texts, language._Letters(), 3)))
            assert all((got[i] == _text_vector(t)).all() for i, t in enumerate(texts)), (part, held)


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat is with the other thing", "en"), ("der hund und die katze sind nicht hier", "de"), ("el perro y los gatos están aquí", "es")] * 20)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !?", "es"), (103, "the thing", None), (104, "der hund ist nicht " * 30_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("cosine", F.lit("x")).withColumn("Score", F.lit("y")).withColumn("others", F.col("doc_id"))


def test_language_edges(spark, mixed):
    model = language.fit(mixed, Stage(spark, "t"))
    got = {r["doc_id"]: r for r in language.predict(mixed, model).collect()}
    assert len(got) == 65 and all(r["lang_pred"] == r["lang"] for i, r in got.items() if i < 60)
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, 104)] == ["und", "und", "und", "en", "de"]
    assert got[100]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values()) and all(r["others"] == i for i, r in got.items())
    apart = {r["doc_id"]: r for r in language.predict(mixed, model, block=1).collect()}
    assert {i: (r["lang_pred"], round(r["score"], 9)) for i, r in apart.items()} == {i: (r["lang_pred"], round(r["score"], 9)) for i, r in got.items()}
    want = sum(_text_vector(t, language.DIMENSIONS) for t in ["der hund und die katze sind nicht hier"] * 20)
    (vector,) = [r["vector"] for r in model.collect() if r["lang"] == "de"]
    assert (np.frombuffer(vector, dtype=np.int64) == want).all()


def test_language_without_rows_or_labels(spark, mixed):
    none = language.fit(mixed.where("lang = 'xx'"), Stage(spark, "t"))
    assert none.count() == 0
    assert {r["lang_pred"] for r in language.predict(mixed, none).collect()} == {"und"}
    assert language.predict(mixed.limit(0), language.fit(mixed, Stage(spark, "t"))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_language_held_out(spark):
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = language.op13_language(spark, DATA).join(truth, "doc_id").where("held_out AND n_chars > 100").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
