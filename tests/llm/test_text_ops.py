import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from brute import ALNUM, SPACES, contamination, kept_digest, near_duplicates, removed, union_find
from pyspark.sql import functions as F

from larder.llm import bloom, kernels, near_dup, substring_dedup
from larder.llm.components import components
from larder.llm.decontaminate import decontaminate
from larder.llm.near_dup import _sieve, heads_for, least_shared
from larder.llm.near_dup import near_duplicates as near
from larder.llm.staging import Stage
from larder.llm.substring_dedup import dedup_substrings

DOCS = "doc_id long, text string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def corpus(seed, n=60):
    """Copies, near copies, shared passages, odd white space, short, empty and null texts, repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 64)
    base = words(rng, 150)
    out = []
    for i in range(n):
        kind = i % 10
        w = words(rng, rng.randrange(1, 220))
        if kind in (1, 2):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
        elif kind == 3:
            w = w[:40] + passage + w[40:80]
        elif kind == 4:
            w = [x.upper() for x in base]
        elif kind == 5:
            w = base[:49] if i % 20 == 5 else passage[:50]
        out.append((i * 3 % (2 * n), rng.choice([" ", "\n", "\t ", " \x1c "]).join(w)))
    return out + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "a b c d"), (1006, "é" * 3000 + " x y z q"), (1007, " ".join(base * 3)), out[1], out[3], (None, " ".join(base))]


def test_words_and_grams():
    texts = ["a b  c", None, "", " x\ny\x1cz ", "é ß漢字 q", "end"]
    data, offsets, nulls = kernels.string_views(pa.array(texts))
    w = kernels.Words(data, offsets, 0, len(texts), kernels.SPACE_WORD, False)
    got = [[w.text(j).decode() for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [SPACES.findall(t or "") for t in texts] and nulls.tolist() == [False, True, False, False, False, False]
    low = kernels.Words(data, offsets, 0, len(texts), kernels.ALNUM_WORD, True)
    assert [low.text(j).decode() for j in range(len(low.start))] == [x for t in texts for x in ALNUM.findall((t or "").lower())]
    x = np.random.default_rng(1).integers(0, 1 << 60, 1000).astype(np.uint64)
    for k in (1, 2, 41, 1000, 1001):
        assert kernels.sliding_min(x, k).tolist() == [int(x[i : i + k].min()) for i in range(len(x) - k + 1)]


def test_hashes_do_not_depend_on_place():
    data, offsets, _ = kernels.string_views(pa.array(["xx alpha beta gamma", "alpha beta gamma yy"]))
    w = kernels.Words(data, offsets, 0, 2, kernels.SPACE_WORD, False)
    h, ok = kernels.grams(w, 3)
    assert h[1] == h[4] and ok.tolist() == [True, True, False, False, True, True, False, False]


@pytest.mark.parametrize("seed, tile", [(1, 1024), (2, 3)])
def test_near_duplicates(spark, seed, tile):
    docs = corpus(seed, 90)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], f"{DOCS}, heads string, n int").repartition(5)
    got = near(df, Stage(spark, "t"), percent=80, tile=tile).collect()
    want = near_duplicates([d for d in docs if d[0] is not None], 80)
    assert len(got) == len(docs)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
    assert near(spark.createDataFrame([], DOCS), Stage(spark, "t")).count() == 0


def test_sieve_passes_pairs_by_binomial_tail():
    """A pair at the threshold may share fewer values than five standard errors below, with a chance above 1e-6."""
    for threshold, shared, heads in ((0.85, 39, 8), (0.8, 34, 9)):
        assert heads_for(threshold) == heads and least_shared(64, threshold)[64] == shared
        assert (np.diff(least_shared(64, threshold)) >= 0).all()
        for m in (2, 30):  # few documents of a tile are compared in pairs, many by a matrix product
            for both, passes in ((shared, True), (shared - 1, False)):
                own = [np.r_[0:both, 2000 : 2064 - both], np.r_[0:both, 1000 : 1064 - both]]  # the second's own values fill the union's sketch
                own += [np.r_[0, 10_000 * i : 10_000 * i + 63] for i in range(1, m - 1)]
                batch = pa.RecordBatch.from_arrays([pa.array([1] * m), pa.array([0] * m), pa.array(range(m)), pa.array([200] * m), pa.array([np.sort(x).astype("<u4").tobytes() for x in own]), pa.array(range(m))], names=["tile", "v", "rep", "n", "sketch", "g"])
                got = [r for out in _sieve(64, heads, threshold)(iter([batch])) for r in out.column(1).to_pylist()]
                assert got == ([0, 1] if passes else [])


@pytest.mark.parametrize("seed", [1, 2])
def test_clouds_of_near_copies(spark, seed, monkeypatch):
    """Two large clouds, whose members link with some of their kind only, and others that share much with them: as brute force, with few comparisons."""
    rng = random.Random(seed)
    base, other = words(rng, 120), words(rng, 120)
    docs = []
    for i in range(500):
        w = list(base if i % 3 else other)
        for _ in range(rng.randrange(0, 4) if i % 10 else 9):
            w[rng.randrange(110)] = f"e{rng.randrange(99)}"
        docs.append((i * 7 % 1000, " ".join(w)))
    docs += [(2000 + i, " ".join(base[: 40 + i] + words(rng, 60))) for i in range(20)]
    asked = []
    sieve = near_dup._sieve
    monkeypatch.setattr(near_dup, "_sieve", lambda *a: asked.append(a) or sieve(*a))
    stage = Stage(spark, "t")
    got = near(spark.createDataFrame(docs, DOCS).repartition(4), stage, percent=80, tile=16)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == near_duplicates(docs, 80) and asked


def test_thinning_saves_tiles(spark):
    """A cloud of near copies that are all alike: hardly any of its pairs is left for the tiles."""
    rng = random.Random(4)
    base = words(rng, 200, 9000)
    docs = []
    for i in range(1200):
        w = list(base)
        w[i % 200] = f"x{i}"
        docs.append((i, " ".join(w)))
    df, stage = spark.createDataFrame(docs, DOCS), Stage(spark, "t")
    rows = []
    drop = stage.drop
    stage.drop = lambda name: rows.append(spark.read.parquet(stage.path(name)).count()) if name == "tiles" else drop(name)
    assert {r["component_id"] for r in near(df, stage, percent=85, tile=64).collect()} == {0}
    assert rows[0] <= 16 * len(docs)  # all pairs would take 19 tiles for each of a document's eight entries


def test_near_duplicates_of_a_chain(spark):
    """Neighbours of a chain link, its ends do not; all is one component."""
    rng = random.Random(5)
    w = words(rng, 200)
    docs = []
    for i in range(40):
        docs.append((i, " ".join(w)))
        w[(i * 5) % 200] = f"new{i}"
    got = near(spark.createDataFrame(docs, DOCS), Stage(spark, "t"), percent=85, tile=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == near_duplicates(docs, 85)


@pytest.mark.parametrize("seed, bits, buffer", [(1, 64, 16 << 20), (2, 64, 2000), (3, 3, 16 << 20), (4, 64, 1)])
def test_substrings(spark, seed, bits, buffer, monkeypatch):
    """Against brute force; with hashes that deceive, and with buffers so small that all is left to the blocks."""
    monkeypatch.setattr(substring_dedup, "BUFFER_BYTES", buffer)
    docs = corpus(seed, 70)
    df = spark.createDataFrame([(i, t, "f", 2.0) for i, t in docs], f"{DOCS}, factors string, key double").repartition(4)
    got = dedup_substrings(df, Stage(spark, "t"), hash_bits=bits).collect()
    want = sorted((i is None, i or 0, len(w), sum(g), kept_digest(w, g)) for i, w, g in removed(docs))
    assert want == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], hashlib.sha256(" ".join(SPACES.findall(r["text"] or "")).encode()).hexdigest()) for r in got)
    assert any(r["n_removed"] for r in got) and all(f["words"] >= 50 and f["source"] < r["doc_id"] for r in got for f in r["factors"])
    texts = dict(docs)
    for r in got:  # factors are what they say
        w = SPACES.findall(texts[r["doc_id"]] or "")
        for f in r["factors"]:
            s = SPACES.findall(texts[f["source"]])
            assert w[f["start"] : f["start"] + f["words"]] == s[f["source_start"] : f["source_start"] + f["words"]]
    assert {r["key"] for r in got} == {2.0}
    assert dedup_substrings(spark.createDataFrame([], DOCS), Stage(spark, "t")).count() == 0


def plain_factors(runs, docs):
    """For each run the greedy parse with longest matches in runs of smaller documents: (run, place, windows)."""
    out = []
    for r, run in enumerate(runs):
        at = 0
        while at < len(run):
            best = 0
            for o, other in enumerate(runs):
                for q in range(len(other)) if docs[o] < docs[r] else ():
                    n = 0
                    while at + n < len(run) and q + n < len(other) and run[at + n] == other[q + n]:
                        n += 1
                    best = max(best, n)
            if best:
                out.append((r, at, best))
            at += max(best, 1)
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_greedy_parse_by_suffix_array(seed):
    rng = random.Random(seed)
    runs = [[rng.randrange(1 + seed % 4 * 2) for _ in range(rng.randrange(1, 30))] for _ in range(25)]
    docs = [rng.randrange(8) for _ in runs]
    size = np.array([len(r) for r in runs])
    stop = np.cumsum(size)
    group, run = np.array([x for r in runs for x in r]), np.repeat(np.arange(len(runs)), size)
    length, source = substring_dedup.longest_matches(group, stop[run] - np.arange(len(run)), np.array(docs)[run])
    here = substring_dedup.greedy_factors(length, stop - size, stop)
    assert sorted(zip(run[here].tolist(), (here - (stop - size)[run[here]]).tolist(), length[here].tolist(), strict=True)) == plain_factors(runs, docs)
    for a in here.tolist():
        b, n = source[a], length[a]
        assert docs[run[b]] < docs[run[a]] and (group[a : a + n] == group[b : b + n]).all()


def test_factors_that_continue_each_other_are_joined():
    f = np.array([[1, 0, 5, 9, 100], [1, 5, 3, 9, 105], [1, 2, 2, 9, 102], [1, 20, 4, 9, 120], [1, 0, 5, 8, 100], [2, 0, 5, 9, 100], [1, 0, 5, 9, 100]]).T
    assert sorted(map(tuple, substring_dedup._joined(f).T.tolist())) == [(1, 0, 5, 8, 100), (1, 0, 8, 9, 100), (1, 20, 4, 9, 120), (2, 0, 5, 9, 100)]
    assert substring_dedup._joined(np.zeros((5, 0), np.int64)).shape == (5, 0)


def test_a_passage_in_every_document(spark):
    """Very common anchors: the passage and its surroundings, with very long texts among the documents."""
    rng = random.Random(12)
    passage = words(rng, 120, 5000)
    docs = [(i, " ".join(words(rng, rng.randrange(0, 40), 5000) + passage + words(rng, rng.randrange(0, 40), 5000))) for i in range(400)]
    long = words(rng, 260_000, 5000)
    docs += [(1000, " ".join(long)), (1001, " ".join(long[1000:200_000] + ["x"] + passage[3:90] + long[:500]))]
    df = spark.createDataFrame(docs, DOCS).repartition(6)
    got = {r["doc_id"]: r for r in dedup_substrings(df, Stage(spark, "t")).collect()}
    for i, w, gone in removed(docs):
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(gone)), i
        assert SPACES.findall(got[i]["text"]) == [x for x, g in zip(w, gone, strict=True) if not g]
    assert len(docs[-1][1]) > 1 << 20  # more than a chunk


def test_substrings_keep_line_ends(spark):
    w = [f"q{i}" for i in range(60)]
    docs = [(1, " ".join(w)), (2, "head line\n" + " ".join(w) + "\ntail\nline")]
    got = {r["doc_id"]: r["text"] for r in dedup_substrings(spark.createDataFrame(docs, DOCS), Stage(spark, "t")).collect()}
    assert got == {1: docs[0][1], 2: "head line\ntail\nline"}


@pytest.mark.parametrize("blocks", [1_000_000, 7])
def test_decontaminate(spark, blocks):
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, n, 30))) for i, n in enumerate([30, 12, 10, 9, 4, 2, 1, 45])] + [(90, None), (91, "!!"), (3, " ".join(words(rng, 11, 30))), (None, "w1 w2")]
    docs = []
    for i in range(50):
        w = words(rng, rng.randrange(0, 300), 30 if i % 3 else 500)
        if i % 4 == 0:
            w[5:5] = items[i % 8][1].upper().replace("W", "w").split()
        docs.append((i, rng.choice([" ", ", ", "--", "\n"]).join(w)))
    docs += [(60, None), (61, ""), (62, "?"), docs[0], (None, items[0][1])]
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in docs], f"{DOCS}, items array<int>, extra string").repartition(3)
    got = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_windows=blocks)
    assert "extra" in got.columns
    got = got.select("doc_id", "n_words", "n_hit", F.size("items").alias("k"), F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0, "hit_spans").collect()
    want = contamination(docs, [x for x in items if x[0] is not None])
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r)[:6] for r in got), key=order) == sorted(want, key=order)
    assert all(sum(s["last"] - s["first"] + 1 for s in r["hit_spans"]) == r["n_hit"] for r in got)
    empty = decontaminate(df, spark.createDataFrame([], "item_id long, text string"))
    assert empty.where("n_hit > 0").count() == 0 and empty.count() == len(docs)
    assert decontaminate(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)] + [(2000, 2001 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long"), Stage(spark, "t")).collect()}
    want = union_find({x for e in edges for x in e}, edges)
    assert all(want[n] == got.get(n, n) for n in want)
    assert components(spark.createDataFrame([], "u long, v long"), Stage(spark, "t")).count() == 0


def test_bloom_and_deal(spark):
    keys = [(int(x),) for x in np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 200_000)]
    df = spark.createDataFrame(keys, "k long")
    f = bloom.build(df, "k", len(keys))
    own = np.array([k[0] for k in keys], dtype=np.int64)
    assert f.count > 1 and f.has(own).all() and f.has(own + 1).mean() < 0.05
    assert not bloom.build(df.limit(0), "k", 0).has(own[:3]).any()
    dealt = spark.range(7).withColumn("i", F.col("id").cast("int")).repartitionById(7, "i").select("i", F.spark_partition_id().alias("p"))
    assert all(r["i"] == r["p"] for r in dealt.collect())


def test_very_long_texts(spark):
    """Texts of more than a chunk of a batch, among short ones, in every text operator."""
    import zlib

    from larder.llm import quality_crf, sharding

    rng = random.Random(8)
    long = words(rng, 230_000, 9000)
    near_copy = list(long)
    for i in range(0, len(near_copy), 100):
        near_copy[i] = "edit"
    item = " ".join(long[150_000:150_015])
    docs = [(1, "\n".join(" ".join(long[i : i + 12]) for i in range(0, len(long), 12))), (2, " ".join(near_copy)), (3, "short one"), (4, " ".join(long[:30])), (5, "x" * 2_000_000), (6, "A!! " * 400_000)]
    assert all(len(t) > 1 << 20 for i, t in docs if i not in (3, 4))
    df = spark.createDataFrame(docs, DOCS).coalesce(2)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in near(df, Stage(spark, "t"), percent=85).collect()}
    want = near_duplicates(docs, 85)
    assert {i: c for i, (c, _) in got.items()} == want and want[2] == 1 and got[1][1] == len({tuple(long[i : i + 5]) for i in range(len(long) - 4)})
    hits = decontaminate(df, spark.createDataFrame([(1, item)], "item_id long, text string")).select("doc_id", "n_words", "n_hit").collect()
    assert sorted(map(tuple, hits)) == sorted((i, n, h) for i, n, h, *_ in contamination(docs, [(1, item)])) and dict((r[0], r[2]) for r in hits)[1] >= 15
    lines = {r["doc_id"]: r["n_lines"] for r in quality_crf.score_quality(df, quality_crf.LineCrf()).collect()}
    assert lines == {i: len([x for x in t.split("\n") if x]) for i, t in docs}
    placed = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard(df, Stage(spark, "t")).collect()}
    assert placed == {i: (len(t) + 8, zlib.crc32(t.encode())) for i, t in docs}


def test_recall_at_the_threshold():
    """Of pairs that link at exactly 85 % no more are missed by lists and filter together than two in a million."""
    rng = np.random.default_rng(1)
    union, shared, k, heads = 2000, 1700, 64, heads_for(0.85)
    least = least_shared(k, 0.85)
    missed = n = 0
    for _ in range(20):
        first = rng.hypergeometric(shared, union - shared, k, size=100_000)  # shared ones among the union's k smallest
        missed += int((first < least[k]).sum()) + int((rng.hypergeometric(shared, union - shared, heads, size=100_000) == 0).sum())
        n += 100_000
    assert missed <= 2e-6 * n + 4
