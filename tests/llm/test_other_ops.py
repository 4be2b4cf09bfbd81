import io
import itertools
import os
import random
import tracemalloc
import zlib

import numpy as np
import pytest
from brute import Page, jump, union_find
from pyspark.sql import functions as F

from larder.llm import chat_format, embedding_dedup, hnsw, packing, quality_crf, sharding, sstable, tokens, warc
from larder.llm.embedding_dedup import _Shard, near_vectors
from larder.llm.kernels import mix
from larder.llm.staging import Stage

DATA = "/root/testdata/sf0.01"
TEXTS = ["", None, "hello world", "a  b \n\n c\t", "<|endoftext|> it's 12,345 é漢字😀", " lead", "trail ", "x" * 5000, "word " * 3000, "dup", "dup"]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


BITS = [
    "'s", "don't", "é", "ab", "A1", "1", " ", "  ", "\n", "\t", "\u2009", "\x1c", "\x85", "\u3000", "\u2028", "\xa0", "!", "_", "...", "×", "漢", "😀", "\r\n", "abc.", "x,", "<|endoftext|>", "<|endoftext", "\u01c5", "ʼn", "“q”",
    "\0", "a\0", "'ll", "longwordofmanyletters" * 2, "-", "''", "'S",
]


@pytest.mark.parametrize("entries", [3, 200, 100_000])
def test_encoder_equals_the_library(encode, entries):
    rng = random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(12))) for _ in range(4000)] + [t or "" for t in TEXTS]
    e = tokens.Encoder(tokens.default_path(), entries=entries)
    for at in range(0, len(texts), 97):
        part = texts[at : at + 97]
        assert [tokens.ids_of(x).tolist() for x in e.encode(part)] == [encode(t) for t in part]


def test_encoder_of_long_texts(encode):
    rng = random.Random(3)
    long = "".join(rng.choice(BITS) + " word" for _ in range(300_000))
    for text in (long, "漢字" * 600_000, " " * 3_000_000, "x" * 50_000 + long):
        e = tokens.Encoder(tokens.default_path())
        assert tokens.ids_of(e.encode([text])[0]).tolist() == encode(text)


def test_encoder_with_specials_as_text():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    e = tokens.Encoder(tokens.default_path(), specials=False)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y"):
        assert tokens.ids_of(e.encode([text])[0]).tolist() == t.encode(text, add_special_tokens=False).ids


def test_encoder_of_another_kind():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["Hello  World", "", "a\nb <|endoftext|> é"]
    assert not e.by_piece and [tokens.ids_of(x).tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing(spark, encode):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (2, "hello world")]
    rng = random.Random(2)
    docs += [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 900)))) for i in range(150)]
    got = packing.pack(spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id long, text string, start int, ids string").repartition(2), pool=16).collect()
    pieces = {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= r["padded_length"] <= 2048
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    have, want = {}, {}
    for (doc, _), rs in pieces.items():
        for r in sorted(rs, key=lambda r: r["start"]):
            have.setdefault(doc, []).extend(tokens.ids_of(r["ids"]).tolist())
    for i, t in docs:
        want.setdefault(i, []).append([*encode(t), 1])
    for i, several in want.items():
        assert sorted(have[i]) == sorted(x for s in several for x in s)
        if len(several) == 1:
            assert have[i] == several[0]
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rs in sequences.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(x["length"] for x in rs[:n]) for n in range(len(rs))]
        total = sum(r["length"] for r in rs)
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bin_slack():
    rng = random.Random(4)
    for _ in range(300):
        pool, items = packing.Slack(), [rng.randrange(1, 40) for _ in range(rng.randrange(1, 8))]
        for x in items:
            pool.add(x, x)
        cap = rng.randrange(1, 90)
        counts = pool.best(cap)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in counts.items()) == max(s for s in sums if s <= cap)
        assert all(n <= items.count(k) for k, n in counts.items())


def test_sstable(spark, encode, tmp_path):
    docs = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)] + [(None, "none"), (-20, "again"), (1 << 62, "far"), (-(1 << 63), "least")]
    root = f"file://{tmp_path}/s"
    manifest = sstable.write_shards(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_tokens int"), root, shards=3)
    got = sorted(sstable.read_shards(spark, manifest).collect(), key=lambda r: r["start"])
    want = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = [*encode(t), 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], tokens.ids_of(r["ids"]).tolist()) == (i, at, len(ids), ids)
        at += len(ids)
    found = set()
    for m in manifest:
        system, place = sstable.filesystem(m["path"])
        with system.open_input_file(place) as f:
            table = sstable.Table(f)
            for i, t in docs:
                x = table.get(i)
                if x is not None:
                    found.add(i)
                    assert x.tolist() in [[*encode(b), 0] for a, b in docs if a == i]
            assert table.get(999_999) is None
    assert found == {i for i, _ in docs}
    asked = spark.createDataFrame([(i,) for i, _ in docs] + [(999_999,), (-(1 << 62),), (-20,)], "doc_id long").repartition(3)
    have = {r["doc_id"]: tokens.ids_of(r["ids"]).tolist() for r in sstable.lookup(spark, manifest, asked).collect()}
    first = {}
    for i, t in want:
        first.setdefault(i, [*encode(t), 0])
    assert have == {i: ids for i, ids in first.items() if i is not None}
    assert sstable.lookup(spark, [], asked).count() == 0
    assert sstable.write_shards(spark.createDataFrame([], "doc_id long, text string"), root) == []


def test_sstable_file():
    sink = io.BytesIO()
    w = sstable.Writer(sink)
    rng = np.random.default_rng(1)
    want = {}
    for i in range(0, 30_000, 3):
        want[i] = rng.integers(0, 50_000 if i % 2 else 90_000, rng.integers(0, 30)).astype("<u4")
        w.add(sstable.key_of(i), want[i])
    w.finish()

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    t = sstable.Table(Source(sink.getvalue()))
    assert t.entries == len(want) and len(t.places) > 3 and [sstable.id_of(k) for k, _ in t] == sorted(want)
    assert all((t.get(i) == want[i]).all() for i in list(want)[::371]) and t.get(1) is None
    assert sum(t.maybe(sstable.key_of(i)) for i in range(1, 30_000, 3)) < 500
    bad = bytearray(sink.getvalue())
    bad[100] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Table(Source(bytes(bad))))
    with pytest.raises(ValueError):
        sstable.Table(Source(b"short"))


def test_sharding(spark):
    docs = [(i, "é" * (i % 50)) for i in range(3000)] + [(None, "x"), (None, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, shard string, slot int").repartition(6)
    got = sharding.shard(df, Stage(spark, "t"), cell=10).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.5 * len(docs) / 24
    for r in got:
        key = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
        h = int(mix(np.array([key], dtype=np.int64).view(np.uint64))[0])
        assert (r["shard"], r["grown_shard"]) == (jump(h, 24), jump(h, 25)) and r["grown_shard"] in (r["shard"], 24)
    pairs = sorted((r["size"], r["text_crc32"]) for r in got)
    assert pairs == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in docs)
    assert sharding.shard(df.limit(0), Stage(spark, "t")).count() == 0


def test_warc(spark, tmp_path):
    page = "<html lang=fr><head><title>T &amp; x</title><style>p{}</style></head><body><!-- no --><script>var a='</p>';</script><p>One&nbsp;two</p><p>Three <b>four</b></p><a href='/l?a=1&amp;b=2'>link</a></body></html>"
    raw = warc.response(7, "http://x/y", page, "2024-01-01T00:00:00Z")
    source, block = warc.parse(raw)
    assert block.endswith(page.encode()) and source["warc-payload-digest"] == warc.digest(page.encode())
    meta, text = (warc.parse(x) for x in warc.derive(raw))
    assert text[1].decode() == "One two\nThree four\nlink"
    assert meta[0]["warc-refers-to"] == text[0]["warc-refers-to"] == source["warc-record-id"] and text[0]["warc-target-uri"] == "http://x/y"
    assert text[0]["warc-source-payload-digest"] == source["warc-payload-digest"] and text[0]["warc-block-digest"] == warc.digest(text[1])
    fields = meta[1].decode().split("\r\n")
    assert {"title: T & x", "language: fr", "outlink: /l?a=1&b=2", f"conversion-record: {text[0]['warc-record-id']}", "source-warc-type: response"} <= set(fields)
    for bad in (b"x", raw[:-3], warc.derive(raw)[0]):
        with pytest.raises(ValueError):
            warc.derive(bad)
    pages = [(1, "u", page, 0), (1, "u", page, 0), (2, None, None, 0), (None, "u", "", 0), (3, "a\r\nb: c", "<p>" * 20_000, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record int").repartition(2)
    manifest = warc.write_derivatives(warc.response_records(df), f"file://{tmp_path}/w")
    got = warc.read_records(spark, manifest).collect()
    assert len(got) == 10 and sum(m["records"] for m in manifest) == 10
    want = sorted(x for p in pages for x in warc.derive(warc.response(*p[:3], "2024-01-01T00:00:00Z")))
    assert sorted(warc.parse(x)[1] for x in want) == sorted(bytes(r["block"]) for r in got)
    assert sum("warc-target-uri" not in r["headers"] for r in got) == 2
    assert warc.write_derivatives(warc.response_records(df.limit(0)), f"file://{tmp_path}/e") == []


def random_page(rng):
    word = lambda: rng.choice(["alpha", "beta &amp; gamma", "x &lt; y", "caf&eacute;", "&#233;t&#xe9;", "&nbsp;", "a  b", "\n", "1 < 2", "naïve"])
    inline = lambda: rng.choice([word, lambda: f"<b>{word()}</b>", lambda: f"<a class=x href='/p?a=1&amp;b={rng.randrange(9)}'>{word()}</a>", lambda: f'<A HREF="http://h/{rng.randrange(9)}">{word()}</A>', lambda: "<!-- <p>hidden</p> -->", lambda: "<script>if (a > b) { '<p>' }</script>", lambda: "<br>"])()
    block = lambda: f"<{(t := rng.choice(['p', 'div', 'li', 'h2', 'section']))} class='c'>{' '.join(inline() for _ in range(rng.randrange(1, 5)))}</{t}>"
    head = "<head><title>T &amp; " + word().replace("<", "&lt;") + "</title><style>p > a {}</style></head>"
    return f"<!DOCTYPE html><html lang={rng.choice(['en', 'fr'])}>{head}<body>{''.join(block() for _ in range(rng.randrange(1, 8)))}<noscript>no <a href=/x>y</a></noscript></body></html>"


def test_warc_text_equals_a_parser():
    rng = random.Random(11)
    for _ in range(400):
        page = random_page(rng)
        want = Page(page)
        assert (warc.to_text(page), warc.title_of(page), warc.language_of(page), warc.links_of(page)) == (want.text, want.title, want.language, want.links), page


@pytest.mark.parametrize("bit", ["<!--", "<script>", "<script", "<title>", "<a ", "<a href=", "<a href='", "<head>", "</script ", "<p", "<", "&#", "<html ", "<!-- x -->", "<script>x</script>", "&#9", "<style></script>"])
def test_warc_is_linear(bit):
    """A megabyte of anything takes about a second, closed at the end or not."""
    import time

    for page in (bit * (1_000_000 // len(bit)), bit * (1_000_000 // len(bit)) + ">", "&#" + "9" * 1_000_000 + ";", "&#" + "0" * 1_000_000 + "65;"):
        began = time.process_time()
        warc.to_text(page), warc.title_of(page), warc.language_of(page), warc.links_of(page)
        assert time.process_time() - began < 4


def test_warc_of_what_is_not_closed():
    assert warc.to_text("a<script>b<p>c<!-- d") == "ab\nc<!-- d"
    assert warc.to_text("a<script>b</script>c<script>d") == "a cd" and warc.to_text("x <b y") == "x <b y"
    assert warc.to_text("&#99999999999999; &#0000065;") == "\ufffd A" and warc.title_of("<title>x") == ""


MESSAGES = "tree string, node long, parent long, role string, text string, score double, rank int"


def test_chat_branches(spark):
    odd = "a\\0 <|turn|> [INST] \\1</s>\n<|end|>\n"
    data = [
        ("t", 1, None, "user", "q", 0.0, 9), ("t", 2, 1, "assistant", odd, 1.0, 9), ("t", 3, 1, "assistant", None, 2.0, 9), ("t", 4, 3, "user", "u2", None, 9), ("t", 5, 2, "user<", "é😀", 1.5, 9), ("t", 6, 99, "assistant", "orphan", 0.0, 9),
        ("c", 1, 2, "user", "loop", 0.0, 9), ("c", 2, 1, "user", "loop", 0.0, 9), (None, 1, None, "assistant", "null tree", 0.0, 9), ("t", 1, None, "user", "q", 0.0, 9),
    ]
    df = spark.createDataFrame(data, MESSAGES)
    out = chat_format.format_reply_trees(df, Stage(spark, "t"), best=None)
    got = out.select("tree", "leaf", "rank", "score", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    have = {(r["tree"], r["leaf"]): (r["rank"], r["score"], [tuple(x) for x in r["turns"]], r["loss"]) for r in got}
    assert have == {
        ("t", 5): (1, 2.5, [("user", "q"), ("assistant", odd), ("user<", "é😀")], odd), ("t", 4): (2, 2.0, [("user", "q"), ("assistant", ""), ("user", "u2")], ""),
        ("t", 6): (3, 0.0, [("assistant", "orphan")], "orphan"), (None, 1): (1, 0.0, [("assistant", "null tree")], "null tree"),
    }
    best = chat_format.format_reply_trees(df, Stage(spark, "t"), best=1).collect()
    assert sorted((r["tree"] or "", r["leaf"]) for r in best) == [("", 1), ("t", 5)]
    for r in out.collect():
        assert all(mark not in r["formatted"].replace("<|turn|>", "").replace("<|says|>", "").replace("<|end|>", "") for mark in ("<", "["))
    assert chat_format.format_reply_trees(df.limit(0), Stage(spark, "t")).count() == 0


def test_chat_very_long_chain(spark):
    n = 100_000
    node = F.col("id")
    df = spark.range(n).select(F.lit("t").alias("tree"), node.alias("node"), F.when(node > 0, node - 1).alias("parent"), F.when(node % 2 == 1, "assistant").otherwise("user").alias("role"), node.cast("string").alias("text"), F.lit(0.5).alias("score"))
    r = chat_format.format_reply_trees(df, Stage(spark, "t")).select("leaf", "score", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()
    assert len(r) == 1 and r[0]["leaf"] == n - 1 and r[0]["score"] == n / 2 and [x["text"] for x in r[0]["turns"]] == [str(i) for i in range(n)]


def test_chat_wide_tree(spark):
    """One message with most of the replies; the best branch of it and of others."""
    data = [("t", 0, None, "user", "root", 0.0, 0)] + [("t", i, 0, "assistant", f"r{i}", float(i % 977), 0) for i in range(1, 5000)] + [(f"u{i}", 1, None, "user", "x", 0.0, 0) for i in range(50)]
    out = chat_format.format_reply_trees(spark.createDataFrame(data, MESSAGES), Stage(spark, "t")).collect()
    assert len(out) == 51 and {r["leaf"]: r["score"] for r in out if r["tree"] == "t"} == {976: 976.0}


def test_chat_long_chain(spark):
    n = 300
    df = spark.createDataFrame([("t", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"text {i}", 0.0, 0) for i in range(n)], MESSAGES)
    r = chat_format.format_reply_trees(df, Stage(spark, "t")).select("*", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()
    assert len(r) == 1 and [x["text"] for x in r[0]["turns"]] == [f"text {i}" for i in range(n)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_quality_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_crf.fit_quality(docs, labels)
    out = quality_crf.score_quality(docs.withColumn("n_lines", F.lit("x")), model)
    both = out.join(labels, "doc_id").where(quality_crf.held_out(F.col("doc_id"))).select("quality", (F.col("score") >= 0.3).cast("int").alias("predicted"))
    rows = both.collect()
    assert np.mean([r[0] == r[1] for r in rows]) >= 0.95 and all(r[1] for r in rows if r[0])


def spoiled(rng, line):
    w = line.split()
    return rng.choice([" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(x + rng.choice(["***", "$$$", "%%%"]) for x in w)])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_lines_are_labelled_one_by_one(spark):
    """Bad lines planted in the middle of good documents are found, and the lines around them are left alone."""
    rng = random.Random(3)
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_crf.fit_quality(docs, labels)
    good = docs.join(labels.where("quality = 1"), "doc_id").where(quality_crf.held_out(F.col("doc_id"))).collect()
    made = {}
    for r in good:
        lines = r["text"].split("\n")
        if len(lines) >= 5 and all(len(x.split()) > 7 for x in lines):
            at = len(lines) // 2
            made[r["doc_id"]] = (at, len(lines), "\n".join([*lines[:at], spoiled(rng, lines[at]), *lines[at + 1 :]]))
    got = quality_crf.score_quality(spark.createDataFrame([(i, t) for i, (*_, t) in made.items()], "doc_id long, text string"), model).collect()
    assert len(made) >= 10
    found = sum(made[r["doc_id"]][0] in r["bad_lines"] for r in got)
    wrong = sum(len(set(r["bad_lines"]) - {made[r["doc_id"]][0]}) for r in got)
    assert found >= 0.9 * len(made) and wrong <= 0.05 * sum(n - 1 for _, n, _ in made.values())
    clean = quality_crf.score_quality(docs.join(labels.where("quality = 1"), "doc_id"), model).agg(F.sum(F.size("bad_lines")), F.sum("n_lines")).first()
    assert clean[0] <= 0.01 * clean[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_neighbouring_lines_tell(spark):
    """A line that says nothing by itself is judged by the lines around it, through their features alone (no transitions)."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    m = quality_crf.fit_quality(docs, labels)
    own, around = np.abs(m.weights[: quality_crf.N_OWN]), np.abs(m.weights[quality_crf.N_OWN : 3 * quality_crf.N_OWN])
    assert around.mean() > 0.1 * own.mean() and around.max() > 0.2 * own.max()  # of the same order
    neutral, clean, junk = "Then there were more of these.", "The cat sat there for a long while and slept.", "BUY!! NOW!! | CHEAP!! | WIN!! | ***"
    texts = [f"{x}\n{neutral}\n{x}" for x in (clean, junk)]
    data, edge = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    x, doc, number, size = quality_crf.line_features(data, edge)
    m.move = np.zeros((2, 2))
    told = m.score(x, doc, size.astype(float), 2)[1][number == 1]
    m.weights[quality_crf.N_OWN : 3 * quality_crf.N_OWN] = 0
    untold = m.score(x, doc, size.astype(float), 2)[1][number == 1]
    assert told[0] - told[1] > 0.05 and abs(untold[0] - untold[1]) < 1e-6


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_score_by_enumeration(spark):
    """Scores of small documents against the sum over all labellings of their lines."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    m = quality_crf.fit_quality(docs, labels)
    some = [r[0] for r in docs.where("length(text) - length(replace(text, '\n', '')) BETWEEN 1 AND 8").select("text").limit(40).collect()] + ["One.", "A!!\n\nB | C\nPlain words are here."]
    got = {r[0]: r[1] for r in quality_crf.score_quality(spark.createDataFrame([(t,) for t in some], "text string"), m).select("text", "score").collect()}
    n = quality_crf.N_OWN
    for text in some:
        data = np.frombuffer(text.encode(), np.uint8)
        x, _, _, size = quality_crf.line_features(data, np.array([0, len(data)]))
        k, total, good = len(x), 0.0, np.zeros(len(x))
        emit = []
        for i in range(k):
            w = m.weights
            s = x[i] @ w[:n] + (x[i - 1] @ w[n : 2 * n] if i else w[-3]) + (x[i + 1] @ w[2 * n : 3 * n] if i + 1 < k else w[-2]) + w[-1]
            emit.append((-s / 2, s / 2))
        for states in itertools.product((0, 1), repeat=k):
            p = np.exp(sum(emit[i][s] for i, s in enumerate(states)) + sum(m.move[a, b] for a, b in itertools.pairwise(states)))
            total += p
            good += p * np.array(states)
        q = quality_crf.SOFT + (1 - 2 * quality_crf.SOFT) * float(good / total @ size / size.sum())
        assert np.isclose(got[text], 1 / (1 + np.exp(-(m.curve[0] + m.curve[1] * np.log(q / (1 - q))))), atol=1e-4), text


def test_gradient_through_marginals():
    rng = np.random.default_rng(4)
    doc = np.repeat(np.arange(6), [3, 1, 4, 2, 5, 3])
    x, size, good = rng.normal(size=(len(doc), quality_crf.N_OWN)).astype(np.float32), rng.integers(1, 50, len(doc)).astype(float), np.array([0, 1, 0, 1, 1, 0])
    f, chains, m = quality_crf.with_neighbours(x, doc), quality_crf.Chains(doc, 6), quality_crf.LineCrf()
    m.weights, m.move, m.curve = rng.normal(size=quality_crf.N_FEATURES) * 0.3, rng.normal(size=(2, 2)), np.array([0.2, 1.3])
    f = f.astype(np.float64)
    m._emit = lambda f: np.stack([-(f @ m.weights) / 2, (f @ m.weights) / 2], axis=1)
    value, gradient = m.likelihood(f, chains, doc, size, good)
    theta = np.concatenate([m.weights, m.move.ravel()])
    for i in [0, 7, 25, 44, 62, *range(len(theta) - 4, len(theta))]:
        sides = []
        for h in (1e-5, -1e-5):
            t = theta.copy()
            t[i] += h
            m.weights, m.move = t[: quality_crf.N_FEATURES], t[quality_crf.N_FEATURES :].reshape(2, 2)
            sides.append(m.likelihood(f, chains, doc, size, good)[0])
        assert np.isclose((sides[0] - sides[1]) / 2e-5, gradient[i], rtol=1e-3, atol=1e-6)


def test_quality_sample_is_bounded(spark):
    """Repeated ids are fitted on once, and no more lines than asked for are gathered."""
    text = "Plain words stand here.\nMore plain words stand there."
    docs = [(1, text)] * 500 + [(i, text if i % 2 else "A!! B!!\nC!! D!!") for i in range(2, 40)] + [(40, "x\n" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, quality int")
    for total in (10, 200_000):
        model = quality_crf.fit_quality(df, labels, sample_total=total)
        assert 0 < model.cut < 1
    out = {r["doc_id"]: r["score"] for r in quality_crf.score_quality(df, model).collect()}
    assert out[1] > 0.5 > out[2] and out[3] > 0.5 and quality_crf.fit_quality(df, labels, sample_total=1).curve[1] == 1


def test_quality_edges(spark):
    docs = [(1, "Plain words here.\nMore plain words."), (2, None), (3, ""), (4, "\n\n"), (5, "AAA!! BBB!!\n" * 3), (6, "one"), (None, "x"), (1, "Plain words here.\nMore plain words.")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (5, 0), (9, 1), (None, 0), (6, None)], "doc_id long, quality int")
    out = quality_crf.score_quality(df, quality_crf.fit_quality(df, labels)).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"]: r["n_lines"] for r in out if r["doc_id"]} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 3, 6: 1}
    assert all(0 <= r["score"] <= 1 for r in quality_crf.score_quality(df, quality_crf.fit_quality(df, labels.limit(0))).collect())
    assert quality_crf.score_quality(df.limit(0), quality_crf.LineCrf()).count() == 0


def test_marginals_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    doc = np.array([0, 0, 0, 2, 3, 3, 3, 3])
    emit, move = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    p, pairs, z = quality_crf.Chains(doc, 5).marginals(emit, move)
    want, logs, expected = np.zeros((8, 2)), 0.0, np.zeros((2, 2))
    for d in np.unique(doc):
        at = np.flatnonzero(doc == d)
        scores = {s: sum(emit[i, y] for i, y in zip(at, s, strict=True)) + sum(move[a, b] for a, b in zip(s, s[1:], strict=False)) for s in itertools.product((0, 1), repeat=len(at))}
        total = np.log(sum(np.exp(v) for v in scores.values()))
        logs += total
        for s, v in scores.items():
            w = np.exp(v - total)
            for i, y in zip(at, s, strict=True):
                want[i, y] += w
            for a, b in zip(s, s[1:], strict=False):
                expected[a, b] += w
    assert np.allclose(p, want) and np.allclose(pairs, expected) and np.isclose(z, logs)


def vectors(seed, n=700, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[:150] = x[0] + 0.1 * rng.normal(size=(150, dim))
    x[150:200] = x[150] + 0.3 * rng.normal(size=(50, dim))
    return x


def test_hnsw_recall():
    x = vectors(1, 3000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    h = hnsw.Hnsw.build(x, mix(np.arange(len(x), dtype=np.uint64)))
    h = hnsw.Hnsw.from_arrays(x, hnsw.unpack(hnsw.pack(h.to_arrays())))
    ids, sims = h.search(x[:300], 64)
    assert np.allclose(sims, np.einsum("ij,ikj->ik", x[:300], x[ids]), atol=1e-5)
    true = np.argsort(-(x[:300] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) > 0.9


@pytest.mark.parametrize("slice_rows", [2048, 50])
def test_near_vectors(spark, slice_rows):
    x = vectors(2)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] + [1.0] * 15), (9005, [float("inf")] * 16), (9006, [1.0] * 5), (9007, [2.0] * 5), (None, rows[0][1]), rows[3], (9008, [1e200] * 16), (9009, [3e200] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, n_links int").repartition(3)
    got = near_vectors(df, Stage(spark, "t"), slice_rows=slice_rows).collect()
    assert len(got) == len(rows) + len(odd)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    edges = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)] + [(9006, 9007), (9008, 9009)]
    comp = union_find(set(range(len(x))) | {i for i, _ in odd if i is not None}, edges)
    degree = {i: int(near[i].sum()) - 1 for i in range(len(x))} | {9006: 1, 9007: 1, 9008: 1, 9009: 1}
    missed = 0
    for r in got:
        if r["vec_id"] is None:
            assert r["n_links"] == 0 and r["kept"] and r["component_id"] is None
            continue
        missed += degree.get(r["vec_id"], 0) - r["n_links"]
        assert r["n_links"] <= degree.get(r["vec_id"], 0) and r["kept"] == (r["component_id"] == r["vec_id"])
        assert r["component_id"] == comp[r["vec_id"]]
    assert missed <= 0.01 * sum(degree.values())
    assert near_vectors(df.limit(0), Stage(spark, "t")).count() == 0


def test_near_vectors_through_graphs(spark):
    """Shards of about 1,000 vectors with a large group of near copies, exact copies, small groups and pairs."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x[1:1000] = x[0] + 1e-2 * rng.normal(size=(999, 32))
    x[1001:1300] = x[1000]
    for k, (lo, hi) in {5: (1300, 1800), 2: (1800, 2400)}.items():
        x[lo:hi] = np.repeat(x[lo:hi:k], k, axis=0) + 0.05 * rng.normal(size=(hi - lo, 32))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = {r["vec_id"]: r for r in near_vectors(df, Stage(spark, "t"), shards=3, report=report).collect()}
    assert report["recall"] >= 0.99 and report["audited"] >= 64 and report["ef"] >= 64
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    comp = union_find(set(range(len(x))), list(zip(*(v.tolist() for v in np.nonzero(np.triu(near, 1))), strict=True)))
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    true = near.sum(axis=1) - 1
    assert (links <= true).all() and np.mean(links[true > 0] / true[true > 0]) >= 0.99
    assert np.mean([got[i]["component_id"] == comp[i] for i in range(len(x))]) >= 0.999


def test_equal_vectors_are_one_node(spark):
    """A group of thousands of copies is one node; ids of several vectors, and copies of theirs, count as they would one by one."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))
    rows = [(i, x[0].tolist()) for i in range(3000)] + [(5000 + i, x[i].tolist()) for i in range(1, 40)] + [(6000, (x[0] + 1e-3).tolist())]
    rows += [(7000, x[0].tolist()), (7000, x[1].tolist()), (7000, (2 * x[0]).tolist()), (7001, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in near_vectors(df, Stage(spark, "t")).collect():
        got.setdefault(r["vec_id"], set()).add((r["n_links"], r["component_id"]))
    assert len(near_vectors(df, Stage(spark, "t")).collect()) == len(rows)
    # copies link with each other, the near one and both vectors of 7000 that point their way
    assert all(got[i] == {(2999 + 1 + 2, 0)} for i in range(3000)) and got[6000] == {(3000 + 2, 0)}
    assert got[7000] == {(2 * 3001 + 2, 0)} and got[5001] == got[7001] == {(2, 0)}


@pytest.mark.parametrize("n", [100, 128, 1000])
def test_every_query_starts_on_the_graph(n):
    rng = np.random.default_rng(n)
    s = _Shard.__new__(_Shard)
    s.ids, s.x = np.arange(n), rng.normal(size=(n, 32))
    s.unit = s.x / np.linalg.norm(s.x, axis=1, keepdims=True)
    s.index = hnsw.Hnsw.build(s.unit, mix(s.ids.astype(np.uint64)))
    asked, search = [], s.index.search
    s.index.search = lambda q, ef: asked.append(len(q)) or search(q, ef)
    a, b, *_ = s.links(s.x, s.unit, s.ids, 0.9, 64, 0.99, 64)
    assert asked[0] == n and a.tolist() == b.tolist() and sorted(a) == list(range(n))


def test_links_of_a_cloud_take_bounded_memory():
    """4,096 different vectors in one cloud: 16.8 million links."""
    rng = np.random.default_rng(11)
    n = 4096
    s = _Shard.__new__(_Shard)
    s.ids, s.weights, s.x = np.arange(n), np.ones(n, dtype=np.int64), rng.normal(size=(1, 64)) + 0.01 * rng.normal(size=(n, 64))
    s.unit = s.x / np.linalg.norm(s.x, axis=1, keepdims=True)
    s.index = hnsw.Hnsw.build(s.unit, mix(s.ids.astype(np.uint64)))
    tracemalloc.start()
    into, audited, _, measured = s.gather(s.x, s.unit, s.ids, 0.9, 64, 0.99, 64, lambda: embedding_dedup._Counts(s.ids, s))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    who, links, x, y = into.result()
    assert peak < 500e6 and audited == 64 and measured == 1
    assert (links == n - 1).all() and len(who) == n and len(x) == n - 1 and set(y) == {0}


class Lossy:
    """An index that finds a large group at once, but other links only in beams of 512; or one whose beams are not filled."""

    def __init__(self, unit, large, unfilled=False):
        self.unit, self.large, self.unfilled = unit, large, unfilled

    def search(self, q, ef):
        sims = q @ self.unit.T
        lost = sims > 0.5
        lost[:, : self.large] = False
        sims[lost & (ef < 512)] = -np.inf if self.unfilled else -1
        ids = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        sims = np.take_along_axis(sims, ids, 1)
        if self.unfilled and ef < 512:
            sims[:, -1] = -np.inf
        return ids, sims


@pytest.mark.parametrize("unfilled", [False, True])
def test_audit_counts_queries_not_links(unfilled):
    """A large group with nearly all links does not hide that those of pairs are lost, and beams that are not filled are not done."""
    rng = np.random.default_rng(8)
    large, pairs = (0, 1024) if unfilled else (900, 600)
    x = rng.normal(size=(large + pairs, 64))
    x[:large] = x[:1] + 1e-3 * rng.normal(size=(large, 64)) if large else x[:0]
    x[large + 1 :: 2] = x[large::2] + 1e-3 * rng.normal(size=(pairs // 2, 64))
    s = _Shard.__new__(_Shard)
    s.ids, s.x, s.unit = np.arange(len(x)), x, x / np.linalg.norm(x, axis=1, keepdims=True)
    s.index = Lossy(s.unit, large, unfilled)
    audit = 0 if unfilled else 64
    a, b, audited, first, measured = s.links(x, s.unit, s.ids, 0.9, 64, 0.99, audit)
    assert len(a) == large * large + 2 * pairs and measured == 1
    assert unfilled or (audited == 64 and first < 0.7)


def test_sparse_links_are_audited(spark, monkeypatch):
    """Tasks whose samples hold no link do not pass unmeasured: the samples grow, and lost links widen all beams."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 64))
    x[1:40:2] = x[0:40:2] + 1e-3 * rng.normal(size=(20, 64))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    asked = []
    run = embedding_dedup.similar_vectors
    monkeypatch.setattr(embedding_dedup, "similar_vectors", lambda *a: asked.append(a[3:]) or run(*a))
    got = near_vectors(df, Stage(spark, "t"), shards=2, audit=4)
    assert sum(r["n_links"] for r in got.collect()) == 40
    assert [a[-1] for a in asked] == sorted({a[-1] for a in asked}) and asked[-1][-1] > 100


def test_chat_without_trained_turns(spark):
    df = spark.createDataFrame([("t", 0, None, "user", "x", 0.0, 0)], MESSAGES)
    r = chat_format.format_reply_trees(df, Stage(spark, "t")).first()
    assert r["formatted"] == "<|turn|>user<|says|>x<|end|>\n" and r["loss_spans"] == []
