"""Model calls as injectable vectorised functions, with deterministic stand-ins, and the small models trained here."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.jsonfix import DEFAULT_TARGETS

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """A stand-in for a text model: signed hashed words, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dim] += 1 if h >> 63 else -1
        return out / np.where((n := np.linalg.norm(out, axis=1, keepdims=True)) == 0, 1, n)

    return embed


def embed_with(make: Callable[[], Embedder], prefix: str = "") -> Callable[[Column], Column]:
    """A column function from a factory; the model is made once per task and called batch by batch."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(model([prefix + (t or "") for t in texts]).astype(np.float32)))

    return run


Chat = Callable[[str], str]


def default_chat() -> Chat:
    """A stand-in for a chat model: the default targets."""
    return lambda prompt: json.dumps({"reasoning": "default", "targets": DEFAULT_TARGETS})


def chat_with(df: DataFrame, prompt: str, out: str, make: Callable[[], Chat]) -> DataFrame:
    """Adds a reply per row; a call that fails gives null, for the defaults to step in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chat = make()

        def ask(p: str) -> str | None:
            try:
                return chat(p)
            except Exception:
                return None

        for b in batches:
            yield b.assign(**{out: [ask(p) for p in b[prompt]]})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string")


def project(df: DataFrame, vec: str = "vec", k: int = 2) -> DataFrame:
    """The first principal components: a linear stand-in for a map of the vectors."""
    x = df.withColumn("features", array_to_vector(F.col(vec)))
    return PCA(k=k, inputCol="features", outputCol="p").fit(x).transform(x).withColumn("xy", vector_to_array("p")).drop("features", "p")


def standardise(df: DataFrame, column: str, train: Column) -> DataFrame:
    """By the mean and deviation (at least 1e-6) of the training rows."""
    s = df.where(train).agg(F.avg(column).alias("m"), F.greatest(F.coalesce(F.stddev_samp(column), F.lit(0.0)), F.lit(1e-6)).alias("s"))
    return df.join(F.broadcast(s)).withColumn(f"{column}_z", (F.col(column) - F.col("m")) / F.col("s")).drop("m", "s")


def destandardise(df: DataFrame, column: str, mean: Column, deviation: Column) -> DataFrame:
    """Back from z-scores."""
    return df.withColumn(column, F.col(column) * deviation + mean)


def order_statistics(df: DataFrame, column: str, shares: Sequence[float], accuracy: int = 100_000) -> DataFrame:
    """One row with q0, q1, ...: the column's quantiles, exact and interpolated between the two ranks around each; nulls do not count.

    A sketch of bounded size brackets each quantile; only values inside a bracket (a 4 / accuracy share of all) are
    counted and put in order, and what lies below is a number.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    n = x.count()
    places = [s * max(n - 1, 0) for s in shares]
    around = [min(1.0, max(0.0, e / max(n, 1) + d / accuracy)) for p in places for e, d in ((math.floor(p), -2), (math.floor(p) + 2, 2))]
    ends = x.agg(F.percentile_approx("x", around, accuracy)).first()[0] or [None] * len(around)
    out = []
    for i, place in enumerate(places):
        lo, hi, rank = *ends[2 * i : 2 * i + 2], math.floor(place)
        below = x.agg(F.coalesce(F.count_if(F.col("x") < F.lit(lo)), F.lit(0)).alias("below"))
        values = x.where(F.col("x").between(F.lit(lo), F.lit(hi))).groupBy("x").agg(F.count("*").alias("n"))
        upto = values.withColumn("upto", F.sum("n").over(Window.orderBy("x")))
        at = lambda r: F.min(F.when(F.col("below") + F.col("upto") > r, F.col("x")))  # noqa: B023, E731
        two = upto.join(F.broadcast(below)).agg(at(rank).alias("a"), at(min(rank + 1, max(n - 1, 0))).alias("b"))
        out.append(two.select((F.col("a") + (F.col("b") - F.col("a")) * (place - rank)).alias(f"q{i}")))
    return reduce(lambda a, b: a.join(F.broadcast(b)), out)  # one row each


def padded_range(df: DataFrame, column: str, share: float = 0.995, pad: float = 0.06) -> DataFrame:
    """lo and hi: the quantiles 1 - share and share, moved apart by `pad` times their distance (and a little, should it be none)."""
    q, by = order_statistics(df, column, [1 - share, share]), pad * (F.col("q1") - F.col("q0") + 1e-9)
    return q.select((F.col("q0") - by).alias("lo"), (F.col("q1") + by).alias("hi"))


_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def _longest_first(*groups: tuple[str, str]) -> list[tuple[str, str]]:
    """(endings separated by spaces, replacement) to (ending, replacement)."""
    return sorted(((e, to) for endings, to in groups for e in endings.split()), key=lambda x: -len(x[0]))


_STEP_2 = _longest_first(
    ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer ization", "ize"), ("ational ation ator", "ate"), ("alism aliti alli", "al"),
    ("fulness fulli", "ful"), ("ousli ousness", "ous"), ("iveness iviti", "ive"), ("biliti bli", "ble"), ("ogi", "og"), ("lessli", "less"), ("li", ""),
)
_STEP_3 = _longest_first(("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate iciti ical", "ic"), ("ful ness ative", ""))
_STEP_4 = _longest_first(("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion", ""))


def _after_syllable(w: str, at: int) -> int:
    """The place after the first consonant that follows a vowel, from `at` on."""
    while at < len(w) and w[at] not in _VOWELS:
        at += 1
    while at < len(w) and w[at] in _VOWELS:
        at += 1
    return min(at + 1, len(w))


def _ends_short(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _VOWELS and w[1] not in _VOWELS
    return len(w) > 2 and w[-3] not in _VOWELS and w[-2] in _VOWELS and w[-1] not in _VOWELS + "wxY"


def _step_1(w: str, r1: int) -> str:
    """Step 1b: verb endings."""
    end = next((e for e in ("eedly", "ingly", "edly", "eed", "ing", "ed") if w.endswith(e)), None)
    if end is None:
        return w
    stem = w[: -len(end)]
    if end in ("eed", "eedly"):
        return stem + "ee" if len(stem) >= r1 else w
    if not any(c in _VOWELS for c in stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem.endswith(_DOUBLES):
        return stem[:-1]
    return stem + "e" if len(stem) == r1 and _ends_short(stem) else stem


def stem_word(w: str) -> str:
    return _stem(w)


@lru_cache(maxsize=1 << 16)
def _stem(w: str) -> str:
    """The Snowball stemmer for English (Porter's second, as of Snowball 2.0): regions, steps 0 to 5 and exceptions."""
    if w in _WHOLE or len(w) <= 2:
        return _WHOLE.get(w, w)
    w = w.removeprefix("'")
    # a y at the start or after a vowel is a consonant, written Y
    for i, c in enumerate(w):
        if c == "y" and (i == 0 or w[i - 1] in _VOWELS):
            w = w[:i] + "Y" + w[i + 1 :]
    r1 = next((len(x) for x in ("gener", "commun", "arsen") if w.startswith(x)), None) or _after_syllable(w, 0)
    r2 = _after_syllable(w, r1)
    # 0 and 1a: possessives and plurals
    w = w.removesuffix(next((e for e in ("'s'", "'s", "'") if w.endswith(e)), ""))
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    w = _step_1(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:  # 1c
        w = w[:-1] + "i"
    for region, endings in ((r1, _STEP_2), (r1, _STEP_3), (r2, _STEP_4)):
        end, to = next((x for x in endings if w.endswith(x[0])), ("", ""))
        stem = w[: len(w) - len(end)]
        if not end or len(stem) < region:
            continue
        allowed = {"ogi": stem.endswith("l"), "li": stem.endswith(tuple("cdeghkmnrt")), "ative": len(stem) >= r2, "ion": stem.endswith(("s", "t"))}
        if allowed.get(end, True):
            w = stem + to
    stem = w[:-1]
    if w.endswith("e") and (len(stem) >= r2 or (len(stem) >= r1 and not _ends_short(stem))) or w.endswith("ll") and len(stem) >= r2:
        w = stem
    return w.replace("Y", "y")


def stem_words(words: Column) -> Column:
    """Stems of an array of words."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda ws: [] if ws is None else [_stem(w) for w in ws])

    return run(words)
