"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes one gap; n-grams of 1 to 3 characters are hashed into BUCKETS. Weights are learned
with follow-the-regularised-leader (FTRL-proximal) under elastic-net penalties, on a bounded sample; most weights end at exactly zero, and
n-grams without another weight are not kept. A temperature fitted on a part of the sample that training leaves out calibrates the
probabilities; its loss is smoothed as if one held-out row more were of another language, so that a part without an error has a finite best temperature.

Defined results: null text, or text without a letter, is ``und`` with score 0, as is every text when nothing could be learned (an empty
table, no label). With one language only, every text with a letter has that language with score 1. Where a key repeats, the training rows are
the first of the sample in order of the key's hash, the language and the n-grams, so every run trains on the same rows. Rows never interact.
Other columns are kept; one that has the name of the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._util import cutoff, each, short

BUCKETS = 1 << 14
UND = "und"
#: Bound of the training sample: rows of a language.
ROWS_PER_LANGUAGE = 400


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a text and how often they occur; None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(_letters()[c], c, np.uint32(0))
    gap = c == 0
    if gap.all():
        return None
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # of each run of gaps, the first
    c = c[keep]
    if c[0]:
        c = np.concatenate([np.zeros(1, np.uint32), c])
    if c[-1]:
        c = np.concatenate([c, np.zeros(1, np.uint32)])
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (c[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    n = np.bincount(np.concatenate([one[c > 0] >> np.uint32(18), two >> np.uint32(18), three >> np.uint32(18)]).astype(np.int32), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at.astype(np.int32), n[at].astype(np.int32)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    place: np.ndarray  # of each bucket among those with a weight, or -1
    weights: np.ndarray  # buckets with a weight x languages
    bias: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.sums(at, _weighed(at, n, self.idf))

    def sums(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        row = self.place[at]
        some = row >= 0
        return v[some] @ self.weights[row[some]] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or (x := counts(text)) is None:
            return UND, 0.0
        p = softmax(self.logits(*x) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _weighed(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1.0 + np.log(n)) * idf[at]
    return v / max(np.sqrt(v @ v), 1e-12)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], alpha: float = 3.0, beta: float = 1.0, l1: float = 0.5, l2: float = 1e-3, epochs: int = 6) -> LanguageModel:
    """A model from (language, n-grams, counts). Every fifth row only calibrates the temperature."""
    languages = sorted({y for y, _, _ in rows})
    df = np.zeros(BUCKETS)
    for _, at, _ in rows:
        df[at] += 1
    idf = np.log((len(rows) + 1) / (df + 1)) + 1
    k = len(languages)
    model = LanguageModel(languages, idf, np.full(BUCKETS, -1, np.int32), np.zeros((0, k)), np.zeros(k), 1.0)
    if k < 2:
        return model
    code = {y: i for i, y in enumerate(languages)}
    data = [(code[y], at, _weighed(at, n, idf)) for y, at, n in rows]
    held = [d for i, d in enumerate(data) if i % 5 == 4]
    learn = [d for i, d in enumerate(data) if i % 5 != 4] if held else data
    z, s = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))  # the last row is the bias

    def weights(at) -> np.ndarray:
        zz, ss = z[at], s[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(ss)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(learn)):
            y, at, v = learn[i]
            rows_ = np.append(at, BUCKETS)
            x = np.append(v, 1.0)
            w = weights(rows_)
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            g2 = g * g
            z[rows_] += g - (np.sqrt(s[rows_] + g2) - np.sqrt(s[rows_])) / alpha * w
            s[rows_] += g2
    every = weights(slice(None))
    kept = np.flatnonzero(every[:-1].any(1))
    model.place[kept] = np.arange(len(kept))
    model.weights, model.bias = every[kept], every[-1]
    if held:
        model.temperature = calibrated(np.stack([model.sums(at, v) for _, at, v in held]), np.array([y for y, _, _ in held]))
    return model


def calibrated(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of the least smoothed log loss, by golden section: the loss is convex in 1 / temperature."""
    n, k = scores.shape
    other = 1 / (n + 2)
    target = np.full((n, k), other / (k - 1))
    target[np.arange(n), truth] = 1 - other

    def loss(inverse: float) -> float:
        z = scores * inverse
        z = z - z.max(1, keepdims=True)
        return float(-(target * (z - np.log(np.exp(z).sum(1, keepdims=True)))).sum(1).mean())

    lo, hi, part = 0.0, 1.0, (5**0.5 - 1) / 2
    while hi < 1e6 and loss(2 * hi) < loss(hi):
        hi *= 2
    hi *= 2
    for _ in range(100):
        a, b = hi - part * (hi - lo), lo + part * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return 1 / max((lo + hi) / 2, 1e-6)


def fit_language_id(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Learns from a sample of ``df`` bounded by ``rows_per_language``: the rows of each language whose key hashes lowest. Texts stay on the executors; hashed counts of the sample come to the driver."""
    rows = df.select(F.col(key).alias("k"), F.col(lang).alias("y"), F.col(text).alias("t")).where("k is not null and y is not null")
    top = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}  # one row a language
    if not top:
        return train([])
    first = Window.partitionBy("y").orderBy("h", "k")
    upto = F.create_map(*(F.lit(x) for y, n in top.items() for x in (y, cutoff(n, rows_per_language))))
    keys = rows.where(F.col("y").isin(list(top))).select("k", "y", F.xxhash64("k").alias("h")).where(F.col("h") <= F.element_at(upto, F.col("y")))
    keys = keys.withColumn("r", F.row_number().over(first)).where(F.col("r") <= rows_per_language).select("k", "h").distinct()
    chosen = rows.where(F.col("y").isin(list(top))).join(F.broadcast(keys), "k")

    def count(batches):
        for b in short(batches):
            h, y, t = (b.column(n).to_pylist() for n in ("h", "y", "t"))
            got = [(i, x) for i, s in enumerate(t) if (x := counts(s)) is not None]
            yield pa.RecordBatch.from_pydict({"h": [h[i] for i, _ in got], "y": [y[i] for i, _ in got], "at": pa.array([x[0] for _, x in got], pa.list_(pa.int32())), "n": pa.array([x[1] for _, x in got], pa.list_(pa.int32()))}, schema=_COUNTED)

    found = chosen.select("h", "y", "t").mapInArrow(count, "h long, y string, at array<int>, n array<int>").orderBy("h", "y", "at", "n").limit(rows_per_language * len(top)).toArrow()  # the limit bites only where a key repeats
    sample = sorted(zip(found["h"].to_pylist(), found["y"].to_pylist(), (np.asarray(v.values) for v in found["at"]), (np.asarray(v.values) for v in found["n"]), strict=True), key=lambda r: (r[0], r[1], r[2].tolist(), r[3].tolist()))
    return train([r[1:] for r in sample])


_COUNTED = pa.schema([("h", pa.int64()), ("y", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_id") -> DataFrame:
    """``df`` with ``out``: struct of (lang, score). The model is at most BUCKETS weights a language, whatever the data."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(t: pa.Array) -> pa.Array:
        got = [shared.value.predict(s) for s in each(t)]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

    return df.withColumn(out, predict(F.col(text)))


def held_out(key: str, folds: int, fold: int) -> Column:
    """crc32 of the key as text, modulo ``folds``, is ``fold``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))
