"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text. Trees are complete and of a fixed depth, flattened into arrays, and traversed for all rows of a
batch at once in numpy.

Defined results: null and empty texts have all-zero statistics and are scored like any other; if there is no usable label every score is
0.5; if all labels agree every score is close to that label. Where a key or its label repeats, the training rows are the first of the sample
in order of the key's hash, the key, the label and the statistics, so every run trains on the same rows. Rows never interact. Other columns are
kept; one that has the name of the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import cutoff, each, short

#: Bound of the training sample: the labelled rows whose key hashes lowest.
TRAIN_ROWS = 12_000
_SYMBOLS = b"#$%&*!|<>{}[]()=+_@/\\~^"
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 beyond ASCII, 7.. one class a symbol
for _i in range(256):
    _c = bytes([_i])
    _CLASS[_i] = 7 + _SYMBOLS.index(_c) if _c in _SYMBOLS else 6 if _i >= 128 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in b" \t\n\r\v\f" else 5 if _c in b".,;:?" else 0
_CLASSES = 7 + len(_SYMBOLS)
N_FEATURES = _CLASSES + 15


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one text."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        out[_CLASSES] = len(raw)
        return out
    size = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:_CLASSES] = np.bincount(_CLASS, weights=size, minlength=_CLASSES) / len(raw)
    n, lengths = len(words), np.fromiter(map(len, words), np.int32, len(words))
    distinct = set(words)
    lines = [x for x in raw.split(b"\n") if x]
    rest = out[_CLASSES:]
    rest[0], rest[1], rest[2] = len(raw), n, len(lines)
    rest[3], rest[4], rest[5] = lengths.mean(), lengths.std(), lengths.max()
    rest[6] = len(distinct) / n
    rest[7] = len(distinct) / np.sqrt(n)
    rest[8] = 1 - len(set(lines)) / max(1, len(lines))
    rest[9] = n / max(1, len(lines))
    rest[10] = (lengths <= 3).mean()
    rest[11] = (lengths == 1).mean()
    rest[12] = sum(map(bytes.isupper, words)) / n
    rest[13] = raw.count(b". ") / n + raw.count(b".\n") / n
    rest[14] = np.count_nonzero(size) / 256
    return out


@dataclass
class Trees:
    """Flattened complete trees: node i of a tree has the children 2i+1 and 2i+2; ``value`` holds the leaves."""

    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = (1 << self.depth) - 1
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: int = 20) -> Trees:
    """Newton boosting of the log loss on binned features; of equal gains the first feature and bin win."""
    n, m = x.shape if len(x) else (0, N_FEATURES)
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not n:
        return Trees(depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # code <= b iff x <= edges[b]
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    offset = np.arange(m) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            flat = ((node - first)[:, None] * (m * bins) + offset + code).ravel()
            G, H, C = (np.bincount(flat, weights=np.repeat(w, m), minlength=width * m * bins).reshape(width, m, bins).cumsum(2) for w in (g, h, np.ones(n)))
            gt, ht, ct = G[:, :, -1:], H[:, :, -1:], C[:, :, -1:]
            gain = G**2 / (H + l2) + (gt - G) ** 2 / (ht - H + l2) - gt**2 / (ht + l2)
            gain[(C < least) | (ct - C < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + l2)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(depth, np.array(features), np.array(thresholds), np.array(values), base)


_STATS = pa.schema([("h", pa.int64()), ("y", pa.int32()), ("x", pa.list_(pa.float32()))])


def _stats(batches):
    for b in short(batches):
        yield pa.RecordBatch.from_pydict({"h": b.column("h"), "y": b.column("y"), "x": pa.array([statistics(t) for t in b.column("t").to_pylist()], pa.list_(pa.float32()))}, schema=_STATS)


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Trees:
    """Learns from at most ``train_rows`` labelled rows (those whose key hashes lowest); their statistics, not their texts, come to the driver."""
    sample = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    sample = sample.withColumn("h", F.xxhash64("k")).where(F.col("h") <= cutoff(sample.count(), train_rows)).orderBy("h", "k", "y").limit(train_rows)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(sample), "k")
    got = rows.select("h", "y", "t").mapInArrow(_stats, "h long, y int, x array<float>").orderBy("h", "y", "x").limit(train_rows).toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    x = np.array(got["x"].to_pylist(), np.float32).reshape(-1, N_FEATURES)
    return fit_trees(x, np.array(got["y"].to_pylist(), float))


def score_quality(df: DataFrame, trees: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with ``out``: the probability that a row's text is of quality 1."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def score(t: pa.Array) -> pa.Array:
        x = np.array([statistics(s) for s in each(t)], np.float32).reshape(-1, N_FEATURES)
        return pa.array(shared.value.predict(x), pa.float64())

    return df.withColumn(out, score(F.col(text)))
