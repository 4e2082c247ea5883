"""Exact top-k inner products: vectors by descending length, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

Components are quantised to floor(scale * x), so scores are exact integers. The rotation comes from the second moments of all vectors
(a dims x dims matrix, summed by partition); it puts most of each product into the first coordinates.

Candidates are dealt to ranges of descending length, queries to blocks by hash; a cell is one range and one block, both of a bounded number of
components, so no side is broadcast and no table is read once per block. A few of the longest vectors give each query its first k-th score;
a query is dealt only to the ranges whose lengths can reach that score, and ranges that no query reaches are not dealt at all. A cell walks its
candidates by descending length, a strip at a time. For the queries that the strip's lengths can reach, partial sums over the first
coordinates are taken level by level; after each, a pair survives only if its sum plus the product of what is left of both lengths reaches
the query's current k-th score, and rows and columns without a survivor leave the sums. What survives the last level is scored on integers.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows without a key, take no part. Only vectors
of equal dimension have a product. Equal scores go to the smaller vec_id. Components are taken up to 2^200 either way (no float is
larger), and a score beyond the range of a long is the nearest long. Rows that share a vec_id are candidates each on its own, never for
queries of that id; repeated query rows are one query, the first by content. Fewer than k candidates give fewer rows. Columns of
other names are not read, so they can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import staged

K, SCALE = 5, 256
#: Components of the candidates, and of the queries, of one cell; rows of a strip; longest vectors that give first scores.
RANGE, BLOCK, STRIP, HEAD = 1 << 21, 1 << 18, 512, 128
#: Shares of the coordinates after which a bound is taken.
LEVELS = (1 / 8, 1 / 4, 1 / 2, 3 / 4, 1)
_EXACT, _LARGEST, _LONG = float(2**53), float(2**200), 2**63 - 1
#: Room for rounding in a bound, as a share of both lengths.
_SLACK = 1e-9


def _integers(scale: int):
    """(id, v, asked) -> (id, dims, integer components as doubles, length, asked) of usable rows."""

    def run(batches):
        for b in batches:
            keep, rows, norms = [], [], []
            for i, v in enumerate(b.column("v")):
                if not v.is_valid or not len(v) or v.values.null_count:
                    continue
                x = np.asarray(v.values, np.float64)
                if np.isfinite(x).all():
                    x = np.floor(np.clip(x, -_LARGEST, _LARGEST) * scale)
                    x = np.clip(x, -_LARGEST, _LARGEST)
                    keep.append(i)
                    rows.append(x)
                    norms.append(float(np.sqrt(x @ x)))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), pa.array([len(x) for x in rows], pa.int32()), pa.array(rows, pa.list_(pa.float64())), pa.array(norms, pa.float64()), b.column("asked").take(at)], names=["id", "dims", "x", "norm", "asked"]
            )

    return run


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dims)


def _moments(dims: int):
    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            x = _matrix(b.column("x"), dims)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    return run


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products of the components of a and b are exact in floating point."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < _EXACT


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with those of b, pair by pair, held to the range of a long."""
    if _exact(a, b):
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    exact = (sum(int(u) * int(v) for u, v in zip(x, y, strict=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    return np.fromiter((max(-_LONG - 1, min(_LONG, s)) for s in exact), np.int64, len(a))


class Search:
    """The k best candidates of each query so far; of equal scores the smaller id. ``pruned`` counts pairs by what ruled them out: lengths, then each level; its last entry counts the pairs that were scored."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int, least: np.ndarray | None = None) -> None:
        self.ids, self.x, self.rotation, self.k = ids, x, rotation, k
        dims = x.shape[1]
        self.ends = sorted({max(1, round(dims * share)) for share in LEVELS})
        self.turned, self.norm, self.rests = self._turn(x)
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), ascending
        self.last = np.full((2, len(ids)), [[-_LONG - 1], [_LONG]])  # score and id of the k-th found
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.pruned = np.zeros(len(self.ends) + 2, np.int64)

    def _turn(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rotated vectors, their lengths, and the lengths of what is left of them after each level."""
        turned = x @ self.rotation
        squares = turned * turned
        after = [np.sqrt(squares[:, end:].sum(1)) for end in self.ends]
        return turned, np.sqrt(squares.sum(1)), after

    def walk(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes in candidates, given by descending length."""
        for a in range(0, len(ids), STRIP):
            some = x[a : a + STRIP]
            longest = math.sqrt(float((some[0] * some[0]).sum())) * (1 + _SLACK)
            rows = np.flatnonzero(self.norm * longest * (1 + _SLACK) >= self.least)
            self.pruned[0] += (len(self.ids) - len(rows)) * len(some)
            if not len(rows):
                self.pruned[0] += len(self.ids) * (len(ids) - a - len(some))
                return
            self._strip(rows, ids[a : a + STRIP], some)

    def _strip(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        turned, norm, rests = self._turn(x)
        cols = np.arange(len(ids))
        sums = np.zeros((len(rows), len(cols)))
        near, start = None, 0
        for level, end in enumerate(self.ends):
            sums += self.turned[rows, start:end] @ turned[cols, start:end].T
            before = sums.size if near is None else np.count_nonzero(near)
            left = np.stack([self.rests[level][rows], _SLACK * self.norm[rows]], 1) @ np.stack([rests[level][cols], norm[cols]])
            reach = sums + left >= self.least[rows, None]
            near = reach if near is None else near & reach
            self.pruned[1 + level] += before - np.count_nonzero(near)
            r, c = near.any(1), near.any(0)
            if not r.any():
                return
            if not (r.all() and c.all()):
                rows, cols, sums, near = rows[r], cols[c], sums[np.ix_(r, c)], near[np.ix_(r, c)]
            start = end
        before = np.count_nonzero(near)
        near &= ids[None, cols] != self.ids[rows, None]
        if len(cols) > self.k:  # the sums are whole now: k others of this strip rule out what lies clearly below them
            sums[~near] = -np.inf
            kth = np.partition(sums, -self.k, 1)[:, -self.k]
            near &= sums >= (kth - 4 * _SLACK * self.norm[rows] * norm[cols].max())[:, None]
        q, c = np.nonzero(near)
        self.pruned[-2:] += before - len(q), len(q)
        if 16 * len(q) > near.size and _exact(self.x[rows], x[cols]):
            score = (self.x[rows] @ x[cols].T)[q, c].astype(np.int64)
            self._take(rows[q], ids[cols[c]], score)
            return
        for lo in range(0, len(q), 1 << 16):
            qs, cs = rows[q[lo : lo + (1 << 16)]], cols[c[lo : lo + (1 << 16)]]
            self._take(qs, ids[cs], _products(self.x[qs], x[cs]))

    def _take(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Takes in scored pairs."""
        last, of = self.last[:, q]
        good = (score > last) | (score == last) & (ids < of)
        q, ids, score = q[good], ids[good], score[good]
        order = np.lexsort((ids, ~score, q))
        q, ids, score = q[order], ids[order], score[order]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        for lo, hi in zip(first, np.append(first[1:], len(q)), strict=True):
            one = int(q[lo])
            hi = min(hi, lo + self.k)
            best = sorted([*self.found[one], *zip((-score[lo:hi].astype(object)).tolist(), ids[lo:hi].tolist(), strict=True)])[: self.k]
            self.found[one] = best
            if len(best) == self.k:
                self.last[:, one] = -best[-1][0], best[-1][1]
                self.least[one] = max(self.least[one], float(-best[-1][0]))


def _by_length(table: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components of the candidates, by descending length, then id."""
    ids, norm, x = table["id"].to_numpy(), table["norm"].to_numpy(), _matrix(table["x"], dims)
    order = np.lexsort((ids, -norm))
    return ids[order], x[order]


def _first_scores(head: pa.Table, rotation: np.ndarray, dims: int, k: int):
    """Queries with ``least``, a score that k of the longest candidates reach."""
    ids, x = _by_length(head, dims)

    def run(batches):
        for b in batches:
            search = Search(b.column("id").to_numpy(), _matrix(b.column("x"), dims), rotation, k)
            search.walk(ids, x)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("id", "x", "norm")), pa.array(search.least)], names=["id", "x", "norm", "least"])

    return run


def _reach(upto: np.ndarray):
    """The number of ranges that a query can reach: ``upto`` holds the greatest length of each range, descending."""

    @F.arrow_udf("int")
    def ranges(norm: pa.Array, least: pa.Array) -> pa.Array:
        n, least_ = (np.asarray(c, np.float64) for c in (norm, least))
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(least_ > 0, least_ / (n * (1 + 4 * _SLACK)), 0.0)  # a score of 0 or less is reached by any length
        shortest = np.where(np.isnan(shortest), np.inf, shortest)
        return pa.array(np.searchsorted(-upto, -shortest, side="right").astype(np.int32))

    return ranges


def _range_of(edges: np.ndarray):
    """The range of a length among descending ``edges``; equal lengths that fill several ranges are dealt by the hash of their ids."""

    @F.arrow_udf("int")
    def place(norm: pa.Array, h: pa.Array) -> pa.Array:
        n, spread = np.asarray(norm, np.float64), np.asarray(h, np.int64)
        lo, hi = np.searchsorted(-edges, -n, side="left"), np.searchsorted(-edges, -n, side="right")
        return pa.array((lo + spread % (hi - lo + 1)).astype(np.int32))

    return place


_TOP = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _cell(rotation: np.ndarray, dims: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return _TOP.empty_table()
        search = Search(queries["id"].to_numpy(), _matrix(queries["x"], dims), rotation, k, queries["least"].to_numpy())
        search.walk(*_by_length(candidates, dims))
        got = [(int(search.ids[i]), c, -s) for i, own in enumerate(search.found) for s, c in own]
        return pa.Table.from_pydict({n: [r[j] for r in got] for j, n in enumerate(_TOP.names)}, schema=_TOP)

    return run


def _of_dimension(table: DataFrame, dims: int, n: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each cell, among vectors of one dimension."""
    spark = table.sparkSession
    sums = table.select("x").mapInArrow(_moments(dims), "i long, row array<double>")
    total = np.zeros((dims, dims))
    for r in sums.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dims x dims numbers
        total[r["i"], r["j"]] = r["v"]
    rotation = np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()
    # The head never grows with the data.
    head = table.orderBy(F.desc("norm"), "id").limit(HEAD).select("id", "norm", "x").toArrow()
    asked = table.where("asked").groupBy("id").agg(F.min(F.struct("x", "norm")).alias("q")).select("id", "q.x", "q.norm")
    asked = staged(asked.mapInArrow(_first_scores(head, rotation, dims, k), "id long, x array<double>, norm double, least double"), "queries")
    # A range holds about RANGE components, a block about BLOCK: what is collected is one number a range.
    ranges = max(1, math.ceil(n * dims / RANGE))
    quantiles = [1 - i / ranges for i in range(1, ranges)]
    accuracy = min(2**31 - 1, 10 * ranges)
    cut = table.agg(F.max("norm").alias("top"), *([F.percentile_approx("norm", quantiles, accuracy).alias("edges")] if quantiles else [])).first()
    edges = np.array(cut["edges"] if quantiles else [], float)
    upto = np.concatenate([[cut["top"]], edges])
    blocks = max(1, math.ceil(asked.count() * dims / BLOCK))
    asked = staged(asked.withColumn("reach", _reach(upto)("norm", "least")), "reach")
    far = asked.agg(F.max("reach").alias("r")).first()["r"] or 0
    left = asked.where("reach > 0").select("id", "x", "least", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("range"))
    right = table.select("id", "x", "norm", _range_of(edges)("norm", F.pmod(F.xxhash64("id", "x"), F.lit(2**31))).alias("range")).where(F.col("range") < far)
    right = right.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    cells = left.groupBy("range", "block").cogroup(right.groupBy("range", "block"))
    return cells.applyInArrow(_cell(rotation, dims, k), "query_id long, vec_id long, score long")


def _parts(table: DataFrame, k: int) -> Iterator[DataFrame]:
    """One result for each dimension that a query has."""
    for r in table.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("asked").cast("int")).alias("asked")).where("asked = 1").orderBy("dims").collect():
        yield _of_dimension(table.where(F.col("dims") == r["dims"]), r["dims"], r["n"], k)


def top_inner_products(vectors: DataFrame, is_query, vector: str = "embedding", key: str = "vec_id", k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which the column expression ``is_query`` (on column ``key``) holds, its k best other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("id is not null")
    table = staged(rows.mapInArrow(_integers(scale), "id long, dims int, x array<double>, norm double, asked boolean"), "vectors")
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for part in _parts(table, k):
        out = out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
