"""Substring dedup: level-wise doubling of repeated word windows.

Words are runs of anything but ASCII white space. A document's windows of a short length are reduced to a sample that every longer
window is sure to meet (of each stretch, the windows that hash lowest), and those found under one key alone drop out. What is left
is extended to twice that length, where windows are again grouped by hash, and so on, until no candidate survives or the length asked for is
reached: ``remove_repeats`` ends at its window length, where a window goes if a document with a smaller key holds it too;
``repeated_passages`` goes on until nothing is left. Sampled windows are grouped by 64 bits, where a collision merely keeps a candidate;
extended windows by 128 bits, of two independent hashes.

Defined results: null or empty text has no words. Rows without a key are returned unchanged and are no source for others. Rows that
share a key never remove each other's windows. Exact copies of a text are settled first: all but that of the smallest key lose every
word that a window covers. Hot passages are pre-aggregated before they are shuffled; no group of rows is gathered in one task. Columns of
other names are not read, so they can't clash.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import dropped, short, staged, window_hashes, word_hashes

#: Words of a window, and of the shortest level.
WINDOW, SHORTEST = 13, 7


def levels(length: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the shortest level up to ``length``, each at most twice the one before."""
    out = [length]
    while out[0] > shortest:
        out.insert(0, max((out[0] + 1) // 2, min(shortest, out[0])))
    return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` consecutive values, by doubling."""
    n, have = 1, values
    while 2 * n <= width:
        have = pick(have[:-n], have[n:])
        n *= 2
    return pick(have[: len(values) - width + 1], have[width - n :][: len(values) - width + 1]) if n < width else have


def chosen(short: np.ndarray, width: int) -> np.ndarray:
    """Positions that are lowest among some ``width`` consecutive short windows (all of equal ones): which they are follows from those windows alone."""
    if len(short) < width:
        return np.zeros(0, np.int64)
    low = _sliding(short, width, np.minimum)
    around = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    around[width - 1 : width - 1 + len(low)] = low
    return np.flatnonzero(_sliding(around, width, np.maximum) == short)


def meeting(short: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Starts of the long windows whose chosen positions are among ``places``."""
    only = np.full(len(short), np.uint64(2**64 - 1))
    only[places] = short[places]
    return np.flatnonzero(_sliding(only, width, np.minimum) == _sliding(short, width, np.minimum))


def covered(starts: np.ndarray, n_words: int, length: int) -> np.ndarray:
    """Which words are covered by the windows that start at ``starts``."""
    edge = np.zeros(n_words + 1, np.int32)
    edge[starts] += 1
    edge[starts + length] -= 1
    return edge.cumsum()[:-1] > 0


def _rows(emit: Callable[[dict], tuple[np.ndarray, ...] | None], names: list[str]):
    """A function over batches: what ``emit`` says of each row (hashes, then places), with the row's k and d."""

    def run(batches):
        for b in short(batches):
            parts, row = [], []
            columns = {n: (b.column(n).cast(pa.binary()).to_pylist() if n == "t" else b.column(n)) for n in b.schema.names if n not in ("k", "d")}
            for i in range(b.num_rows):
                got = emit({n: c[i] for n, c in columns.items()})
                if got is not None and len(got[0]):
                    parts.append(got)
                    row.append(np.full(len(got[0]), i))
            if parts:
                at = pa.array(np.concatenate(row))
                made = [np.concatenate(c) for c in zip(*parts, strict=True)]
                hashes = [pa.array(c.view(np.int64)) for c in made[:-1]]
                yield pa.RecordBatch.from_arrays([*hashes, b.column("k").take(at), b.column("d").take(at), pa.array(made[-1].astype(np.int32))], names=[*names, "k", "d", "p"])

    return run


def _seeds(short: int, length: int):
    """(k, d, t) -> one row for each chosen short window: its hash and place. Texts without a window of ``length`` have none."""

    def emit(row):
        own = word_hashes(row["t"])
        if len(own) < length:
            return None
        h = window_hashes(own, short)
        at = chosen(h, length - short + 1)
        return h[at], at

    return _rows(emit, ["h"])


def _extended(short: int, length: int, sampled: bool):
    """(k, d, t, ps: places of repeated short windows) -> the windows of ``length`` that may repeat: those whose chosen short window repeats, or (not sampled) whose first and last short windows do."""

    def emit(row):
        own = word_hashes(row["t"])
        if len(own) < length:
            return None
        places = np.asarray(row["ps"].values)
        if sampled:
            at = meeting(window_hashes(own, short), places, length - short + 1)
        else:
            hit = np.zeros(len(own), bool)
            hit[places] = True
            n = len(own) - length + 1
            at = np.flatnonzero(hit[:n] & hit[length - short :][:n])
        if not len(at):
            return None
        return window_hashes(own, length)[at], window_hashes(word_hashes(row["t"], 1), length)[at], at

    return _rows(emit, ["h", "g"])


_SHORT, _WHOLE = "h long, k long, d long, p int", "h long, g long, k long, d long, p int"


def _repeated(windows: DataFrame) -> DataFrame:
    """Hashes of windows that more than one key holds, with the smallest; pre-aggregated before the shuffle."""
    by = [c for c in ("h", "g") if c in windows.columns]
    return windows.groupBy(*by).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select(*by, "lo")


def _numbered(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(k, d, t): key, what tells rows of one key apart, text. ``d`` is 0 where no key repeats, so that it costs nothing in a shuffle."""
    keys = docs.select(F.col(key).cast("long").alias("k")).where("k is not null")
    repeat = not keys.groupBy("k").count().where("count > 1").isEmpty()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.select("k", (F.xxhash64("t") if repeat else F.lit(0).cast("long")).alias("d"), "t")


def later_copies(rows: DataFrame) -> DataFrame:
    """(k, d) of rows whose very text a smaller key holds, as a table."""
    marked = rows.where("k is not null and t <> ''").select("k", "d", F.unhex(F.md5("t")).alias("m"))
    # A table of its own: both sides of the join are then plain exchanges, whose hot partitions Spark can split.
    copies = staged(marked.groupBy("m").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("m", "lo"), "texts")
    out = staged(marked.join(copies, "m").where("k > lo").select("k", "d").distinct(), "copies")
    dropped(copies)
    return out


def _held(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Rows with the places ``ps`` (a table) of their surviving windows, one for each text of a key."""
    found = rows.join(places.hint("shuffle_hash").withColumnsRenamed({"k": "k3", "d": "d3"}), (F.col("k") == F.col("k3")) & (F.col("d") == F.col("d3")))
    return found.select("k", "d", "t", "ps").dropDuplicates(["k", "d"])


def _survivors(windows: DataFrame, twice: DataFrame, after: str = "true") -> DataFrame:
    """Places of the windows that repeat, by text. The few hashes that repeat are each there once, so a partition of them is the side to hash, and the many windows need no sort."""
    by = [c for c in ("h", "g") if c in windows.columns]
    return windows.join(twice.hint("shuffle_hash"), by).where(after).groupBy("k", "d").agg(F.collect_set("p").alias("ps"))


def repeat_places(rows: DataFrame, later: DataFrame, length: int = WINDOW) -> DataFrame:
    """(k, d, t, starts): a row for each text that holds windows which also start under a smaller key, ``starts`` their places. Later copies (``later``) need none and are left out."""
    skip = later.select(F.col("k").alias("k2"), F.col("d").alias("d2"))
    first = rows.where("k is not null and t <> ''").join(skip, (F.col("k") == F.col("k2")) & (F.col("d") == F.col("d2")), "left_anti")
    steps = levels(length)
    if len(steps) == 1:
        steps = [length, length]
    seeds = staged(first.mapInArrow(_seeds(*steps[:2]), _SHORT), "seeds")
    repeated = staged(_repeated(seeds), "repeated")
    places = staged(_survivors(seeds, repeated), "places")
    dropped(seeds, repeated)
    found = staged(_held(first, places), "candidates")
    dropped(places)
    for i in range(1, len(steps)):  # each level twice as long as the one before
        windows = found.mapInArrow(_extended(steps[i - 1], steps[i], i == 1), _WHOLE)
        twice = staged(_repeated(windows), "windows")
        last = i == len(steps) - 1
        places = staged(_survivors(windows, twice, "k > lo" if last else "true"), "places")
        dropped(twice)
        if last:
            return found.select("k", "d", "t").join(places.withColumnRenamed("ps", "starts"), ["k", "d"])
        longer = staged(_held(found.drop("ps"), places), "candidates")
        dropped(found, places)
        found = longer
    raise AssertionError


def _cut(length: int, all_words: bool):
    """(k, d, t, starts) -> what is left of the text."""

    def run(batches):
        for b in short(batches):
            n, cut, sha = [], [], []
            lists = [None] * b.num_rows if all_words else b.column("starts")
            for t, s in zip(b.column("t").cast(pa.binary()).to_pylist(), lists, strict=True):
                words = t.split()
                drop = None if s is None else covered(np.asarray(s.values), len(words), length)
                n.append(len(words))
                cut.append(0 if drop is None else int(drop.sum()))
                sha.append(sha256(b" ".join(words if drop is None else compress(words, (~drop).tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("d"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(sha, pa.string())], names=["k", "d", "n", "cut", "sha"])

    return run


_CUT = "k long, d long, n long, cut long, sha string"


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept_sha256 (of the kept words joined by a space)."""
    rows = _numbered(docs, text, key)
    later = later_copies(rows)
    changed = repeat_places(rows, later, length).mapInArrow(_cut(length, False), _CUT).select("k", "d", F.col("cut").alias("some"), F.col("sha").alias("left"))
    every = rows.mapInArrow(_cut(length, True), _CUT)
    base = every.join(changed, ["k", "d"], "left").join(later.withColumn("copy", F.lit(True)), ["k", "d"], "left")
    gone = F.coalesce("copy", F.lit(False)) & (F.col("n") >= length)
    return base.select(
        F.col("k").alias(key),
        F.col("n").alias("n_words"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("some", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
    )


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = WINDOW) -> DataFrame:
    """Longest doubled windows that several keys hold: (level length, key, start), each window that is in no repeated window of twice its length. Doubles from ``length`` until no candidate survives."""
    rows = _numbered(docs, text, key).where("k is not null").dropDuplicates(["k", "d"])

    def windows(row):
        own = word_hashes(row["t"])
        return window_hashes(own, length), window_hashes(word_hashes(row["t"], 1), length), np.arange(max(0, len(own) - length + 1))

    def surviving(found: DataFrame) -> DataFrame:
        return staged(found.join(_repeated(found).drop("lo"), ["h", "g"]).select("k", "d", "p"), "level")

    level = surviving(rows.mapInArrow(_rows(windows, ["h", "g"]), _WHOLE))
    out = None
    while True:
        places = level.groupBy("k", "d").agg(F.collect_set("p").alias("ps"))
        twice = surviving(_held(rows, places).mapInArrow(_extended(length, 2 * length, False), _WHOLE))
        inside = twice.select("k", "d", F.explode(F.sequence("p", F.col("p") + length)).alias("p")).distinct()
        own = level.join(inside, ["k", "d", "p"], "left_anti").select(F.lit(length).alias("length"), F.col("k").alias(key), F.col("p").alias("start"))
        out = own if out is None else out.unionByName(own)
        if twice.isEmpty():
            return out.distinct()
        level, length = twice, 2 * length
