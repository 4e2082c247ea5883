"""N-gram Jaccard join by MinHash banding.

Each document's set of five-word shingles is reduced to a MinHash signature; band and row counts are the cheapest that reach the target
recall at the similarity threshold; documents are shuffled on band hashes, and candidates are verified on their full shingle sets.

Documents with the same shingle set form a class, and one of them stands for it. Representatives that share a band are chained to the
smallest of the band, so a band of n gives n - 1 candidate links, not n squared. A connected candidate group of at most BLOCK documents is
verified as a whole. A larger one is dealt to blocks by the first band (a hot band by hash, too), and only pairs of blocks that
share a band are verified, so documents that a chain of others connects cost nothing. A pair of blocks is one task's group; no pair of
documents becomes a row, and every link between two members that share a band is counted. What is shipped to a pair of blocks is sorted shingle hashes, not texts.

Defined results: words are runs of anything but white space, lower-cased; a text of one to four words is one shingle; a null or empty text
links with nothing. Rows that share a key are one document with the shingles of each of its rows: their sets and signatures are merged by
aggregation, and no row joins their texts. Rows without a key are left out. Columns of other names are not read, so they can't clash.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import dropped, mix, short, staged, window_hashes, word_hashes
from .components import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9995
#: Documents, and shingles, of a block at most on average; a task holds two blocks.
BLOCK, BLOCK_SHINGLES = 256, 400_000


def bands_and_rows(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 160) -> tuple[int, int]:
    """The most selective banding that finds a pair at the threshold with the target recall, within ``most`` hashes: 1 - (1 - s^rows)^bands >= recall."""
    best = None
    for rows in range(1, 33):
        p = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best or (most, 1)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of shingle hashes of a text."""
    own = word_hashes(text.lower().encode("utf-8", "replace"))
    if not len(own):
        return own
    return np.unique(window_hashes(own, size) if len(own) >= size else window_hashes(own, len(own)) ^ np.uint64(len(own)))


@cache
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**32, (n, 1), np.uint32) | np.uint32(1), r.integers(0, 2**32, (n, 1), np.uint32)


def minima(s: np.ndarray, n: int) -> np.ndarray:
    """The minima of ``n`` multiply-add hashes of a set; those of a union of sets are the lower ones of each."""
    a, b = _seeds(n)
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, np.uint32(2**32 - 1))
    for i in range(0, len(x), 1024):  # strips that stay in the cache
        h = a * x[None, i : i + 1024]
        h += b
        np.minimum(low, h.min(1), out=low)
    return low


def band_hashes(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band of the signature."""
    low = low.astype(np.uint64).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = mix(out, low[:, r])
    return out


def _marks(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each shingle; xored over a set they tell it from other sets."""
    return mix(s, s >> np.uint64(7)), mix(s ^ np.uint64(0x5BD1E995), s)


def _signed(bands: int, rows: int):
    """(k, t) -> (k, x, y: marks of the set, size, bands); texts without a word give nothing."""

    def run(batches):
        for b in short(batches):
            marks, sig, size, keep = [], [], [], []
            for i, t in enumerate(b.column("t").to_pylist()):
                s = shingles(t)
                if len(s):
                    keep.append(i)
                    size.append(len(s))
                    marks.append([np.bitwise_xor.reduce(m) for m in _marks(s)])
                    sig.append(band_hashes(minima(s, bands * rows), bands, rows).view(np.int64))
            x, y = (pa.array(np.array([m[j] for m in marks], np.uint64).view(np.int64)) for j in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(keep, pa.int64())), x, y, pa.array(size, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], names=["k", "x", "y", "size", "bands"])

    return run


_SIGNED = "k long, x long, y long, size long, bands array<long>"


def _exploded(batches):
    """(k, t) -> (k, g, x, y): each shingle with its marks."""
    for b in short(batches):
        for i, t in enumerate(b.column("t").to_pylist()):
            s = shingles(t)
            if len(s):
                at = pa.array(np.full(len(s), i))
                yield pa.RecordBatch.from_arrays([b.column("k").take(at), *(pa.array(c.view(np.int64)) for c in (s, *_marks(s)))], names=["k", "g", "x", "y"])


def _lowest(n: int):
    """(k, t) -> (k, low): the minima of each row."""

    def run(batches):
        for b in short(batches):
            low = [minima(shingles(t), n).astype(np.int64) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(low, pa.list_(pa.int64()))], names=["k", "low"])

    return run


def _merged(rows_: DataFrame, grams: DataFrame, bands: int, rows: int) -> DataFrame:
    """Signatures of keys that several rows share. ``grams``: their distinct shingles."""
    least = rows_.mapInArrow(_lowest(bands * rows), "k long, low array<long>").select("k", F.posexplode("low").alias("i", "v")).groupBy("k", "i").agg(F.min("v").alias("v"))
    low = least.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("low"))  # bands * rows numbers a key

    @F.arrow_udf("array<long>")
    def banded(low: pa.Array) -> pa.Array:
        return pa.array([band_hashes(np.asarray(v.values, np.int64), bands, rows).view(np.int64) for v in low], pa.list_(pa.int64()))

    sets = grams.groupBy("k").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count(F.lit(1)).alias("size"))
    return sets.join(low, "k").select("k", "x", "y", "size", banded("low").alias("bands"))


def _packed(batches):
    """(k, ..., t) -> the same with the sorted shingle hashes of the text in place of it."""
    for b in short(batches):
        s = pa.array([shingles(t).tobytes() for t in b.column("t").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names if n != "t"), s], names=[*(n for n in b.schema.names if n != "t"), "s"])


@F.arrow_udf(T.BinaryType())
def _sorted_bytes(g: pa.Array) -> pa.Array:
    return pa.array([np.sort(np.asarray(v.values, np.int64).view(np.uint64)).tobytes() for v in g], pa.binary())


def _block_links(similarity: float):
    """Verifies the documents of one pair of blocks: for each, its links, and the smallest document that it is linked with here, itself included."""

    def run(key, table):
        x, y = int(key[1].as_py()), int(key[2].as_py())
        table = table.sort_by("k")
        keys, block, copies = (table[c].to_numpy() for c in ("k", "block", "copies"))
        sets = [np.frombuffer(b, np.uint64) for b in table["s"].to_pylist()]
        n = len(keys)
        size = np.array([len(s) for s in sets], np.int64)
        every, code, held = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
        # A shingle of one document alone is shared with none.
        common = held > 1
        owner, place = np.repeat(np.arange(n), size), np.cumsum(common) - 1
        mine = common[code]
        code, owner = place[code[mine]], owner[mine]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        shared = np.zeros((n, n), np.float32)
        for a in range(0, int(common.sum()), 2048):  # a dense strip of the shingle axis at a time
            lo, hi = np.searchsorted(code, (a, a + 2048))
            some, row = np.unique(owner[lo:hi], return_inverse=True)
            strip = np.zeros((len(some), 2048), np.float32)
            strip[row, code[lo:hi] - a] = 1
            shared[np.ix_(some, some)] += strip @ strip.T
        union = size[:, None] + size[None, :] - shared
        linked = shared >= similarity * union - 1e-6
        np.fill_diagonal(linked, False)
        linked &= (block[:, None] == x) & (block[None, :] == y) | (block[:, None] == y) & (block[None, :] == x)
        links = linked @ copies
        at = np.flatnonzero(links)
        # Chains of links inside the blocks, reduced to one edge a document.
        root = np.arange(n)
        while True:
            lower = np.minimum(root, np.where(linked, root[None, :], n).min(1, initial=n))
            lower = lower[lower]
            if (lower == root).all():
                break
            root = lower
        return pa.table({"k": keys[at], "links": links[at], "to": keys[root[at]]}, schema=_LINKS)

    return run


_LINKS = pa.schema([("k", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _blocks(groups: DataFrame, classes: DataFrame, standing: DataFrame) -> DataFrame:
    """(k, g, large, block, copies) of the members of the candidate groups: block 0 in a small group; a large one has about as many blocks as its size asks for, by the hash of the first band, and a hot first band has blocks of its own."""
    held = groups.join(classes.select("k", "copies", "size"), "k").join(standing.select("k", F.col("bands")[0].alias("first")), "k")

    def parts(n: str, shingles: str):
        return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES))

    def sizes(*by: str) -> DataFrame:
        return held.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).select(*by, parts("n", "all").alias("parts"))

    dealt = held.join(sizes("g").withColumnRenamed("parts", "blocks"), "g").join(sizes("g", "first"), ["g", "first"]).withColumn("large", F.col("blocks") > 1)
    hot = F.xxhash64("first", F.pmod(F.xxhash64("k"), F.col("parts")))
    block = F.when(~F.col("large"), F.lit(0).cast("long")).when(F.col("parts") > 1, hot).otherwise(F.pmod(F.xxhash64("first"), F.col("blocks")))
    return dealt.select("k", "g", "large", block.alias("block"), "copies")


def _cells(members: DataFrame, standing: DataFrame) -> DataFrame:
    """(g, block, x, y): for each block the pairs of blocks that it is verified in: itself, and in large groups all that share a band with it."""
    own = members.select("g", "block").distinct().select("g", "block", F.col("block").alias("x"), F.col("block").alias("y"))
    bands = staged(standing.select("k", F.explode("bands").alias("h")).join(members.where("large").select("k", "g", "block"), "k").select("g", "h", "block").distinct(), "blocks")
    pairs = bands.withColumnRenamed("block", "x").join(bands.withColumnRenamed("block", "y"), ["g", "h"]).where("x < y").select("g", "x", "y").distinct()
    return own.unionByName(pairs.select("g", F.explode(F.array("x", "y")).alias("block"), "x", "y"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per key: doc_id, class_id (the smallest key it is connected to by links), copy_id (the smallest key with the same shingle set), n_links (keys other than its own whose similarity reaches the threshold)."""
    bands, rows = bands_and_rows(similarity, recall)
    own = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).where("k is not null")
    keys = own.select("k")
    repeated = staged(keys.groupBy("k").count().where("count > 1").select(F.col("k").alias("r")), "repeated")
    some = not repeated.isEmpty()
    single = own.join(repeated, F.col("k") == F.col("r"), "left_anti") if some else own
    signed = single.mapInArrow(_signed(bands, rows), _SIGNED)
    grams = None
    if some:
        several = own.join(repeated, F.col("k") == F.col("r"), "left_semi").distinct()
        grams = staged(several.mapInArrow(_exploded, "k long, g long, x long, y long").distinct(), "shingles")
        signed = signed.unionByName(_merged(several, grams, bands, rows))
    signed = staged(signed, "signatures")
    # Tables of their own: both sides of the joins below are then plain exchanges, whose hot partitions Spark can split.
    copies = staged(signed.groupBy("x", "y", "size").agg(F.min("k").alias("copy_id"), F.count(F.lit(1)).alias("copies")), "copies")
    classes = staged(signed.select("k", "x", "y", "size").join(copies, ["x", "y", "size"]).select("k", "copy_id", "copies", "size"), "classes")
    standing = staged(signed.join(classes.where("k = copy_id").select("k"), "k", "left_semi").select("k", "bands"), "standing")
    dropped(signed, copies)
    dealt = standing.select("k", F.explode("bands").alias("h"))
    least = staged(dealt.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("h", "lo"), "bands")
    chained = staged(dealt.join(least, "h").where("k > lo").select(F.col("k").alias("a"), F.col("lo").alias("b")).distinct(), "chained")
    groups = staged(components(chained, "candidates").withColumnsRenamed({"node": "k", "root": "g"}), "groups")
    dropped(least, chained)
    members = staged(_blocks(groups, classes, standing), "members")
    cells = staged(_cells(members, standing), "cells")
    wanted = members.select(F.col("k").alias("k2"), "g", "block", "copies").hint("shuffle_hash")
    sets = single.join(wanted, F.col("k") == F.col("k2")).select("k", "g", "block", "copies", "t").mapInArrow(_packed, "k long, g long, block long, copies long, s binary")
    if some:
        whole = grams.withColumnRenamed("g", "gram").join(wanted, F.col("k") == F.col("k2")).groupBy("k", "g", "block", "copies").agg(F.collect_list("gram").alias("a"))
        sets = sets.unionByName(whole.select("k", "g", "block", "copies", _sorted_bytes("a").alias("s")))
    sets = staged(sets, "sets")
    found = staged(sets.join(cells, ["g", "block"]).groupBy("g", "x", "y").applyInArrow(_block_links(similarity), "k long, links long, to long"), "links")
    dropped(sets, cells, members, standing, groups)
    rooted = components(found.where("k <> to").select(F.col("k").alias("a"), F.col("to").alias("b")), "classes")
    linked = found.groupBy("k").agg(F.sum("links").alias("links"))
    standing_for = classes.join(rooted.select(F.col("node").alias("copy_id"), "root"), "copy_id", "left").join(linked.withColumnRenamed("k", "copy_id"), "copy_id", "left")
    got = standing_for.select("k", F.coalesce("root", "copy_id").alias("class_id"), "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    every = keys.distinct() if some else keys
    out = every.join(got.withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"), "left")
    return out.select(F.col("k").alias("doc_id"), F.coalesce("class_id", "k").alias("class_id"), F.coalesce("copy_id", "k").alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", **more) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest key; rows without a key stay, and rows that share a key stay or go together."""
    gone = near_duplicates(docs, text, key, **more).where("doc_id <> class_id").select(F.col("doc_id").alias("gone")).hint("shuffle_hash")
    return docs.join(gone, docs[key] == gone["gone"], "left_anti")
