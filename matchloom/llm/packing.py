"""Packing by shortest pack first over the length histogram.

Texts become token ids, each followed by the end id; full sequences are cut off the front, and what is left of each document is one piece.
Only the histogram of piece lengths (at most ``sequence`` bins) comes to the driver. There, lengths are placed longest first: each goes into
the open packing pattern that is shortest, or into new ones, and pattern counts are split as needed. A piece finds its pattern by its rank
among pieces of its length; ranks come from counts of (length, bucket) and from the order in a bucket, so no length is gathered in one task.

Defined results: a null text is empty, and an empty text is the end id alone. Repeated rows are packed each on its own. A null key is kept.
Columns of other names are not read, so they can't clash. Texts on which the quicker tokenizer gives up (such as a million spaces) are left
to the slower one, whose ids are the same.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._util import short, staged

SEQUENCE, END = 2048, 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


@cache
def _tokenizers(tokenizer: str, ranks: str):
    """The tokenizer, a quicker one with the same ids, and the special strings for which only the former will do."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    slow = Tokenizer.from_file(tokenizer)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    return slow, tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), special


def token_ids(text: str, tokenizer: str, ranks: str, end: int = END) -> np.ndarray:
    slow, quick, special = _tokenizers(tokenizer, ranks)
    ids = None if any(s in text for s in special) else np.zeros(0, np.uint32)
    if ids is not None and text:
        try:
            ids = quick.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its pattern backtracks too deep on a long run of white space
            ids = None
    if ids is None:
        ids = np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.append(ids, np.uint32(end)).astype("<u4")


def pack(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths): every piece of the histogram is in one, and no pattern is longer than ``sequence``.

    Longest lengths first. Each goes into the pattern that has the least in it and still takes it; where there are more pieces than such
    patterns, the next shortest follows, and the rest open new patterns. A pattern keeps fewer than ``sequence`` distinct fills open.
    """
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # by what is in them
    done: list[tuple[int, list[int]]] = []

    def put(count: int, lengths: list[int], fill: int) -> None:
        if fill >= sequence:
            done.append((count, lengths))
        else:
            open_.setdefault(fill, []).append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fill = min((f for f in open_ if f + length <= sequence), default=None)
            if fill is None:
                each = max(1, sequence // length)  # new patterns of this length alone
                if left >= each:
                    put(left // each, [length] * each, each * length)
                if left % each:
                    put(1, [length] * (left % each), (left % each) * length)
                left = 0
                continue
            count, lengths = open_[fill].pop()
            if not open_[fill]:
                del open_[fill]
            times = max(1, min((sequence - fill) // length, left // count))  # pieces that each of these packs takes
            used = min(count, left // times)
            if used < count:
                put(count - used, lengths, fill)
            put(used, lengths + [length] * times, fill + times * length)
            left -= used * times
    return done + [p for ps in open_.values() for p in ps]


def _plan(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where each of its slots begins among the ranks, and the slot's first sequence and offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    first = 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((count, first, offset))
            offset += length
        first += count
    out = {}
    for length, slots in rows.items():
        n, sequence, offset = (np.array(c, np.int64) for c in zip(*slots, strict=True))
        out[length] = (np.cumsum(n) - n, sequence, offset)
    return out


_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, salt int"


def pieces(docs: DataFrame, tokenizer: str, ranks: str, text: str = "text", key: str = "doc_id", sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece; the ids themselves stay out, and ``token_ids`` of the text gives them back. ``salt`` numbers the pieces of a task, and so deals equal rows to several buckets."""

    def cut(batches):
        rows = 0
        for b in short(batches):
            doc, start, length, crc, total = [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = token_ids(t or "", tokenizer, ranks, end)
                for a in range(0, len(ids), sequence):
                    part = ids[a : a + sequence]
                    doc.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            salt = pa.array(np.arange(rows, rows + len(doc)) % (1 << 30), pa.int32())
            rows += len(doc)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), salt], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(cut, _PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str, text: str = "text", key: str = "doc_id", sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    table = staged(pieces(docs, tokenizer, ranks, text, key, sequence, end), "pieces")
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}  # at most ``sequence`` rows
    shared = spark.sparkContext.broadcast(_plan(pack(histogram, sequence)))
    # Rank among the pieces of a length, without gathering them: buckets grow with the data, so each holds a bounded share of a hot length.
    buckets = max(1, sum(histogram.values()) // 200_000) * 8
    dealt = table.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "salt"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "bucket").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "bucket", "base")
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "salt")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        sequence_id, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for one in np.unique(n):
            at = np.flatnonzero(n == one)
            first, seq, off = shared.value[int(one)]
            slot = np.searchsorted(first, r[at], side="right") - 1
            sequence_id[at] = seq[slot] + r[at] - first[slot]
            offset[at] = off[slot]
        return pa.StructArray.from_arrays([pa.array(sequence_id), pa.array(offset)], ["sequence_id", "offset"])

    got = ranked.withColumn("at", place("length", "rank"))
    return got.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")
