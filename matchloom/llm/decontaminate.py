"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders (a capitalised word at the start of a sentence is read both as a name and as a literal); windows of five template words are hash-joined with those of the benchmark items. On
each alignment of an item with a document, the slots (placeholder values) must be consistent: one value of the item always stands for one
value of the document. An item has leaked into a document if at least 0.8 of its windows are found so, in order;
words may be put in or left out between them. A question whose numbers or names
were changed throughout is caught; one whose slots contradict each other is not.

Defined results: null and empty texts, and items without a word, match nothing. An item of fewer than five words is one
window, which only a document that says nothing else holds. Windows
without a literal word tell nothing and are left out, unless the item has no other. Repeated items are each reported. Rows that share a
key, of documents or of items, are matched each on its own text, and a key's best match is reported. Rows without a key match nothing, and
columns of other names are not read. Template windows of a benchmark within PRIME_WINDOWS are shared with all tasks (a checked bound); a
larger benchmark is joined by a shuffle, with the same result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import hash_spans, short, staged, window_hashes

WORDS, SIMILARITY = 5, 0.8
#: Most benchmark windows that are broadcast: 48 bytes each.
PRIME_WINDOWS = 500_000

#: Unit words.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "% percent dollar dollars euro euros cent cents usd eur gbp mph kmh hz khz mhz ghz w kw v a c f k degree degrees".split()
)
#: Words that open sentences and name nobody: capitals say nothing there.
OPENERS = frozenset(
    "a an the this that these those it its he she they we you i his her their our your my who what which whose whom when where why how if in on at of for from to by with and or but so as then there here "
    "is are was were do does did has have had can could should would not no yes after before while since let find give each every all some "
    "der die das ein eine einer er sie es wir ihr ich wer was welche welcher welches wann wo warum wie wenn und oder aber in im am an auf mit von zu für ist sind hat haben nach vor "
    "le la les un une des il elle ils elles on nous vous je ce cette ces qui que quel quelle quand où pourquoi comment si et ou mais dans en de du pour avec est sont "
    "el los las una unos unas él ella ellos qué quién cuál cuándo dónde cómo cuánto cuántos cuántas y o pero con por para es son se su".split()
)
_NUMBER = re.compile(r"[-+]?[$€£]?[0-9][0-9.,:/]*%?")
_PARTS = re.compile(r"([-+]?[$€£]?[0-9][0-9.,:/]*)([^\W\d]+|%)")

LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: What a placeholder hashes as.
_PLACEHOLDER = np.array([0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\v\f")] = True
_EDGE = _SPACE.copy()
_EDGE[list(b".,;:!?\"'`()[]{}<>*#&")] = True
_END = np.zeros(256, bool)
_END[list(b".!?")] = True
_WIDTH = np.array([1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.int64)
_QUOTES = str.maketrans("«»“”„‘’", "\"\"\"\"\"''")
_QUOTE = re.compile("[«»“”„‘’]")


@cache
def _uneven() -> tuple[re.Pattern, dict[int, str]]:
    """Letters that lower case makes longer or shorter: they stay as they are."""
    odd = [chr(i) for i in range(128, 0x110000) if not 0xD800 <= i < 0xE000 and len(chr(i).lower().encode()) != len(chr(i).encode())]
    return re.compile(f"[{''.join(odd)}]"), dict.fromkeys(map(ord, odd), "_")


def template(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, kind and value hash of each word, and whether it may be a name though it is taken for a literal (a run of anything but ASCII white space, without the punctuation at its ends, in lower case).

    A number is made of digits, with a currency sign, a percent sign or a unit; a unit is a unit word after a number; a name is a
    capitalised word, not all in capitals, that starts no sentence; one that starts a sentence, and is not among ``OPENERS``, may be a name. All words of the text are judged at once, on its bytes.
    """
    if not text.isascii():
        text = text.translate(_QUOTES) if _QUOTE.search(text) else text
        odd, stay = _uneven()
        text = text.translate(stay) if odd.search(text) else text
    raw, low = text.encode("utf-8", "replace"), text.lower().encode("utf-8", "replace")
    b, c = np.frombuffer(raw, np.uint8), np.frombuffer(low, np.uint8)
    inside = np.zeros(len(c) + 2, np.int8)
    inside[1:-1] = ~_SPACE[c]
    change = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = change[::2], change[1::2]
    n = len(first)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, bool)
    core = np.flatnonzero(~_EDGE[c])  # what is neither space nor punctuation
    bare = np.searchsorted(core, first), np.searchsorted(core, last)
    some = bare[1] > bare[0]
    if len(core):
        a = np.where(some, core[np.minimum(bare[0], len(core) - 1)], first)
        z = np.where(some, core[np.maximum(bare[1] - 1, 0)] + 1, last)
    else:
        a, z = first, last
    value = hash_spans(low, 0, c, a, z)
    kind = np.zeros(n, np.int8)
    maybe = np.zeros(n, bool)
    starts = np.ones(n, bool)
    starts[1:] = _END[c[last[:-1] - 1]]
    changed = b != c
    if changed.any():
        upper = np.concatenate([[0], np.cumsum(changed)])
        letter = np.concatenate([[0], np.cumsum(((b >= 97) & (b <= 122)) | (b >= 0xC0))])  # small ASCII letters, and letters beyond ASCII
        beyond = np.concatenate([[0], np.cumsum(changed & (b >= 0x80))])
        rest = np.minimum(a + _WIDTH[b[a]], z)
        name = (upper[rest] > upper[a]) & (letter[z] - letter[rest] > beyond[z] - beyond[rest])
        kind[name & ~starts] = NAME
        first_names = np.flatnonzero(name & starts)
        openers = _openers()
        maybe[first_names] = [v not in openers for v in value[first_names].tolist()]
    digit = (c >= 48) & (c <= 57)
    if digit.any():
        held = np.unique(np.searchsorted(first, np.flatnonzero(digit), side="right") - 1)
        for i in held.tolist():
            word = low[a[i] : z[i]].decode("utf-8", "replace")
            if _NUMBER.fullmatch(word) or (m := _PARTS.fullmatch(word)) and m[2] in UNITS:
                kind[i] = NUMBER
        for i in (np.flatnonzero(kind[:-1] == NUMBER) + 1).tolist():
            if kind[i] != NUMBER and low[a[i] : z[i]].decode("utf-8", "replace") in UNITS:
                kind[i] = UNIT
    return np.where(kind == LITERAL, value, _PLACEHOLDER[kind]), kind, value, maybe & (kind == LITERAL)


@cache
def _readings() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each set of words (as bits) the non-empty subsets: place of the first, their number, all of them."""
    subsets = [[m for m in range(1, c + 1) if c & m == m] for c in range(1 << WORDS)]
    count = np.array([len(x) for x in subsets])
    return np.cumsum(count) - count, count, np.array([m for x in subsets for m in x])


@cache
def _openers() -> frozenset[int]:
    """Value hashes of the openers."""
    words = [w.encode() for w in OPENERS]
    return frozenset(int(hash_spans(w, 0, np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in words)


def windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window hashes, their places and readings, and kind and value of each word. Windows without a literal are left out if others are there.

    A reading is a bit for each word of the window that may be a name and is read as one; reading 0, in which such words are literals, is
    there for each place, the others where they leave a literal.
    """
    t, kind, value, maybe = template(text)
    size = min(WORDS, len(t))
    if not size:
        return t, np.zeros(0, np.int64), np.zeros(0, np.int8), kind, value
    short = np.uint64(size if size < WORDS else 0)
    h = window_hashes(t, size) ^ short
    literal = kind == LITERAL
    literals = np.concatenate([[0], np.cumsum(literal)])
    at = np.flatnonzero(literals[size:] - literals[:-size] > 0) if size == WORDS else np.zeros(1, np.int64)
    at = at if len(at) else np.arange(len(h))
    out = [(h[at], at, np.zeros(len(at), np.int8))]
    if maybe.any():
        bits = 1 << np.arange(size)
        code, held = (sum(x[i : i + len(h)].astype(np.int8) << i for i in range(size))[at] for x in (maybe, literal))
        some = np.flatnonzero(code)
        first, count, masks = _readings()
        n = count[code[some]]
        which = np.repeat(some, n)
        mask = masks[np.arange(len(which)) + np.repeat(first[code[some]] - np.cumsum(n) + n, n)]
        left = held[which] & ~mask > 0
        which, mask = which[left], mask[left]
        w = t[at[which] + np.arange(size)[:, None]]
        w[bits[:, None] & mask > 0] = _PLACEHOLDER[NAME]
        out.append((window_hashes(w, size)[0] ^ short, at[which], mask.astype(np.int8)))
    return (*(np.concatenate(c) for c in zip(*out, strict=True)), kind, value)


def _pairs(x: list[int], y: list[int]) -> dict[int, int] | None:
    """What a window binds, item value to document value; None if it contradicts itself."""
    out: dict[int, int] = {}
    for u, v in zip(x, y, strict=False):  # short items are filled up with literals
        if u and out.setdefault(u, v) != v:
            return None
    return out


def _agrees(pairs: dict[int, int] | None, bound: dict[int, int]) -> bool:
    return pairs is not None and all(bound.get(u, v) == v for u, v in pairs.items())


def _longest(rows: list[tuple]) -> list[tuple]:
    """A longest chain of rows whose places rise in the item and in the document; rows are in order of item place, and of falling document place."""
    ends: list[int] = []
    last: list[int] = []
    before = []
    for i, r in enumerate(rows):
        n = bisect_left(ends, r[1])
        before.append(last[n - 1] if n else -1)
        ends[n : n + 1], last[n : n + 1] = [r[1]], [i]
    out = []
    i = last[-1] if last else -1
    while i >= 0:
        out.append(rows[i])
        i = before[i]
    return out[::-1]


def _chain(rows: list[tuple], bound: dict[int, int]) -> tuple[list[tuple], dict[int, int]]:
    """The longest chain of rows that agree with a binding, which the longest run of the chain on one alignment extends until no row of the chain is left unbound."""
    bound = dict(bound)
    while True:
        chain = _longest([r for r in rows if _agrees(r[2], bound)])
        runs = [list(g) for _, g in groupby(chain, lambda r: r[1] - r[0])]
        unbound = [g for g in runs if any(not r[2].keys() <= bound.keys() for r in g)]
        if not unbound:
            return chain, bound
        for r in max(unbound, key=len):
            if _agrees(r[2], bound):
                bound |= r[2]


def _contradicted(chain: list[tuple], rows: list[tuple]) -> bool:
    """Whether a window that the chain lacks stands where it belongs, between (or beyond) windows of one alignment, with other slots."""
    places = [r[0] for r in chain]
    for a, p, _, firm in rows:
        if not firm:
            continue
        n = bisect_left(places, a)
        if n < len(places) and places[n] == a:
            continue
        sides = {r[1] - r[0] for r in chain[max(n - 1, 0) : n + 1]}
        if sides == {p - a}:
            return True
    return False


def verify(item: list[tuple], n_windows: int, similarity: float = SIMILARITY) -> tuple[float, int] | None:
    """Whether matched windows show a leak: rows are (place in the item, place in the document, item's slots, document's slots, whether no word is read as a name that only may be one), slots being value hashes of a window with 0 for literals. The best share of the item's windows over alignments, and the number of slots bound.

    The binding comes from one exact alignment (or from each stretch of it without a contradiction); windows of other alignments, however far
    words put in or left out have moved them, are added in order of item and document where they agree with it.
    """
    rows = sorted(((a, p, _pairs(x, y), firm) for a, p, x, y, firm in item), key=lambda r: (r[0], -r[1], not r[3]))
    by: dict[int, list[tuple]] = {}
    for r in rows:
        by.setdefault(r[1] - r[0], []).append(r)
    seeds = []
    for shift, line in by.items():
        bound, size = {}, 0
        for _, same in groupby(line, lambda r: r[0]):  # the readings of one place
            same = [r[2] for r in same if r[2] is not None]
            new = next((x for x in same if _agrees(x, bound)), None)
            if new is None:
                seeds.append((size, shift, bound))
                bound, size, new = {}, 0, same[0] if same else {}
            bound, size = bound | new, size + 1
        seeds.append((size, shift, bound))
    most = len(_longest([r for r in rows if r[2] is not None])) / n_windows  # under any binding
    best, tried = None, set()
    for _, _, bound in sorted(seeds, key=lambda s: (-s[0], s[1])):
        if most < similarity or best and best[0] >= most:
            break
        if (same := frozenset(bound.items())) in tried:
            continue
        tried.add(same)
        chain, bound = _chain(rows, bound)
        share = len(chain) / n_windows
        if share >= similarity and (best is None or share > best[0]) and not _contradicted(chain, rows):
            best = (share, len(bound))
    return best


def _slots(kind: np.ndarray, value: np.ndarray, at: int, reading: int = 0) -> list[int]:
    k, v = kind[at : at + WORDS], value[at : at + WORDS]
    return np.where((k == LITERAL) & (reading >> np.arange(len(k)) & 1 == 0), np.uint64(0), v | np.uint64(1)).view(np.int64).tolist()


def _emit(batches):
    """(k, d, t) -> all template windows: for a benchmark, and for documents where the benchmark is too large to share."""
    for b in short(batches):
        for i, t in enumerate(b.column("t").to_pylist()):
            h, at, reading, kind, value = windows(t)
            n = len(at)
            if n:
                slots = [_slots(kind, value, a, m) for a, m in zip(at.tolist(), reading.tolist(), strict=True)]
                row = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays(
                    [b.column("k").take(row), b.column("d").take(row), pa.array(h.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(slots, pa.list_(pa.int64())), pa.array(reading == 0), pa.array(np.full(n, (reading == 0).sum(), np.int32))],
                    names=["k", "d", "h", "p", "s", "f", "n"],
                )


_EMIT = "k long, d long, h long, p int, s array<long>, f boolean, n int"
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("n_slots", pa.int64())])
_FOUND_SQL = "doc_id long, item_id long, similarity double, n_slots long"


def _local(shared, similarity: float):
    """Matches whole documents against the shared windows: a hash join on sorted hashes, then the slot check."""

    def run(batches):
        h, item, place, slots, firm, total, keys = shared.value
        sieve = np.zeros(1 << 20, bool)
        sieve[h >> np.uint64(44)] = True
        for b in short(batches):
            out = []
            for k, t in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), strict=True):
                own, at, reading, kind, value = windows(t)
                maybe = np.flatnonzero(sieve[own >> np.uint64(44)])
                if not len(maybe):
                    continue
                lo, hi = np.searchsorted(h, own[maybe], "left"), np.searchsorted(h, own[maybe], "right")
                found: dict[int, list[tuple]] = {}
                for j in np.flatnonzero(hi > lo).tolist():
                    p, m = int(at[maybe[j]]), int(reading[maybe[j]])
                    s = _slots(kind, value, p, m)
                    for i in range(int(lo[j]), int(hi[j])):
                        found.setdefault(int(item[i]), []).append((int(place[i]), p, slots[i].tolist(), s, bool(firm[i]) and not m))
                for i, rows in found.items():
                    if len(rows) >= similarity * total[i] and (got := verify(rows, int(total[i]), similarity)):
                        out.append((k, int(keys[i]), *got))
            yield pa.RecordBatch.from_pydict({n: [r[c] for r in out] for c, n in enumerate(_FOUND.names)}, schema=_FOUND)

    return run


def _prime(items: pa.Table) -> tuple[np.ndarray, ...]:
    """Windows of all items in order of their hashes; an item is a place among the distinct texts, for each of which there are a number of windows and a key."""
    k, d, h = items["k"].to_numpy(), items["d"].to_numpy(), items["h"].to_numpy().view(np.uint64)
    order = np.lexsort((items["p"].to_numpy(), d, k, h))
    slots = np.zeros((len(h), WORDS), np.int64)
    for i, s in enumerate(items["s"].to_pylist()):
        slots[i, : len(s)] = s
    _, first, item = np.unique(np.stack([k, d], 1), axis=0, return_index=True, return_inverse=True)
    return h[order], item.ravel()[order], items["p"].to_numpy()[order], slots[order], items["f"].to_numpy()[order], items["n"].to_numpy()[first], k[first]


def _grouped(similarity: float):
    def run(key, table):
        rows = zip(*(table[c].to_pylist() for c in ("ip", "p", "sx", "s", "firm")), strict=True)
        got = verify(list(rows), int(table["total"][0].as_py()), similarity)
        out = [(key[0].as_py(), key[2].as_py(), *got)] if got else []
        return pa.Table.from_pydict({n: [r[c] for r in out] for c, n in enumerate(_FOUND.names)}, schema=_FOUND)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", similarity: float = SIMILARITY, prime_windows: int = PRIME_WINDOWS) -> DataFrame:
    """Pairs (doc_id, item_id) of a document and an item that leaked into it, with the share of the item's windows found and the number of slots bound."""
    spark = docs.sparkSession

    def texts(df: DataFrame, k: str, t: str) -> DataFrame:
        """``d`` tells the texts of one key apart."""
        return df.select(F.col(k).cast("long").alias("k"), F.xxhash64(t).alias("d"), F.col(t).alias("t")).where("k is not null and t is not null")

    rows = texts(docs, key, text)
    items = texts(benchmark, item_key, item_text).distinct().mapInArrow(_emit, _EMIT)
    if items.count() <= prime_windows:
        shared = spark.sparkContext.broadcast(_prime(items.toArrow().combine_chunks()))
        found = rows.mapInArrow(_local(shared, similarity), _FOUND_SQL)
    else:
        own = rows.distinct().mapInArrow(_emit, _EMIT).select("k", "d", "h", "p", "s", "f")
        pairs = own.join(items.select(F.col("k").alias("i"), F.col("d").alias("e"), "h", F.col("p").alias("ip"), F.col("s").alias("sx"), F.col("f").alias("fx"), F.col("n").alias("total")), "h")
        found = pairs.withColumn("firm", F.col("f") & F.col("fx")).groupBy("k", "d", "i", "e").applyInArrow(_grouped(similarity), _FOUND_SQL)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", "n_slots")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", "best.n_slots")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **more) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows without a key stay."""
    leaked = staged(find_leaks(docs, benchmark, text, key, **more).select(F.col("doc_id").alias("gone")).distinct(), "leaked")  # its size is then known to the planner
    return docs.join(leaked, docs[key] == leaked["gone"], "left_anti")
