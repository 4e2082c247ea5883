"""The older blockers: capped equi-joins on prefixes and rare words, and nearest neighbours on character n-grams.

Each takes records (entity_id, country, name, addr) of both sides and returns distinct (s, t). Keys that too many targets hold are dropped
by a count, which is their own definition of a block, so no block's pairs grow without bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.stage import staged
from .retrieval import S_BLOCK, T_BLOCK, borders, spread

PREFIXES, PREFIX_CAP, NAME_CAP, ADDRESS_CAP = (3, 4, 5), 500, 200, 300
#: The commonest n-grams of a text that are left for later have this part of the least score together, or less. A matter of speed only.
REST = 0.3
#: Texts that are compared together with a stretch of targets. A matter of speed only.
TOGETHER, STRETCH = 64, 2048
#: A country has this many blocks of s at least, unless they would be smaller than so many texts. A matter of speed only.
PIECES, PIECE = 8, 1000


def _capped_join(s: DataFrame, t: DataFrame, most: int) -> DataFrame:
    """Pairs of equal (country, key) whose key at most ``most`` target rows hold."""
    rare = t.groupBy("country", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("country", "key")
    kept = t.join(rare, ["country", "key"])
    return s.join(kept, ["country", "key"]).select("s", "t").distinct()


def _keyed(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.select(F.col("entity_id").alias(name), "country", key.alias("key"))


def by_name_prefix(s: DataFrame, t: DataFrame, lengths: tuple[int, ...] = PREFIXES, most: int = PREFIX_CAP) -> DataFrame:
    """First n letters of the name. A key counts only if country label, separator and prefix are longer than 3 + n letters together."""

    def side(df: DataFrame, n: int, name: str) -> DataFrame:
        return _keyed(df, F.substring("name", 1, n), name).where(F.length("country") + 1 + F.length("key") > 3 + n)

    return reduce(DataFrame.unionByName, (_capped_join(side(s, n, "s"), side(t, n, "t"), most) for n in lengths)).distinct()


def by_name_token(s: DataFrame, t: DataFrame, most: int = NAME_CAP) -> DataFrame:
    tokens = F.explode(F.filter(words(F.col("name")), lambda w: F.length(w) >= 4))
    return _capped_join(_keyed(s, tokens, "s").distinct(), _keyed(t, tokens, "t"), most)


def by_address_token(s: DataFrame, t: DataFrame, most: int = ADDRESS_CAP) -> DataFrame:
    """Numbers of three digits or more, words of five letters or more."""
    tokens = F.explode(F.filter(words(F.col("addr")), lambda w: w.rlike(r"^(?:\p{N}{3,}|\p{L}{5,})$")))
    return _capped_join(_keyed(s, tokens, "s").distinct(), _keyed(t, tokens, "t"), most)


def char_ngrams(word: str, low: int = 3, high: int = 5) -> list[str]:
    """n-grams of a word with a space on either side, repeats included."""
    w = f" {word} "
    return [g for n in range(low, high + 1) for g in ([w] if len(w) <= n else [w[i : i + n] for i in range(len(w) - n + 1)])]


class _Words:
    """Distinct words of some texts, and which word stands in which text (``row``, ``word``, in order of rows)."""

    def __init__(self, texts: pa.Array) -> None:
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten()
        real = pc.not_equal(words, "")
        coded = words.filter(real).dictionary_encode()
        self.n, self.words, self.word = len(texts), coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.row = np.repeat(np.arange(self.n), pc.list_value_length(lists).to_numpy())[real.to_numpy(zero_copy_only=False)]

    def spell(self, places: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of the distinct words, repeats included: where those of each word start, and all of them."""
        grams = [places(w) for w in self.words]
        return np.concatenate(([0], np.cumsum([len(g) for g in grams], dtype=np.int64))), np.fromiter((g for x in grams for g in x), np.int64)

    def grams(self, start: np.ndarray, gram: np.ndarray, n_grams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, n-gram and how often, by rows and n-grams."""
        count = (start[1:] - start[:-1])[self.word]
        keys, often = np.unique(np.repeat(self.row, count) * n_grams + gram[spread(start[self.word], count)], return_counts=True)
        return keys // n_grams, keys % n_grams, often


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(country, g, n): in how many of the records n-grams occur, from (country, text, n) with n equal records."""
    of = lru_cache(1 << 16)(char_ngrams)
    for batch in batches:
        place = {}
        texts = _Words(batch["text"].cast(pa.string()))
        row, gram, _ = texts.grams(*texts.spell(lambda w: [place.setdefault(g, len(place)) for g in of(w)]), 1 << 31)  # noqa: B023
        countries = batch["country"].dictionary_encode()
        keys, at = np.unique(countries.indices.to_numpy().astype(np.int64)[row] * (1 << 31) + gram, return_inverse=True)
        n = np.bincount(at, batch["n"].to_numpy()[row], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([countries.dictionary.take(pa.array(keys >> 31)), pa.array(place, pa.string()).take(pa.array(keys % (1 << 31))), pa.array(n)], ["country", "g", "n"])


class _Grams:
    """Texts: row, n-gram and weight of each posting, of length 1; their words, and what a word's n-grams are."""

    def __init__(self, texts: pa.Array, place: dict[str, int], idf: np.ndarray) -> None:
        self.words, self.n = _Words(texts), len(texts)
        self.start, self.spelt = self.words.spell(lambda w: [place[g] for g in char_ngrams(w) if g in place])
        self.row, self.gram, often = self.words.grams(self.start, self.spelt, len(place))
        w = often * idf[self.gram]
        self.length = np.sqrt(np.bincount(self.row, w * w, self.n))
        self.w = w / self.length[self.row]


def _close(s: _Grams, t: _Grams, idf: np.ndarray, least: float, n_grams: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
    """Of each row of s: the rows of t whose score may be over ``least``, these scores, in single precision, without some n-grams of s, and what these can add at most.

    The score of a target is the sum of what each of its words adds, so what s gives to a word is summed once for all targets that hold it. Rows of s are
    done ``TOGETHER``, each a column; targets are sorted by their number of words, so the j-th words of a stretch of them are one lookup.
    """
    of_word = np.repeat(np.arange(len(t.words.words)), t.start[1:] - t.start[:-1])
    by = np.argsort(t.spelt, kind="stable")
    holding, at_gram = of_word[by], borders(t.spelt, n_grams)
    first = borders(s.row, s.n)
    size = np.bincount(t.words.row, minlength=t.n)
    order = np.argsort(-size, kind="stable")
    begin, size = borders(t.words.row, t.n)[order], size[order]
    scale = np.divide(1, t.length, out=np.zeros(t.n), where=t.length > 0)[order].astype(np.float32)
    for low in range(0, s.n, TOGETHER):
        rows = range(low, min(low + TOGETHER, s.n))
        sums, terms = np.empty((2, STRETCH, len(rows)), np.float32)
        given, left = np.empty((len(rows), len(t.words.words)), np.float32), np.zeros(len(rows), np.float32)
        for c, i in enumerate(rows):
            own, w = s.gram[first[i] : first[i + 1]], s.w[first[i] : first[i + 1]]
            # The commonest n-grams come last. Together they add at most their length to a score.
            rest = np.sqrt(np.cumsum((w * w)[::-1]))[::-1]
            cut = np.count_nonzero(rest >= REST * least)
            if cut < len(w):
                own, w, left[c] = own[:cut], w[:cut], rest[cut]
            n = at_gram[own + 1] - at_gram[own]
            given[c] = np.bincount(holding[spread(at_gram[own], n)], np.repeat(w * idf[own], n), given.shape[1])
        given = np.ascontiguousarray(given.T)
        columns, found, scores = [], [], []
        for a in range(0, t.n, STRETCH):
            if not size[a]:
                break
            z = min(a + STRETCH, t.n)
            total, looked = sums[: z - a, : len(rows)], terms[: z - a, : len(rows)]
            total.fill(0)
            for j in range(size[a]):
                m = np.searchsorted(-size[a:z], -j)  # targets of more than j words
                total[:m] += np.take(given, t.words.word[begin[a : a + m] + j], 0, looked[:m], "clip")
            total *= scale[a:z, None]
            at, c = np.divmod(np.flatnonzero(total > least - left), len(rows))
            columns.append(c)
            found.append(order[a + at])
            scores.append(total[at, c])
        columns, found, scores = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (columns, found, scores))
        by_column = np.argsort(columns, kind="stable")
        edge = borders(columns, len(rows))
        for c, i in enumerate(rows):
            mine = by_column[edge[c] : edge[c + 1]]
            yield i, found[mine], scores[mine], left[c]


def _nearest(k: int, least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest targets, above a score, of each text of a cell: (country, text, t, score). Texts of t, with the first k ids of each, and the n-grams of the country with their idf come as one table."""

    def cell(s: pa.Table, t: pa.Table) -> pa.Table:
        known = t.filter(pc.is_valid(t["g"])).sort_by([("df", "ascending"), ("g", "ascending")])
        t = t.filter(pc.is_null(t["g"]))
        texts, country = s["text"].combine_chunks().cast(pa.string()), (s if len(s) else t)["country"][:1].combine_chunks()
        if not len(s) or not len(t) or not len(known):
            return pa.table({"country": country.slice(0, 0), "text": texts.slice(0, 0), "t": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        place, idf = {g: i for i, g in enumerate(known["g"].to_pylist())}, known["idf"].to_numpy()
        lists = t["ids"].combine_chunks()
        ids, of_text = lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        s, t = _Grams(texts, place, idf), _Grams(t["text"].combine_chunks().cast(pa.string()), place, idf)
        first, own_t, weight = borders(s.row, s.n), borders(t.row, t.n), np.zeros(len(place))
        slack = 2e-7 * (8 + np.bincount(t.words.row, minlength=1).max(initial=0))  # more than sums in single precision can be off
        rows, found, scores = [], [], []
        for i, near, about, left in _close(s, t, idf, least - slack, len(place)):
            if len(near) > k:
                near = near[about + left >= np.partition(about, len(near) - k)[len(near) - k] - 2 * slack]
            if not len(near):
                continue
            own = slice(first[i], first[i + 1])
            weight[s.gram[own]] = s.w[own]
            count = own_t[near + 1] - own_t[near]
            at = spread(own_t[near], count)
            score = np.round(np.bincount(np.repeat(np.arange(len(near)), count), t.w[at] * weight[t.gram[at]], len(near)), 9)
            weight[s.gram[own]] = 0
            near, score = near[score > least], score[score > least]
            n = of_text[near + 1] - of_text[near]
            each, score = spread(of_text[near], n), np.repeat(score, n)
            best = np.lexsort((rank[each], -score))[:k]
            rows.append(np.full(len(best), i))
            found.append(each[best])
            scores.append(score[best])
        join = lambda x, kind: np.concatenate([np.empty(0, kind), *x])
        out = pa.array(join(rows, np.int64))
        return pa.table({"country": country.take(pa.array(np.zeros(len(out), np.int64))), "text": texts.take(out), "t": ids.take(pa.array(join(found, np.int64))), "score": pa.array(join(scores, np.float64))})

    return cell


def tfidf_neighbours(s: DataFrame, t: DataFrame, column: str, k: int = 10, distance: float = 0.7, min_df: int = 2, max_df: float = 0.9) -> DataFrame:
    """(s, t): the k nearest targets of each s on character n-grams of one column, within a cosine distance, by country (s is read three times, t twice: give tables). n-grams of fewer than ``min_df`` records or more than the share ``max_df`` are left out.

    Equal texts have equal neighbours, and of equal targets the k of the lowest ids come first, so distinct texts are compared.
    """
    side = lambda df: df.select(F.col("country").alias("country"), F.col("entity_id").alias("id"), F.col(column).alias("text"))  # noqa: E731  country by a new name, since s and t may come from one table
    same = ["country", "text"]
    first = Window.partitionBy(*same).orderBy("id")
    ids = side(t).withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).groupBy(*same).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    # A text with the number of its records on either side; a text that is null or has no words counts as a record only.
    texts = staged(side(s).groupBy(*same).agg(F.count(F.lit(1)).alias("n_s")).join(side(t).groupBy(*same).agg(F.count(F.lit(1)).alias("n_t")), same, "full"), "texts")
    found = lambda c: F.sum(F.col(c).isNotNull().cast("long"))
    sizes = staged(texts.groupBy("country").agg(F.sum("n_s").alias("n_s"), F.sum("n_t").alias("n_t"), found("n_s").alias("texts_s"), found("n_t").alias("texts_t")).where("n_s > 0 AND n_t > 0"), "sizes")
    real = (F.col("text") != "") & F.col("country").isNotNull()
    counts = texts.where(real).select(*same, (F.coalesce("n_s", F.lit(0)) + F.coalesce("n_t", F.lit(0))).alias("n")).mapInArrow(_counted, "country string, g string, n long").groupBy("country", "g").agg(F.sum("n").alias("df"))
    n = F.col("n_s") + F.col("n_t")
    of = lambda x, size: F.ceil(F.col(f"texts_{x}") / size)
    blocks = {"s": F.greatest(of("s", S_BLOCK), F.least(F.lit(PIECES), of("s", PIECE))).cast("int").alias("blocks_s"), "t": of("t", T_BLOCK).cast("int").alias("blocks_t")}
    cells = sizes.select(*blocks.values()).agg(F.sum(F.col("blocks_s") * F.col("blocks_t"))).first()[0] or 0
    parts = 1 + 2 * min(cells, 5000)  # cells are few and slow: more parts than cells keep most of them apart
    known = counts.join(F.broadcast(sizes), "country").where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))  # one row a country
    grams = staged(known.select("country", "g", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"), *blocks.values()), "ngrams")
    own = lambda x: F.array(F.pmod(F.xxhash64("text"), F.col(f"blocks_{x}")).cast("int"))
    every = lambda x: F.sequence(F.lit(0), F.col(f"blocks_{x}") - 1)

    def dealt(df: DataFrame, b_s: Column, b_t: Column) -> DataFrame:
        return df.withColumn("b_s", F.explode(b_s)).withColumn("b_t", F.explode(b_t)).drop("blocks_s", "blocks_t")

    blocked = F.broadcast(sizes.select("country", *blocks.values()))  # one row a country
    left = texts.where(real & F.col("n_s").isNotNull()).select(*same).join(blocked, "country")
    right = ids.where(real).join(blocked, "country")
    cell = ["country", "b_s", "b_t"]
    right = dealt(right, every("s"), own("t")).unionByName(dealt(grams, every("s"), every("t")), allowMissingColumns=True)
    scores = dealt(left, own("s"), every("t")).repartition(parts, *cell).groupBy(*cell).cogroup(right.repartition(parts, *cell).groupBy(*cell)).applyInArrow(_nearest(k, 1 - distance), "country string, text string, t string, score double")
    near = staged(scores, "near")
    best = Window.partitionBy(*same).orderBy(F.desc("score"), "t")
    nearest = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select(*same, "t")
    return side(s).withColumnRenamed("id", "s").join(nearest, same).select("s", "t")


def all_blocks(s: DataFrame, t: DataFrame, neighbours: bool = True) -> DataFrame:
    """Distinct union of the blockers."""
    parts = [by_name_prefix(s, t), by_name_token(s, t), by_address_token(s, t)]
    if neighbours:
        parts += [tfidf_neighbours(s, t, "name"), tfidf_neighbours(s, t, "addr")]
    return reduce(DataFrame.unionByName, parts).distinct()


def candidate_lists(s: DataFrame, pairs: DataFrame) -> DataFrame:
    """(entity_id, candidates): sorted, comma-joined; an entity without candidates keeps an empty list."""
    lists = pairs.groupBy("s").agg(F.concat_ws(",", F.array_sort(F.collect_set("t"))).alias("candidates"))
    return s.select("entity_id").join(lists, F.col("entity_id") == F.col("s"), "left").select("entity_id", F.coalesce("candidates", F.lit("")).alias("candidates"))


def shared_countries(s: DataFrame, t: DataFrame) -> DataFrame:
    return s.select("country").intersect(t.select("country"))
