"""Nearest neighbours on character n-grams against their definition, and what they write."""

import math
import random
from collections import Counter

import pytest

from matchloom.operators import evaluation, legacy_blocking
from matchloom.sources import stage

WORDS = "acme acmes store stores main street north oak elm river rivers bank union a of".split()


def sides():
    rng = random.Random(7)
    rows = [(str(i), rng.choice("xy"), " ".join(rng.choices(WORDS, k=rng.randint(0, 4)))) for i in range(90)]
    return rows[:40], rows[40:]


def brute(s, t, k, least):
    grams = {i: Counter(g for w in x.split() for g in legacy_blocking.char_ngrams(w)) for i, _, x in s + t}
    n, df = Counter(c for _, c, _ in s + t), Counter((c, g) for i, c, _ in s + t for g in grams[i])
    idf = {(c, g): math.log((1 + n[c]) / (1 + d)) + 1 for (c, g), d in df.items() if 2 <= d <= 0.9 * n[c]}
    vectors = {i: {g: f * idf[c, g] for g, f in grams[i].items() if (c, g) in idf} for i, c, _ in s + t}
    length = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    out = set()
    for i, c, _ in s:
        scores = [(-round(sum(x * vectors[j].get(g, 0) for g, x in vectors[i].items()) / (length[i] * length[j]), 9), j) for j, d, _ in t if c == d and length[i] and length[j]]
        out |= {(i, j) for x, j in sorted(x for x in scores if -x[0] > least)[:k]}
    return out


def test_ngrams():
    assert legacy_blocking.char_ngrams("a") == [" a "] * 3
    assert legacy_blocking.char_ngrams("été") == [" ét", "été", "té ", " été", "été ", " été "]


@pytest.mark.parametrize("rest, block", [(0.0, 1000), (0.5, 1000), (0.5, 6), (1.0, 9)])
def test_neighbours_by_brute_force(spark, monkeypatch, rest, block):
    rows, written = sides(), {}

    def counted(df, name):
        out = stage.staged(df, name)
        written[name] = out.count()
        return out

    for name, value in (("staged", counted), ("REST", rest), ("S_BLOCK", block), ("T_BLOCK", block)):
        monkeypatch.setattr(legacy_blocking, name, value)
    s, t = (spark.createDataFrame(x, "entity_id string, country string, name string") for x in rows)
    got = legacy_blocking.tfidf_neighbours(s, t, "name", k=3)
    assert {tuple(r) for r in got.collect()} == brute(*rows, 3, 0.3)
    # No pair is written but the nearest of each cell.
    assert written["near"] <= 3 * len(rows[0]) * math.ceil(len(rows[1]) / block)


def test_copies_are_compared_once(spark, monkeypatch):
    rng, written = random.Random(8), {}

    def counted(df, name):
        out = stage.staged(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(legacy_blocking, "staged", counted)
    texts = ["acme stores main", "acme store oak", "river bank", "", "rivers bank union", "elm north street"]
    rows = [[(str(i), "x", rng.choice(texts)) for i in range(a, a + 60)] for a in (0, 60)]
    s, t = (spark.createDataFrame(x, "entity_id string, country string, name string") for x in rows)
    got = legacy_blocking.tfidf_neighbours(s, t, "name", k=3)
    pairs = [tuple(r) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute(*rows, 3, 0.3)
    # Neighbours are written for distinct texts, not for each copy.
    assert 0 < written["near"] <= 3 * len(texts)


def test_block_recall_counts_true_pairs_by_class(spark):
    rows = [(1 if i % 3 == 0 else 2 + i % 2, str(i), i % 4 == 3) for i in range(40)]
    copies = spark.createDataFrame([(src, i, int(c)) for src, i, c in rows], "src int, id string, class long")
    true = {(i, j) for a, i, c in rows for b, j, d in rows if a == 1 and b > 1 and c == d}
    blocks = [(i, j) for a, i, _ in rows for b, j, _ in rows if a == 1 and b > 1 and (int(i) + int(j)) % 5 == 0]
    pairs = spark.createDataFrame(blocks, "s string, t string")
    got = evaluation.block_recall(copies, pairs).first()
    n = len(true & set(blocks))
    assert tuple(got) == (len(true), n, n / len(true)) and 0 < n < len(true)
    assert tuple(evaluation.block_recall(copies.limit(0), pairs).first()) == (0, 0, None)
