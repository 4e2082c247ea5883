import random
import zlib

import numpy as np
import pytest

pytest.importorskip("matchloom.llm")
from pyspark.sql import functions as F

import corpus_pipeline
from matchloom.llm import decontaminate, language, neardup, packing, pii, queries, substring, topk
from matchloom.llm._util import window_hashes, word_hashes
from matchloom.llm.components import components
from tests.llm import brute
from tests.llm.test_text_operators import ODD, documents

SF = "/root/testdata/sf0.01"


def made(seed=0, n=60):
    """Documents with copies, near copies and shared passages."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(400)
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(r.randrange(0, 90))] for _ in range(n)]
    for i in range(n):
        if i % 4 == 1:
            base[i] = list(base[r.randrange(n)])
            for _ in range(r.randrange(3)):
                if base[i]:
                    base[i][r.randrange(len(base[i]))] = word()
        if i % 5 == 2:
            at = r.randrange(len(base[i]) + 1)
            base[i][at:at] = passage[: r.randrange(10, 30)]
    return [(i, r.choice([" ", "\n", "\t "]).join(w)) for i, w in enumerate(base)]


def test_window_hashes_tell_windows_apart():
    r = random.Random(3)
    words = [b"%d" % r.randrange(3) for _ in range(400)]
    h = word_hashes(b"  ".join(words) + b"\n")
    for n in (1, 2, 3, 5, 7, 13, 26):
        got = window_hashes(h, n)
        groups = {}
        for i in range(len(words) - n + 1):
            groups.setdefault(tuple(words[i : i + n]), set()).add(int(got[i]))
        assert len(got) == len(words) - n + 1 and all(len(v) == 1 for v in groups.values()) and len({x for v in groups.values() for x in v}) == len(groups)


def test_word_hashes_follow_the_words():
    r = random.Random(1)
    for size in (0, 1, 50, 3000):
        raw = "".join(r.choice(["a", "b", "é", " ", "\t", "\n", "\x0b", "\x1c", "\xa0", "x" * 70, "Ω"]) for _ in range(size)).encode()
        words = raw.split()
        got = word_hashes(raw).tolist()
        assert len(got) == len(words) and len(set(got)) == len(set(words)) == len(set(zip(got, words)))
    long = b"w" * 600000
    assert word_hashes(long + b" x " + long).tolist()[0] == word_hashes(long).tolist()[0] and len(word_hashes(b"ab " * 200000)) == 200000 and len(set(word_hashes(b"ab " * 200000).tolist())) == 1


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_matches_brute_force(spark, seed):
    docs = made(seed)
    got = sorted(tuple(r) for r in substring.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(brute.repeats(docs)) and sum(r[2] for r in got)


def test_substring_cases(spark):
    shared = " ".join(map(str, range(20)))
    rows = [*ODD, (9, shared, "en", "a", 1), (8, shared, "en", "a", 1), (None, shared, "en", "a", 1), (9, "other " + shared, "en", "a", 1), (10, "x y " + shared, "en", "a", 1)]
    got = sorted((tuple(r) for r in substring.remove_repeats(documents(spark, rows, True)).collect()), key=str)
    assert got == sorted(brute.repeats([r[:2] for r in rows]), key=str)
    assert substring.remove_repeats(documents(spark, [])).count() == 0


def test_passages_double_until_none_is_left(spark):
    r = random.Random(1)
    passage = ["p%d" % i for i in range(60)]
    docs = [(i, " ".join(["a%d_%d" % (i, j) for j in range(r.randrange(5))] + passage[: 60 if i < 2 else 14])) for i in range(3)]
    got = substring.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["length"] for r in got if r["doc_id"] < 2} >= {52} and {r["length"] for r in got if r["doc_id"] == 2} == {13}


def test_near_duplicates_match_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    want = brute.near(docs)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op9_neardup(spark, SF).collect()}
    assert got == want
    docs = dict(made(5, 120))
    got = neardup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == brute.near(docs)


def test_a_large_group_is_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(2)
    base = ["w%d" % r.randrange(10**6) for _ in range(100)]
    docs = {}
    for i in range(90):
        own = list(base)
        own[r.randrange(100)] = "changed%d" % i
        if i % 3 == 0:
            own[r.randrange(100)] = "twice%d" % i
        docs[i] = " ".join(own)
    got = neardup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == brute.near(docs)


def test_near_duplicate_cases(spark):
    got = sorted(tuple(r) for r in neardup.near_duplicates(documents(spark, ODD, True)).collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 5]
    assert neardup.near_duplicates(documents(spark, [])).count() == 0
    assert sorted(str(r["doc_id"]) for r in neardup.keep_first(documents(spark, [*ODD, (9, "1234", "en", "a", 1)], True)).collect()) == ["1", "2", "3", "3", "4", "5", "None"]
    bands, rows = neardup.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= neardup.RECALL


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_of_repeated_keys(spark, monkeypatch, block):
    """Rows of one key are one document with the shingles of each row, as in the query's SQL: no shingle crosses two rows."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = [(1, "a b c d e"), (1, "f g h i j"), (2, "a b c d e"), (2, "f g h i j"), (2, "a b c d e "), (3, None), (3, "a b c d e"), (4, "a b c d e"), (4, ""), (None, "a b c d e")]
    r = random.Random(7)
    for k, t in made(8, 60):
        words = t.split()
        cut = r.randrange(len(words) + 1)
        rows += [(100 + k, t)] if k % 3 else [(100 + k, " ".join(words[:cut])), (100 + k, " ".join(words[cut:]))]
        if k % 6 == 0:
            rows += [(200 + k, " ".join(words[:cut])), (200 + k, " ".join(words[cut:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["copy_id"], r["n_links"]) for r in neardup.near_duplicates(docs).collect()}
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = {a: (b, c, d) for a, b, c, d in con.execute(queries.oracle_sql()["op9_neardup"].replace("documents UNION", "(SELECT DISTINCT doc_id FROM documents) UNION").replace("FROM documents", "FROM (SELECT * FROM documents WHERE doc_id IS NOT NULL)", 1)).fetchall() if a is not None}
    assert got == want and got[1][1] == got[2][1] == 1 and got[3][1] == got[4][1] == 3


def test_a_chain_of_documents_is_verified_where_bands_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    words = ["w%d" % i for i in range(900)]
    docs = {i: " ".join(words[4 * i : 4 * i + 100]) for i in range(200)}
    got = neardup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), recall=0.9999)
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got.collect()} == brute.near(docs)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 900), (900, 7), (7, 7)] + [(1000, r.randrange(1001, 1100)) for _ in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


BENCH = [(1, "A train with 5 wagons leaves Paris at 30 km per hour while Anna waits and 5 wagons stay behind there."), (2, "zwei drei vier"), (3, None), (4, "")]


def leaks(spark, texts, **more):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("h", F.lit(0)).withColumn("item_id", F.lit(0))
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items, **more).collect()}


@pytest.mark.parametrize("more", [{}, {"prime_windows": 0}])
def test_leaks_by_template(spark, more):
    text = BENCH[0][1]
    changed = text.replace("5", "17").replace("Paris", "Rome").replace("Anna", "Bob").replace("30 km", "90 miles")
    torn = text.replace("with 5", "with 17").replace("Anna", "Paris")
    texts = ["so it was. " + text + " more of it", "he said. " + changed, "he said. " + torn, "nothing at all here", None, "", "eins zwei drei vier", "zwei drei vier", " ".join(text.split()[:9])]
    assert leaks(spark, texts, **more) == {(0, 1), (1, 1), (7, 2)}


def shares(item, text):
    """What verify() says of one item and one text, by plain comparison of windows."""
    h, at, m, kind, value = decontaminate.windows(item)
    g, to, n, k, v = decontaminate.windows(text)
    rows = [(int(a), int(p), decontaminate._slots(kind, value, int(a), int(i)), decontaminate._slots(k, v, int(p), int(j)), not i and not j) for x, a, i in zip(h, at, m) for y, p, j in zip(g, to, n) if x == y]
    return decontaminate.verify(rows, int((m == 0).sum()))


@pytest.mark.parametrize("item", ["What is 12 + 15 + 18 + 21 + 24 when added up carefully", "we saw Anna and Bob and Carl and Dora in town", "es sind die Katze und die Maus und die Katze da"])
def test_templates_that_repeat_are_found(item):
    assert shares(item, item)[0] == 1
    assert shares(item, "and so on. " + item + " and more")[0] == 1
    changed = item
    for old, new in (("12", "7"), ("15", "8"), ("18", "8"), ("Anna", "Eve"), ("Bob", "Eve"), ("Katze", "Kuh")):
        changed = changed.replace(old, new)
    assert shares(item, changed)[0] == 1


def test_slots_that_contradict_each_other_are_no_leak():
    item = "a bus with 5 seats " + " ".join(f"w{'x' * i}" for i in range(40)) + " has 5 seats in the end"
    assert shares(item, item.replace("5", "6"))[0] == 1
    assert shares(item, item.replace("has 5", "has 6")) is None
    assert shares(item, item.replace("with 5", "with 6")) is None


def test_words_put_in_or_left_out():
    words = [f"w{'x' * i}" for i in range(40)]
    put = words[:20] + ["so"] * 5 + words[20:]
    assert shares(" ".join(words), " ".join(put))[0] == 32 / 36
    assert shares(" ".join(put), " ".join(words)) is None  # 32 of 41
    long = [f"{'v' * (i % 20)}u{'x' * (i // 20)}" for i in range(200)]
    spread = [w for i, w in enumerate(long) for w in ([w, "so"] if i % 25 == 24 and i < 190 else [w])]
    assert shares(" ".join(long), " ".join(spread))[0] == (196 - 28) / 196
    assert shares(" ".join(long), " ".join(long[:100] + long[106:]))[0] == (196 - 10) / 196
    assert shares(" ".join(long), " ".join(long[100:] + long[:100])) is None  # not in order


def test_words_put_into_a_template_that_repeats():
    names = "Anna Bob Carl Anna Dora Bob Emil Anna Fritz Bob Gerd Anna Hans Bob Ida Anna Jan Bob Kai Anna Lars Bob Max Anna Nele Bob Otto".split()
    item = "we saw " + " and ".join(names) + " in town"
    text = "we saw " + " and ".join([*names[:14], "Zoe", *names[14:]]) + " in town"
    assert shares(item, text)[0] >= 0.9


@pytest.mark.parametrize("more", [{}, {"prime_windows": 0}])
def test_names_that_start_sentences(spark, more):
    tom = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have now?"
    texts = [tom, tom.replace("Tom", "Sue"), "it says: " + tom.replace("Tom", "Sue").replace("5", "9"), tom.replace("Tom has", "Sue has").replace("Tom buys", "Eve buys"), "tom has no apples at all"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(1, tom), (2, "Paris lies. Rome waits. Bonn sleeps. Oslo sings.")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs, items, **more).collect()}
    assert got == {(0, 1): 1, (1, 1): 1, (2, 1): 1}


def test_repeated_keys_are_matched_text_by_text(spark):
    item = BENCH[0][1]
    other = item.replace("5", "8").replace("Paris", "Oslo")
    docs = [(1, "one says: " + item), (1, "two says: " + other), (2, "no"), (2, other), (3, item[:40]), (3, item[40:]), (4, item), (4, item), (None, item)]
    items = [(1, item), (1, "the quick brown fox jumps over a lazy dog today"), (2, "zwei drei vier"), (2, "zwei drei vier fünf sechs sieben"), (1, item)]
    docs.append((5, "see the quick brown fox jumps over a lazy dog today"))
    docs.append((6, "zwei drei vier"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [sorted(tuple(r) for r in decontaminate.find_leaks(d, b, prime_windows=n).collect()) for n in (10**6, 0)]
    assert got[0] == got[1] and [r[:3] for r in got[0]] == [(1, 1, 1.0), (2, 1, 1.0), (4, 1, 1.0), (5, 1, 1.0), (6, 2, 1.0)]


def brute_leak(item, text, least=0.8):
    """Whether a text holds an item up to its numbers and mid-sentence names, by trying every alignment of every binding: no hashes, no chains."""
    import re

    def read(t):
        out, start = [], True
        for w in t.split():
            bare = w.strip(".,;:!?")
            kind = "N" if re.fullmatch("[0-9]+", bare) else "P" if bare[:1].isupper() and not bare.isupper() and not start else ""
            out.append((kind or bare.lower(), bare.lower() if kind else None))
            start = w[-1] in ".!?"
        return out

    a, b = read(item), read(text)
    n = len(a) - 4
    best = 0
    for shift in range(-len(a), len(b)):
        places = [i for i in range(n) if 0 <= i + shift and i + shift + 5 <= len(b) and all(a[i + j][0] == b[i + shift + j][0] for j in range(5)) and any(a[i + j][1] is None for j in range(5))]
        binding = {}
        for i in places:
            for j in range(5):
                if a[i + j][1] is not None:
                    binding.setdefault(a[i + j][1], set()).add(b[i + shift + j][1])
        if all(len(v) == 1 for v in binding.values()):
            best = max(best, len(places))
    counted = sum(any(a[i + j][1] is None for j in range(5)) for i in range(n))
    return best >= least * counted


def test_leaks_match_a_brute_force_template_matcher(spark):
    r = random.Random(11)
    nouns, names = [f"noun{'x' * i}" for i in range(40)], [f"Name{'y' * i}" for i in range(12)]
    items = []
    for i in range(12):
        words = [r.choice(nouns) if r.random() < 0.75 else r.choice(names) if r.random() < 0.5 else str(r.randrange(20)) for _ in range(r.randrange(12, 30))]
        items.append((i, "the " + " ".join(words)))
    texts = []
    for i, t in items:
        fresh = {w: (r.choice(names) if w[0] == "N" else str(r.randrange(100, 200))) for w in set(t.split()) if w[0] == "N" or w.isdigit()}
        changed = " ".join(fresh.get(w, w) for w in t.split())
        torn = changed.split()
        at = [j for j, w in enumerate(torn) if w.isdigit()]
        if at:
            torn[at[0]] = "999"
        cut = t.split()[: len(t.split()) // 2]
        texts += [t, "before it " + changed + " after it", " ".join(torn), " ".join(cut), "nothing of the kind " + " ".join(r.choices(nouns, k=20))]
    docs = list(enumerate(texts))
    want = {(k, i) for k, t in docs for i, x in items if brute_leak(x, t)}
    for prime in (10**6, 0):
        got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), prime_windows=prime)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) >= 24


def test_leaks_of_whole_items(spark):
    docs = {r["doc_id"]: (r["text"] or "") for r in queries.table(spark, "/root/testdata/sf0.1", "documents").collect()}
    items = {r["item_id"]: r["text"] for r in queries.table(spark, "/root/testdata/sf0.1", "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, "/root/testdata/sf0.1").collect()}
    sets = {i: brute.shingles(t) for i, t in items.items()}
    of = {}
    for i, s in sets.items():
        for g in s:
            of.setdefault(g, []).append(i)
    want = set()
    for k, t in docs.items():
        hit = {}
        for g in brute.shingles(t):
            for i in of.get(g, ()):
                hit[i] = hit.get(i, 0) + 1
        want |= {(k, i) for i, n in hit.items() if n >= 0.8 * len(sets[i])}
    assert want and got == want


def test_leak_cases(spark):
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontaminate.find_leaks(documents(spark, ODD, True), items).count() == 0
    assert decontaminate.drop_leaked(documents(spark, ODD, True), items).count() == len(ODD)
    assert decontaminate.find_leaks(documents(spark, []), items).count() == 0
    assert decontaminate.find_leaks(documents(spark, ODD), items.limit(0)).count() == 0


def check_packed(rows, texts):
    tokenizer, ranks = queries.tokenizer_paths()
    of, fill = {}, {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append(r)
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in fill.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SEQUENCE
    assert sorted(of) == sorted(texts)
    for k, ps in of.items():
        ids, at = packing.token_ids(texts[k] or "", tokenizer, ranks), 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    return sum(packing.SEQUENCE - n for s in fill.values() if (n := sum(x for _, x in s)) & (n - 1)) / sum(r["length"] for r in rows)


def test_packing_is_a_round_trip(spark):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    assert check_packed(queries.op7_packing(spark, SF).collect(), texts) < 0.02


def test_packing_cases(spark):
    rows = [(1, None), (2, ""), (4, "<|endoftext|> x"), (5, "word " * 9000), (6, "a" * 20000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(1)).withColumn("rank", F.lit(1)), *queries.tokenizer_paths()).collect()
    check_packed(got, dict(rows))
    assert packing.pack_documents(documents(spark, ODD, True), *queries.tokenizer_paths()).where("doc_id = 3").select("sequence_id", "offset").distinct().count() > 1
    assert packing.pack_documents(documents(spark, []), *queries.tokenizer_paths()).count() == 0


def test_long_white_space_is_tokenised(spark):
    from tokenizers import Tokenizer

    tokenizer, ranks = queries.tokenizer_paths()
    slow = Tokenizer.from_file(tokenizer)
    for text in ("a" + " " * 3_000_000 + "b", "\n" * 3_000_000, "x " + "\t" * 1_000_000):
        assert packing.token_ids(text, tokenizer, ranks).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 1]
    rows = [(1, "a" + " " * 3_000_000), (None, "same"), (None, "same"), (2, "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer, ranks).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["start"] == 0) == ["1", "2", "None", "None"]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_quick_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer, ranks = queries.tokenizer_paths()
    slow, r = Tokenizer.from_file(tokenizer), random.Random(0)
    alphabet = "ab é'sntdm  \n\t\x0b\x1c\x85  　١२Ⅷ²—中文𝒜👩‍👩‍👧.,!?0123<|>" + chr(0x1F600)
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(80)))
        assert packing.token_ids(text, tokenizer, ranks).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 1]


def test_pack_places_every_piece():
    r = random.Random(0)
    for _ in range(50):
        histogram = {r.randrange(1, 129): r.randrange(1, 500) for _ in range(r.randrange(1, 60))}
        got = {}
        for count, lengths in packing.pack(histogram, 128):
            assert count > 0 and sum(lengths) <= 128
            for n in lengths:
                got[n] = got.get(n, 0) + count
        assert got == histogram


def test_topk_matches_brute_force(spark, monkeypatch):
    r = np.random.default_rng(0)
    x = r.normal(size=(700, 12)) * r.choice([0.1, 1, 5], size=(700, 1))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000, None), (1050, [float("nan")] * 12), (1001, [None] * 12), (1100, [1.0, 2.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("norm", F.lit(1))
    got = {}
    monkeypatch.setattr(topk, "BLOCK", 48)
    monkeypatch.setattr(topk, "RANGE", 1200)
    monkeypatch.setattr(topk, "HEAD", 16)
    for a in topk.top_inner_products(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(a["query_id"], []).append((a["rank"], a["vec_id"], a["score"]))
    q = np.floor(256 * x).astype(int)
    s = q @ q.T
    want = {i: [(n + 1, j, int(s[i, j])) for n, j in enumerate(sorted((j for j in range(700) if j != i), key=lambda j: (-s[i, j], j))[:5])] for i in range(0, 700, 50)}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert topk.top_inner_products(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_inner_products(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).count() == 2


def test_pipeline(spark):
    docs = {r["doc_id"]: r for r in queries.table(spark, SF, "documents").collect()}
    frame = queries.table(spark, SF, "documents").withColumn("extra", F.col("doc_id"))
    columns, left = frame.columns, set(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = queries.written(stage(spark, frame, SF), "t") if hasattr(queries, "written") else stage(spark, frame, SF).cache()
        rows = {r["doc_id"]: r for r in frame.collect()}
        assert frame.columns == columns and set(rows) <= left
        if name == "language_id":
            assert all(any(map(str.isalpha, r["text"])) for r in rows.values()) and len(left) - len(rows) < 0.01 * len(left)
        if name == "near_duplicates":
            classes = brute.near({k: docs[k]["text"] for k in left})
            assert set(rows) == {k for k in left if classes[k][0] == k}
        if name == "pii":
            assert all(r["text"] == pii.redact(docs[k]["text"]) and r["n_chars"] == len(r["text"]) for k, r in rows.items())
            assert not any(brute.pii(r["text"]) for r in rows.values())
        left = set(rows)
    got = corpus_pipeline.run(spark, SF).collect()
    check_packed(got, {k: pii.redact(docs[k]["text"]) for k in left})


def test_pipeline_cases(spark, tmp_path):
    documents(spark, ODD, True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 3 in got and 1 not in got and 4 not in got


def test_topk_of_extreme_components_and_mixed_dimensions(spark):
    rows = [(0, [3e38, -1.0]), (50, [1e300, 2.0]), (1, [-3e38, 1e-3]), (2, [1.0, 1.0]), (3, [2e7 * 256, 2e7]), (4, [2e7 * 256, 2e7]), (100, [1.0, 2.0, 3.0]), (5, [1.0, 0.0, 0.5]), (150, [0.0])]
    got = {}
    for a in topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=3).collect():
        got.setdefault(a["query_id"], []).append((a["rank"], a["vec_id"], a["score"]))
    top, low = 2**63 - 1, -(2**63)
    assert sorted(got[0]) == [(1, 2, top), (2, 3, top), (3, 4, top)] and sorted(got[50]) == [(1, 0, top), (2, 2, top), (3, 3, top)]
    assert got[100] == [(1, 5, 256 * 256 + 3 * 256 * 128)] and 150 not in got
    two = [r for r in rows if r[0] in (0, 1)]
    assert [tuple(r) for r in topk.top_inner_products(spark.createDataFrame(two, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()] == [(0, 1, 1, low)]


def test_topk_prunes_by_levels_and_scores_few():
    r = np.random.default_rng(3)
    x = np.floor(256 * r.normal(size=(4000, 64)) * 2.0 ** -np.arange(64)[None, :])
    order = np.argsort(-np.sqrt((x * x).sum(1)), kind="stable")
    search = topk.Search(np.arange(0, 4000, 50), x[::50], np.eye(64), 5)
    search.walk(order, x[order])
    assert search.pruned.sum() == 80 * 4000 and search.pruned[-1] < 0.02 * 80 * 4000 and search.pruned[:3].sum() > 0.8 * 80 * 4000
