import base64
import random
import re
import string

import numpy as np
import pytest

pytest.importorskip("matchloom.llm")
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import html, language, pii, quality, queries, secrets
from tests.llm import brute


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("score", F.lit("x")).withColumn("k", F.lit(1)).withColumn("t", F.lit(2)) if extra else df


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "the cat", "en", "a", 7), (3, "the " * 40000, "en", "b", 1), (3, "the " * 40000, "en", "b", 1), (4, "1234", None, "c", 4), (5, "x" * 50000, "en", "c", 1)]

PIECES = st.lists(st.sampled_from(["a.b", "@", "x@y.z", ".", "1.2.3.4", "256", "+", "1", " ", "-", "4111111111111111", "4111 1111 1111 1111", "+1 (437) 555-0689", "é", "token", "=", '"', "b44e15e09fd311c3", "AKIA", "ABCDEFGHIJKLM", ":", "API_KEY", "ſecret", "GB82 WEST 1234 5698 7654 32", "\n", "12", "0" * 20]), max_size=14).map("".join)


@settings(max_examples=600, deadline=None)
@given(PIECES)
def test_base_spans_are_what_the_patterns_match(text):
    assert [s[:3] for s in pii.scan(text) if s[0] in pii.BASE] == brute.pii(text)
    assert [s for s in secrets.scan(text) if s[0] in secrets.BASE] == brute.secrets(text)


@pytest.mark.parametrize("name,plain", [("op8_pii", brute.pii), ("op10_secrets", brute.secrets)])
def test_scan_queries_match_brute_force(spark, name, plain):
    sf = "/root/testdata/sf0.01"
    text = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    got = queries.queries()[name](spark, sf).collect()
    assert len(got) == len(text)
    base = pii.BASE if name == "op8_pii" else secrets.BASE
    for r in got:
        want = plain(text[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(brute.joined(want))
        assert [r[f"n_{k}"] for k in base] == [sum(s[0] == k for s in want) for k in base]
        assert set(brute.joined(want).split(",")) <= set(r["spans"].split(","))


def test_added_spans():
    assert [s[0] for s in pii.scan("iban GB82 WEST 1234 5698 7654 32 ok")] == ["iban"]
    assert pii.scan("GB83 WEST 1234 5698 7654 32") == []
    assert pii.scan("code 123-45-6789") == [] and pii.scan("ssn 123-45-6789")[0][0] == "ssn"
    assert pii.redact("mail a@b.co and 4111111111111111.") == "mail [EMAIL] and [CARD]."
    key = "wJalrXUtnFEMI7K7MDENGbPxRfiCYzEXq9"
    assert [s[0] for s in secrets.scan(f"private credential {key} here")] == ["novel"]
    assert secrets.scan(f"nothing special {key} here") == []
    assert secrets.scan("auth " + "zq1" * 12) == []


ORDINARY = (
    "usr/lib/python3/site-packages/requests2/auth meeting-notes-january-2024-final src/main/java/com/example/AuthController2 config-version-2024-update-notes app/models/user_session_token_v2 "
    "com/example/service/AuthenticationServiceImpl2 my-awesome-project-name-123 docs/guides/getting-started-with-oauth2 tests/integration/test_api_key_rotation_01 release-2023-11-05-hotfix-build-42 "
    "AbstractSingletonProxyFactoryBean2 user_profile_settings_page_1 session_timeout_seconds_default_30 HTTP_PROXY_AUTHENTICATION_REQUIRED_407 0123456789abcdefghij 1234567890-1234567890-1234 "
    "aaaaaaaaaaaaaaaaaaaaaaaa1 2024-01-15T10-30-00-backup kubernetes-cluster-node-pool-03 department-of-education-report-2021 customerOrderHistoryRepository7 static/images/background-header-2x "
    "the_quick_brown_fox_jumps_over_13 src/components/LoginForm/index2 quarterly-financial-results-q3-2022 PaymentGatewayTimeoutException4 chapter-12-introduction-to-algebra"
).split()


def keys(seed, n):
    r = random.Random(seed)
    made = [lambda: "".join(r.choices(string.ascii_letters + string.digits, k=r.choice((20, 24, 32, 40)))), lambda: "".join(r.choices("0123456789abcdef", k=r.choice((22, 26, 30)))), lambda: base64.b64encode(r.randbytes(r.choice((18, 24, 32)))).decode().rstrip("="), lambda: "".join(r.choices(string.ascii_lowercase + string.digits, k=r.choice((24, 32))))]
    return [k for i in range(n) if re.search("[0-9]", k := made[i % 4]()) and re.search("[a-zA-Z]", k)]


def test_novelty_tells_keys_from_ordinary_names():
    text = "the {} is {} in the file"
    reported = lambda word, x: any(k == "novel" or k == "hex" for k, _, _ in secrets.scan(text.format(word, x)))
    random_keys = keys(1, 400)
    caught = sum(reported("auth token", k) for k in random_keys) / len(random_keys)
    false = [x for x in ORDINARY if reported("auth token", x)]
    assert caught >= 0.98 and len(false) <= 0.04 * len(ORDINARY), (caught, false)
    assert not any(reported("author name", k) for k in random_keys if not re.fullmatch("[0-9a-f]{32,}", k))


@pytest.mark.parametrize("seed", ["0", "1", "77"])
def test_novelty_is_the_same_under_any_hash_seed(seed):
    import os
    import subprocess
    import sys

    code = "from matchloom.llm.secrets import novelty; print([novelty(x, 'auth token at ', ' here and there') for x in ('meeting-notes-january-2024-final', 'wJalrXUtnFEMI7K7MDENG')])"
    run = lambda s: subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONHASHSEED": s}, capture_output=True, text=True, check=True).stdout
    assert run(seed) == run("5")


@pytest.mark.parametrize(
    "kind,number,word",
    [("iban", "DE89 3704 0044 0532 0130 00", "IBAN"), ("vin", "1M8GDM9AXKP042788", "vehicle"), ("imei", "490154203237518", "IMEI"), ("routing", "021000021", "routing"), ("steuer_id", "36574261809", "Steuer"), ("dni", "12345678Z", "DNI"), ("dni", "X1234567L", "NIE"), ("nir", "2 55 08 14 168 025 38", "NIR"), ("ssn", "123-45-6789", "SSN")],
)
def test_checksums_and_context(kind, number, word):
    kinds = lambda text: [s[0] for s in pii.scan(text) if s[0] not in pii.BASE]
    assert kind in kinds(f"her {word}: {number}, so") and kind not in kinds(f"invoice order {number}, so")
    i = max(j for j, c in enumerate(number) if c.isdigit())
    wrong = number[:i] + str((int(number[i]) + 1) % 10) + number[i + 1 :]
    assert kind == "ssn" or kind not in kinds(f"her {word}: {wrong}, so")


def test_context_moves_scores_by_whole_words():
    score = lambda text: pii.scan(text)[0][3]
    plain = score("so 4111111111111111 it")
    assert score("credit 4111111111111111 it") > plain > score("example 4111111111111111 it") > 0
    assert score("discredited 4111111111111111 postcards") == plain
    assert score("the hotel +1 437 555 0689") == pii.PRIOR["phone"] < score("the tel +1 437 555 0689")
    assert all(0 <= s[3] <= 1 for s in pii.scan("visa 4111111111111111 card example 1.2.3.4 ip a@b.co"))


def test_scans_are_linear_on_long_runs(spark):
    long = "a" * 300000 + " " + "1" * 300000 + " " + "+1" * 100000
    assert [s for s in pii.scan(long) if s[0] == "email"] == []
    assert pii.find_pii(documents(spark, ODD, True)).count() == len(ODD)
    assert secrets.digest(secrets.find_secrets(documents(spark, ODD, True))).count() == len(ODD)
    assert pii.digest(pii.find_pii(documents(spark, []))).count() == 0
    kept = pii.redact_pii(documents(spark, [(1, "a@b.co", "en", "s", 6)], True)).first()
    assert (kept["text"], kept["n_chars"]) == ("[EMAIL]", 7)


def test_language_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op6_language(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_cases(spark):
    docs = documents(spark, [*ODD, (6, "der hund und die katze", "de", "s", 3), (7, "und der", "de", "s", 3)], True)
    model = language.fit_language_id(docs)
    got = [(r["doc_id"], r["lang_id"]["lang"]) for r in language.predict_language(docs, model).collect()]
    assert dict(got)[1] == dict(got)[2] == dict(got)[4] == language.UND
    empty = language.fit_language_id(documents(spark, []))
    assert empty.predict("hello") == (language.UND, 0.0)
    one = language.fit_language_id(documents(spark, [(1, "hello you", "en", "s", 9)]))
    assert one.predict("anything") == ("en", 1.0) and one.predict("123") == (language.UND, 0.0)


def test_language_model_is_sparse_and_calibrated(spark):
    docs = queries.table(spark, "/root/testdata/sf0.1", "documents").where("lang is not null")
    model = language.fit_language_id(docs.where(~language.held_out("doc_id", 5, 0)))
    assert len(model.weights) < 0.3 * language.BUCKETS and (model.weights == 0).mean() > 0.3
    rows = [(r["lang"], language.counts(r["text"])) for r in docs.where(language.held_out("doc_id", 5, 0)).collect()]
    scores = np.stack([model.logits(*x) for _, x in rows if x is not None])
    y = np.array([model.languages.index(k) for k, x in rows if x is not None])
    loss = lambda t: -np.log(language.softmax(scores / t)[np.arange(len(y)), y]).mean()
    assert 1e-3 < model.temperature < 1e3 and loss(model.temperature) <= min(loss(0.05), loss(20.0))
    p = language.softmax(scores / model.temperature)
    assert loss(model.temperature) < 0.05 and abs((p.argmax(1) == y).mean() - p.max(1).mean()) < 0.02


def test_the_temperature_is_the_best_of_a_fine_grid():
    r = np.random.default_rng(2)
    scores, truth = r.normal(size=(300, 4)) * 3, r.integers(0, 4, 300)
    scores[np.arange(300), truth] += r.choice([1, 4, 8], 300)
    other = 1 / 302
    target = np.full((300, 4), other / 3)
    target[np.arange(300), truth] = 1 - other
    loss = lambda t: -(target * np.log(language.softmax(scores / t))).sum(1).mean()
    assert loss(language.calibrated(scores, truth)) <= min(map(loss, np.exp(np.linspace(-3, 5, 800)))) + 1e-6


def test_language_prediction_by_brute_force():
    """A model's probabilities from n-grams that are counted one by one."""
    texts = [("en", "the cat and the dog"), ("de", "der hund und die katze"), ("fr", "le chat et le chien"), ("en", "this is the house"), ("de", "das ist das haus")] * 4
    model = language.train([(y, *language.counts(t)) for y, t in texts])

    def hashed(gram):
        c = [ord(x) if x != " " else 0 for x in gram]
        m = 2**32
        h = c[0] * 0x9E3779B1 % m
        if len(c) > 1:
            h = (h ^ (c[1] + 0x7F4A7C15) % m) * 0x85EBCA6B % m
        if len(c) > 2:
            h = (h ^ (c[2] + 0x165667B1) % m) * 0xC2B2AE35 % m
        return h >> 18

    for text in ("The dog, the CAT!", "und das 12 haus", "x"):
        letters = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        letters = re.sub(" +", " ", letters)
        grams = {}
        for n in (1, 2, 3):
            for i in range(len(letters) - n + 1):
                g = letters[i : i + n]
                if g != " ":
                    grams[hashed(g)] = grams.get(hashed(g), 0) + 1
        v = {h: (1 + np.log(n)) * model.idf[h] for h, n in grams.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        z = np.array(model.bias, float)
        for h, x in v.items():
            if model.place[h] >= 0:
                z = z + x / size * model.weights[model.place[h]]
        p = np.exp(z / model.temperature) / np.exp(z / model.temperature).sum()
        lang, score = model.predict(text)
        assert lang == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-9


def test_training_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 30, "the cat %d sat %s" % (i, "on " * (i % 5)), "en", "a", 1) for i in range(90)] + [(100 + i % 30, "der hund %d lag %s" % (i, "da " * (i % 4)), "de", "a", 1) for i in range(90)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(i, 1) for i in range(10)], "doc_id long, quality int")
    models, trees = [], []
    for seed in (0, 1):
        random.Random(seed).shuffle(rows)
        docs = documents(spark, rows).repartition(3 + seed)
        models.append(language.fit_language_id(docs, rows_per_language=20))
        trees.append(quality.fit_quality(docs, labels, train_rows=25))
    assert (models[0].weights == models[1].weights).all() and models[0].temperature == models[1].temperature
    assert (trees[0].value == trees[1].value).all() and (trees[0].threshold == trees[1].threshold).all()


def test_boosting_by_brute_force():
    """Each split is the best of all, found by trying every threshold on every statistic; leaves are Newton steps."""
    r = np.random.default_rng(4)
    x = np.round(r.random((120, 4)), 1)
    y = ((x[:, 0] > 0.5) ^ (r.random(120) < 0.1)).astype(float)
    rounds, depth, rate, l2, least = 3, 2, 0.3, 1.0, 5
    trees = quality.fit_trees(x, y, rounds=rounds, depth=depth, rate=rate, l2=l2, least=least)
    margin = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, level):
            if level == depth:
                margin[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)
                return
            best, at = 1e-9, None
            for j in range(x.shape[1]):
                for t in sorted(set(x[:, j])):
                    a, b = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                    if len(a) >= least and len(b) >= least:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (a, b)) - g[rows].sum() ** 2 / (h[rows].sum() + l2)
                        if gain > best + 1e-9:
                            best, at = gain, (a, b)
            for part in at or (rows, rows[:0]):
                if len(part):
                    grow(part, level + 1)

        grow(np.arange(len(x)), 0)
    assert np.allclose(trees.margin(x), margin)


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, sf).collect()}
    rows = [(got[r["doc_id"]]["score"], r["quality"]) for r in queries.table(spark, sf, "labels").collect() if got[r["doc_id"]]["held_out"]]
    order = np.argsort([s for s, _ in rows])
    y = np.array([q for _, q in rows])[order]
    auc = (np.flatnonzero(y == 1).sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert len(y) > 500 and auc > 0.85


def test_quality_cases(spark):
    docs = documents(spark, ODD, True)
    none = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score2"] for r in quality.score_quality(docs, none, out="score2").collect()} == {0.5}
    same = quality.fit_quality(docs, spark.createDataFrame([(3, 1), (5, 1), (None, 0), (2, None)], "doc_id long, quality int"))
    assert min(r["score"] for r in quality.score_quality(docs, same).collect()) > 0.9


def test_trees_are_traversed_as_learned():
    r = np.random.default_rng(1)
    x = r.random((2000, quality.N_FEATURES)).astype(np.float32)
    y = (x[:, 3] > 0.5).astype(float)
    trees = quality.fit_trees(x, y, rounds=20)
    assert ((trees.predict(x) > 0.5) == y).mean() > 0.99
    for row in x[:20]:
        margin = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            margin += v[node - len(f)]
        assert abs(margin - trees.margin(row[None])[0]) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; line</h1><p>One <b>two</b>
  three<br>four<p>Five &#8364; &lt;six&gt;<script>var t="</p>";</script><div class="share-buttons">Share</div><form><input>Sign up</form><aside>Else</aside>
<ul><li>a<li>b</ul><section id="comments"><p>Nice!</p></section></article></main><footer>&copy; me</footer></body></html>"""


def test_page_structure():
    assert html.difference(html.lines(PAGE), None) == ["Head & line", "One two three four", "Five € <six>", "a", "b"]
    assert html.lines(None) == [] and html.lines("") == []
    assert html.difference(html.lines("just text &amp; <b>more"), None) == ["just text & more"]
    assert html.lines("<!-- x <p>no</p>") == []
    html.lines("<div>" * 20000 + "<a" * 20000)


def test_other_page_structures():
    page = '<body><div class="top-nav">Home</div><div>Crumb</div><div id="content"><div class="entry-header"><h1>Title</h1></div><p>Body<div class="post-comments"><p>me too</div></div><div class="sidebar"><p>x</div></body>'
    assert html.difference(html.lines(page), None) == ["Title", "Body"]
    page = '<div class="content"><div>wrapper</div><article class="post"><header><h1>T</h1></header><p>a<b>b</b>c</p><footer>by</footer></article></div>'
    assert html.difference(html.lines(page), None) == ["T", "abc"]
    assert html.difference(html.lines('<p>a</p><div role="alert">n</div><div style="display: none">h</div><p hidden>x</p><button>Go</button><p>z'), None) == ["a", "z"]


@pytest.mark.parametrize(
    "page",
    [
        "<body><form id='aspnetForm'><nav>Menu</nav><article><p>a</p><p>b</p></article></form></body>",
        "<body><form><div>Menu</div><div class='content'><p>a</p><p>b</p></div></form></body>",
        "<body><form><nav>Menu</nav><div>a</div><p>b</p></form></body>",
        "<body class='has-sidebar'><div>x</div><main class='no-sidebar'><p>a</p><p>b</p></main></body>",
        "<article class='post comment-open'><p>a</p><p>b</p></article>",
        "<div id='page-header'><article><p>a</p><p>b</p></article></div>",
        "<article><section id='related-work'><p>a</p></section><h2 id='social-impact'>b</h2><div class='share-buttons'>s</div><div id='comments'><article>c</article></div></article>",
    ],
)
def test_content_is_not_lost_to_loose_marks(page):
    assert html.difference(html.lines(page), None) == ["a", "b"]


def test_differencing_deletes_aligned_shared_lines():
    a = html.lines("<div>Menu</div><div>One</div><div>Two</div><div>Imprint</div>")
    b = html.lines("<div>Menu</div><div>Three</div><div>Four</div><div>Five</div><div>Imprint</div>")
    assert html.difference(a, b) == ["One", "Two"]
    assert html.difference(a, a) == ["Menu", "One", "Two", "Imprint"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcde"), max_size=12))
def test_common_is_a_longest_common_subsequence(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    got = sorted(html.common(a, b))
    rest = iter(b)
    assert len(got) == n[-1][-1] and all(a[i] in rest for i in got)


def test_reading_is_linear():
    import time

    start = time.process_time()
    for page in ("<div>" * 200000, "<div>" * 100000 + "</p>" * 100000, "<b>" * 100000 + "</i>" * 100000, "<iframe>" * 100000, "<!" * 200000, "<p><b>" * 60000, "<a =\"" * 60000, "<title>" * 100000, "<!--" * 100000, "<span class=ad>" * 60000 + "</em>" * 60000):
        html.lines(page)
    assert time.process_time() - start < 20


def test_nothing_else_is_dropped():
    page = "<article><p>a\x00b</p><p>x <math><mi>y</mi></math> z</p><noscript><p>shown</p></noscript><object><p>fallback</p></object>" + "<b>" * 5000 + "deep" + "</b>" * 5000 + "</article><noscript>Enable JavaScript</noscript>"
    assert html.difference(html.lines(page), None) == ["a\x00b", "x y z", "shown", "fallback", "deep"]


def brute_texts(pages):
    """The same rule over whole lists: pages of a host with equal lines are one, each page is paired with the nearest path that is no copy."""
    first = {}
    for _, url, page in pages:
        host, _, path = url.split("//")[1].partition("/")
        k = (host, tuple(html.lines(page)))
        first[k] = min(first.get(k, "/" + path), "/" + path)
    left = {}
    for (host, page), path in first.items():
        same = sorted((p, html.page_key(h, b"".join(html.xxh3_64_intdigest(t.encode()).to_bytes(8, "little") for t, _ in q), bytes(s for _, s in q)), q) for (h, q), p in first.items() if h == host)
        at = next(i for i, x in enumerate(same) if x[2] == page)
        near = sorted((i for i in range(len(same)) if 0 < abs(i - at) <= html.NEAR), key=lambda i: (-html._likeness(same[i][0], path), abs(i - at), i))
        texts, states = [t for t, _ in page], [s for _, s in page]
        gone = set()
        for i in near:
            other = [t for t, _ in same[i][2]]
            n = [[0] * (len(other) + 1) for _ in range(len(texts) + 1)]
            for a, x in enumerate(texts):
                for b, y in enumerate(other):
                    n[a + 1][b + 1] = n[a][b] + 1 if x == y else max(n[a][b + 1], n[a + 1][b])
            if n[-1][-1] != len(html.common(texts, other)):
                raise AssertionError
            got = html._shared(texts, states, other)
            if got is not None:
                gone = got
                break
        left[host, page] = "\n".join(texts[i] for i in html._kept(states, gone))
    return sorted((k, left[url.split("//")[1].partition("/")[0], tuple(html.lines(page))]) for k, url, page in pages)


def test_texts_match_brute_force_for_any_partitioning(spark):
    r = random.Random(5)
    pages = []
    for i in range(90):
        menu = ["<div>Menu %d</div>" % (i % 3), "<div>Home</div>"]
        body = ["<div>line %d</div>" % r.randrange(60) for _ in range(r.randrange(1, 6))]
        if i % 2 == 0:
            body = ["<article><p>story %d</p><p>more %d</p><p>free licence</p></article>" % (i // 4, i), "<nav>Home</nav>"]
        pages.append((i, "http://%s/%s/%d" % (r.choice(["a", "a", "a", "b"]), r.choice("xyz"), r.randrange(40)), "".join([*menu, *body, "<div>Imprint</div>"])))
    pages += [(100 + i, pages[0][1], pages[0][2]) for i in range(20)]
    want = brute_texts(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = html.extract_text(df.repartition(int(n))).collect()
            assert sorted((r["page_id"], r["text"]) for r in got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["n_shared"] for r in got) > 100 and any(r["n_vetoed"] for r in got)


def test_pages_query(spark):
    pages = spark.createDataFrame([(1, "http://h/a/1", "<div>M</div><div>x y</div><div>F</div>"), (2, "http://h/a/2", "<div>M</div><div>z</div><div>w</div><div>F</div>"), (3, None, None), (3, None, None), (4, "http://other/", "<p>alone</p>")], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("no"))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_text(pages.coalesce(1)).collect())
    assert [g for g in got if g[0] > 2] == [(3, "", 0), (3, "", 0), (4, "alone", 5)]
    assert len(got) == 5 and all(len(t) == n for _, t, n in got)
    assert html.extract_text(pages.limit(0)).count() == 0
    sf = "/root/testdata/sf0.01"
    want = {tuple(" ".join(x.split()) for x in r["text"].split("\n")) for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = queries.op2_html(spark, sf).collect()
    assert sum(tuple(r["text"].split("\n")[1:]) in want for r in got) == len(got) == 250
