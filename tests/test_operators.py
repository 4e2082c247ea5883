import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import similarity as sim
from matchloom.operators import context, decide, difference, folds, legacy_blocking, models, shift, validate
from matchloom.plans import resolve
from matchloom.sources import io

WORDS = st.text("abc ", max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_ratios(a, b):
    assert sim.lcs(a, b) == lcs(a, b)

    def best(short, long):
        n = len(short)
        windows = [long[max(0, e - n) : min(len(long), e)] for e in range(1, len(long) + n)]
        return max(2 * lcs(short, w) / (n + len(w)) for w in windows) if short else float(not long)

    want = max(best(x, y) for x, y in ((a, b), (b, a)) if len(x) <= len(y))
    assert sim.partial_ratio(a, b) == pytest.approx(want)
    for f in sim.KERNELS.values():
        assert 0 <= f(a, b) <= 1 + 1e-12 and f(a, b) == pytest.approx(f(b, a))
        assert f(a, a) == 1.0


def plain_ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a + b else 1.0


def plain_stretch(a, b):
    """The shorter string against each window of the longer, at the ends shorter windows too."""
    out = []
    for x, y in ((a, b), (b, a)):
        if len(x) <= len(y):
            windows = {y[i:j] for i in range(len(y) + 1) for j in range(i + 1, len(y) + 1) if j - i == len(x) or j - i < len(x) and (i == 0 or j == len(y))}
            out += [plain_ratio(x, w) for w in windows] if x else [float(not y)]
    return max(out)


def plain_kernels(a, b):
    """Each kernel from its definition, on sorted words and sets of words."""
    x, y = sorted(a.split()), sorted(b.split())
    both, only_x, only_y = (" ".join(sorted(s)) for s in (set(x) & set(y), set(x) - set(y), set(y) - set(x)))
    joined = [" ".join(filter(None, (both, s))) for s in (only_x, only_y)]
    out = {"ratio": plain_ratio(a, b), "partial": plain_stretch(a, b), "tsort": plain_ratio(" ".join(x), " ".join(y)), "ptset": 1.0 if both else plain_stretch(only_x, only_y)}
    out["tset"] = float(not x and not y) if not x or not y else 1.0 if both and not (only_x and only_y) else max([plain_ratio(*joined), *(plain_ratio(both, j) for j in joined if both)])
    if not a or not b:
        out["wratio"] = float(a == b)
    else:
        far = max(len(a), len(b)) / min(len(a), len(b))
        scale = 0.9 if far < 8 else 0.6
        out["wratio"] = max(out["ratio"], 0.95 * out["tsort"], 0.95 * out["tset"]) if far < 1.5 else max(out["ratio"], scale * out["partial"], 0.95 * scale * max(plain_stretch(" ".join(x), " ".join(y)), out["ptset"]))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["ab", "b", "abc", "ca", "acb", "bb"]), max_size=4).map(" ".join), st.lists(st.sampled_from(["ab", "b", "abc", "ca", "cab", "bb"]), max_size=4).map(" ".join))
def test_kernels_follow_their_definitions(a, b):
    want = plain_kernels(a, b)
    assert {k: sim.KERNELS[k](a, b) for k in want} == pytest.approx(want)


def test_string_features_by_brute_force(spark):
    """The 21 string features of random pairs of records, from the definitions of fields and kernels."""
    from matchloom.operators import features

    r = random.Random(3)
    words = ["acme", "blue", "store", "stores", "main", "12", "7", "street", "x"]
    fields = ("name_core", "name_full", "name_dba", "name_skel", "addr", "nums", "city", "state", "postal", "house")
    sides = [[{f: " ".join(r.choices(words, k=r.randrange(4))) for f in fields} | {"is_domain": False, "name_indic": False} for _ in range(60)] for _ in "ab"]
    rows = [{"i": i} | {f"a_{k}": v for k, v in a.items()} | {f"b_{k}": v for k, v in b.items()} for i, (a, b) in enumerate(zip(*sides))]
    got = {g["i"]: g for g in features.pair_features(spark.createDataFrame(rows)).collect()}
    for i, (a, b) in enumerate(zip(*sides)):
        run = lambda kernel, x, y: (sim.jaro_winkler(x, y) if kernel == "jw" else plain_kernels(x, y)[kernel])
        address = lambda kernel, f: run(kernel, a[f], b[f]) if b["addr"] else None
        name = {k: run(k, a["name_core"], b["name_core"]) for k in ("ratio", "partial", "tset", "tsort", "jw", "wratio")}
        packed = [s["name_core"].replace(" ", "") for s in (a, b)]
        first = [(s["name_core"].split() or [""])[0] for s in (a, b)]
        dba = [x for x in (run("tset", a["name_dba"], b["name_core"]) if a["name_dba"] else None, run("tset", a["name_core"], b["name_dba"]) if b["name_dba"] else None) if x is not None]
        want = {f"name_{k}": v for k, v in name.items()} | {
            "namecat_ratio": run("ratio", *packed), "namecat_partial": run("partial", *packed), "skel_ratio": run("ratio", a["name_skel"], b["name_skel"]), "skel_tset": run("tset", a["name_skel"], b["name_skel"]),
            "namefull_tset": run("tset", a["name_full"], b["name_full"]), "first_tok_jw": run("jw", *first), "dba_tset": max(dba) if dba else None,
            "addr_ratio": address("ratio", "addr"), "addr_tset": address("tset", "addr"), "addr_tsort": address("tsort", "addr"), "addr_partial": address("ptset", "addr"),
            "nums_tset": address("tset", "nums"), "nums_tsort": address("tsort", "nums"), "city_jw": run("jw", a["city"], b["city"]) if a["city"] and b["city"] else None,
        }
        want["name_x_addr"] = name["tset"] * (0.5 if want["addr_tset"] is None else want["addr_tset"])
        assert len(want) == 21 and {k: got[i][k] for k in want} == pytest.approx(want, nan_ok=True)


def test_published_examples():
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert sim.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert sim.ratio("this is a test", "this is a test!") == pytest.approx(0.9655, abs=1e-4)
    assert sim.partial_ratio("this is a test", "this is a test!") == 1.0
    assert sim.token_sort("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == 1.0
    assert sim.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0


def pairs(spark, seed=0, n=120):
    r = random.Random(seed)
    rows = {(r.choice([2, 3]), r.randrange(20), r.randrange(15)): (r.random(), r.random(), int(r.random() < 0.3)) for _ in range(n)}
    return spark.createDataFrame([(*k, *v) for k, v in rows.items()], "src int, s long, t long, p1 double, p double, label int"), rows


def test_expected_f_is_the_best_prefix(spark):
    df, rows = pairs(spark)
    miss, alpha, least = 0.05, 1.2, 0.2
    got = {(r["src"], r["s"], r["t"]) for r in decide.expected_f(df, miss, alpha, least).collect()}
    want = set()
    for s in {k[1] for k in rows}:
        own = sorted(((-v[1], k) for k, v in rows.items() if k[1] == s and v[1] > least))
        p = [-x for x, _ in own]
        n = sum(p) / (1 - miss)
        value = [1.25 * sum(p[: j + 1]) / (0.25 * n + j + 1) for j in range(len(p))]
        if p and max(value) > alpha * math.prod(1 - x for x in p) * (1 - miss):
            stop = next(j for j, v in enumerate(value) if v >= max(value) - 1e-12)
            want |= {k for _, k in own[: stop + 1]}
    assert got == want


def test_exclusive_and_context(spark):
    df, rows = pairs(spark, 1)
    kept = decide.exclusive(df).collect()
    assert len({(r["src"], r["t"]) for r in kept}) == len(kept) == len({(k[0], k[2]) for k in rows})
    ranked = context.group_stats(df, ["src", "t"], "p", ["s"]).collect()
    for _, group in itertools.groupby(sorted(ranked, key=lambda r: (r["src"], r["t"])), lambda r: (r["src"], r["t"])):
        group = list(group)
        assert sorted(r["rank"] for r in group) == list(range(len(group)))
        assert all((r["second"] is None) == (len(group) == 1) for r in group)


def test_em_prior_is_a_fixed_point(spark):
    r = random.Random(0)
    rows = spark.createDataFrame([(1, r.random() ** 2, int(r.random() < 0.4)) for _ in range(500)] + [(2, 0.5, 0), (2, 0.7, 0)], "g int, p double, label int")
    got = {x["g"]: (x["prior"], x["target"]) for x in shift.em_prior(rows, shift.priors(rows, ["g"]), ["g"]).collect()}
    prior, target = got[1]
    mean = rows.where("g = 1").select(F.avg(shift.adjust(F.col("p"), F.lit(prior), F.lit(target)))).first()[0]
    assert mean == pytest.approx(target, abs=1e-6)
    assert got[2][0] == 0 and 0 <= got[2][1] <= 1


def test_log_odds(spark):
    rows = spark.createDataFrame([(["a", "a", "b"], 1), (["a"], 1), (["a", "c"], 0), (["b"], 0), (["b"], 0), ([], 1)], "w array<string>, label int")
    got = {r["word"]: r["lo"] for r in difference.fit_log_odds(rows, "w").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"] == pytest.approx((math.log(2.5 / 1.5) - math.log(3 / 3)) * 3 / 13)


def test_word_matching():
    assert difference.unmatched("acme wigdets store", "akm wktts str", "acme widgets stores", "akm wtkts strs") == ([], [])
    assert difference.unmatched("acme blue", "akm pl", "acme red", "akm rt") == (["blue"], ["red"])
    assert difference.unmatched("", "", "a", "a") == ([], ["a"])


def test_folds_and_samples(spark):
    df = spark.range(2000).withColumnRenamed("id", "s")
    counts = {r[0]: r[1] for r in df.groupBy(folds.fold(F.col("s"))).count().collect()}
    assert 500 < counts["A"] < 700 and 500 < counts["B"] < 700 and None in counts
    dropped = folds.drop_sample(df, "s", 0.05)
    assert dropped.count() == 100 and dropped.where(folds.fold(F.col("s")).isNotNull()).count() == 0


def test_row_ids(spark):
    for keys in (["k%03d" % (i * 7 % 500) for i in range(500)], [], ["a", "a", "b"]):
        got = io.with_row_id(spark.createDataFrame([(k,) for k in keys], "entity_id string")).collect()
        assert sorted(r["row_id"] for r in got) == list(range(len(keys)))
        assert [r["entity_id"] for r in sorted(got, key=lambda r: r["row_id"])] == sorted(keys)


def test_missing_join_partner_raises(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no partner"):
        folds.complete_join(a, b, ["k"], "v").collect()


def test_model_takes_missing_values(spark, tmp_path):
    r = random.Random(0)
    rows = [(2, i, i, int(x > 0.5), "A" if i % 2 else "B", None if i % 7 == 0 else x, float("nan") if i % 5 == 0 else 1.0) for i in range(300) for x in [r.random()]]
    df = spark.createDataFrame(rows, "src int, s long, t long, label int, fold string, x double, y double")
    settings_ = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3}
    a, b = models.fit_two(df, ["x", "y"], settings_)
    got = models.score_two(df, (a, b)).collect()
    assert sum((q["p_a"] > 0.5) == q["label"] for q in got if q["x"] is not None) / sum(q["x"] is not None for q in got) > 0.9
    a.save(str(tmp_path / "m"))
    again = models.Scorer.load(spark, str(tmp_path / "m")).score(df, "p_a").collect()
    assert [q["p_a"] for q in again] == [q["p_a"] for q in a.score(df, "p_a").collect()]


HEAD = "source1_entity_id\tmatched_entity_ids\n"


@pytest.mark.parametrize("content,rules", [
    (HEAD + "S1-1\tS2-1,S3-2\nS1-2\t\n", set()),
    ("", {"empty_file"}),
    ("a,b\n", {"comma_separated"}),
    ("x\ty\nS1-1\t\nS1-2\t\n", {"wrong_header"}),
    (HEAD + "S1-1\nS1-2\t\n", {"row_without_tab", "missing_row"}),
    (HEAD + "S1-1\t\nS1-1\t\nS1-2\t\n", {"duplicate_row"}),
    (HEAD + "S1-1\tS2-1,S2-1\nS1-2\t\n", {"repeated_id"}),
    (HEAD + "S1-1\tS1-2\nS1-2\t\n", {"source1_id_in_list"}),
    (HEAD + "S1-1\tX9\nS1-2\t\n", {"bad_prefix"}),
    (HEAD + "S1-1\tS2-77\nS1-2\t\n", {"unknown_id"}),
    (HEAD + "S1-1\t\n", {"missing_row"}),
    (HEAD + "S1-1\t\nS1-2\t\nS1-9\t\n", {"unexpected_row"}),
    (HEAD.encode() + b"S1-1\tS2-\xff\nS1-2\t\n", {"not_utf8", "unknown_id"}),
])
def test_validator(spark, tmp_path, content, rules):
    f = tmp_path / "m.tsv"
    f.write_bytes(content if isinstance(content, bytes) else content.encode())
    need = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    known = spark.createDataFrame([("S2-1",), ("S3-2",)], "entity_id string")
    found = validate.validate(spark, str(f), need, known=known)
    assert {r["rule"] for r in found.collect()} == rules
    assert validate.exit_code(found) == int(bool(rules))


def test_validator_compares_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text(HEAD + "S1-1\tS2-1,S2-2\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\n")
    need = spark.createDataFrame([("S1-1",)], "entity_id string")
    found = validate.validate(spark, str(tmp_path / "m.tsv"), need, str(tmp_path / "c.tsv")).collect()
    assert [(r["rule"], r["severity"], r["examples"]) for r in found] == [("not_a_candidate", "warning", ["S1-1"])]
    assert {r["rule"] for r in validate.validate(spark, str(tmp_path / "none"), need).collect()} == {"no_such_file"}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "entity_id string, country string, name string, addr string")
    some = spark.createDataFrame([("1", "US", "acme stores", "12 main street")], none.schema)
    for s, t in ((none, some), (some, none)):
        assert legacy_blocking.all_blocks(s, t).count() == 0
    assert [tuple(r) for r in legacy_blocking.candidate_lists(some, spark.createDataFrame([], "s string, t string")).collect()] == [("1", "")]


def made_split(folder, split, seed, n, orphans):
    """TSV files of records with typical noise; the share ``orphans`` of targets belongs to records that are not there. Returns the truth's lines."""
    r = random.Random(seed)
    names = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(200)]
    files, truth = {1: [], 2: [], 3: []}, []
    for i in range(n):
        name, street = f"{r.choice(names)} {r.choice(names)}", f"{r.randrange(1, 900)} {r.choice(names)} street, {r.choice(names)}, CA {90000 + i}"
        there = r.random() >= orphans
        if there:
            files[1].append(f"S1-{i}\tUS\t{name.title()} Inc\t{street}")
            truth.append(f"S1-{i}\tS2-{i},S3-{i}")
        files[2].append(f"S2-{i}\tUS\t{name.upper()} LLC\t{street.replace('street', 'st')}")
        files[3].append(f"S3-{i}\tUS \tThe {name}\t{'' if i % 9 == 0 else street}")
    for k, rows in files.items():
        (folder / f"{split}_source{k}.tsv").write_text("entity_id\tcountry\tbusiness_name\tbusiness_address\n" + "\n".join(rows) + "\n")
    return truth


def test_models_of_one_split_resolve_another(spark, tmp_path, monkeypatch):
    """Train, keep, load, score a split with more orphans, correct, decide by the tuned rule, write, validate, by the command line too."""
    from matchloom import __main__ as cli

    (tmp_path / "truth.tsv").write_text(HEAD + "\n".join(made_split(tmp_path, "train", 1, 90, 0.0)) + "\n")
    want = {(line.split("\t")[0], t) for line in made_split(tmp_path, "test", 2, 80, 0.4) for t in line.split("\t")[1].split(",")}
    paths = io.Paths(str(tmp_path), str(tmp_path / "work"), str(tmp_path / "out"))
    small = {"maxIter": 10, "maxDepth": 3, "stepSize": 0.6}  # sharp enough for the priors to be told
    for settings_ in (models.STAGE1, models.STAGE2):
        for k in list(settings_):
            monkeypatch.delitem(settings_, k)
        for k, v in small.items():
            monkeypatch.setitem(settings_, k, v)
    measured = resolve.train(spark, paths, str(tmp_path / "truth.tsv"), ablation=True)
    assert 0 <= measured["tuned"] <= 1 and 0 <= measured["honest"] <= 1 and 0 <= measured["without_differences"] <= 1
    rule = io.read_json(spark, paths.table("models", "decision"))
    assert rule["exclusive"] and rule["kind"] in ("threshold", "threshold_top", "expected_f")
    assert spark.read.parquet(paths.table("models", "priors")).count() > 0 and spark.read.parquet(paths.table("models", "log_odds_miss")).columns == ["apply_fold", "word", "lo"]
    assert set(io.read_json(spark, paths.table("models", "features"))) == {"stage1", "stage2"}
    before = (tmp_path / "work" / "features" / "train.fingerprint").stat().st_mtime
    chosen = {(r["s"], r["t"]) for r in resolve.resolve(spark, paths, "test").collect()}
    assert len(chosen & want) / len(chosen) > 0.8 and len(chosen & want) / len(want) > 0.6
    assert cli.main(["score", "--data", paths.data, "--work", paths.work, "--output", paths.output, "--split", "test", "--matching-only"]) == 0
    assert not (tmp_path / "out" / "test_candidates.tsv").exists()
    lists = {(r[0], t) for r in io.read_tsv(spark, f"{paths.output}/test_matching.tsv", io.TRUTH).collect() for t in r[1].split(",") if t}
    assert lists == chosen
    checked = ["validate", f"{paths.output}/test_matching.tsv", "--source1", paths.raw("test", 1), "--targets", paths.raw("test", 2), paths.raw("test", 3)]
    assert cli.main(checked) == 0 and cli.main([*checked[:3], paths.raw("train", 2)]) == 1
    # Other inputs in the same folders are seen, unchanged ones are not read anew.
    made_split(tmp_path, "test", 3, 30, 0.4)
    again = {r["s"] for r in resolve.resolve(spark, paths, "test").collect()}
    assert again and all(int(s[3:]) < 30 for s in again)
    assert (tmp_path / "work" / "features" / "train.fingerprint").stat().st_mtime == before


def test_blocking_reports(spark, tmp_path, capsys):
    from matchloom import __main__ as cli

    truth = made_split(tmp_path, "train", 4, 60, 0.1)
    (tmp_path / "truth.tsv").write_text(HEAD + "\n".join(truth) + "\n")
    folders = ["--data", str(tmp_path), "--work", str(tmp_path / "work"), "--output", str(tmp_path / "out")]
    assert cli.main(["blocking", *folders, "--truth", str(tmp_path / "truth.tsv")]) == 0
    report = io.read_json(spark, f"{tmp_path}/work/reports/blocking_train")
    assert {r["value"] for r in report["recall"] if r["metric"] == "union"} == {1.0} and len(report["sweep"]) == 32 and len(report["quantiles"]) == 2
    capsys.readouterr()
    assert cli.main(["older-blocking", *folders]) == 0
    assert "n_pairs" in capsys.readouterr().out
    lists = spark.read.csv(str(tmp_path / "out" / "train_older_candidates.tsv"), sep="\t", header=True).collect()
    found = {(r["source1_entity_id"], t) for r in lists for t in (r["candidate_entity_ids"] or "").split(",")}
    assert len(lists) == len(truth) and all((f"S1-{r['source1_entity_id'][3:]}", f"S2-{r['source1_entity_id'][3:]}") in found for r in lists)


def test_end_to_end(spark, tmp_path):
    """TSV files to validated lists: copies of a record with typical noise find each other."""
    r = random.Random(0)
    names = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(200)]
    header = "entity_id\tcountry\tbusiness_name\tbusiness_address\n"
    files, truth = {1: [], 2: [], 3: []}, []
    for i in range(90):
        name, street = f"{r.choice(names)} {r.choice(names)}", f"{r.randrange(1, 900)} {r.choice(names)} street, {r.choice(names)}, CA {90000 + i}"
        files[1].append(f"S1-{i}\tUS\t{name.title()} Inc\t{street}")
        files[2].append(f"S2-{i}\tUS\t{name.upper()} LLC\t{street.replace('street', 'st')}")
        files[3].append(f"S3-{i}\tUS \tThe {name}\t{'' if i % 9 == 0 else street}")
        truth.append(f"S1-{i}\tS2-{i},S3-{i}")
    for n, rows in files.items():
        (tmp_path / f"train_source{n}.tsv").write_text(header + "\n".join(rows) + "\n")
    (tmp_path / "truth.tsv").write_text(HEAD + "\n".join(truth) + "\n")
    paths = io.Paths(str(tmp_path), str(tmp_path / "work"), str(tmp_path / "out"))
    small = {"maxIter": 3, "maxDepth": 3, "stepSize": 0.5}
    keep = models.STAGE1.copy(), models.STAGE2.copy()
    models.STAGE1.clear(), models.STAGE2.clear()
    models.STAGE1.update(small), models.STAGE2.update(small)
    try:
        chosen = resolve.run(spark, paths, "train", str(tmp_path / "truth.tsv")).collect()
    finally:
        models.STAGE1.update(keep[0]), models.STAGE2.update(keep[1])
    right = sum(c["s"][3:] == c["t"][3:] for c in chosen)
    assert right / max(1, len(chosen)) > 0.9 and right > 120
    lists = io.read_tsv(spark, f"{paths.output}/train_matching.tsv", io.TRUTH)
    assert lists.count() == 90
    assert io.read_json(spark, f"{paths.output}/train_findings")["exit_code"] == 0
