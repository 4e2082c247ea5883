from pyspark.sql import functions as F

from matchloom.plans import resolve
from matchloom.sources import io

HEAD = "entity_id\tcountry\tbusiness_name\tbusiness_address\n"


def test_tsv_scans(spark, tmp_path):
    f = tmp_path / "a.tsv"
    f.write_text(HEAD + 'S1-2\t US \tThe "Quoted\t\nS1-1\tIndia\tNA\t12, x\n\nS1-1\tIndia\tNA\t12, x\n')
    rows = [tuple(r) for r in io.read_tsv(spark, str(f)).orderBy("entity_id").collect()]
    assert rows == [("S1-1", "India", "NA", "12, x")] * 2 + [("S1-2", "US", 'The "Quoted', "")]
    assert io.read_first(spark, str(f), 1).first()["entity_id"] == "S1-1"
    assert {r["id"] for r in io.read_ids(spark, str(f)).collect()} == {"S1-1", "S1-2"}
    (tmp_path / "b.tsv").write_text("a\tb\n1\t\n2\tx\n")
    inferred = io.read_tsv_inferred(spark, str(tmp_path / "b.tsv"))
    assert dict(inferred.dtypes) == {"a": "int", "b": "string"} and inferred.where("b is null").count() == 1


def test_written_lists_read_back(spark, tmp_path):
    s = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    chosen = spark.createDataFrame([("S1-1", "S3-9"), ("S1-1", "S2-1"), ("S1-1", "S2-1"), ("S1-3", "S2-5")], "s string, t string")
    io.write_lists(io.match_lists(s, chosen), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-9\nS1-2\t\nS1-3\tS2-5\n"
    io.write_tsv(s, str(tmp_path / "plain"))
    assert spark.read.csv(str(tmp_path / "plain"), sep="\t", header=True).count() == 3


def test_steps_are_made_once_and_remade_when_inputs_change(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    where = str(tmp_path / "step")
    assert io.materialised(spark, where, make, "a").count() == 1
    assert io.materialised(spark, where, make, "a").count() == 1 and len(made) == 1
    assert io.materialised(spark, where, make, "b").count() == 2 and len(made) == 2


def test_paths_follow_the_environment(monkeypatch):
    monkeypatch.setenv("MATCHLOOM_WORK_DIR", "/w")
    paths = io.Paths.from_environment(data="/d")
    assert paths.raw("train", 2) == "/d/train_source2.tsv" and paths.normalised("test", 1) == "/w/norm/test_source1.parquet" and paths.table("a", "b") == "/w/a/b"


def test_scores_are_corrected_by_country_and_segment(spark):
    rows = [(2, f"s{i}", f"t{i}", 0.1 + 0.8 * (i % 10) / 10, i % 3 == 0, i % 2, None if i % 5 == 0 else i % 2) for i in range(200)]
    pairs = spark.createDataFrame([(*r[:4], int(r[4]), r[5], r[6]) for r in rows], "src int, s string, t string, p2 double, label int, addr_empty_b int, house_eq int")
    s = spark.createDataFrame([(f"s{i}", "US" if i % 4 else "FR") for i in range(200)], "id string, country string")
    known = resolve.with_country(pairs, s)
    for by_segment in (True, False):
        got = resolve.corrected(known, known.where("country = 'US'"), by_segment).collect()
        assert len(got) == 200 and all(0 <= r["p_adj"] <= 1 for r in got)
        assert all(r["p_adj"] == r["p2"] for r in got if r["country"] == "FR")


def test_staged_tables_leave_the_session_as_it_was(spark):
    from types import SimpleNamespace

    import pytest

    from matchloom.sources import stage

    before = dict(spark.sparkContext._conf.getAll()), {k: spark.conf.get(k, None) for k in (stage._CLEANUP, stage._ARROW)}
    table = stage.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert table.count() == 7 and before == (dict(spark.sparkContext._conf.getAll()), {k: spark.conf.get(k, None) for k in (stage._CLEANUP, stage._ARROW)})
    stage.dropped(table)
    assert not io.exists(spark, table._staged)
    with pytest.raises(ValueError), stage.option(spark, stage._ARROW, "1000"):
        raise ValueError
    assert spark.conf.get(stage._ARROW, None) == before[1][stage._ARROW]
    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://there:7077"))
    with pytest.raises(RuntimeError, match="share"):
        stage.shared_dir(away)


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    from matchloom.operators import validate

    folder = tmp_path / "parts"
    folder.mkdir()
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (folder / "part-0.tsv").write_text("\n".join(lines[:3000]) + "\n")
    (folder / "part-1.tsv").write_text("\n".join(lines[3000:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        got = {r["line"]: r["value"] for r in validate.numbered_lines(spark, str(folder)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(lines, 1))


def test_a_sample_is_the_lowest_hashes(spark):
    from matchloom.operators import folds

    df = spark.range(3000).withColumnRenamed("id", "s")
    for n in (0, 1, 700, 3000, 5000):
        want = {r["s"] for r in df.orderBy(folds.bucket(F.col("s"), "sample"), "s").limit(n).collect()}
        assert {r["s"] for r in folds.sample(df, "s", n).collect()} == want
