"""Names and addresses, one noise class a row."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions import text
from matchloom.functions.indic import transliterate

NAMES = [
    ("Acme Widgets Pvt. Ltd.", "acme widgets"),
    ("ACME  Widgéts LLC", "acme widgets"),
    ("A. B. C. Stores", "abc stores"),
    ("Shri Ganesh & Sons", "ganesh and sons"),
    ("O'Neil’s Bakery", "oneils bakery"),
    ("Widgets Widgets Inc", "widgets"),
    ("Ltd Co", "ltd co"),
    ("www.acme-widgets.com", "acme widgets"),
    ("Acme (ID: 4471) Works", "acme works"),
    ("Acme (North Wing)", "acme north wing"),
    ("", ""),
    (None, ""),
]


@pytest.fixture(scope="module")
def named(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NAMES)] + [(100, "Global Foods Ltd t/a Joe's Diner"), (101, "Global Foods dba Joes Diner Inc")], "i int, raw string")
    return {r["i"]: r["n"] for r in text.normalize_name(df, "raw", "n").collect()}


@pytest.mark.parametrize("i", range(len(NAMES)))
def test_core(named, i):
    assert named[i]["core"] == NAMES[i][1]


def test_trade_names(named):
    assert named[100]["dba"] == "joes diner" and named[100]["core"] == "global foods joes diner"
    assert named[101]["dba"] == "joes diner"
    assert named[0]["dba"] == "" and named[7]["is_domain"] and not named[0]["is_domain"]


def test_addresses(spark):
    rows = [
        (1, "US", "12B Main St, Suite 400, Springfield, CA 90210"),
        (2, "US", "12 Washington Ave, Boston, massachusetts"),
        (3, "India", "Plot 7, MG Rd, Pune, महाराष्ट्र 411001"),
        (4, "France", "5 rue de l'Église, 75011 Paris"),
        (5, "US", ""),
        (6, "US", None),
        (7, "US", "Reno, NV 89501, 00025 Oak Blvd"),
    ]
    got = {r["i"]: r["a"] for r in text.normalize_address(spark.createDataFrame(rows, "i int, country string, raw string"), "raw", "country", "a").collect()}
    assert (got[1]["state"], got[1]["city"], got[1]["postal"], got[1]["house"]) == ("ca", "springfield", "90210", "12")
    assert got[1]["addr"] == "12 b main street 400 springfield ca 90210"
    assert (got[2]["state"], got[2]["city"]) == ("ma", "boston") and "washington" in got[2]["addr"]
    assert (got[3]["state"], got[3]["city"], got[3]["postal"], got[3]["house"]) == ("mh", "pune", "411001", "7")
    assert (got[4]["state"], got[4]["postal"], got[4]["house"]) == ("", "75011", "5")
    assert tuple(got[5]) == tuple(got[6]) == ("",) * 6
    assert (got[7]["state"], got[7]["city"]) == ("nv", "reno")


def test_house_numbers(spark):
    df = spark.createDataFrame([("25", "025"), ("25", "25"), ("25", "26"), ("0", "00")], "a string, b string")
    assert [r[0] for r in df.select(text.pad_equal(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


@pytest.mark.parametrize("word,latin", [("नमस्ते", "namaste"), ("राम", "raam"), ("गणेश", "ganesh"), ("१२३", "123"), ("தமிழ்", "tamil"), ("abc", "abc"), ("दिल्ली store", "dillii store")])
def test_romanisation(word, latin):
    assert transliterate(word) == latin


def test_fold_and_indic(spark):
    df = spark.createDataFrame([("Café ＡＢ",), ("गणेश Stores",), (None,)], "x string")
    assert [tuple(r) for r in df.select(text.base_clean("x"), text.has_indic("x")).collect()] == [("cafe ab", False), ("ganesh stores", True), ("", False)]


def test_skeletons(spark):
    df = spark.createDataFrame([("bhagat",), ("pagat",), ("ganesh",), ("kanes",), ("aaa",), ("",)], "x string")
    got = [r[0] for r in df.select(text.skeleton(F.col("x"))).collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[4] == "a" and got[5] == ""


def test_skeletons_of_numbers_and_sounds(spark):
    want = {"1100": "1100", "55": "55", "hospitality": "hsptlt", "hospitailiti": "hsptlt", "xerox": "krk", "john": "khn", "jon": "kn", "whale": "vhl", "a11b": "a1p", "wine": "vn", "f" + "bc" * 2000: "p" + "pk" * 2000}
    want["f" + "bc" * 2000] = "pk" * 2000
    df = spark.createDataFrame([(w,) for w in want], "x string")
    assert {r["x"]: r["k"] for r in df.select("x", text.skeleton(F.col("x")).alias("k")).collect()} == want


def test_state_inside_a_chunk(spark):
    rows = [(1, "US", "5 Main St Boston Massachusetts 02101"), (2, "India", "7 MG Road Pune Maharashtra India"), (3, "US", "9 Oregon Trail near New York city"), (4, "France", "1 rue de Texas"), (5, "US", "9 Oregon Trail, CA"), (6, "US", "ste 400 Elm Road, Puerto Rico"), (7, "India", "1 A, Uttaranchal"), (8, "US", "1 " + "2 " * 1500 + "90210")]
    got = {r["i"]: r["a"] for r in text.normalize_address(spark.createDataFrame(rows, "i int, country string, raw string"), "raw", "country", "a").collect()}
    assert (got[1]["state"], got[1]["addr"], got[1]["city"]) == ("ma", "5 main street boston ma 02101", "")
    assert (got[2]["state"], got[2]["addr"]) == ("mh", "7 mg road pune mh india")
    assert (got[3]["state"], got[3]["addr"]) == ("ny", "9 or trail near ny city") and got[4]["state"] == ""
    assert (got[5]["state"], got[5]["addr"]) == ("ca", "9 oregon trail ca") and (got[6]["state"], got[6]["addr"]) == ("pr", "400 elm road pr")
    assert got[7]["state"] == "uk" and got[8]["postal"] == "90210"


@pytest.mark.parametrize("raw,core", [("Acme id 123 Works", "acme works"), ("Acme Ref: 77", "acme"), ("Global a k a Local Shop", "global local shop"), ("प्राइम प्राइवेट लिमिटेड", "praaim"), ("Dupont EURL", "dupont"), ("Idea 5 Lab", "idea 5 lab")])
def test_tags_and_legal_forms(spark, raw, core):
    assert text.normalize_name(spark.createDataFrame([(raw,)], "raw string"), "raw", "n").first()["n"]["core"] == core


@pytest.mark.parametrize("word,latin", [("गणेश, ग", "ganesha, g"), ("মুম্বই", "mumbai"), ("ಕರ್ನಾಟಕ", "karnaatak"), ("ज्ञान", "jnyaan"), ("अंग", "ang"), ("ൻ ൽ ൿ", "n l k"), ("ଓଡ଼ିଶା", "odishaa"), ("कृष्ण", "krishn"), ("॥ ॐ", " "), ("०९", "09")])
def test_romanisation_by_names(word, latin):
    assert transliterate(word) == latin


def test_older_normalisation(spark):
    df = spark.createDataFrame([("Acme Inc. & Co", "12 N St, Apt 4"), (None, None), ("Foo, LLC", "ＡＢ Rd")], "business_name string, business_address string")
    got = [(r["norm_name"], r["norm_name_no_suffix"], r["norm_address"]) for r in text.simple_normalised(df).collect()]
    assert got == [("acme incorporated and company", "acme and", "12 n street apartment 4"), ("", "", ""), ("foo limited liability company", "foo", "ab road")]


def test_older_cleaner(spark):
    df = spark.createDataFrame([("Foo & Bar, Limited Liability Company",), ("Größe GmbH",), (None,)], "x string")
    clean = text.simple_clean("x")
    assert [tuple(r) for r in df.select(clean, text.remove_legal_suffixes(clean)).collect()] == [("foo and bar limited liability company", "foo and bar"), ("größe gmbh", "größe"), ("", "")]
    assert spark.createDataFrame([("12 North Street East",)], "x string").select(text.simple_clean("x", text.SIMPLE_ADDRESS)).first()[0] == "12 n st e"
