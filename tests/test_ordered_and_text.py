import random
import unicodedata

from pyspark.sql import functions as F

from tripleloom.functions import naming
from tripleloom.functions.text import iso_micros, letters_digits, squeeze, strip, utc_text
from tripleloom.operators.ordered import sequence


def test_letters_digits_matches_unicode_rules(spark):
    texts = ["État é", "Straße İx", "a-b_c|d", "", None, "  ", "日本 12", "é", "１２ ²"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(letters_digits(F.col("t"))).collect()]
    want = [None if t is None else "".join(c for c in unicodedata.normalize("NFC", t).lower() if unicodedata.category(c)[0] in "LN") for t in texts]
    assert got == want


def test_times(spark):
    texts = ["2021-01-01T06:55:37+02:00", "2021-01-01 06:55:37", "2021-01-01", "2021-01-01T00:00:00.5Z", " 2021-01-01T00:00:00-0530 ", "soon", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(utc_text(iso_micros(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).collect()]
    assert got == ["2021-01-01T04:55:37Z", "2021-01-01T06:55:37Z", "2021-01-01T00:00:00Z", "2021-01-01T00:00:00Z", "2021-01-01T05:30:00Z", None, None, None]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert [r[0] for r in df.select(utc_text(iso_micros(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss'Z'")).collect()] == got
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_squeeze_and_strip(spark):
    r = spark.createDataFrame([("　A  b\t",)], "t string").select(squeeze(F.col("t")), strip(F.col("t"))).first()
    assert tuple(r) == ("a b", "A  b")


def test_sequence_over_partition_borders(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(1000)) for _ in range(300)]
    rows = list(dict.fromkeys(rows))
    got = {r["pos"]: (r["k"], r["o"], r["next_o"]) for r in sequence(spark.createDataFrame(rows, "k string, o int"), ["k"], ["o"], "o", n=7).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted(got) == list(range(len(rows)))
    for i, (k, o) in enumerate(ordered):
        nxt = ordered[i + 1] if i + 1 < len(ordered) else (object(), None)
        assert got[i] == (k, o, nxt[1] if nxt[0] == k else None)


def test_sequence_of_nothing(spark):
    assert sequence(spark.createDataFrame([], "k string, o int"), ["k"], ["o"], "o").collect() == []


def test_jaro_winkler_known_values():
    for a, b, v in [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("dwayne", "duane", 0.84), ("", "", 0.0), ("a", "a", 1.0), ("abc", "xyz", 0.0)]:
        assert abs(naming.jaro_winkler_value(a, b) - v) < 1e-4


def test_metaphone_and_initials(spark):
    assert naming.metaphone_value("deepwalk") == naming.metaphone_value("deep walk")
    assert naming.metaphone_value("phone") == naming.metaphone_value("fone")
    assert naming.metaphone_value("1234") == ""
    df = spark.createDataFrame([("GNN", "Graph Neural Network"), ("GN", "Graph Neural Network"), (None, "x y"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(naming.initialism(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]
    naming.register(spark)
    assert spark.sql("SELECT jaro_winkler('abc', 'abc'), metaphone('knight')").first()[0] == 1.0
