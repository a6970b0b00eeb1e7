from pyspark.sql import functions as F

from mediasift.functions import text as X


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r[0] for r in df.select(fn(F.col("v")).alias("r")).collect()]


def test_extension(spark):
    cases = {
        "archive.tar.JPG": "jpg",
        "..jpg": "jpg",
        ".bash": None,
        "x/.jpg": None,
        "dir.d/f": None,
        "dir.d\\clip.MP4": "mp4",
        "name.": None,
        "a..": None,
        "": None,
        "plain": None,
        "a.b/": None,
        None: None,
    }
    assert column(spark, list(cases), X.file_extension) == list(cases.values())


def test_mime(spark):
    cases = {
        "image/png": "image/png",
        " IMAGE/PNG ; charset=x": "image/png",
        "image/": None,
        "image": None,
        "image /png": None,
        "": None,
        "a/b/c": None,
        None: None,
    }
    assert column(spark, list(cases), X.normalized_mime) == list(cases.values())


def test_safe_ids(spark):
    good = ["a", "A-1_b", "console", "com10", "nulls", "0123456789abcdef0123456789abcdef", "..."]
    bad = ["../escape", "..\\escape", "subdir/name", "/absolute", ".", "..", "", "a:b", "a\x00b", "C:x"]
    reserved = ["CON", "con", "PRN", "AUX", "NUL", "nul.txt", "aux .x"]
    reserved += [f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)]
    assert column(spark, good, X.is_safe_id) == [True] * len(good)
    assert column(spark, bad + reserved, X.is_safe_id) == [False] * len(bad + reserved)


def test_artifact_paths(spark):
    def check(path):
        return X.is_safe_artifact(F.lit("key_frame_1"), path)

    good = ["a.png", "frames/0001.png", "a//b", "./a", "a/./b"]
    bad = ["", ".", "..", "a/../b", "/abs", "a/.hidden", "C:/x", "a\\b", "con/x", "x/nul.txt", "a/b ", "é"]
    assert column(spark, good, check) == [True] * len(good)
    assert column(spark, bad, check) == [False] * len(bad)
    row = spark.range(1).select(X.is_safe_artifact(F.lit("Bad Id"), F.lit("a")).alias("r"))
    assert row.first()[0] is False


def test_utc_text_and_serialization(spark):
    good = ["2031-02-03T04:05:06Z", "2031-02-03T04:05:06.5+00:00", "2031-02-03 04:05Z", "2031-02-03t04:05:06z"]
    bad = ["2031-02-03T04:05:06+03:00", "2031-02-03T04:05:06", "2026-13-01T00:00:00Z", "now", ""]
    assert column(spark, good, X.is_utc_text) == [True] * len(good)
    assert column(spark, bad, X.is_utc_text) == [False] * len(bad)
    printed = column(spark, good[:2], lambda c: X.iso_utc(X.utc_timestamp(c)))
    assert printed == ["2031-02-03T04:05:06Z", "2031-02-03T04:05:06.500000Z"]


def test_non_finite_literals(spark):
    bad = ['{"a":1e999}', "[-1E+400]", '{"a":{"b":[0.1e5000]}}']
    good = ['{"a":"1e999"}', '{"a":"\\"1e999"}', '{"a":1e300}', '{"a":"x\\\\","b":"1e999"}', "{}"]
    assert column(spark, bad, X.has_non_finite_number) == [True] * len(bad)
    assert column(spark, good, X.has_non_finite_number) == [False] * len(good)
    long = '{"a":"' + '\\u0416"'.replace('"', "") * 60000 + '","b":1e999}'
    assert column(spark, [long], X.has_non_finite_number) == [True]


def test_blank(spark):
    values = ["", "  ", "\t\n", "\u00a0\u2003", "x", " x "]
    assert column(spark, values, X.is_blank) == [True, True, True, True, False, False]


def test_ids(spark):
    df = spark.range(3)
    random = [r[0] for r in df.select(X.random_id().alias("r")).collect()]
    assert len(set(random)) == 3 and all(len(r) == 32 for r in random)
    stable = df.select(X.stable_id(F.col("id"), F.lit("p")).alias("r"))
    assert stable.collect() == stable.collect()
    assert stable.select(X.is_system_id(F.col("r")).alias("ok")).distinct().collect() == [(True,)]


def test_utc_texts_that_need_no_cast(spark):
    texts = ["2031-02-28T04:05:06Z", "2031-02-28T04:05:06.5Z", "2031-02-29T04:05:06Z", "2032-02-29T04:05:06Z", "2031-13-01T04:05:06Z", "2031-02-03T24:05:06Z", "0000-01-01T00:00:00Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r["u"], r["c"]) for r in df.select("i", X.is_utc_text(F.col("t")).alias("u"), X.utc_timestamp(F.col("t")).isNotNull().alias("c")).orderBy("i").collect()]
    assert all(u == c for u, c in got) and [u for u, _ in got][:6] == [True, True, False, True, False, False]
