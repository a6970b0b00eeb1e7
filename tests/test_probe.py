import json

from pyspark.sql import functions as F

from mediasift.functions import jsontypes as J
from mediasift.functions import probe as P


def values(spark, fn, *items):
    rows = [(i, json.dumps({"v": v})) for i, v in enumerate(items)]
    df = spark.createDataFrame(rows, "i int, j string").coalesce(1)
    tree = F.try_parse_json("j")
    return [r[0] for r in df.select(fn(J.member(tree, "v")).alias("r")).collect()]


def test_positive_int(spark):
    items = [5, "5", " 48000 ", "1_0", "+7", 0, -1, "x", "1.0", 1.5, 44100.0, True, None, [], 10**30]
    want = [5, 5, 48000, 10, 7] + [None] * 10
    assert values(spark, J.positive_int, *items) == want


def test_positive_float(spark):
    items = [1.5, "1.5", " 2 ", "1e3", ".5", 3, "1_0.5", 0, "-1", "inf", "nan", "1e400", "1.5d", None, "x", {}]
    want = [1.5, 1.5, 2.0, 1000.0, 0.5, 3.0, 10.5] + [None] * 9
    assert values(spark, J.positive_float, *items) == want


def test_frame_rate(spark):
    items = ["25/1", "30000/1001", "25", "0/0", "1/0", "-25/1", "a/b", 25, "", "25/-1", "1e400", None]
    want = [25.0, 30000 / 1001, 25.0] + [None] * 9
    assert values(spark, J.frame_rate, *items) == want


def test_nonempty_text(spark):
    assert values(spark, J.nonempty_text, "h264", "", 5, None, True) == ["h264", None, None, None, None]


def test_optional_values_and_fallbacks(spark):
    audio = {"codec_type": "audio", "codec_name": "aac", "sample_rate": "44100", "channels": 2}
    video = {
        "codec_type": "video", "codec_name": "h264", "width": 64, "height": 48, "duration": "9",
        "avg_frame_rate": "0/0", "r_frame_rate": "24/1", "bit_rate": "x",
    }
    docs = [
        {"format": {"format_name": "mp4", "duration": "3", "bit_rate": "800"}, "streams": [video]},
        {"format": {"format_name": "m4a", "duration": "3"}, "streams": [audio]},
        {"format": {"format_name": "m4a"}, "streams": [audio]},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").coalesce(1)
    probed = df.select(P.flatten(F.col("j")).alias("p"))
    rows = probed.select(
        P.audio_parameters(F.col("p")).alias("a"), P.video_parameters(F.col("p"), F.lit("mp4")).alias("v")
    ).collect()
    assert rows[0]["a"] is None and rows[0]["v"].asDict() == {
        "duration_seconds": 9.0, "container": "mp4", "video_codec": "h264", "audio_codec": None, "width": 64,
        "height": 48, "fps": 24.0, "bitrate_bps": 800, "has_audio": False,
    }
    assert rows[1]["a"]["duration_seconds"] == 3.0 and rows[1]["a"]["bitrate_bps"] is None
    assert rows[2]["a"] is None
