"""Evaluation from records: checks, distractors and masks; crops; streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackloom.functions import expressions as X
from trackloom.functions import images
from trackloom.operators import preparing, tracks
from trackloom.streaming.sessions import streaming_sightings


def test_checks(spark):
    lengths = spark.createDataFrame([("s", 5)], "scene string, seq_length int")
    rows = lambda *r: spark.createDataFrame([("s", f, i, c) for f, i, c in r], "scene string, frame long, id long, class int")
    assert preparing.checked(rows((1, 1, 1), (5, 1, 1)), lengths, 1).count() == 2
    for bad, said in ((rows((1, 1, 1), (1, 1, 1)), "twice"), (rows((6, 1, 1)), "outside"), (rows((1, 1, 2)), "class")):
        with pytest.raises(PySparkException, match=said):
            preparing.checked(bad, lengths, 1).select("id").collect()


def test_distractors(spark):
    truth = spark.createDataFrame([("s", 1, 1, 1), ("s", 1, 2, 8)], "scene string, frame long, id long, class int")
    tracker = spark.createDataFrame([("s", 1, i) for i in (10, 11, 12)], "scene string, frame long, id long")
    # 10 would suit the distractor best, but the best matching of all gives it to the person
    sim = spark.createDataFrame([("s", 1, 1, 10, 0.9), ("s", 1, 2, 10, 0.95), ("s", 1, 2, 11, 0.8), ("s", 1, 1, 12, 0.4)], "scene string, frame long, gt long, trk long, sim double")
    assert sorted(r.id for r in preparing.without_distractors(tracker, truth, sim, preparing.distractors()).collect()) == [10, 12]
    assert 6 in preparing.distractors("MOT20") and 6 not in preparing.distractors()
    kept = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 3)], "id int, conf int, class int")
    assert [[r.id for r in preparing.kept_truth(kept, p, b).collect()] for p, b in ((False, "MOT17"), (True, "MOT17"), (True, "MOT15"))] == [[2, 3], [2], [2, 3]]


def test_crops():
    rng = np.random.default_rng(0)
    noise = lambda h, w: rng.integers(0, 255, (h, w, 3), dtype=np.uint8)
    assert images.is_low_quality(noise(10, 20)) and not images.is_low_quality(noise(16, 185)) and images.is_low_quality(np.zeros((0, 0, 3), np.uint8))
    assert images.is_low_quality(np.full((60, 40, 3), 90, np.uint8))  # nothing but blur
    assert 290 < images.LEAST_AREA < 624


def test_garment_colours(spark):
    crop = np.zeros((100, 60, 3), np.uint8)
    crop[:55] = (30, 30, 200)  # blue, green, red: a red top
    crop[55:] = (110, 40, 20)  # dark blue below
    crop[30:34, 20:24] = 255  # a badge
    rows = [(crop.tobytes(), 100, 60), (crop[:8, :8].tobytes(), 8, 8), (None, 5, 5), (b"xy", 3, 3)]
    df = spark.createDataFrame([(i, bytearray(d) if d else None, h, w) for i, (d, h, w) in enumerate(rows)], "i int, d binary, h int, w int")
    got = {r.i: (r.c.upper, r.c.lower, r.low) for r in df.select("i", images.garment_colours("d", "h", "w").alias("c"), images.low_quality("d", "h", "w").alias("low")).collect()}
    assert got[0][:2] == ("red", "dark blue") and got[1] == ("unknown", "unknown", True) and got[2] == got[3] == ("unknown", "unknown", True)


def test_expressions(spark):
    df = spark.createDataFrame([(["appearance unclear (low-quality crop)", "a man", "a dog"], [[0.1, 0.9], [0.5, 0.5]], [3.0, 4.0]), (["appearance unclear (low-quality crop) x"], [], [0.0, 0.0])], "c array<string>, p array<array<double>>, v array<double>")
    got = df.select(X.joined_captions(F.col("c")).alias("j"), X.mean_confidence(F.col("p")).alias("m"), X.normalised(F.col("v")).alias("n")).collect()
    assert [r.j for r in got] == ["a man a dog", "appearance unclear (low-quality crop) x"] and got[1].m is None and abs(got[0].m - 0.7) < 1e-12 and got[0].n == [0.6, 0.8] and got[1].n == [0.0, 0.0]
    one = spark.range(1)
    words = one.select(X.without_words(F.lit("a dark-colored  jacket , red-and-white, Blue. and jeans .")), X.mentions(F.lit("two girls, walking")), X.mentions(F.lit("a small white bird")), X.mentions(F.lit(None).cast("string"))).first()
    assert tuple(words) == ("a jacket, and jeans.", True, False, False)
    maths = one.select(X.geometric_mean(F.lit(4.0), F.lit(9.0)), X.jaccard(F.lit(50.0), F.lit(50.0)), X.multiplication(F.lit(50.0), F.lit(20.0)), X.jaccard(F.lit(0.0), F.lit(0.0))).first()
    assert np.allclose(tuple(maths), (6.0, 100 / 3, 10.0, 0.0))


def test_ranked_and_spread(spark):
    s = spark.createDataFrame([(f"t{i:02}", "HOTA", float(i)) for i in range(30)] + [("x", "MOTA", 99.0)], "tracker string, field string, value double")
    assert [r.tracker for r in tracks.ranked_trackers(s, "HOTA").collect()] == [f"t{i:02}" for i in range(29, 9, -1)]
    r = tracks.spread(s.where("field = 'HOTA'"), F.col("value"), 3).first()
    assert (r.n, r.mean, r.median, round(r.p10, 9), r.max, r.below) == (30, 14.5, 14.5, 2.9, 29.0, 0.1)


def test_stream_is_as_the_batch(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, "a", at(0)), (1, "a", at(30)), (1, "a", at(61)), (2, "a", at(10)), (1, "b", at(5))]
    df = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = streaming_sightings(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "30 minutes", "1 minute")
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = sorted(tuple(r) for r in streaming_sightings(df, "30 minutes", "1 minute").collect())
    assert batch == [(1, "a", at(0), at(30), 2), (1, "a", at(61), at(61), 1), (1, "b", at(5), at(5), 1), (2, "a", at(10), at(10), 1)]
    assert set(tuple(r) for r in spark.table("sessions").collect()) <= set(batch)
