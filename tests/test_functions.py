"""Calibration against numpy, tool calls, claims and captions on hand-made cases."""

import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import calibration, colours, reports
from trackloom.operators import captions, sampling


def rodrigues(v):
    v = np.array(v)
    a = np.linalg.norm(v)
    if a == 0:
        return np.eye(3)
    x, y, z = v / a
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


def test_homography(spark):
    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("rx", 1.8), ("ry", 0.1), ("rz", -0.3))])
    h = calibration.ground_homography(F.lit(800.0), F.lit(820.0), F.lit(320.0), F.lit(240.0), calibration.rotation(F.col("rx"), F.col("ry"), F.col("rz")), [F.lit(100.0), F.lit(200.0), F.lit(5000.0)])
    row = row.select(F.array(*[F.array(*r) for r in h]).alias("h"))
    got = np.array(row.first().h)
    want = (np.array([[800, 0, 320], [0, 820, 240], [0, 0, 1.0]]) @ np.column_stack([rodrigues([1.8, 0.1, -0.3]), [100, 200, 5000]]))[:, [0, 1, 3]]
    assert np.allclose(got, want)
    x, y = calibration.inverse_point(calibration.cells(F.col("h")), F.lit(300.0), F.lit(200.0))
    p = np.linalg.inv(want) @ [300, 200, 1]
    assert np.allclose(tuple(row.select(x, y).first()), p[:2] / p[2])
    scaled = F.transform("h", lambda r: F.transform(r, lambda v: v * 7.0))
    diff = row.withColumn("g", scaled).select(calibration.relative_difference(calibration.cells(F.col("h")), calibration.cells(F.col("g")))).first()[0]
    assert abs(diff) < 1e-12
    zero = spark.range(1).select(*[v.alias(f"c{i}{j}") for i, r in enumerate(calibration.rotation(F.lit(0.0), F.lit(0.0), F.lit(0.0))) for j, v in enumerate(r)]).first()
    assert np.array_equal(np.array(zero).reshape(3, 3), np.eye(3))


def test_tool_calls(spark):
    call = '{"name": "f", "arguments": {"a": 1}}'
    cases = [(f"<tool_call>{call}</tool_call> and\n<tool_call>\n{call}\n</tool_call>", 2), (f"<tool_call>{call}</tool_call>{call}</tool_call>", 1), ("plain", 0), (f"<tool_call>{call}", 1), ("<tool_call>{broken</tool_call>", 0), (None, 0), ("", 0)]
    df = spark.createDataFrame(cases, "t string, want int").withColumn("got", reports.tool_calls(F.col("t")))
    for r in df.collect():
        assert len(r.got) == r.want
        assert all(c.name == "f" for c in r.got)


def test_claims(spark):
    text = "global_id 5: 3 confirmed interactions of their own today\nglobal_id 6: 1 confirmed interaction of her own\nplain"
    df = spark.createDataFrame([(text, [6])], "t string, ids array<long>")
    assert df.select(reports.scrubbed(F.col("t"), F.col("ids"))).first()[0] == "[claim about global_id 5's interaction count removed -- no verified tool result for it]\nglobal_id 6: 1 confirmed interaction of her own\nplain"


def test_texts_and_colours(spark):
    r = spark.range(1).select(reports.slug(F.lit("Who is near 5?")), reports.clothing_caption(F.lit("red"), F.lit("blue"), F.lit("A man.")), reports.percent(F.lit(0.492825)), colours.nearest_colour(F.lit(238.0), F.lit(236.0), F.lit(233.0)), colours.nearest_colour(F.lit(10.0), F.lit(12.0), F.lit(9.0))).first()
    assert tuple(r)[1:2] + tuple(r)[3:] == ("red top, blue bottom. A man.", "white", "black")
    assert r[0] == "Who_is_near_5_"


def test_consensus(spark):
    a, b, c = [1.0, 0.0], [0.8, 0.6], [0.0, 1.0]
    rows = [
        (1, 0, "a man", 0.9, a), (1, 1, "a man walks", 0.9, b), (1, 2, "a man sits", 0.9, c),  # the middle one
        (2, 0, "a man", 0.9, a), (2, 1, "a bird", 0.1, b),  # one is left, another was out
        (3, 0, "a man", 0.9, a),  # the only one
        (4, 0, "", 0.1, a), (4, 1, "bald bald bald", 0.9, b),  # none is sound: the first
        (5, 0, "a sandwich", 0.9, b), (5, 1, "a man", 0.9, a), (5, 2, "a man sits", 0.9, c),  # most mention a person
    ]
    df = spark.createDataFrame(rows, "entity long, idx long, caption string, confidence double, vector array<double>")
    got = {r.entity: r for r in captions.consensus(captions.candidates(df, ["man"])).collect()}
    assert [got[i].idx for i in range(1, 6)] == [1, 0, 0, 0, 1]
    assert [got[i].n for i in range(1, 6)] == [3, 1, 1, 1, 2]
    assert [round(got[i].agreement, 6) for i in range(1, 6)] == [round((0.8 + 0 + 0.6) / 3, 6), 0.0, 1.0, 0.0, 0.0]


def test_nearest_box(spark):
    boxes = spark.createDataFrame([(1, "a", 10, True), (1, "a", 14, False), (1, "a", 6, False), (2, "a", 30, True)], "global_id long, camera string, frame long, touches boolean")
    targets = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (2, "a", 60)], "global_id long, camera string, target long")
    assert sorted((r.global_id, r.target, r.frame) for r in sampling.nearest_boxes(targets, boxes, 15).collect()) == [(1, 10, 14), (2, 20, 30)]
