"""Every reader and writer: round trips, filters and what must not be read."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trackloom.sources import files


def text(path, lines):
    path.mkdir()
    (path / "part.txt").write_text("\n".join(lines) + "\n")
    return str(path)


def test_detections(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 7, "person", 10.0, 20.0, 4.0, 8.0, 0.5), (2, 8, "car", 1.0, 1.0, 2.0, 2.0, 0.9)], "frame int, track_id int, class string, cx double, cy double, w double, h double, conf double")
    files.write_detections(boxes, f"{tmp_path}/d")
    assert [tuple(r) for r in files.read_detections(spark, f"{tmp_path}/d").collect()] == [(1, 7, "person", 8.0, 16.0, 4.0, 8.0, 0.5)]


def test_records(spark, tmp_path):
    rows = [(535, 1, 0, 1.0, 2.0, 3.0, 4.0, 5.1231, 6.0), (536, 2, 5, 1.5, 2.25, 3.0, 4.0, -5.0, 6.5)]
    df = spark.createDataFrame(rows, files.RECORD)
    files.write_records(df, f"{tmp_path}/r")
    got = sorted(tuple(r) for r in files.read_records(spark, f"{tmp_path}/r").collect())
    assert got == [(535, 1, 0, 1.0, 2.0, 3.0, 4.0, 5.123, 6.0), (536, 2, 5, 1.5, 2.25, 3.0, 4.0, -5.0, 6.5)]
    assert [r.id for r in files.read_records(spark, f"{tmp_path}/r", [536], 5).collect()] == [2]
    files.copy_cameras(spark, f"{tmp_path}/r", f"{tmp_path}/c", [535])
    assert [r.value.split()[0] for r in spark.read.text(f"{tmp_path}/c").collect()] == ["535"]
    bad = text(tmp_path / "bad", ["535 -1 3 1 2 3 4 5 6", "536 1 0 1 2 3 4 5 6"])
    with pytest.raises(PySparkException, match="negative"):  # though the row is of another camera and no column of it is asked for
        files.read_records(spark, bad, [536]).select("x").collect()
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        files.read_records(spark, text(tmp_path / "odd", ["535 one 3 1 2 3 4 5 6"])).collect()


def test_scene_map(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"scene_name": "a", "camera_ids": [1, 2]}, {"scene_name": "a", "camera_ids": [2, 3]}, {"scene_name": "b", "camera_ids": [4]}]))
    got = files.read_scene_map(spark, f"{tmp_path}/m.json")
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 4)]


def test_mot(spark, tmp_path):
    path = text(tmp_path / "mot", ["1 1 1 2 3 4 1 5 6 -1 ", "1,2,1,2,3,4,crowd,5,6,-1", "2, 3, 1, 2, 3, 4, Car, 5, 6, -1", "2 -4 1 2 3 4 1 5 6 -1", ""])
    rows, ignored = files.read_mot(spark, path, crowd={"conf": ["crowd"]}, convert={"conf": {"car": 7.0, "crowd": 9.0, "1": 1.0}}, drop_negative=True)
    assert sorted((r.frame_id, r.id, r.conf, r.zworld) for r in rows.collect()) == [(1, 1, 1.0, -1.0), (2, 3, 7.0, -1.0)]
    assert [(r.frame_id, r.id, r.conf) for r in ignored.collect()] == [(1, 2, 9.0)]
    only, _ = files.read_mot(spark, path, crowd={"conf": ["crowd", "car"]}, valid={"id": ["1"]})
    assert [r.id for r in only.collect()] == [1]
    with pytest.raises(PySparkException):
        files.read_mot(spark, path)[0].collect()  # "crowd" is no number


def test_sequences(spark, tmp_path):
    for name, body in (("s1", "[Sequence]\nname=s1\nseqLength=12\n"), ("s2", "[Sequence]\nseqLength = 7.0\n")):
        (tmp_path / "gt" / name).mkdir(parents=True)
        (tmp_path / "gt" / name / "seqinfo.ini").write_text(body)
    (tmp_path / "map.txt").write_text("name\ns1\ns2\n\n")
    assert sorted(tuple(r) for r in files.read_sequences(spark, f"{tmp_path}/map.txt", f"{tmp_path}/gt").collect()) == [("s1", 12), ("s2", 7)]
    (tmp_path / "map.txt").write_text("name\ns3\n")
    with pytest.raises(PySparkException, match="s3"):
        files.read_sequences(spark, f"{tmp_path}/map.txt", f"{tmp_path}/gt").collect()


def test_features_graph_and_ids(spark, tmp_path):
    f = spark.createDataFrame([(0, 1, [1.0, 0.0])], "camera int, track_id int, embedding array<double>")
    files.write_features(f, f"{tmp_path}/f")
    got = files.read_features(spark, f"{tmp_path}/f")
    assert set(files.OPTIONAL) <= set(got.columns) and got.first().first_px_x is None and got.first().embedding == [1.0, 0.0]
    tables = {n: spark.range(k).toDF("x") for n, k in (("entities", 2), ("sightings", 3), ("edges", 4))}
    files.write_graph(f"{tmp_path}/g", **tables)
    assert {n: t.count() for n, t in files.read_graph(spark, f"{tmp_path}/g").items()} == {"entities": 2, "sightings": 3, "edges": 4}
    ids = spark.createDataFrame([("535", 1, 0), ("536", 1, 0)], "camera string, track_id int, global_id long")
    files.write_id_map(ids, f"{tmp_path}/i")
    assert sorted(tuple(r) for r in files.read_id_map(spark, f"{tmp_path}/i").collect()) == [("535", 1, 0), ("536", 1, 0)]


def test_results(spark, tmp_path):
    one = spark.createDataFrame([(0.5, 40.0, 7.0, 3.0)], "Other double, HOTA double, IDTP double, MOTA double")
    files.write_summary(one, f"{tmp_path}/s")
    assert spark.read.text(f"{tmp_path}/s").first().value == "HOTA MOTA IDTP Other"
    files.write_summary(one.withColumn("HOTA", F.lit(30.0)), f"{tmp_path}/t")
    both = files.read_summaries(spark, {"a": f"{tmp_path}/s", "b": f"{tmp_path}/t"})
    assert sorted((r.tracker, r.value) for r in both.where("field = 'HOTA'").collect()) == [("a", 40.0), ("b", 30.0)]
    d = spark.createDataFrame([("COMBINED", 1.0), ("z", 2.0), ("b", 3.0), ("gap", None)], "seq string, HOTA___5 double")
    files.write_detailed(d, f"{tmp_path}/d")
    assert [r.value.split(",")[0] for r in spark.read.text(f"{tmp_path}/d").collect()] == ["seq", "b", "gap", "z", "COMBINED"]
    assert sorted(tuple(r) for r in files.read_detailed(spark, f"{tmp_path}/d").collect()) == [("COMBINED_SEQ", "HOTA___5", 1.0), ("b", "HOTA___5", 3.0), ("z", "HOTA___5", 2.0)]


def test_calibration_files(spark, tmp_path):
    block = "# Camera {}\n####\n# Head plane homography\n9 9 9\n9 9 9\n9 9 9\n\n# Ground plane homography\n# rows\n1 2 {}\n4 5.5 6\n-7 8e-1 9\n\n"
    (tmp_path / "c.txt").write_text("intro\n" + block.format(0, 3) + block.format(12, 30))
    got = {r.camera: r.h for r in files.read_homographies(spark, f"{tmp_path}/c.txt").collect()}
    assert got == {0: [[1.0, 2.0, 3.0], [4.0, 5.5, 6.0], [-7.0, 0.8, 9.0]], 12: [[1.0, 2.0, 30.0], [4.0, 5.5, 6.0], [-7.0, 0.8, 9.0]]}
    (tmp_path / "t.xml").write_text('<Camera name="x"><Geometry width="360" height="288" dpx="0.02" dpy="0.03"/><Intrinsic focal="20.5" kappa1="1e-3" cx="160" cy="140" sx="1.1"/><Extrinsic tx="1" ty="2" tz="3" rx="0.1" ry="0.2" rz="0.3"/></Camera>')
    r = files.read_tsai(spark, f"{tmp_path}/t.xml").first()
    assert (r.width, r.focal, r.kappa1, r.tz, r.rz, r.dpy) == (360.0, 20.5, 0.001, 3.0, 0.3, 0.03)
