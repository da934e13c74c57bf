"""From folders and archives to all four metrics."""

import zipfile

import pytest
from pyspark.sql import functions as F

from trackloom.plans import evaluating
from trackloom.sources import datasets


def write(root, truth, tracker, length=10):
    for scene in truth:
        (root / "gt" / scene / "gt").mkdir(parents=True)
        (root / "gt" / scene / "gt" / "gt.txt").write_text("\n".join(truth[scene]) + "\n")
        (root / "gt" / scene / "seqinfo.ini").write_text(f"[Sequence]\nname={scene}\nseqLength={length}\n")
    (root / "trk").mkdir()
    for scene, lines in tracker.items():
        (root / "trk" / f"{scene}.txt").write_text("\n".join(lines))
    with zipfile.ZipFile(root / "gt.zip", "w") as z:
        for f in sorted((root / "gt").rglob("*.*")):
            z.write(f, f.relative_to(root / "gt"))
    with zipfile.ZipFile(root / "trk.zip", "w") as z:
        for f in (root / "trk").iterdir():
            z.write(f, f.name)


@pytest.mark.parametrize("form", ["", ".zip"])
def test_ground_folder(spark, tmp_path, form):
    """Two scenes; scene a: ids 1 and 2 in frames 1 and 10 only, one switch, an id twice in a frame, a row marked 0."""
    truth = {"a": ["1 1 0 0 1 1 1 0.0 0 -1", "1 1 0 0 1 1 1 500 0 -1", "10 1 0 0 1 1 1 1.0 0 -1", "1 2 0 0 1 1 1 50 0 -1", "10 9 0 0 1 1 0 50 0 -1 "], "b": ["1,1,0,0,1,1,1,0,0,-1"]}
    tracker = {"a": ["1 7 0 0 1 1 1 0.2 0 -1", "10 8 0 0 1 1 1 1 0 -1", "10 5 0 0 1 1 1 90 0 -1"], "b": ["1;3;0;0;1;1;1;0;0;-1"]}
    write(tmp_path, truth, tracker)
    got = evaluating.evaluate(spark, f"{tmp_path}/gt{form}", f"{tmp_path}/trk{form}")
    clear = {r.scene: r for r in got["clear"].collect()}
    assert (clear["a"].tp, clear["a"].fn, clear["a"].fp, clear["a"].idsw, clear["a"].frames) == (2, 1, 1, 1, 10)
    assert clear["a"].fp_per_frame == pytest.approx(0.1) and clear["a"].motp == pytest.approx((0.9 + 1.0) / 2)
    assert clear["b"].mota == 1.0
    assert (clear["COMBINED_SEQ"].tp, clear["COMBINED_SEQ"].frames, clear["COMBINED_SEQ"].fp_per_frame) == (3, 20, pytest.approx(1 / 20))
    identity = {r.scene: r for r in got["identity"].collect()}
    assert (identity["a"].idtp, identity["a"].idfn, identity["a"].idfp, identity["COMBINED_SEQ"].idtp) == (1, 2, 2, 2)
    count = {r.scene: (r.dets, r.gt_dets, r.ids, r.gt_ids, r.frames) for r in got["count"].collect()}
    assert count == {"a": (3, 3, 3, 2, 10), "b": (1, 1, 1, 1, 10), "COMBINED_SEQ": (4, 4, 4, 3, 20)}
    hota = {(r.scene, round(r.alpha, 2)): r for r in got["hota"].collect()}
    assert (hota["a", 0.5].tp, hota["a", 0.95].tp, hota["COMBINED_SEQ", 0.5].tp) == (2, 1, 3)
    assert hota["b", 0.5].hota == pytest.approx(1.0)
    assert {r.scene for r in evaluating.evaluate(spark, f"{tmp_path}/gt{form}", f"{tmp_path}/trk{form}", scenes=["b"])["count"].collect()} == {"b", "COMBINED_SEQ"}


def test_box_folder(spark, tmp_path):
    """Boxes of two classes: IoU, classes apart, and rows of another class do not match."""
    truth = {"s": ["1,1,0,0,10,10,1,1,1", "2,1,0,0,10,10,1,1,1", "1,2,100,0,10,10,1,3,1"]}
    tracker = {"s": ["1,5,0,0,10,8,1,1", "2,5,0,5,10,10,1,1", "1,6,100,0,10,10,1,3", "2,6,0,0,10,10,1,3"]}
    write(tmp_path, truth, tracker, 2)
    got = evaluating.evaluate(spark, f"{tmp_path}/gt", f"{tmp_path}/trk", datasets.BOXES)
    clear = {(r["class"], r.scene): (r.tp, r.fn, r.fp) for r in got["clear"].collect()}
    assert clear == {(1, "s"): (1, 1, 1), (3, "s"): (1, 0, 1), (1, "COMBINED_SEQ"): (1, 1, 1), (3, "COMBINED_SEQ"): (1, 0, 1)}
    hota = {(r["class"], round(r.alpha, 2)): r for r in got["hota"].where("scene = 's'").collect()}
    assert (hota[1, 0.3].tp, hota[1, 0.5].tp, hota[1, 0.9].tp) == (2, 1, 0) and hota[1, 0.8].loc_a == pytest.approx(0.8)
    per_class = got["hota"].where(F.col("scene") == evaluating.COMBINED).drop("scene")
    from trackloom.operators import evaluation as E

    average = {round(r.alpha, 2): r for r in E.class_average(per_class).collect()}
    assert average[0.5].tp == 2


def test_order_of_lines(spark, tmp_path):
    """Lines keep their order over blocks and files; the first of an id counts."""
    (tmp_path / "b.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "a.txt").write_text("".join(f"first {i}\n" for i in range(10)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    got = [r.value for r in datasets.read_lines(spark, f"{tmp_path}/*.txt").orderBy("ordinal").collect()]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"first {i}" for i in range(10)] + [f"line {i}" for i in range(5000)]
