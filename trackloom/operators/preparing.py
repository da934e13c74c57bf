"""From record files to what the evaluation reads: scenes, masks, distractors, labels and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators.evaluation import EPS
from trackloom.operators.matching import assigned
from trackloom.operators.scans import dense_ranks
from trackloom.operators.tracks import first_of_frame

# The classes of the evaluation and the numbers that files give them.
CLASSES = {"pedestrian": 1, "person_on_vehicle": 2, "car": 3, "bicycle": 4, "motorbike": 5, "non_mot_vehicle": 6, "static_person": 7, "distractor": 8, "occluder": 9, "occluder_on_ground": 10, "occluder_full": 11, "reflection": 12, "crowd": 13}
DISTRACTORS = ["person_on_vehicle", "static_person", "distractor", "reflection"]


def distractors(benchmark: str = "MOT17") -> list[int]:
    names = DISTRACTORS + (["non_mot_vehicle"] if benchmark == "MOT20" else [])
    return [CLASSES[n] for n in names]


def scene_records(records: DataFrame, scene_map: DataFrame, order: str = "ordinal") -> DataFrame:
    """Ten-column records a scene of nine-column ones: all cameras of the scene, the first row of a frame and id in file order.

    Frames count from 1 instead of 0, those below 1 are left out; conf is 1 and zworld -1.
    """
    m = scene_map.select(F.col("scene_name").alias("scene"), "camera_id")
    r = records.join(F.broadcast(m), "camera_id").withColumn("frame_id", F.col("frame_id") + 1)
    r = first_of_frame(r.where("frame_id >= 1"), ["scene", "frame_id", "id"], order)
    return r.select("scene", "frame_id", "id", "x", "y", "width", "height", F.lit(1.0).alias("conf"), "xworld", "yworld", F.lit(-1.0).alias("zworld"))


def kept_truth(truth: DataFrame, preprocess: bool = False, benchmark: str = "MOT17", wanted: int = 1) -> DataFrame:
    """The ground truth (conf, class) that counts: not zero-marked and, with preprocessing of a benchmark that has classes, of the wanted class."""
    t = truth.where("conf <> 0")
    return t.where(F.col("class") == wanted) if preprocess and benchmark != "MOT15" else t


def without_distractors(tracker: DataFrame, truth: DataFrame, sim: DataFrame, classes: list[int]) -> DataFrame:
    """tracker (scene, frame, id) without the detections that a one-to-one matching of each frame gives to truth of a distractor class."""
    pairs = sim.where(F.col("sim") >= 0.5 - EPS)
    matched = assigned(pairs, ["scene", "frame"], "sim").select("scene", "frame", F.col("gt").alias("id"), "trk")
    bad = matched.join(truth.where(F.col("class").isin(classes)).select("scene", "frame", "id"), ["scene", "frame", "id"], "left_semi")
    return tracker.join(bad.select("scene", "frame", F.col("trk").alias("id")), ["scene", "frame", "id"], "left_anti")


def relabelled(rows: DataFrame, name: str = "label") -> DataFrame:
    """rows with the ids of each scene numbered 0, 1, ... in their order."""
    return rows.join(dense_ranks(rows, ["scene"], "id", name), ["scene", "id"])


def _failing(bad: Column, text: Column) -> Column:
    return F.when(bad, F.raise_error(text).cast("boolean")).otherwise(F.lit(True))


def checked(rows: DataFrame, lengths: DataFrame, highest_class: int | None = None) -> DataFrame:
    """rows (scene, frame, id, class) as they are; an id that comes twice in a frame, a frame outside 1 to the scene's length, or too high a class raises an error."""
    n = F.count("*").over(Window.partitionBy("scene", "frame", "id"))
    j = rows.withColumn("_n", n).join(F.broadcast(lengths.select("scene", "seq_length")), "scene", "left")
    where = F.concat_ws(" ", F.lit(" in"), "scene", F.lit("at"), F.col("frame").cast("string"))
    ok = _failing(F.col("_n") > 1, F.concat(F.lit("id comes twice"), where))
    ok = ok & _failing(~F.coalesce(F.col("frame").between(1, F.col("seq_length")), F.lit(False)), F.concat(F.lit("frame outside the sequence"), where))
    if highest_class is not None:
        ok = ok & _failing(F.col("class") > highest_class, F.concat(F.lit("class that is not evaluated"), where))
    return j.where(ok).select(*rows.columns)


def unknown_classes(truth: DataFrame) -> DataFrame:
    """(class, n): classes of the ground truth that the evaluation does not know."""
    return truth.where(~F.col("class").isin(list(CLASSES.values()))).groupBy("class").agg(F.count("*").alias("n"))


def merged_raw(truth: DataFrame, tracker: DataFrame) -> DataFrame:
    """(scene, frame, gt_ids, tracker_ids): both sides' ids a frame, empty where one side has none."""
    ids = lambda df, name: df.groupBy("scene", "frame").agg(F.array_sort(F.collect_list("id")).alias(name))
    j = ids(truth, "gt_ids").join(ids(tracker, "tracker_ids"), ["scene", "frame"], "full")
    return j.select("scene", "frame", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("gt_ids", "tracker_ids")])
