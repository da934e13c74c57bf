"""From records to evaluated scenes, over stand-in records: cameras 1 to 5, two scenes, classes by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.catalog import DET, GATED, query
from trackloom.functions import expressions as X
from trackloom.operators import evaluation as E
from trackloom.operators import preparing, tracks
from trackloom.sources.standins import detections, evaluation

SCENES = [("north", 1), ("north", 2), ("north", 3), ("south", 4), ("south", 5)]
RECORDS = f"""{DET}, rec AS (SELECT ordinal, CAST(camera AS INT) AS camera_id, global_id AS id, frame // 60 - 1 AS frame_id, CAST(global_id % 360 AS DOUBLE) AS x, wy AS y, 20.0::DOUBLE AS width, 40.0::DOUBLE AS height, wx AS xworld, wy AS yworld FROM det),
sm AS (SELECT * FROM (VALUES {', '.join(f"('{s}', {c})" for s, c in SCENES)}) v(scene, camera_id)),
sr AS (SELECT scene, frame_id + 1 AS frame_id, id, x, y, width, height, xworld, yworld, row_number() OVER (PARTITION BY scene, frame_id, id ORDER BY ordinal) AS k FROM rec JOIN sm USING (camera_id) WHERE frame_id + 1 >= 1)"""


def records(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return det.select("ordinal", F.col("camera").cast("int").alias("camera_id"), F.col("global_id").alias("id"), (F.floor(F.col("frame") / 60) - 1).alias("frame_id"), (F.col("global_id") % 360).cast("double").alias("x"), F.col("wy").alias("y"), F.lit(20.0).alias("width"), F.lit(40.0).alias("height"), F.col("wx").alias("xworld"), F.col("wy").alias("yworld"))


@query(f"WITH {RECORDS} SELECT scene, frame_id, id, x, y, width, height, 1.0::DOUBLE AS conf, xworld, yworld, -1.0::DOUBLE AS zworld FROM sr WHERE k = 1")
def scene_records(spark: SparkSession, d: str) -> DataFrame:
    """Ten-column records of scenes from nine-column ones of cameras."""
    return preparing.scene_records(records(spark, d), spark.createDataFrame(SCENES, "scene_name string, camera_id int"))


CLASSED = "1 + gt % 3 * 6 AS class, CASE WHEN gt % 11 = 0 THEN 0 ELSE 1 END AS conf"


def _classed(truth: DataFrame) -> DataFrame:
    return truth.withColumn("class", (1 + F.col("id") % 3 * 6).cast("int")).withColumn("conf", F.when(F.col("id") % 11 == 0, 0).otherwise(1))


@query(f"WITH {GATED}, c AS (SELECT *, {CLASSED} FROM g) SELECT scene, frame, gt AS id FROM c WHERE conf <> 0 AND class = 1")
def kept_truth(spark: SparkSession, d: str) -> DataFrame:
    return preparing.kept_truth(_classed(evaluation(spark, d)[0]), True).select("scene", "frame", "id")


@query(f"""WITH {GATED}, bad AS (SELECT scene, frame, trk FROM sim WHERE sim >= 0.5 - 2.220446049250313e-16 AND 1 + gt % 3 * 6 IN (2, 7, 8, 12)) SELECT scene, frame, trk AS id FROM t ANTI JOIN bad USING (scene, frame, trk)""")
def without_distractors(spark: SparkSession, d: str) -> DataFrame:
    """Tracker detections that match no ground truth of a distractor class."""
    g, t = evaluation(spark, d)
    return preparing.without_distractors(t, _classed(g), E.similarity(g, t), preparing.distractors()).select("scene", "frame", "id")


@query(f"WITH {GATED} SELECT scene, frame, gt AS id, dense_rank() OVER (PARTITION BY scene ORDER BY gt) - 1 AS label FROM g")
def relabelled_ids(spark: SparkSession, d: str) -> DataFrame:
    return preparing.relabelled(evaluation(spark, d)[0]).select("scene", "frame", "id", F.col("label").cast("long").alias("label"))


@query(f"WITH {GATED}, c AS (SELECT 1 + gt % 3 * 6 AS class FROM g) SELECT class + 100 AS class, count(*) AS n FROM c GROUP BY 1")
def unknown_classes(spark: SparkSession, d: str) -> DataFrame:
    g = _classed(evaluation(spark, d)[0])
    found = preparing.unknown_classes(g.withColumn("class", F.col("class") + 100))
    return found.withColumn("class", F.col("class").cast("long"))


@query(f"""WITH {GATED}, a AS (SELECT scene, frame, count(*) AS n, sum(gt) AS s FROM g GROUP BY 1, 2), b AS (SELECT scene, frame, count(*) AS n, sum(trk) AS s FROM t GROUP BY 1, 2)
SELECT coalesce(a.scene, b.scene) AS scene, coalesce(a.frame, b.frame) AS frame, coalesce(a.n, 0) AS gts, coalesce(b.n, 0) AS trks, CAST(coalesce(a.s, 0) AS BIGINT) AS gt_sum, CAST(coalesce(b.s, 0) AS BIGINT) AS trk_sum FROM a FULL JOIN b ON a.scene = b.scene AND a.frame = b.frame""")
def merged_raw(spark: SparkSession, d: str) -> DataFrame:
    """Both sides' ids a frame."""
    m = preparing.merged_raw(*evaluation(spark, d))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return m.select("scene", "frame", F.size("gt_ids").cast("long").alias("gts"), F.size("tracker_ids").cast("long").alias("trks"), add("gt_ids").alias("gt_sum"), add("tracker_ids").alias("trk_sum"))


@query(f"""WITH {DET}, m AS (SELECT DISTINCT camera, global_id AS track_id, global_id * 10 + CAST(camera AS INT) AS global_id FROM det WHERE global_id % 4 <> 0) SELECT CAST(d.camera AS INT) AS camera_id, m.global_id AS id, frame AS frame_id, wx AS xworld FROM det d JOIN m ON m.camera = d.camera AND m.track_id = d.global_id""")
def global_records(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of tracks that have a global id, as records."""
    det = detections(spark, d).withColumnRenamed("global_id", "track_id")
    ids = det.where("track_id % 4 <> 0").select("camera", "track_id", (F.col("track_id") * 10 + F.col("camera").cast("int")).alias("global_id")).distinct()
    boxes = det.select("camera", "track_id", "frame", "wx", "wy", *[F.lit(1.0).alias(c) for c in ("left", "top", "width", "height")])
    return tracks.global_records(boxes, ids).select("camera_id", "id", "frame_id", "xworld")


BOXES = "global_id % 360 AS l, CAST(wy AS BIGINT) % 288 AS t, 20 + global_id % 11 AS w, 40 + global_id % 17 AS h"


@query(f"""WITH {DET}, b AS (SELECT ordinal, {BOXES} FROM det), c AS (SELECT *, greatest(0, l) AS x1, greatest(0, t) AS y1, least(320, l + w) AS x2, least(240, t + h) AS y2 FROM b)
SELECT ordinal, l <= 5 OR t <= 5 OR l + w >= 315 OR t + h >= 235 AS touches, CASE WHEN x2 > x1 AND y2 > y1 THEN (x2 - x1) * (y2 - y1) END AS area FROM c""")
def crops(spark: SparkSession, d: str) -> DataFrame:
    """Whether boxes touch the margin of a 320 x 240 frame, and the area of what is inside."""
    k = F.col("wy").cast("long")
    box = [F.col("global_id") % 360, k % 288, 20 + F.col("global_id") % 11, 40 + F.col("global_id") % 17]
    b = detections(spark, d).select("ordinal", X.touches_margin(*box, F.lit(320), F.lit(240)).alias("touches"), X.clipped(*box, F.lit(320), F.lit(240)).alias("c"))
    return b.select("ordinal", "touches", ((F.col("c.x2") - F.col("c.x1")) * (F.col("c.y2") - F.col("c.y1"))).cast("long").alias("area"))


@query(f"""WITH {DET}, b AS (SELECT ordinal, camera, CAST(floor(frame/60.0) AS BIGINT) AS slot, {BOXES} FROM det), p AS (SELECT x.ordinal AS a, y.ordinal AS b,
greatest(least(x.l + x.w, y.l + y.w) - greatest(x.l, y.l), 0) * greatest(least(x.t + x.h, y.t + y.h) - greatest(x.t, y.t), 0) AS i, x.w * x.h AS own FROM b x JOIN b y ON x.camera = y.camera AND x.slot = y.slot AND x.ordinal < y.ordinal)
SELECT a, b, round_even(i / CAST(own AS DOUBLE), 6) AS ioa FROM p WHERE i > 0""")
def ioa_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Intersection over the first box's area, boxes given by corners."""
    k = F.col("wy").cast("long")
    b = detections(spark, d).select("ordinal", "camera", F.floor(F.col("frame") / 60).alias("slot"), (F.col("global_id") % 360).alias("l"), (k % 288).alias("t"), (20 + F.col("global_id") % 11).alias("w"), (40 + F.col("global_id") % 17).alias("h"))
    one, two = X.corners([F.col(c) for c in "ltwh"]), X.corners([F.col(c + "2") for c in "ltwh"])
    p = E.meeting_boxes(b, ["camera", "slot"], "ordinal")
    return p.select("a", "b", X.rint(X.ioa(one, two, as_corners=True), 6).alias("ioa")).where("ioa > 0")
