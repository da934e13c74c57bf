"""Every file format over the stand-ins: written to the shared folder, read back, and held against SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.catalog import DET, GAP, HOTA, SIGHT, query
from trackloom.functions import expressions as X
from trackloom.operators import evaluation as E
from trackloom.operators import sightings
from trackloom.operators.lineage import shared_dir
from trackloom.sources import datasets, files
from trackloom.sources.standins import detections, evaluation, table, track_features


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


@query(f"WITH {DET} SELECT frame, global_id AS track_id, wx - (20 + global_id % 11) / 2.0 AS bbox_left, wy - (40 + global_id % 17) / 2.0 AS bbox_top, 20.0::DOUBLE + global_id % 11 AS bbox_width, 40.0::DOUBLE + global_id % 17 AS bbox_height FROM det WHERE camera <> '5'")
def filed_detections(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of boxes given by centres, read back as corners, of one class: camera 5 is written as cars."""
    w, h = (20 + F.col("global_id") % 11).cast("double"), (40 + F.col("global_id") % 17).cast("double")
    kind = F.when(F.col("camera") == "5", "car").otherwise("person")
    boxes = detections(spark, d).select(F.col("frame").cast("int").alias("frame"), F.col("global_id").cast("int").alias("track_id"), kind.alias("class"), F.col("wx").alias("cx"), F.col("wy").alias("cy"), w.alias("w"), h.alias("h"), F.lit(0.5).alias("conf"))
    files.write_detections(boxes, path := _folder(spark))
    got = files.read_detections(spark, path)
    return got.select(F.col("frame").cast("long").alias("frame"), F.col("track_id").cast("long").alias("track_id"), "bbox_left", "bbox_top", "bbox_width", "bbox_height")


def _records(spark: SparkSession, d: str) -> DataFrame:
    det = detections(spark, d)
    return det.select(F.col("camera").cast("int").alias("camera_id"), F.col("global_id").cast("int").alias("id"), F.col("frame").cast("int").alias("frame_id"), (F.col("global_id") % 360).cast("double").alias("x"), F.col("wy").alias("y"), F.lit(20.0).alias("width"), F.lit(40.0).alias("height"), F.rint(F.col("wx")).alias("xworld"), F.col("wy").alias("yworld"))


RECORDS = "CAST(camera AS BIGINT) AS camera_id, global_id AS id, frame AS frame_id, CAST(global_id % 360 AS DOUBLE) AS x, wy AS y, round_even(wx, 0) AS xworld"


@query(f"WITH {DET} SELECT {RECORDS} FROM det WHERE camera IN ('1', '3') AND frame % 2 = 0")
def filed_records(spark: SparkSession, d: str) -> DataFrame:
    """Nine-column records written, lines of two cameras copied as they are, and every second frame of one copy read."""
    path, copy = _folder(spark), _folder(spark)
    files.write_records(_records(spark, d), path)
    files.copy_cameras(spark, path, copy, [1, 3])
    got = files.read_records(spark, copy, [1, 3], 2)
    return got.select(*[F.col(c).cast("long").alias(c) for c in ("camera_id", "id", "frame_id")], "x", "y", "xworld")


@query(f"WITH {DET} SELECT {RECORDS.replace('CAST(camera AS BIGINT) AS camera_id, ', '')}, camera AS scene FROM det WHERE global_id % 7 <> 0")
def filed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Ten-column lines of all cameras in folders by scene, read as one table with their order; rows marked 0 are left out."""
    mark = F.when(F.col("id") % 7 == 0, "0").otherwise("1")
    line = F.concat_ws(",", "frame_id", "id", "x", "y", "width", "height", mark, "xworld", "yworld", F.lit("-1"))
    path = _folder(spark)
    _records(spark, d).select(F.concat(F.lit("s"), F.col("camera_id").cast("string")).alias("scene"), line.alias("value")).write.partitionBy("scene").text(path)
    got = datasets.read_scenes(spark, f"{path}/*/*", r"scene=s([^/]+)/[^/]+$", datasets.Variant((7, 8, 2, 3))).where("mark <> 0")
    return got.select("scene", F.col("frame").alias("frame_id"), "id", F.col("w").alias("x"), F.col("h").alias("y"), F.col("x").alias("xworld"))


@query(f"WITH {DET} SELECT frame AS frame_id, global_id AS id, CASE WHEN global_id % 3 = 1 THEN 7.0::DOUBLE ELSE 1.0::DOUBLE END AS conf FROM det WHERE global_id % 3 <> 2")
def filed_crowd(spark: SparkSession, d: str) -> DataFrame:
    """Ten-column records with names in the place of numbers: crowds go aside, other names become numbers."""
    kind = F.when(F.col("id") % 3 == 2, "Crowd").when(F.col("id") % 3 == 1, "CAR").otherwise("person")
    path = _folder(spark)
    _records(spark, d).select(F.concat_ws(" ", "frame_id", "id", "x", "y", "width", "height", kind, "xworld", "yworld", F.lit("-1 ")).alias("value")).write.text(path)
    rows, _ = files.read_mot(spark, path, crowd={"conf": ["crowd"]}, convert={"conf": {"car": 7.0, "person": 1.0, "crowd": 0.0}})
    return rows.select(F.col("frame_id").cast("long").alias("frame_id"), F.col("id").cast("long").alias("id"), "conf")


@query("SELECT DISTINCT 'scene_' || (user_id % 4) AS scene_name, user_id % 30 AS camera_id FROM events")
def filed_scene_map(spark: SparkSession, d: str) -> DataFrame:
    """A JSON list of scenes with their cameras; scenes that come twice are joined, repeated cameras count once."""
    e = table(spark, d, "events").select(F.concat(F.lit("scene_"), (F.col("user_id") % 4).cast("string")).alias("scene_name"), (F.col("user_id") % 30).cast("int").alias("c"), (F.col("event_id") % 3).alias("part"))
    listed = e.groupBy("scene_name", "part").agg(F.array_sort(F.collect_set("c")).alias("camera_ids"))  # at most 12 rows
    text = listed.agg(F.to_json(F.collect_list(F.struct("scene_name", "camera_ids"))).alias("value"))
    text.write.text(path := _folder(spark))
    return files.read_scene_map(spark, path).select("scene_name", F.col("camera_id").cast("long").alias("camera_id"))


@query("SELECT vec_id * 4 + c AS track_id, c AS camera, (vec_id * 37) % 5000 + c * 300 AS first_frame, true AS no_pixels FROM embeddings, range(2) r(c)")
def filed_features(spark: SparkSession, d: str) -> DataFrame:
    """Track features without the columns that older files lack: they come out null."""
    files.write_features(track_features(spark, d).drop("vec_id"), path := _folder(spark))
    f = files.read_features(spark, path)
    return f.select("track_id", F.col("camera").cast("long").alias("camera"), F.col("first_frame").cast("long").alias("first_frame"), (F.col("first_px_x").isNull() & F.col("caption_embedding").isNull()).alias("no_pixels"))


@query(f"WITH {SIGHT} SELECT camera, count(*) AS sightings, CAST(sum(num_detections) AS BIGINT) AS detections, count(DISTINCT global_id) AS entities FROM s GROUP BY 1")
def filed_graph(spark: SparkSession, d: str) -> DataFrame:
    """The event graph's tables written and read back: what each camera saw."""
    s = sightings.sightings(detections(spark, d), GAP)
    files.write_graph(path := _folder(spark), entities=s.select("global_id").distinct(), sightings=s, edges=sightings.edges(s))
    g = files.read_graph(spark, path)
    seen = g["sightings"].join(g["entities"], "global_id")
    return seen.groupBy("camera").agg(F.count("*").alias("sightings"), F.sum("num_detections").alias("detections"), F.countDistinct("global_id").alias("entities"))


@query("SELECT CAST(c AS VARCHAR) AS camera, vec_id * 4 + c AS track_id, vec_id AS global_id FROM embeddings, range(2) r(c)")
def filed_id_map(spark: SparkSession, d: str) -> DataFrame:
    ids = track_features(spark, d).select("camera", "track_id", F.col("vec_id").alias("global_id"))
    files.write_id_map(ids, path := _folder(spark))
    return files.read_id_map(spark, path).select("camera", F.col("track_id").cast("long").alias("track_id"), "global_id")


@query(f"WITH {HOTA}, z AS (SELECT scene, avg(sqrt(det_a * ass_a)) AS h, avg(det_a) AS d FROM h GROUP BY 1), a AS (SELECT avg(h) AS h, avg(d) AS d FROM z) SELECT 'one' AS tracker, 'HOTA' AS field, round_even(h, 6) AS value FROM a UNION ALL SELECT 'one', 'DetA', round_even(d, 6) FROM a UNION ALL SELECT 'two', 'HOTA', round_even(h / 2, 6) FROM a UNION ALL SELECT 'two', 'DetA', round_even(d / 2, 6) FROM a")
def filed_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summary files of two trackers, one with half the other's scores, read as one table."""
    score = E.final_score(E.hota(*evaluation(spark, d))).select(F.col("hota").alias("HOTA"), F.col("det_a").alias("DetA"))
    one, two = _folder(spark), _folder(spark)
    files.write_summary(score, one)
    files.write_summary(score.select((F.col("HOTA") / 2).alias("HOTA"), (F.col("DetA") / 2).alias("DetA")), two)
    return files.read_summaries(spark, {"one": one, "two": two}).withColumn("value", X.rint(F.col("value"), 6))


@query(f"WITH {HOTA}, w AS (SELECT scene, avg(sqrt(det_a * ass_a)) AS v FROM h GROUP BY 1) SELECT scene AS seq, 'hota___AUC' AS field, round_even(v, 6) AS value FROM w UNION ALL SELECT 'COMBINED_SEQ', 'hota___AUC', round_even(avg(v), 6) FROM w")
def filed_details(spark: SparkSession, d: str) -> DataFrame:
    """A detailed file with the combined row last, read back by field."""
    per = E.detailed(E.hota(*evaluation(spark, d)), "hota").select(F.col("scene").alias("seq"), "hota___AUC")
    every = per.unionByName(per.agg(F.avg("hota___AUC").alias("hota___AUC")).withColumn("seq", F.lit("COMBINED")))
    files.write_detailed(every, path := _folder(spark))
    return files.read_detailed(spark, path).withColumn("value", X.rint(F.col("value"), 6))
