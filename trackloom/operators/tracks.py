"""Tracks from boxes: where they are, how they begin and end, what they look like, and the records made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.expressions import normalised
from trackloom.operators.scans import quantiles

TRACK = ["camera", "track_id"]


def track_positions(boxes: DataFrame) -> DataFrame:
    """(camera, track_id, world_x, world_y, first and last frame, pixel and world position) of boxes (frame, px_x, px_y, wx, wy): medians an axis."""
    first, last = (lambda c: F.min_by(c, "frame")), (lambda c: F.max_by(c, "frame"))
    return boxes.groupBy(*TRACK).agg(
        F.median("wx").alias("world_x"), F.median("wy").alias("world_y"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        *[f(c).alias(f"{n}_{c}") for n, f in (("first", first), ("last", last)) for c in ("px_x", "px_y", "wx", "wy")],
    )


def track_embeddings(crops: DataFrame) -> DataFrame:
    """(camera, track_id, embedding): the mean of a track's normalised vectors (camera, track_id, vector), normalised again."""
    places = crops.select(*TRACK, F.posexplode(normalised(F.col("vector"))).alias("place", "x")).groupBy(*TRACK, "place").agg(F.avg("x").alias("x"))
    mean = places.groupBy(*TRACK).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("mean"))
    return mean.select(*TRACK, normalised(F.col("mean")).alias("embedding"))


def global_records(boxes: DataFrame, ids: DataFrame) -> DataFrame:
    """Boxes (camera, track_id, frame, left, top, width, height, wx, wy) of tracks with a global id as nine-column records; others are left out."""
    j = boxes.join(ids, TRACK)
    return j.select(F.col("camera").cast("int").alias("camera_id"), F.col("global_id").alias("id"), F.col("frame").alias("frame_id"), F.col("left").alias("x"), F.col("top").alias("y"), "width", "height", F.col("wx").alias("xworld"), F.col("wy").alias("yworld"))


def reliable_or_all(sightings: DataFrame, least: int = 10) -> DataFrame:
    """The sightings of at least `least` detections; all of an entity's where it has none such."""
    reliable = F.col("num_detections") >= least
    s = sightings.withColumn("_any", F.max(reliable).over(Window.partitionBy("global_id")))
    return s.where(reliable | ~F.col("_any")).drop("_any")


def first_of_frame(records: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    """One record a key, the first in file order."""
    return records.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def spread(df: DataFrame, value: Column, threshold: float) -> DataFrame:
    """One row: count, mean, median, tenth percentile, maximum and share below a threshold of a column; quantiles are exact and no task holds all values."""
    v = df.select(value.alias("v")).where("v IS NOT NULL")
    found = quantiles(v, "v", [0.5, 0.1])
    at = lambda share: F.lit(found.get(share)).cast("double")
    return v.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), at(0.5).alias("median"), at(0.1).alias("p10"), F.max("v").alias("max"), F.avg((F.col("v") < threshold).cast("double")).alias("below"))


def graph_counts(sightings: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): how many entities, sightings and edges a graph has."""
    kind = lambda name, n: [F.lit(name).alias("kind"), n.alias("n")]
    return sightings.agg(F.countDistinct("global_id").alias("n")).select(*kind("entities", F.col("n"))).union(sightings.agg(F.count("*").alias("n")).select(*kind("sightings", F.col("n")))).union(edges.agg(F.count("*").alias("n")).select(*kind("edges", F.col("n"))))


def ranked_trackers(summaries: DataFrame, field: str, most: int = 20) -> DataFrame:
    """The trackers (tracker, field, value) of the highest values of a field."""
    return summaries.where(F.col("field") == field).select("tracker", "value").orderBy(F.desc("value"), "tracker").limit(most)

