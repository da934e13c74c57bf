"""From files to scores in one call: all scenes and classes of a dataset through the four metrics in one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.catalog import CLEAR_COUNTS, CLEAR_RATES, CLEAR_SHOWN, _clear, _eval, _hota, _rounded, query
from trackloom.operators import evaluation as E
from trackloom.operators.lineage import checkpointed
from trackloom.sources import datasets
from trackloom.sources.datasets import GROUND, Variant
from trackloom.sources.standins import evaluation

#: The combined row's scene.
COMBINED = "COMBINED_SEQ"


def by_class(rows: DataFrame) -> DataFrame:
    """rows whose scene also names the class, so that one plan evaluates all classes apart."""
    return rows.withColumn("scene", F.struct("class", "scene"))


def apart(scores: DataFrame) -> DataFrame:
    """scores with class and scene as columns again."""
    return scores.select("scene.class", "scene.scene", *[c for c in scores.columns if c != "scene"])


def scores(truth: DataFrame, tracker: DataFrame, variant: Variant = GROUND, lengths: DataFrame | None = None, threshold: float = 0.5) -> dict[str, DataFrame]:
    """`hota`, `clear`, `identity` and `count` by (class, scene), and under the scene COMBINED_SEQ of each class the combined values.

    truth and tracker: (scene, frame, id, class, x, y and, for boxes, w, h), each id once a frame and class. Similarity is
    IoU for boxes, else it falls with the distance. lengths: (scene, seq_length); else the last frame with a row. A class
    is evaluated in the scenes where either side has it.
    """
    g, t = checkpointed(by_class(truth)), checkpointed(by_class(tracker))
    sim = checkpointed(E.box_similarity(g, t) if variant.boxes else E.similarity(g, t, variant.zero_distance))
    own = E.scene_lengths(g, t)
    if lengths is not None:
        own = own.join(lengths.select(F.col("scene").alias("_s"), F.col("seq_length").alias("_n")), F.col("scene.scene") == F.col("_s"), "left").select("scene", F.coalesce("_n", "seq_length").alias("seq_length"))
    out = {
        "hota": apart(E.hota_finals(E.hota(g, t, sim))), "clear": apart(E.clear_fields(g, t, sim, threshold, own)),
        "identity": apart(E.identity(g, t, sim, threshold)), "count": apart(E.count_fields(g, t, own)),
    }
    out = {k: checkpointed(v) for k, v in out.items()}
    combined = {"hota": E.combined_sequences, "clear": E.combined_clear, "identity": E.combined_identity, "count": lambda c, by: E.summed(c, by, ["dets", "gt_dets", "ids", "gt_ids", "frames"])}
    return {k: v.unionByName(combined[k](v, ["class"]).withColumn("scene", F.lit(COMBINED)), allowMissingColumns=True) for k, v in out.items()}


def evaluate(spark: SparkSession, truth_folder: str, tracker_folder: str, variant: Variant = GROUND, scenes: list[str] | None = None) -> dict[str, DataFrame]:
    """scores of a tracker's folder or zip archive against a truth folder or archive; of an id that comes twice in a frame the first line counts."""
    first = lambda df: df.groupBy("scene", "frame", "id", "class").agg(F.min_by(F.struct(*[c for c in df.columns if c in "xywh"]), "ordinal").alias("p")).select("scene", "frame", "id", "class", "p.*")
    g, t = datasets.read_truth(spark, truth_folder, variant, scenes), datasets.read_tracker(spark, tracker_folder, variant, scenes)
    return scores(first(g), first(t), variant, datasets.read_lengths(spark, truth_folder))


def _of_classes(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    kind = lambda df: df.withColumn("class", (1 + F.col("id") % 2).cast("int"))
    g, t = evaluation(spark, d)
    return scores(kind(g), kind(t))


#: The stand-in's scenes, each once a class: the class of an id is its last bit.
CLASSED = _eval("global_id * 10 + wy * 0.01").replace("'scene_' || camera AS scene", "'scene_' || camera || ':' || CAST(1 + global_id % 2 AS VARCHAR) AS scene")
SPLIT = "CAST(split_part(scene, ':', 2) AS INT) AS class, split_part(scene, ':', 1) AS scene"


@query(f"WITH {_hota(CLASSED)} SELECT {SPLIT}, alpha, tp, fn, fp, round_even(sqrt(det_a * ass_a), 6) AS hota FROM h")
def hota_of_classes(spark: SparkSession, d: str) -> DataFrame:
    """HOTA of all classes and scenes, evaluated in one plan."""
    h = _of_classes(spark, d)["hota"].where(F.col("scene") != COMBINED)
    return _rounded(h.select("class", "scene", "alpha", "tp", "fn", "fp", "hota"), ["hota"])


@query(f"{_clear(CLASSED)} SELECT {SPLIT}, {CLEAR_COUNTS}, {CLEAR_SHOWN} FROM c")
def clear_of_classes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_of_classes(spark, d)["clear"].where(F.col("scene") != COMBINED), CLEAR_RATES)
