"""The event graph: gap sessions of detections, their succession, timelines and co-occurrence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from trackloom.functions.expressions import mmss, rint, seconds
from trackloom.operators.lineage import checkpointed
from trackloom.operators.scans import sessions

KEYS = ["global_id", "camera"]


def segmented(detections: DataFrame, max_gap: int) -> DataFrame:
    """detections with seg_idx: a new one where more than max_gap frames passed since the entity's last on the camera."""
    return sessions(detections, KEYS, "frame", ["ordinal"], max_gap, "seg_idx")


def sightings(detections: DataFrame, max_gap: int) -> DataFrame:
    return segmented(detections, max_gap).groupBy(*KEYS, "seg_idx").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), rint(F.avg("wx"), 3).alias("mean_world_x"), rint(F.avg("wy"), 3).alias("mean_world_y"), F.count("*").alias("num_detections")
    )


def trajectories(detections: DataFrame, max_gap: int, fps: float) -> DataFrame:
    """(global_id, camera, seg_idx, trajectory): each sighting's (frame, time_sec, x, y) in order."""
    point = F.struct("frame", "ordinal", seconds(F.col("frame"), fps).alias("time_sec"), F.col("wx").alias("x"), F.col("wy").alias("y"))
    s = segmented(detections, max_gap).groupBy(*KEYS, "seg_idx").agg(F.sort_array(F.collect_list(point)).alias("p"))
    return s.select(*KEYS, "seg_idx", F.transform("p", lambda p: F.struct(p["frame"].alias("frame"), p["time_sec"].alias("time_sec"), p["x"].alias("x"), p["y"].alias("y"))).alias("trajectory"))


def node(kind: str = "sighting") -> Column:
    return F.concat_ws(":", F.lit(kind), F.col("global_id").cast("string"), "camera", F.col("seg_idx").cast("string"))


def edges(s: DataFrame) -> DataFrame:
    """(src, dst, relation): entity to sighting, sighting to camera, sighting to the entity's next sighting."""
    s = s.withColumn("node", node())
    follows = Window.partitionBy("global_id").orderBy("start_frame", "camera", "seg_idx")
    has = s.select(F.concat(F.lit("entity:"), F.col("global_id").cast("string")).alias("src"), F.col("node").alias("dst"), F.lit("HAS_SIGHTING").alias("relation"))
    within = s.select(F.col("node").alias("src"), F.concat(F.lit("camera:"), "camera").alias("dst"), F.lit("IN_CAMERA").alias("relation"))
    precedes = s.select(F.col("node").alias("src"), F.lead("node").over(follows).alias("dst"), F.lit("PRECEDES").alias("relation")).where("dst IS NOT NULL")
    return has.unionByName(within).unionByName(precedes)


def timeline(s: DataFrame, fps: float) -> DataFrame:
    return s.select("global_id", "camera", "seg_idx", mmss(F.col("start_frame") / fps).alias("start"), mmss(F.col("end_frame") / fps).alias("end"), "num_detections")


def in_camera(s: DataFrame, camera: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Sightings on a camera that touch the closed interval; an open end is None."""
    s = s.where(F.col("camera") == str(int(camera)))
    s = s if lo is None else s.where(F.col("end_frame") >= lo)
    return s if hi is None else s.where(F.col("start_frame") <= hi)


#: Each level's buckets are 2^STEP times as wide as the one's below: more levels copy more, fewer let more pairs meet in vain.
STEP = 3
#: Entities of a block, which is copied once for each block; blocks that are made where there are enough entities, and the fewest of such a block.
BLOCK, BLOCKS, SMALL_BLOCK = 1 << 16, 8, 1 << 12
#: Cells of a strip of the matrix of counts of two blocks (64 MB), rows of it that are read out at once, and rows of a batch.
CELLS, STRIP, OUT = 1 << 24, 64, 1 << 16


def level_of(length: Column) -> Column:
    """The least multiple of STEP whose power of two is no shorter than a length."""
    return (STEP * F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1), length)) / STEP))).cast("int")


def cooccurrence(s: DataFrame, max_gap: int, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of entities with sightings on one camera at most max_gap frames apart, and how many such pairs.

    An index of dyadic buckets: a sighting, grown by the gap, is posted at the level of its length, where buckets are as
    wide as the next power of 2^STEP, so in two buckets at most, and looked up at each higher level that there is. However
    long a sighting is among short ones, nothing is copied more than twice a level. A pair meets at the longer one's level
    and counts in the first bucket that both touch. Where sightings are so dense that more pairs would meet than blocks of
    `block` entities are copied, each two blocks are counted in one task instead, and no pair is shuffled.
    """
    own = s.select("global_id", "camera", (F.col("start_frame") - max_gap).alias("lo"), F.col("start_frame").alias("first"), F.col("end_frame").alias("last"))
    own = checkpointed(own.withColumn("level", level_of(F.col("last") - F.col("lo") + 1)))
    levels = sorted(r[0] for r in own.select("level").distinct().collect())  # at most 64 / STEP
    if not levels:
        return s.select(F.col("global_id").alias("a"), F.col("global_id").alias("b"), F.lit(0).cast("long").alias("n_matches")).limit(0)
    own = own.withColumns({c: F.col(c).cast("long") for c in ("lo", "first", "last")})
    buckets = F.explode(F.expr("sequence(shiftright(lo, level), shiftright(last, level))"))
    posted = own.withColumn("bucket", buckets)
    asked = own.withColumnRenamed("level", "own_level").withColumn("level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("own_level"))))
    asked = asked.withColumn("bucket", buckets)
    at = ["camera", "level", "bucket"]
    meets = posted.groupBy(*at).agg(F.count("*").alias("n")).join(asked.groupBy(*at).agg(F.count("*").alias("m")), at).agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0]
    n, entities = own.agg(F.count("*"), F.count_distinct("global_id")).first()
    blocks = max(-(-entities // block), min(BLOCKS, -(-entities // SMALL_BLOCK)))
    if (meets or 0) > n * (blocks + 1):
        return _counted_in_blocks(own, max_gap, blocks)
    posted = posted.select(*at, F.col("global_id").alias("g"), F.col("lo").alias("g_lo"), F.col("first").alias("g0"), F.col("last").alias("g1"))
    asked = asked.select(*at, "own_level", F.col("global_id").alias("h"), F.col("lo").alias("h_lo"), F.col("first").alias("h0"), F.col("last").alias("h1"))
    once = (F.col("g") != F.col("h")) & ((F.col("level") > F.col("own_level")) | (F.col("g") < F.col("h")))
    near = F.greatest(F.col("g0") - F.col("h1"), F.col("h0") - F.col("g1")) <= max_gap
    met = posted.join(asked, at).where(once & near & (F.col("bucket") == F.expr("shiftright(greatest(g_lo, h_lo), level)")))
    return met.groupBy(F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b")).agg(F.count("*").alias("n_matches"))


def _counted_in_blocks(own: DataFrame, max_gap: int, blocks: int) -> DataFrame:
    """cooccurrence of sightings (global_id, camera, first, last) block against block: entities are dealt to blocks by hash, each two of which are counted in one task, in strips of a matrix."""
    rows = own.where("global_id IS NOT NULL AND camera IS NOT NULL AND first IS NOT NULL AND last IS NOT NULL")
    rows = rows.select("global_id", "camera", "first", "last", F.pmod(F.xxhash64("global_id"), F.lit(blocks)).cast("int").alias("own"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), (F.col("own") > F.col("with")).alias("right"), "camera", "first", "last", "global_id")
    kind = own.schema["global_id"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        ids, cameras = t.column("global_id").combine_chunks().dictionary_encode(), t.column("camera").combine_chunks().dictionary_encode()
        order = np.argsort(pc.array_sort_indices(ids.dictionary).to_numpy())  # the place of each id among all
        who, camera = order[ids.indices.to_numpy()], cameras.indices.to_numpy()
        first, last, right = (t.column(c).to_numpy() for c in ("first", "last", "right"))
        sides = [np.flatnonzero(~right), np.flatnonzero(right) if x < y else np.flatnonzero(~right)]
        names = [np.unique(who[s]) for s in sides]
        places = [np.searchsorted(n, who[s]) for n, s in zip(names, sides, strict=True)]
        # of each camera the left sightings by entity, the right ones by their start and by their end
        left, right_ = [], []
        for c in range(len(cameras.dictionary)):
            (a, b), (i, j) = zip(*[(s[camera[s] == c], p[camera[s] == c]) for s, p in zip(sides, places, strict=True)], strict=True)
            by = np.argsort(i, kind="stable")
            left.append((i[by], first[a[by]], last[a[by]]))
            right_.append([(j[by], at[by]) for at in (first[b], last[b]) for by in [np.argsort(at)]])
        values = ids.dictionary.take(pc.array_sort_indices(ids.dictionary))
        high = max(1, CELLS // max(1, len(names[1])))
        for low in range(0, len(names[0]), high):
            counts = np.zeros((min(high, len(names[0]) - low), len(names[1])), np.int32)
            for (i, start, end), (began, ended) in zip(left, right_, strict=True):
                of = slice(*np.searchsorted(i, [low, low + high]))
                # of each right entity, what began until the left sighting's end, less what had ended before its start
                _swept(counts, i[of] - low, end[of] + max_gap, *began, 1)
                _swept(counts, i[of] - low, start[of] - max_gap - 1, *ended, -1)
            for k in range(0, len(counts), STRIP):
                part = counts[k : k + STRIP]
                own = names[0][low + k : low + k + len(part)]
                i, j = np.nonzero((part > 0) & (own[:, None] < names[1]) if x == y else part > 0)
                g, h, n = own[i], names[1][j], part[i, j].astype(np.int64)
                for z in range(0, len(g), OUT):
                    s = slice(z, z + OUT)
                    yield pa.RecordBatch.from_arrays([values.take(pa.array(np.minimum(g[s], h[s]))), values.take(pa.array(np.maximum(g[s], h[s]))), pa.array(n[s])], ["a", "b", "n_matches"])

    # by number: the work of two blocks is not told by their bytes
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), blocks * (blocks + 1) // 2)
    schema = StructType([StructField("a", kind), StructField("b", kind), StructField("n_matches", LongType())])
    return rows.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(count, schema)


def _swept(counts: np.ndarray, rows: np.ndarray, until: np.ndarray, cols: np.ndarray, at: np.ndarray, sign: int) -> None:
    """Add to counts[r], for each row r with its `until`, how many of each column's values `at`, which ascend, are no greater."""
    by = np.argsort(until)
    ends = np.searchsorted(at, until[by], "right")
    past, k = np.zeros(counts.shape[1], np.int32), 0
    for r, e in zip(rows[by].tolist(), ends.tolist(), strict=True):
        if e > k:
            np.add.at(past, cols[k:e], sign)
            k = e
        counts[r] += past


def multi_camera(s: DataFrame) -> DataFrame:
    return s.groupBy("global_id").agg(F.array_join(F.array_sort(F.collect_set("camera")), ",").alias("cameras"), F.countDistinct("camera").alias("n_cameras")).where("n_cameras > 1")
