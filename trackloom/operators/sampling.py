"""Picks by frame: the nearest box of a frame, windows of clips, nearest points of other cameras."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from trackloom.functions.expressions import distance
from trackloom.operators.lineage import stored


def nearest_boxes(targets: DataFrame, boxes: DataFrame, reach: int = 15) -> DataFrame:
    """For each target (global_id, camera, target) the box (global_id, camera, frame, touches, ...) at most `reach` frames away.

    Boxes off the margin come first, then the nearest, the later one on ties. Boxes are bucketed by `reach` frames and
    copied to the neighbouring buckets, so the range join has an equi key. Targets without a box are left out.
    """
    keys = ["global_id", "camera"]
    t = targets.select(*keys, "target").distinct().withColumn("bucket", F.floor(F.col("target") / reach))
    b = boxes.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("frame") - reach) / reach), F.floor((F.col("frame") + reach) / reach))))
    off = F.col("frame") - F.col("target")
    near = t.join(b, [*keys, "bucket"]).where(F.abs(off) <= reach).drop("bucket")
    place = F.row_number().over(Window.partitionBy(*keys, "target").orderBy("touches", F.abs(off), off < 0, *[c for c in ("ordinal",) if c in boxes.columns]))
    return near.withColumn("_place", place).where("_place = 1").drop("_place")


def last_target(found: DataFrame) -> DataFrame:
    """One box an entity and camera: that of the last target."""
    place = F.row_number().over(Window.partitionBy("global_id", "camera").orderBy(F.desc("target")))
    return found.withColumn("_place", place).where("_place = 1").drop("_place")


def clip_windows(segments: DataFrame, clips: int, length: int) -> DataFrame:
    """(global_id, camera, seg_idx, first, last): in each entity's `clips` longest sightings, the frames of a window that starts in the middle."""
    own = Window.partitionBy("global_id", "camera", "seg_idx")
    n = segments.groupBy("global_id", "camera", "seg_idx").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("global_id").orderBy(F.desc("n"), "camera", "seg_idx"))
    n = n.withColumn("_place", place).where(F.col("_place") <= clips).drop("_place")
    i = F.row_number().over(own.orderBy("frame", "ordinal")) - 1
    rows = segments.withColumn("_i", i).join(n, ["global_id", "camera", "seg_idx"])
    middle = F.floor(F.col("n") / 2)
    inside = (F.col("_i") >= middle) & (F.col("_i") < F.least(middle + length, "n"))
    return rows.where(inside).groupBy("global_id", "camera", "seg_idx").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


#: Points with the same keys that one task searches, points that a task is dealt, and distances that it computes at once.
GROUP_POINTS, TASK_POINTS, CHUNK = 1 << 21, 1 << 18, 1 << 20


def nearest_of_others(points: DataFrame, keys: list[str], group: str = "camera", most: int | None = None) -> DataFrame:
    """(keys, id, d): for points (keys, id, group, wx, wy) the distance to the nearest point of another group with the same keys; points without any are left out.

    Points with the same keys are searched in one task, so that each is shuffled once; keys with more than `most` of them
    go by joins of grids. Repeated ids of equal keys count as one point each; null positions are left out.
    """
    most = most or GROUP_POINTS
    p = points.select(*keys, "id", F.col(group).alias("_g"), "wx", "wy").dropna(subset=[*keys, "_g", "wx", "wy"])
    sizes = stored(p.groupBy(*keys).agg(F.count("*").alias("_n")))
    n, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    if not n:
        return p.select(*keys, "id", F.lit(0.0).alias("d")).limit(0)
    if largest <= most:
        return _nearest_in_tasks(p, keys, n)
    big = sizes.where(F.col("_n") > most).drop("_n")
    far = _nearest_by_grids(p.join(F.broadcast(big), keys, "left_semi"), keys)  # no more keys than the points divided by `most`
    return _nearest_in_tasks(p.join(F.broadcast(big), keys, "left_anti"), keys, n).unionByName(far)


def _nearest_in_tasks(p: DataFrame, keys: list[str], n: int) -> DataFrame:
    """nearest_of_others of n points in all, each key in one task."""
    kind = {f.name: f.dataType for f in p.schema.fields}
    out = StructType([StructField(c, kind[c]) for c in (*keys, "id")] + [StructField("d", DoubleType())])

    def solve(t: pa.Table) -> pa.Table:
        g = t.column("_g").combine_chunks().dictionary_encode().indices.to_numpy()
        x, y = (t.column(c).to_numpy() for c in ("wx", "wy"))
        d, found = np.empty(len(g)), np.zeros(len(g), bool)
        for own in (g == k for k in range(int(g.max()) + 1)):
            if not own.all():
                d[own], found[own] = _nearest(x[own], y[own], x[~own], y[~own]), True
        t = t.select([*keys, "id"]).append_column("d", pa.array(d))
        return t.filter(pa.array(found))

    # by number, as adaptive execution would put many keys into one task
    tasks = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-n // TASK_POINTS))
    p = p.withColumns({c: F.col(c).cast("double") for c in ("wx", "wy")})
    return p.repartition(tasks, *keys).groupBy(*keys).applyInArrow(solve, out)


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different positions, and which of them each position is."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[new], y[new], place


def _least(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least distance of each p to the q from its start to its end, a bounded part at a time; infinite where there is none, NaN only where all are."""
    n, d, least = ends - starts, np.full(len(px), np.inf), np.fmin
    past, k = np.concatenate([[0], np.cumsum(n)]), 0
    while k < len(n):
        e = max(k + 1, int(np.searchsorted(past, past[k] + CHUNK, "right")) - 1)
        i = np.arange(k, e)[n[k:e] > 0]
        if len(i):
            at, first = np.repeat(i, n[i]), past[i] - past[k]
            j = np.arange(past[e] - past[k]) - np.repeat(first - starts[i], n[i])
            dx, dy = qx[j] - px[at], qy[j] - py[at]
            d[i] = least.reduceat(np.sqrt(dx * dx + dy * dy), first)
        k = e
    return d


def _nearest(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """The distance of each p to the nearest q, by grids that coarsen, as in _nearest_by_grids."""
    px, py, place = _distinct(px, py)
    qx, qy, _ = _distinct(qx, qy)
    p_ok, q_ok = np.isfinite(px) & np.isfinite(py), np.isfinite(qx) & np.isfinite(qy)
    d = np.full(len(px), np.inf)
    odd = np.flatnonzero(~p_ok) if q_ok.any() else np.arange(len(px))
    with np.errstate(invalid="ignore"):
        d[odd] = _least(px[odd], py[odd], qx, qy, np.zeros(len(odd), np.int64), np.full(len(odd), len(qx)))
    rest, qx, qy = np.flatnonzero(p_ok) if q_ok.any() else odd[:0], qx[q_ok], qy[q_ok]
    if not len(rest):
        return d[place]
    x0, y0 = min(px[rest].min(), qx.min()), min(py[rest].min(), qy.min())
    extent = max(px[rest].max(), qx.max()) - x0, max(py[rest].max(), qy.max()) - y0
    wide = max(max(extent) / np.sqrt(len(qx)), 1e-9)
    while len(rest):
        step = int(max(extent) // wide) + 4
        cell = lambda x, y, w=wide: (((x - x0) // w).astype(np.int64), ((y - y0) // w).astype(np.int64))
        cx, cy = cell(qx, qy)
        key = (cx + 1) * step + cy + 1
        order = np.argsort(key, kind="stable")
        qx, qy, key = qx[order], qy[order], key[order]
        cx, cy = cell(px[rest], py[rest])
        found = np.full(len(rest), np.inf)
        for row in (0, 1, 2):  # three cells in a row are neighbours in the order
            at = (cx + row) * step + cy
            found = np.minimum(found, _least(px[rest], py[rest], qx, qy, np.searchsorted(key, at), np.searchsorted(key, at + 2, "right")))
        settled = (found <= wide * (1 - 1e-9)) | (wide >= max(extent))
        d[rest[settled]] = found[settled]
        rest, wide = rest[~settled], 2 * wide
    return d[place]


def _nearest_by_grids(p: DataFrame, keys: list[str]) -> DataFrame:
    """nearest_of_others by joins.

    Grids that coarsen: a point looks into the three by three cells around its own, and is done when what it found is no
    farther than a cell is wide, as nothing outside can be nearer. The others look again in cells twice as wide, until
    one holds all. The first cells hold about one point each. Groups are part of the key, so points of one group never
    meet.
    """
    extent = F.greatest(F.max("wx") - F.min("wx"), F.max("wy") - F.min("wy"))
    size = p.groupBy(*keys).agg(extent.alias("_extent"), F.min("wx").alias("_x0"), F.min("wy").alias("_y0"), F.count("*").alias("_n"), F.collect_set("_g").alias("_groups"))
    size = size.where(F.size("_groups") > 1).withColumn("_width", F.greatest(F.col("_extent") / F.sqrt("_n"), F.lit(1e-9)))
    size = stored(size)
    left = stored(p.join(size.drop("_n", "_groups"), keys).withColumn("_row", F.monotonically_increasing_id()))
    others = size.select(*keys, F.explode("_groups").alias("_other"))
    rest, level, done = left, 0, []
    while not rest.isEmpty():
        cell = lambda x, k=level: F.floor((F.col(f"w{x}") - F.col(f"_{x}0")) / (F.col("_width") * 2.0**k))
        right = left.select(*keys, F.col("_g").alias("_other"), cell("x").alias("_cx"), cell("y").alias("_cy"), F.col("wx").alias("_ox"), F.col("wy").alias("_oy"))
        around = rest.join(others, keys).where(F.col("_g") != F.col("_other"))
        around = around.withColumn("_cx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("_cy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
        found = around.join(right, [*keys, "_other", "_cx", "_cy"]).groupBy("_row").agg(F.min(distance(F.col("wx"), F.col("wy"), F.col("_ox"), F.col("_oy"))).alias("d"))
        looked = stored(rest.join(found, "_row", "left"))
        wide = F.col("_width") * 2.0**level
        settled = F.col("d").isNotNull() & ((F.col("d") <= wide) | (wide >= F.col("_extent")))
        done.append(looked.where(settled).select(*keys, "id", "d"))
        rest, level = looked.where(~settled).drop("d"), level + 1
    return reduce(DataFrame.unionByName, done) if done else p.select(*keys, "id", F.lit(0.0).alias("d")).limit(0)


def cross_camera_agreement(points: DataFrame, case: list[str], slot: list[str]) -> DataFrame:
    """(case, points, mean_nearest): the mean distance of points (id, camera, wx, wy) to the nearest one of another camera in their slot."""
    return nearest_of_others(points, [*case, *slot]).groupBy(*case).agg(F.count("*").alias("points"), F.avg("d").alias("mean_nearest"))
