"""Tracking evaluation: detection, association, identity and switches, per scene and combined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from trackloom.functions.expressions import distance, iou
from trackloom.operators.lineage import checkpointed, stored
from trackloom.operators.matching import KERNEL_PAIRS, LIST_PAIRS, _starts, assigned, dense_matching, grown, in_lists, lazy_matching, matching, whole_groups
from trackloom.operators.scans import numbered

EPS = 2.220446049250313e-16
ALPHAS = [round(0.05 * i, 2) for i in range(1, 20)]


def _by_cells(truth: DataFrame, tracker: DataFrame, zero_distance: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cells (_cx, _cy) of their frame, four times as wide as that distance; the tracker's copied to each cell within it, at most four."""
    cell = lambda x, by=0.0: F.floor((F.col(x) + by) / (4 * zero_distance))
    near = lambda x: F.explode(F.sequence(cell(x, -1.001 * zero_distance), cell(x, 1.001 * zero_distance)))
    g = truth.select("scene", "frame", F.col("id").alias("gt"), F.col("x").alias("gx"), F.col("y").alias("gy"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    t = tracker.select("scene", "frame", F.col("id").alias("trk"), F.col("x").alias("tx"), F.col("y").alias("ty"), near("x").alias("_cx"), "y")
    return g, t.withColumn("_cy", near("y")).drop("y")


def similarity(truth: DataFrame, tracker: DataFrame, zero_distance: float = 2.0) -> DataFrame:
    """(scene, frame, gt, trk, sim) with sim = max(0, 1 - distance / zero_distance), zero ones left out; detections of a frame meet by cells."""
    g, t = _by_cells(truth, tracker, zero_distance)
    sim = F.greatest(F.lit(0.0), 1 - distance(F.col("gx"), F.col("gy"), F.col("tx"), F.col("ty")) / zero_distance)
    return g.join(t, ["scene", "frame", "_cx", "_cy"]).withColumn("sim", sim).where("sim > 0").select("scene", "frame", "gt", "trk", "sim")


def box_similarity(truth: DataFrame, tracker: DataFrame) -> DataFrame:
    """(scene, frame, gt, trk, sim) with sim the IoU of boxes (x, y, w, h), zero ones left out."""
    side = lambda df, name, p: df.select("scene", "frame", F.col("id").alias(name), *[F.col(c).alias(p + c) for c in "xywh"])
    j = side(truth, "gt", "g").join(side(tracker, "trk", "t"), ["scene", "frame"])
    return j.withColumn("sim", iou([F.col("g" + c) for c in "xywh"], [F.col("t" + c) for c in "xywh"])).where("sim > 0").select("scene", "frame", "gt", "trk", "sim")


def meeting_boxes(boxes: DataFrame, keys: list[str], box_id: str, wide: int = 32, high: int = 64) -> DataFrame:
    """(keys, a, l, t, w, h, b, l2, t2, w2, h2): pairs a < b of boxes with the same keys that may overlap, each once.

    A box is copied to the cells of a grid that it touches; a pair counts in the cell of its intersection's upper left corner.
    """
    cells = lambda at, size, step: F.explode(F.sequence(F.floor(F.col(at) / step), F.floor((F.col(at) + F.greatest(F.lit(0), F.col(size))) / step)))
    x = boxes.select(*keys, F.col(box_id).alias("a"), *"ltwh").withColumn("_cx", cells("l", "w", wide)).withColumn("_cy", cells("t", "h", high))
    y = x.select(*keys, "_cx", "_cy", F.col("a").alias("b"), *[F.col(c).alias(c + "2") for c in "ltwh"])
    once = (F.col("_cx") == F.floor(F.greatest("l", "l2") / wide)) & (F.col("_cy") == F.floor(F.greatest("t", "t2") / high))
    return x.join(y, [*keys, "_cx", "_cy"]).where((F.col("a") < F.col("b")) & once).drop("_cx", "_cy")


def per_id(rows: DataFrame) -> DataFrame:
    """(scene, id, n): detections of each id."""
    return rows.groupBy("scene", "id").agg(F.count("*").alias("n"))


def counts(truth: DataFrame, tracker: DataFrame) -> DataFrame:
    t = per_id(tracker).groupBy("scene").agg(F.sum("n").alias("dets"), F.count("*").alias("ids"))
    g = per_id(truth).groupBy("scene").agg(F.sum("n").alias("gt_dets"), F.count("*").alias("gt_ids"))
    return g.join(t, "scene", "full").select("scene", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("dets", "gt_dets", "ids", "gt_ids")])


def count_fields(truth: DataFrame, tracker: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """counts with frames: the scene's length (scene, seq_length)."""
    lengths = scene_lengths(truth, tracker) if lengths is None else lengths
    return counts(truth, tracker).join(lengths.select("scene", F.col("seq_length").alias("frames")), "scene", "left")


def scene_lengths(truth: DataFrame, tracker: DataFrame) -> DataFrame:
    """(scene, seq_length): the last frame of either side, as frames count from 1; empty frames before it count."""
    return truth.select("scene", "frame").union(tracker.select("scene", "frame")).groupBy("scene").agg(F.max("frame").alias("seq_length"))


def alignment(sim: DataFrame, truth: DataFrame, tracker: DataFrame) -> DataFrame:
    """Global alignment of each (scene, gt, trk): soft co-occurrence over the union of both tracks' detections."""
    rows = F.sum("sim").over(Window.partitionBy("scene", "frame", "gt"))
    cols = F.sum("sim").over(Window.partitionBy("scene", "frame", "trk"))
    soft = sim.withColumn("den", rows + cols - F.col("sim")).where(F.col("den") > EPS).groupBy("scene", "gt", "trk").agg(F.sum(F.col("sim") / F.col("den")).alias("pot"))
    n_g = per_id(truth).select("scene", F.col("id").alias("gt"), F.col("n").alias("ng"))
    n_t = per_id(tracker).select("scene", F.col("id").alias("trk"), F.col("n").alias("nt"))
    return soft.join(n_g, ["scene", "gt"]).join(n_t, ["scene", "trk"]).withColumn("ga", F.col("pot") / (F.col("ng") + F.col("nt") - F.col("pot")))


#: Cells of the greatest matrix that a frame may take in a task: 256 MB, of which some four are held.
FRAME_CELLS = 1 << 25


#: Pairs that a task sorts at once: its windows hold each of them several times.
TASK_PAIRS = 1 << 16


def meeting_pairs(truth: DataFrame, tracker: DataFrame, zero_distance: float = 2.0) -> int:
    """How many pairs meet in cells, by the counts of the cells; similarity has no more."""
    at = ["scene", "frame", "_cx", "_cy"]
    one, two = (s.groupBy(*at).agg(F.count("*").cast("double").alias(n)) for s, n in zip(_by_cells(truth, tracker, zero_distance), "nm", strict=True))
    return int(one.join(two, at).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)


def crowded(truth: DataFrame, tracker: DataFrame, pairs: int) -> bool:
    """Whether more pairs meet in frames than a copy of each id's track to each of its frames has rows, and frames fit a task as matrices."""
    at, sides = ["scene", "frame"], (truth, tracker)
    copies = sum(per_id(s).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0 for s in sides)
    if pairs <= copies:
        return False
    one, two = (s.groupBy(*at).agg(F.count("*").cast("double").alias(n)) for s, n in zip(sides, "nm", strict=True))
    return one.join(two, at).agg(F.max(F.col("n") * F.col("m"))).first()[0] <= FRAME_CELLS


def _similarities(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, zero_distance: float) -> np.ndarray:
    s = 1 - np.sqrt((x[j] - x[i, None]) ** 2 + (y[j] - y[i, None]) ** 2) / zero_distance
    return np.where(s > 0, s, 0.0)


def matched_by_frames(truth: DataFrame, tracker: DataFrame, zero_distance: float = 2.0) -> DataFrame:
    """(scene, frame, gt, trk, sim, ng, nt): the matching of each frame by alignment and similarity, without a row for each pair.

    A frame's pairs are a matrix in a task. One pass sums each detection's similarities. Then each frame gets the whole
    tracks of its ids, from which it adds up the alignment of its pairs itself, frame by frame of these tracks.
    """
    at = ["scene", "frame"]
    tasks = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    side = lambda df, right: df.select(*at, F.lit(right).alias("right"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = side(truth, False).unionByName(side(tracker, True))

    def summed_up(t: pa.Table) -> pa.Table:
        right, x, y = (t.column(c).to_numpy() for c in ("right", "x", "y"))
        i, j = np.flatnonzero(~right), np.flatnonzero(right)
        s, soft = _similarities(x, y, i, j, zero_distance), np.zeros(len(x))
        soft[i], soft[j] = s.sum(1), s.sum(0)
        return t.append_column("soft", pa.array(soft))

    soft = rows.repartition(tasks, *at).groupBy(*at).applyInArrow(summed_up, StructType([*rows.schema.fields, StructField("soft", DoubleType())]))
    tracks = soft.groupBy("scene", "right", "id").agg(F.sort_array(F.collect_list(F.struct("frame", "x", "y", "soft"))).alias("p"))
    tracks = tracks.select("scene", "right", "id", *[F.col(f"p.{c}").alias(f"{c}s") for c in ("frame", "x", "y", "soft")])
    kind = {f.name: f.dataType for f in rows.schema.fields}
    out = StructType([StructField(n, kind[c]) for n, c in (("scene", "scene"), ("frame", "frame"), ("gt", "id"), ("trk", "id"))] + [StructField("sim", DoubleType()), StructField("ng", LongType()), StructField("nt", LongType())])

    def solve(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("id", "ascending")]))
        right, n = t.column("right").to_numpy(), pc.list_value_length(t.column("frames")).to_numpy().astype(np.int64)
        frames, x, y, soft = (pc.list_flatten(t.column(c)).to_numpy() for c in ("frames", "xs", "ys", "softs"))
        a, b, place = np.flatnonzero(~right), np.flatnonzero(right), np.zeros(len(right), np.int64)
        place[a], place[b] = np.arange(len(a)), np.arange(len(b))
        owner, now = np.repeat(np.arange(len(n)), n), t.column("frame")[0].as_py()
        pot, sim = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
        order = np.argsort(frames, kind="stable")
        for rows_ in np.split(order, np.flatnonzero(np.diff(frames[order])) + 1):
            i, j = rows_[~right[owner[rows_]]], rows_[right[owner[rows_]]]
            if len(i) and len(j):
                s = _similarities(x, y, i, j, zero_distance)
                den = soft[i, None] + soft[j] - s
                both = np.ix_(place[owner[i]], place[owner[j]])
                pot[both] += np.divide(s, den, out=np.zeros_like(s), where=den > EPS)
                if frames[rows_[0]] == now:
                    sim[both] = s
        i, j = dense_matching(pot / (n[a, None] + n[b] - pot) * sim)
        i, j, s = a[i], b[j], sim[i, j]
        ids = t.column("id")
        return pa.table([t.column("scene").take(pa.array(i)), t.column("frame").take(pa.array(i)), ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(s), pa.array(n[i]), pa.array(n[j])], out.names)

    dealt = tracks.withColumn("frame", F.explode("frames")).repartition(tasks, *at)
    return dealt.groupBy(*at).applyInArrow(solve, out)


def hota(truth: DataFrame, tracker: DataFrame, sim: DataFrame | None = None) -> DataFrame:
    """(scene, alpha, tp, fn, fp, det_a, ass_a, ass_re, ass_pr, loc_a, hota) at 19 thresholds.

    A scene with an empty side has loc_a 1 and no matches; one with both sides and no match at a threshold has loc_a 0.
    """
    pairs = meeting_pairs(truth, tracker) if sim is None else sim.count()
    if sim is None and crowded(truth, tracker, pairs):
        m = matched_by_frames(truth, tracker)
    else:
        # so many tasks that none has to sort more when the input grows
        tasks = max(int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-pairs // TASK_PAIRS))
        sim = checkpointed((similarity(truth, tracker) if sim is None else sim).repartition(tasks, "scene", "frame"))  # once for both passes, dealt as both need it
        ga = alignment(sim, truth, tracker)
        m = assigned(sim.join(ga.select("scene", "gt", "trk", "ga", "ng", "nt"), ["scene", "gt", "trk"]).withColumn("w", F.col("ga") * F.col("sim")), ["scene", "frame"], "w", tasks=tasks)
    m = m.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS]))).where(F.col("sim") >= F.col("alpha") - EPS)
    per = m.groupBy("scene", "alpha", "gt", "trk").agg(F.count("*").alias("n"), F.sum("sim").alias("s"), F.first("ng").alias("ng"), F.first("nt").alias("nt"))
    over = lambda x: F.sum(F.col("n") * F.col("n") / F.greatest(F.lit(1), x))
    tot = per.groupBy("scene", "alpha").agg(F.sum("n").alias("tp"), F.sum("s").alias("s"), over(F.col("ng") + F.col("nt") - F.col("n")).alias("a"), over(F.col("ng")).alias("re"), over(F.col("nt")).alias("pr"))
    base = counts(truth, tracker).withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    j = base.join(tot, ["scene", "alpha"], "left").fillna(0, ["tp", "s", "a", "re", "pr"])
    j = j.withColumn("fn", F.col("gt_dets") - F.col("tp")).withColumn("fp", F.col("dets") - F.col("tp"))
    per_match = lambda c: F.col(c) / F.greatest(F.lit(1), F.col("tp"))
    loc = F.when((F.col("dets") == 0) | (F.col("gt_dets") == 0), 1.0).otherwise(F.col("s") / F.greatest(F.lit(1e-10), F.col("tp")))
    j = j.withColumns({"det_a": F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn") + F.col("fp")), "ass_a": per_match("a"), "ass_re": per_match("re"), "ass_pr": per_match("pr"), "loc_a": loc})
    return j.select("scene", "alpha", "tp", "fn", "fp", "det_a", "ass_a", "ass_re", "ass_pr", "loc_a", F.sqrt(F.col("det_a") * F.col("ass_a")).alias("hota"))


#: Meetings of detections that a task counts in all, about, and those it holds at once.
TASK_MEETINGS, MEETINGS = 1 << 28, 1 << 21


def frame_pairs(truth: DataFrame, tracker: DataFrame) -> int:
    """How many pairs of detections share a scene and frame."""
    at = ["scene", "frame"]
    one, two = (s.groupBy(*at).agg(F.count("*").cast("double").alias(n)) for s, n in zip((truth, tracker), "nm", strict=True))
    return int(one.join(two, at).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)


def overlaps(truth: DataFrame, tracker: DataFrame, threshold: float = 0.5, zero_distance: float = 2.0, blocks: int = 1, least: int = 1, spread: bool = False) -> DataFrame:
    """(scene, gt, trks, ws): for each gt the tracks that are that similar to it in `least` frames, with in how many; one row a gt and block of tracks. With spread, (scene, w, n): how many pairs are so in w frames.

    Ids are dealt to blocks by hash, and each two blocks of a scene meet in one task, so that no pair is shuffled.
    """
    tasks = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    own, all_ = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    shown = [F.col("frame").cast("long").alias("frame"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    side = lambda df, right, a, b: df.select("scene", a.alias("_a"), b.alias("_b"), F.lit(right).alias("right"), *shown).dropna(subset=["scene", "frame", "id", "x", "y"])
    rows = side(truth, False, own, all_).unionByName(side(tracker, True, all_, own))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    out = StructType([StructField("scene", kind["scene"]), StructField("gt", kind["id"]), StructField("trks", ArrayType(kind["id"])), StructField("ws", ArrayType(IntegerType()))])
    out = StructType([StructField("scene", kind["scene"]), StructField("w", LongType()), StructField("n", LongType())]) if spread else out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        scene, right = t.column("scene")[0].as_py(), t.column("right").to_numpy()
        one, two = t.filter(pa.array(~right)), t.filter(pa.array(right))
        if not len(one) or not len(two):
            return
        two = two.take(pc.sort_indices(two, [("frame", "ascending")]))
        one = one.take(pc.sort_indices(one, [("id", "ascending")]))
        gts, trks = (side.column("id").combine_chunks().dictionary_encode() for side in (one, two))
        g, k, n = gts.indices.to_numpy(), trks.indices.to_numpy(), len(trks.dictionary)
        gx, gy, tx, ty = (side.column(c).to_numpy() for side in (one, two) for c in "xy")
        frame, frames = one.column("frame").to_numpy(), two.column("frame").to_numpy()
        start = np.searchsorted(frames, frame)
        size = np.searchsorted(frames, frame, "right") - start
        past = np.concatenate([[0], np.cumsum(size)])
        first = np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g))  # where each gt's detections begin
        a = 0
        while a < len(first) - 1:
            e = max(a + 1, int(np.searchsorted(past[first], past[first[a]] + MEETINGS, "right")) - 1)
            of = np.arange(first[a], first[e])
            i = np.repeat(of, size[of])
            j = np.arange(len(i)) + np.repeat(start[of] - past[of] + past[first[a]], size[of])
            dx, dy = gx[i] - tx[j], gy[i] - ty[j]
            s = 1 - np.sqrt(dx * dx + dy * dy) / zero_distance
            some = (s > 0) & (s >= threshold)
            code, w = np.unique(g[i[some]].astype(np.int64) * n + k[j[some]], return_counts=True)
            if spread:
                many = np.bincount(w)
                at = np.flatnonzero(many)
                yield pa.RecordBatch.from_arrays([pa.array([scene] * len(at)), pa.array(at), pa.array(many[at])], out.names)
            code, w = code[w >= least], w[w >= least]
            own, from_ = np.unique(code // n, return_index=True)
            if len(own) and not spread:
                ends = pa.array(np.append(from_, len(code)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([scene] * len(own)), gts.dictionary.take(pa.array(own)), pa.ListArray.from_arrays(ends, trks.dictionary.take(pa.array(code % n))), pa.ListArray.from_arrays(ends, pa.array(w.astype(np.int32)))], out.names)
            a = e

    return rows.repartition(max(tasks, blocks * blocks), "scene", "_a", "_b").groupBy("scene", "_a", "_b").applyInArrow(count, out)


def in_lists_and_below(lists: DataFrame, truth: DataFrame, tracker: DataFrame, least: int, threshold: float = 0.5, zero_distance: float = 2.0) -> DataFrame:
    """(scene, gt, trk, w) of each scene's matching, for the overlaps of `least` frames or more; those of fewer are counted anew, gt by gt, from the scene's detections, when the matching comes to them."""
    tasks = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    shown = ["scene", F.col("frame").cast("long").alias("frame"), "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    side = lambda df, right: df.select(F.lit(right).alias("right"), *shown).dropna(subset=["scene", "frame", "id", "x", "y"])
    rows = side(truth, False).unionByName(side(tracker, True))
    kind = {f.name: f.dataType for f in rows.schema.fields}
    out = StructType([StructField("scene", kind["scene"]), StructField("gt", kind["id"]), StructField("trk", kind["id"]), StructField("w", LongType())])

    def solve(listed: pa.Table, t: pa.Table) -> pa.Table:
        right = t.column("right").to_numpy()
        one, two = t.filter(pa.array(~right)), t.filter(pa.array(right))
        one, two = one.take(pc.sort_indices(one, [("id", "ascending")])), two.take(pc.sort_indices(two, [("frame", "ascending")]))
        gts, trks = (s.column("id").combine_chunks().dictionary_encode() for s in (one, two))
        g, k, n, m = gts.indices.to_numpy(), trks.indices.to_numpy(), len(gts.dictionary), len(trks.dictionary)
        (gx, gy), (tx, ty) = ([s.column(c).to_numpy() for c in "xy"] for s in (one, two))
        frames = two.column("frame").to_numpy()
        start, end = (np.searchsorted(frames, one.column("frame").to_numpy(), s) for s in ("left", "right"))
        first = np.searchsorted(g, np.arange(n + 1))

        def counted(r: int) -> tuple[np.ndarray, np.ndarray]:
            of = slice(first[r], first[r + 1])
            size = end[of] - start[of]
            j = np.arange(size.sum()) + np.repeat(start[of] - np.cumsum(size) + size, size)
            dx, dy = np.repeat(gx[of], size) - tx[j], np.repeat(gy[of], size) - ty[j]
            s = 1 - np.sqrt(dx * dx + dy * dy) / zero_distance
            return np.unique(k[j[(s > 0) & (s >= threshold)]], return_counts=True)

        def below(r: int) -> tuple[np.ndarray, np.ndarray]:
            cols, w = counted(r)
            return cols[w < least], w[w < least]

        row = pc.index_in(listed.column("gt"), value_set=gts.dictionary).to_numpy()
        order = np.argsort(row, kind="stable")
        size = pc.list_value_length(listed.column("trks")).to_numpy()[order].astype(np.int64)
        cols, ws = (pc.list_flatten(listed.column(c).combine_chunks().take(pa.array(order))) for c in ("trks", "ws"))
        cols = pc.index_in(cols, value_set=trks.dictionary).to_numpy()
        starts = np.concatenate([[0], np.cumsum(np.bincount(row[order], size, n).astype(np.int64))])
        held = lazy_matching(starts, cols, ws.to_numpy(), m, least, below)
        i = np.flatnonzero(held >= 0)
        w = [int(c[1][np.searchsorted(c[0], held[r])]) for r in i.tolist() for c in [counted(r)]]
        scene = t.column("scene").slice(0, 1).take(pa.array(np.zeros(len(i), np.int64)))
        return pa.table([scene, gts.dictionary.take(pa.array(i)), trks.dictionary.take(pa.array(held[i])), pa.array(w, pa.int64())], out.names)

    return lists.repartition(tasks, "scene").groupBy("scene").cogroup(rows.repartition(tasks, "scene").groupBy("scene")).applyInArrow(solve, out)


def identity(truth: DataFrame, tracker: DataFrame, sim: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(scene, idtp, idfn, idfp, idr, idp, idf1): the one-to-one mapping of tracks with the most common detections.

    Without sim, scenes whose detections nearly all meet in cells are counted block against block, and only pairs of so
    many common detections are listed that a scene's fit a task.
    """
    lists, least = None, 1
    if sim is None:
        pairs = frame_pairs(truth, tracker)
        if pairs > KERNEL_PAIRS and pairs <= 4 * meeting_pairs(truth, tracker):
            blocks = int(np.ceil(np.sqrt(pairs / TASK_MEETINGS)))
            if pairs > LIST_PAIRS:
                many = overlaps(truth, tracker, threshold, blocks=blocks, spread=True).groupBy("scene", "w").agg(F.sum("n").alias("n"))
                past = F.sum("n").over(Window.partitionBy("scene").orderBy(F.desc("w")))
                least = int(many.withColumn("past", past).where(F.col("past") > LIST_PAIRS).agg(F.max("w")).first()[0] or 0) + 1  # a row a weight
            lists = stored(overlaps(truth, tracker, threshold, blocks=blocks, least=least))
        else:
            sim = similarity(truth, tracker)
    if lists is None:
        overlap = sim.where(F.col("sim") >= threshold).groupBy("scene", "gt", "trk").agg(F.count("*").cast("double").alias("w"))
        took = assigned(overlap, ["scene"], "w", split=True)
    else:
        took = in_lists(lists, ["scene"]) if least == 1 else in_lists_and_below(lists, truth, tracker, least, threshold)
    tp = took.groupBy("scene").agg(F.sum("w").cast("long").alias("idtp"))
    j = counts(truth, tracker).join(tp, "scene", "left").fillna(0, ["idtp"])
    return identity_rates(j.select("scene", "idtp", (F.col("gt_dets") - F.col("idtp")).alias("idfn"), (F.col("dets") - F.col("idtp")).alias("idfp")))


def identity_rates(c: DataFrame) -> DataFrame:
    """idtp, idfn and idfp with idr, idp and idf1; holds for one scene as for sums over scenes."""
    tp, fn, fp = (F.col(x) for x in ("idtp", "idfn", "idfp"))
    share = lambda rest: tp / F.greatest(F.lit(1.0), tp + rest)
    return c.withColumns({"idr": share(fn), "idp": share(fp), "idf1": share(0.5 * fp + 0.5 * fn)})


def clear_matches(truth: DataFrame, tracker: DataFrame, sim: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(scene, frame, gt, trk): matches frame by frame that prefer the last frame's.

    Where no id has a choice, the matches follow from the pairs alone and SQL takes them. A run of frames with choices
    depends on nothing before the frame that it follows, so runs are folded each on its own; frames where one side is
    empty are passed over.
    """
    at = ["scene", "frame"]
    both = processed_frames(truth, tracker)
    tasks = int(sim.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    p = sim.where(F.col("sim") >= threshold - EPS).select(*at, F.col("gt").cast("long").alias("gt"), F.col("trk").cast("long").alias("trk"), "sim").repartition(tasks, *at)
    p = p.withColumns({f"_{s}": F.count("*").over(Window.partitionBy(*at, s)) for s in ("gt", "trk")})
    p = checkpointed(p.withColumn("hard", F.max((F.col("_gt") > 1) | (F.col("_trk") > 1)).over(Window.partitionBy(*at))).drop("_gt", "_trk"))
    easy = p.where("NOT hard").select(*at, "gt", "trk")
    if p.where("hard").isEmpty():
        return easy
    frames = p.where("hard").select(*at).distinct().join(both, at)
    frames = checkpointed(numbered(frames, ["scene"], ["k"], "_n").withColumn("run", F.col("k") - F.col("_n")).drop("_n"))
    rows = p.where("hard").join(frames, at).select("scene", "run", "frame", "gt", "trk", "sim")
    starts = frames.groupBy("scene", "run").agg((F.min("k") - 1).alias("k"))
    given = easy.join(both, at).join(starts, ["scene", "k"]).select("scene", "run", "frame", "gt", "trk", F.lit(None).cast("double").alias("sim"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, before = None, {}
        for x in whole_groups(batches, ["scene", "run", "frame"]):
            scene, number, frame, gt, trk, sim_ = (x[c].tolist() for c in ("scene", "run", "frame", "gt", "trk", "sim"))
            given, out, a = x["sim"].isna().tolist(), [], 0
            while a < len(x):
                b = a
                while b < len(x) and (scene[b], number[b], frame[b]) == (scene[a], number[a], frame[a]):
                    b += 1
                if run != (scene[a], number[a]):
                    run, before = (scene[a], number[a]), {}
                if given[a]:
                    before = dict(zip(gt[a:b], trk[a:b], strict=True))
                else:
                    one, two = {}, {}
                    w = [1000.0 * (before.get(g) == t) + s for g, t, s in zip(gt[a:b], trk[a:b], sim_[a:b], strict=True)]
                    took = matching([one.setdefault(g, len(one)) for g in gt[a:b]], [two.setdefault(t, len(two)) for t in trk[a:b]], w)
                    before = {gt[a + k]: trk[a + k] for k in took}
                    out += [(scene[a], frame[a], g, t) for g, t in before.items()]
                a = b
            yield pd.DataFrame(out, columns=["scene", "frame", "gt", "trk"])

    # a run streams through its task frame by frame, so that only one frame's pairs are held; by number, as the work of a run is not told by its bytes
    order = ["scene", "run", "frame", "gt", "trk"]
    hard = rows.unionByName(given).repartition(tasks, "scene", "run").sortWithinPartitions(*order).mapInPandas(fold, easy.schema)
    return easy.unionByName(hard)


def processed_frames(truth: DataFrame, tracker: DataFrame) -> DataFrame:
    """(scene, frame, k): the frames where neither side is empty, numbered from 0 a scene, however many frames it has."""
    at = ["scene", "frame"]
    both = truth.select(*at).distinct().join(tracker.select(*at).distinct(), at)
    return checkpointed(numbered(checkpointed(both), ["scene"], ["frame"], "k"))


#: Pairs a detection beyond which clear goes by frames, and cells of a frame that the kernel on lists takes.
DENSE_PAIRS, LISTED_CELLS = 8, 1 << 12


def _alike(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, zero_distance: float) -> np.ndarray:
    s = _similarities(x, y, i, j, zero_distance)
    return np.where(s >= threshold - EPS, s, 0.0)


def _listed_matching(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.nonzero(w)
    number: dict[int, int] = {}  # as clear_matches numbers them, so that ties end alike
    took = matching(i.tolist(), [number.setdefault(c, len(number)) for c in j.tolist()], w[i, j].tolist())
    return i[took], j[took]


def _kept_on(w: np.ndarray, own: np.ndarray, price: np.ndarray, held: np.ndarray, g: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a best matching that has the pairs g, t, from the best one of all and its prices."""
    rows, cols = np.setdiff1d(np.arange(w.shape[0]), g), np.setdiff1d(np.arange(w.shape[1]), t)
    place = np.full(w.shape[1] + 1, -1)
    place[cols] = np.arange(len(cols))
    w, own, price, held = w[np.ix_(rows, cols)], own[rows], price[cols], place[held[rows]]
    grown(w, own, price, held)
    holder, some = np.full(len(cols), -1), np.flatnonzero(held >= 0)
    holder[held[some]] = some
    grown(w.T, price, own, holder)
    some = np.flatnonzero(holder >= 0)
    return np.concatenate([g, rows[holder[some]]]), np.concatenate([t, cols[some]])


def matched_in_turn(truth: DataFrame, tracker: DataFrame, threshold: float = 0.5, zero_distance: float = 2.0) -> DataFrame:
    """clear_matches of detections whose similar pairs are too many to be rows; a frame must fit a task as a matrix.

    Every frame is matched on its own first, with prices that prove it. Then a scene's frames pass one task in order.
    Pairs of the last frame that are still similar weigh more than whatever they displace, so a frame takes them all; only
    a frame that has some is matched anew, from its prices. What is shuffled are detections.
    """
    at = ["scene", "frame"]
    tasks = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    side = lambda df, right: df.select(*at, F.lit(right).alias("right"), F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = side(truth, False).unionByName(side(tracker, True)).dropna()
    kind = {f.name: f.dataType for f in rows.schema.fields}
    out = StructType([StructField(c, kind[k]) for c, k in (("scene", "scene"), ("frame", "frame"), ("gt", "id"), ("trk", "id"))])

    def alone(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, [("right", "ascending"), ("id", "ascending")]))
        right, x, y = (t.column(c).to_numpy() for c in ("right", "x", "y"))
        i, j = np.flatnonzero(~right), np.flatnonzero(right)
        w = _alike(x, y, i, j, threshold, zero_distance)
        own, price, held = np.full(len(i), w.max(initial=0.0)), np.zeros(len(j)), np.full(len(i), -1)
        if w.size <= LISTED_CELLS:
            a, b = _listed_matching(w)
            held[a] = b
        else:
            grown(w, own, price, held)
        if not w.size:
            t = t.slice(0, 0)
            held = own = price = held[:0]
        more = np.concatenate([held, np.full(len(price), -1)])
        return t.append_column("dual", pa.array(np.concatenate([own, price]).astype(float))).append_column("held", pa.array(more.astype(np.int64)))

    first = rows.repartition(tasks, *at).groupBy(*at).applyInArrow(alone, StructType([*rows.schema.fields, StructField("dual", DoubleType()), StructField("held", LongType())]))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scene, gt, trk = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in whole_groups(batches, at):
            bounds, done = [*_starts(part, at).tolist(), len(part)], []
            names, frames = part["scene"].tolist(), part["frame"].to_numpy()
            right, ids, x, y, dual, held = (part[c].to_numpy() for c in ("right", "id", "x", "y", "dual", "held"))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if scene != names[a]:
                    scene, gt, trk = names[a], gt[:0], trk[:0]
                i, j = a + np.flatnonzero(~right[a:b]), a + np.flatnonzero(right[a:b])
                g, t = np.searchsorted(ids[i], gt), np.searchsorted(ids[j], trk)
                still = (g < len(i)) & (t < len(j))
                still[still] = (ids[i[g[still]]] == gt[still]) & (ids[j[t[still]]] == trk[still])
                g, t = g[still], t[still]
                near = np.array([_alike(x, y, i[[p]], j[[q]], threshold, zero_distance)[0, 0] > 0 for p, q in zip(g, t, strict=True)], bool)
                g, t = g[near], t[near]
                if not len(g):
                    g = np.flatnonzero(held[i] >= 0)
                    t = held[i[g]]
                else:
                    w = _alike(x, y, i, j, threshold, zero_distance)
                    if w.size <= LISTED_CELLS:
                        w[g, t] += 1000.0
                        g, t = _listed_matching(w)
                    else:
                        g, t = _kept_on(w, dual[i].copy(), dual[j].copy(), held[i].copy(), g, t)
                gt, trk = ids[i[g]], ids[j[t]]
                done.append(pd.DataFrame({"scene": scene, "frame": frames[a], "gt": gt, "trk": trk}))
            yield pd.concat(done, ignore_index=True)

    # a scene streams through its task, of which a frame is held at a time
    return first.repartition(tasks, "scene").sortWithinPartitions(*at, "right", "id").mapInPandas(fold, out)


def clear(truth: DataFrame, tracker: DataFrame, sim: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(scene, tp, fn, fp, idsw, mota). Without sim, where pairs are many times the detections and frames fit a task, no pair is a row."""
    m = None
    if sim is None:
        frames = [s.groupBy("scene", "frame").agg(F.count("*").cast("double").alias(n)) for s, n in ((truth, "n"), (tracker, "m"))]
        n, most = frames[0].join(frames[1], ["scene", "frame"]).agg(F.sum(F.col("n") + F.col("m")), F.max(F.col("n") * F.col("m"))).first()
        if n and most <= FRAME_CELLS and meeting_pairs(truth, tracker) > DENSE_PAIRS * n:
            m = checkpointed(matched_in_turn(truth, tracker, threshold))
        else:
            sim = similarity(truth, tracker)
    m = clear_matches(truth, tracker, sim, threshold) if m is None else m
    last = F.lag("trk").over(Window.partitionBy("scene", "gt").orderBy("frame"))
    tot = m.withColumn("sw", (last != F.col("trk")).cast("int")).groupBy("scene").agg(F.count("*").alias("tp"), F.coalesce(F.sum("sw"), F.lit(0)).alias("idsw"))
    j = counts(truth, tracker).join(tot, "scene", "left").fillna(0, ["tp", "idsw"])
    j = j.withColumn("fn", F.col("gt_dets") - F.col("tp")).withColumn("fp", F.col("dets") - F.col("tp"))
    mota = (F.col("tp") - F.col("fp") - F.col("idsw")) / F.greatest(F.lit(1), F.col("gt_dets"))
    return j.select("scene", "tp", "fn", "fp", "idsw", F.when((F.col("dets") == 0) | (F.col("gt_dets") == 0), 0.0).otherwise(mota).alias("mota"))


def final_score(per_scene: DataFrame) -> DataFrame:
    """The mean over scenes of the mean over thresholds."""
    return per_scene.groupBy("scene").agg(F.avg("hota").alias("h"), F.avg("det_a").alias("d"), F.avg("ass_a").alias("a"), F.avg("loc_a").alias("l")).agg(*[F.avg(c).alias(n) for c, n in (("h", "hota"), ("d", "det_a"), ("a", "ass_a"), ("l", "loc_a"))])


def clear_fields(truth: DataFrame, tracker: DataFrame, sim: DataFrame, threshold: float = 0.5, lengths: DataFrame | None = None) -> DataFrame:
    """All CLEAR fields per scene: counters, mostly, partly and hardly tracked ids (mt, pt, ml), fragments and rates.

    frames is the scene's length, from lengths (scene, seq_length) or else scene_lengths. Frames where one side is empty
    are passed over: they neither end a fragment nor break a track. A scene with an empty side has its misses or false
    alarms counted, mlr 1 and, without a tracker, all its ids in ml; everything else is 0, the frames too.
    """
    sim = checkpointed(sim)
    m = clear_matches(truth, tracker, sim, threshold).join(sim, ["scene", "frame", "gt", "trk"]).join(processed_frames(truth, tracker), ["scene", "frame"])
    own = Window.partitionBy("scene", "gt").orderBy("frame")
    m = m.withColumn("sw", (F.lag("trk").over(own) != F.col("trk")).cast("int")).withColumn("br", (F.col("k") - F.lag("k").over(own) > 1).cast("int"))
    # one row an id first: hits, switches and breaks, then the scene's sums
    hit = m.groupBy("scene", "gt").agg(F.count("*").alias("hit"), F.coalesce(F.sum("sw"), F.lit(0)).alias("sw"), F.coalesce(F.sum("br"), F.lit(0)).alias("br"), F.sum("sim").alias("s"))
    share = per_id(truth).withColumnRenamed("id", "gt").join(hit, ["scene", "gt"], "left").fillna(0).withColumn("r", F.col("hit") / F.col("n"))
    kept = share.groupBy("scene").agg(
        F.sum("hit").alias("tp"), F.sum("sw").alias("idsw"), F.sum("br").alias("frag"), F.sum("s").alias("motp_sum"),
        F.count(F.when(F.col("r") > 0.8, 1)).alias("mt"), F.count(F.when((F.col("r") >= 0.2) & (F.col("r") <= 0.8), 1)).alias("pt"), F.count(F.when(F.col("r") < 0.2, 1)).alias("ml"),
    )
    j = count_fields(truth, tracker, lengths).join(kept, "scene", "left").fillna(0)
    j = j.withColumn("fn", F.col("gt_dets") - F.col("tp")).withColumn("fp", F.col("dets") - F.col("tp"))
    lone = (F.col("dets") == 0) | (F.col("gt_dets") == 0)
    j = j.withColumn("frames", F.when(lone, 0).otherwise(F.col("frames"))).withColumn("ml", F.when(F.col("dets") == 0, F.col("gt_ids")).otherwise(F.col("ml")))
    rates = clear_rates(j.select("scene", "frames", "tp", "fn", "fp", "idsw", "frag", "mt", "pt", "ml", "motp_sum", lone.alias("_lone")))
    return rates.withColumns({c: F.when(F.col("_lone"), 1.0 if c == "mlr" else 0.0).otherwise(F.col(c)) for c in CLEAR_RATES}).drop("_lone")


CLEAR_COUNTS = ["frames", "tp", "fn", "fp", "idsw", "frag", "mt", "pt", "ml", "motp_sum"]
CLEAR_RATES = ["mtr", "ptr", "mlr", "motp", "clr_re", "clr_pr", "moda", "mota", "motal", "smota", "clr_f1", "fp_per_frame"]
ID_COUNTS, ID_RATES = ["idtp", "idfn", "idfp"], ["idr", "idp", "idf1"]
HOTA_RATES = ["hota", "det_a", "ass_a", "ass_re", "ass_pr", "loc_a", "det_re", "det_pr", "owta"]


def clear_rates(c: DataFrame) -> DataFrame:
    """The counters with the rates that follow from them; holds for one scene as for sums over scenes."""
    at_least_1 = lambda x: F.greatest(F.lit(1), x)
    tp, fp, sw, gt = F.col("tp"), F.col("fp"), F.col("idsw"), F.col("tp") + F.col("fn")
    ids = at_least_1(F.col("mt") + F.col("pt") + F.col("ml"))
    log_sw = F.when(sw > 0, F.log10(F.greatest(F.lit(1), sw))).otherwise(0.0)
    return c.withColumns({
        "mtr": F.col("mt") / ids, "ptr": F.col("pt") / ids, "mlr": F.col("ml") / ids, "motp": F.col("motp_sum") / at_least_1(tp), "clr_re": tp / at_least_1(gt), "clr_pr": tp / at_least_1(tp + fp),
        "moda": (tp - fp) / at_least_1(gt), "mota": (tp - fp - sw) / at_least_1(gt), "motal": (tp - fp - log_sw) / at_least_1(gt), "smota": (F.col("motp_sum") - fp - sw) / at_least_1(gt),
        "clr_f1": tp / at_least_1(tp + 0.5 * F.col("fn") + 0.5 * fp), "fp_per_frame": fp / at_least_1(F.col("frames")),
    })


def combined_sequences(h: DataFrame, by: list[str]) -> DataFrame:
    """HOTA rows summed over scenes within `by` and alpha: counts add up, the association and location scores weigh by tp.

    Without any match the location score is 1. The average over detections of several classes is the same sum.
    """
    weigh = lambda c: F.sum(F.col(c) * F.col("tp")) / F.greatest(F.lit(1), F.sum("tp"))
    loc = F.greatest(F.lit(1e-10), F.sum(F.col("loc_a") * F.col("tp"))) / F.greatest(F.lit(1e-10), F.sum("tp"))
    s = h.groupBy(*by, "alpha").agg(*[weigh(c).alias(c) for c in ("ass_a", "ass_re", "ass_pr")], loc.alias("loc_a"), *[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])
    s = s.withColumn("det_a", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn") + F.col("fp")))
    return hota_finals(s).select(*by, "alpha", "tp", "fn", "fp", "det_re", "det_pr", "det_a", "ass_a", "ass_re", "ass_pr", "loc_a", "hota", "owta")


def hota_finals(h: DataFrame) -> DataFrame:
    """Recall and precision of detection, HOTA and OWTA from tp, fn, fp, det_a and ass_a."""
    re, pr = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")), F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))
    return h.withColumns({"det_re": re, "det_pr": pr, "hota": F.sqrt(F.col("det_a") * F.col("ass_a")), "owta": F.sqrt(re * F.col("ass_a"))})


def summed(c: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The counters summed within `by`: over scenes, or over the classes of a super-category."""
    return c.groupBy(*by).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in columns])


def combined_clear(c: DataFrame, by: list[str]) -> DataFrame:
    return clear_rates(summed(c, by, CLEAR_COUNTS))


def combined_identity(c: DataFrame, by: list[str]) -> DataFrame:
    return identity_rates(summed(c, by, ID_COUNTS))


def combined_counts(c: DataFrame, by: list[str]) -> DataFrame:
    return summed(c, by, ["dets", "gt_dets", "ids", "gt_ids"])


def class_average(h: DataFrame, ignore_empty: bool = False) -> DataFrame:
    """Means over classes per alpha of the combined HOTA rows (class, alpha, ...), sums of their counts; classes without any detection may be left out."""
    h = h.withColumn("_any", F.sum(F.col("tp") + F.col("fn") + F.col("fp")).over(Window.partitionBy("class")) > 0)
    h = h.where("_any") if ignore_empty else h
    return h.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")], *[F.avg(c).alias(c) for c in HOTA_RATES if c in h.columns])


def class_average_of(c: DataFrame, counts_: list[str], rates: list[str], present: list[str], ignore_empty: bool = False) -> DataFrame:
    """One row: sums of the counters and means of the rates over classes; those whose `present` counters are all 0 may be left out."""
    if ignore_empty:
        c = c.where(sum((F.col(x) for x in present[1:]), F.col(present[0])) > 0)
    return c.agg(*[F.sum(x).alias(x) for x in counts_], *[F.avg(x).alias(x) for x in rates])


def class_average_clear(c: DataFrame, ignore_empty: bool = False) -> DataFrame:
    return class_average_of(c, [x for x in CLEAR_COUNTS if x != "motp_sum"], [*CLEAR_RATES, "motp_sum"], ["tp", "fn", "fp"], ignore_empty)


def class_average_identity(c: DataFrame, ignore_empty: bool = False) -> DataFrame:
    return class_average_of(c, ID_COUNTS, ID_RATES, ID_COUNTS, ignore_empty)


def super_categories(per_class: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of classes with `parent` from (class, parent): combine them `by` parent as sequences are. A class may have several parents."""
    return per_class.join(F.broadcast(parents), "class")


def at_first_threshold(h: DataFrame) -> DataFrame:
    """(scene, hota_0, loc_a_0, hota_loc_a_0): the values at the lowest threshold and their product."""
    first = h.where(F.col("alpha") == ALPHAS[0])
    return first.select("scene", F.col("hota").alias("hota_0"), F.col("loc_a").alias("loc_a_0"), (F.col("hota") * F.col("loc_a")).alias("hota_loc_a_0"))


def detailed(h: DataFrame, field: str) -> DataFrame:
    """One row a scene: the field at each threshold as field___5 ... field___95, and its mean as field___AUC."""
    wide = [F.max(F.when(F.col("alpha") == a, F.col(field))).alias(f"{field}___{round(100 * a)}") for a in ALPHAS]
    return h.groupBy("scene").agg(*wide, F.avg(field).alias(f"{field}___AUC"))
