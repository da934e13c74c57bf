"""Assignment against all permutations; plausibility and text rules on hand-made cases."""

from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from trackloom.functions import expressions as X
from trackloom.operators import evaluation as E
from trackloom.operators import identity as I
from trackloom.operators.evaluation import clear, clear_matches, hota, identity, similarity
from trackloom.operators.identity import plausibility
from trackloom.operators.matching import matching


def best_assignment(w):
    """A best one-to-one assignment of a small matrix, all of them tried."""
    flip = w.shape[0] > w.shape[1]
    small = w.T if flip else w
    p = max(permutations(range(small.shape[1]), small.shape[0]), key=lambda p: sum(small[i, j] for i, j in enumerate(p)))
    return [(j, i) if flip else (i, j) for i, j in enumerate(p)]


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 6, 2)
        w = np.round(rng.random((n, m)), 2)
        w[rng.random((n, m)) < rng.choice([0, 0.3, 0.7])] = 0
        r, c = np.nonzero(w)
        took = matching(r.tolist(), c.tolist(), w[r, c].tolist())
        assert len({r[k] for k in took}) == len({c[k] for k in took}) == len(took)
        assert abs(sum(w[r[k], c[k]] for k in took) - sum(w[a, b] for a, b in best_assignment(w))) < 1e-9


def test_plausibility(spark):
    rows = [(100, 200, 100, 200, 1.0, True, 0.0, 0.0), (100, 200, 100, 200, 0.02, False, 0.01, 1.0), (100, 200, 100, 200, 10.0, False, 0.0, 0.0), (50, 100, 130, 180, 1.0, True, 0.5, 1.0), (100, 300, 300, 500, 0.0, True, 0.01, 1.0), (100, 300, 150, 350, 0.0, True, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "fa int, la int, fb int, lb int, m double, same boolean, lo double, hi double")
    p = plausibility(*[F.col(c) for c in ("fa", "la", "fb", "lb", "m", "same")])
    assert all(r.lo <= r.p <= r.hi for r in df.select(p.alias("p"), "lo", "hi").collect())


def test_captions(spark):
    df = spark.createDataFrame([("a bald bald bald man", True), ("a small bird", False), ("", False), (None, False), ("bald, bald. bald", False), (" A\tbald Bald\nBALD man", True)], "c string, want boolean")
    assert all(r.got == r.want for r in df.select(X.degenerate(F.col("c")).alias("got"), "want").collect())


def brute_hota(truth, tracker, sims, alpha):
    """(tp, ass_a, ass_re, ass_pr, loc sum) by trying every one-to-one matching of a frame."""
    ng, nt = Counter(i for _, i in truth), Counter(i for _, i in tracker)
    pot, by_frame = Counter(), {}
    for (f, g, t), s in sims.items():
        by_frame.setdefault(f, {})[g, t] = s
    for pairs in by_frame.values():
        for (g, t), s in pairs.items():
            den = sum(x for (a, _), x in pairs.items() if a == g) + sum(x for (_, b), x in pairs.items() if b == t) - s
            pot[g, t] += s / den
    ga = {k: v / (ng[k[0]] + nt[k[1]] - v) for k, v in pot.items()}
    matched, loc = Counter(), 0.0
    for pairs in by_frame.values():
        gs, ts = sorted({g for g, _ in pairs}), sorted({t for _, t in pairs})
        options = permutations([*ts, *[None] * len(gs)], len(gs))
        best = max(options, key=lambda o: sum(ga[g, t] * pairs[g, t] for g, t in zip(gs, o) if (g, t) in pairs))
        for g, t in zip(gs, best):
            if (g, t) in pairs and pairs[g, t] >= alpha - 2e-16:
                matched[g, t] += 1
                loc += pairs[g, t]
    tp = sum(matched.values())
    over = lambda den: sum(n * n / max(1, den(g, t, n)) for (g, t), n in matched.items()) / max(1, tp)
    return tp, over(lambda g, t, n: ng[g] + nt[t] - n), over(lambda g, t, n: ng[g]), over(lambda g, t, n: nt[t]), loc / max(1e-10, tp)


def test_contested_scenes_against_brute_force(spark):
    rng = np.random.default_rng(8)
    truth = [(f, g) for f in range(12) for g in range(3) if rng.random() < 0.9]
    tracker = [(f, t) for f in range(12) for t in range(20, 23) if rng.random() < 0.9]
    sims = {(f, g, t): float(rng.uniform(0.1, 1)) for f, g in truth for h, t in tracker if f == h and rng.random() < 0.8}
    df = lambda rows: spark.createDataFrame([("s", f, i) for f, i in rows], "scene string, frame long, id long")
    sim = spark.createDataFrame([("s", *k, v) for k, v in sims.items()], "scene string, frame long, gt long, trk long, sim double")
    rows = {round(r.alpha, 2): r for r in hota(df(truth), df(tracker), sim).collect()}
    for alpha in (0.05, 0.5, 0.9):
        r = rows[alpha]
        assert np.allclose((r.tp, r.ass_a, r.ass_re, r.ass_pr, r.loc_a), brute_hota(truth, tracker, sims, alpha))
    overlap = Counter((g, t) for (f, g, t), s in sims.items() if s >= 0.5)
    want = max(sum(overlap[g, t] for g, t in zip(range(3), o)) for o in permutations((20, 21, 22, None, None, None), 3))
    got = identity(df(truth), df(tracker), sim).first()
    assert (got.idtp, got.idfn, got.idfp) == (want, len(truth) - want, len(tracker) - want) and np.isclose(got.idr, want / len(truth)) and np.isclose(got.idp, want / len(tracker))


def test_one_sided_scenes(spark):
    row = lambda s, i: (s, 1, i, 0.0, 0.0)
    schema = "scene string, frame long, id long, x double, y double"
    truth, tracker = spark.createDataFrame([row("a", 1), row("a", 2), row("c", 1)], schema), spark.createDataFrame([row("b", 1), row("c", 1)], schema)
    h = {r.scene: r for r in hota(truth, tracker).where("alpha = 0.5").collect()}
    assert [(h[s].tp, h[s].fn, h[s].fp, h[s].loc_a, h[s].hota) for s in "abc"] == [(0, 2, 0, 1.0, 0.0), (0, 0, 1, 1.0, 0.0), (1, 0, 0, 1.0, 1.0)]
    c = {r.scene: r for r in E.clear_fields(truth, tracker, similarity(truth, tracker)).collect()}
    assert [(c[s].fn, c[s].fp, c[s].ml, c[s].mlr, c[s].mota, c[s].frames) for s in "ab"] == [(2, 0, 2, 1.0, 0.0, 0), (0, 1, 0, 1.0, 0.0, 0)]
    alone = E.combined_sequences(hota(truth.where("scene = 'a'"), tracker.where("false")), []).first()
    assert (alone.tp, alone.loc_a) == (0, 1.0)
    assert E.class_average_identity(spark.createDataFrame([("x", 1, 1, 0, 0.5, 1.0, 0.6), ("y", 0, 0, 0, 0.0, 0.0, 0.0)], "class string, idtp long, idfn long, idfp long, idr double, idp double, idf1 double"), ignore_empty=True).first().idr == 0.5


def test_perfect_and_switched_tracks(spark):
    truth = spark.createDataFrame([("s", f, i, 10.0 * i, 0.0) for f in range(4) for i in (1, 2)], "scene string, frame long, id long, x double, y double")
    assert {r.hota for r in hota(truth, truth).collect()} == {1.0}
    switched = truth.withColumn("id", F.when(F.col("frame") < 2, F.col("id")).otherwise(3 - F.col("id")))
    sim = similarity(truth, switched)
    assert identity(truth, switched, sim).first().idtp == 4
    got = clear(truth, switched, sim).first()
    assert (got.tp, got.idsw, got.mota) == (8, 2, 0.75)


def test_matches_of_contested_frames_follow_the_fold(spark):
    """Runs folded apart against one fold over all frames, with easy, contested and one-sided frames mixed."""
    rng = np.random.default_rng(3)
    truth = [("s", f, i) for f in range(40) for i in range(3) if rng.random() < 0.8]
    tracker = [("s", f, i) for f in range(40) for i in range(10, 13) if rng.random() < 0.8]
    sims = [("s", f, g, t, float(rng.uniform(0.3, 1))) for _, f, g in truth for _, h, t in tracker if f == h and rng.random() < 0.4]
    frame = lambda rows: spark.createDataFrame(rows, "scene string, frame long, id long")
    before, want = {}, set()
    for f in sorted({r[1] for r in truth} & {r[1] for r in tracker}):
        w = np.zeros((3, 3))
        for _, h, g, t, s in sims:
            if h == f and s >= 0.5:
                w[g, t - 10] = s + 1000 * (before.get(g) == t)
        before = {a: b + 10 for a, b in best_assignment(w) if w[a, b] > 0}
        want |= {(f, a, b) for a, b in before.items()}
    got = clear_matches(frame(truth), frame(tracker), spark.createDataFrame(sims, "scene string, frame long, gt long, trk long, sim double"))
    assert {(r.frame, r.gt, r.trk) for r in got.collect()} == want


def test_overlap_across_cameras_needs_nearness(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.02, 1.0)], "m double, want double")
    p = plausibility(F.lit(0), F.lit(9), F.lit(0), F.lit(9), F.col("m"), F.lit(False))
    assert all(r.p == r.want for r in df.select(p.alias("p"), "want").collect())


def test_handoff(spark):
    rows = [(6, 20.0, 0.85), (200, 500.0, 0.0), (6, None, 0.0), (11, 36.0, 0.425), (8, 46.0, 0.425), (-30, 10.0, 0.85)]
    df = spark.createDataFrame(rows, "gap int, px double, want double")
    got = df.select(I.handoff(F.col("gap"), F.col("px")).alias("got"), I.handoff(F.col("gap"), F.col("px"), strict=True).alias("strict"), "gap", "want").collect()
    assert all(abs(r.got - r.want) < 1e-9 and abs(r.strict - (r.want if r.gap >= 0 else 0)) < 1e-9 for r in got)


def test_merges_keep_overlapping_tracks_of_a_camera_apart(spark):
    # tracks 1 and 2 of camera 0 overlap; both match track 3 of camera 1, only the first may join it
    members = spark.createDataFrame([(0, 1, 0, 100, 1, 1), (0, 2, 50, 150, 2, 2), (1, 3, 0, 10, 3, 3), (1, 4, 200, 210, 4, 4)], "camera int, track_id long, first_frame int, last_frame int, root long, rep_id long")
    pairs = spark.createDataFrame([(0, 1, 1, 3), (0, 2, 1, 3)], "cam_a int, a long, cam_b int, b long")
    got = {(r.camera, r.root): tuple(r.cluster) for r in I.merged(members, pairs).collect()}
    assert got == {(0, 1): (0, 1), (1, 3): (0, 1), (0, 2): (0, 2), (1, 4): (1, 4)}


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    got = I.labelled(nodes, spark.range(49).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    ids = {r.node: r.global_id for r in I.dense_ids(got).collect()}
    assert ids == {n: max(0, n - 49) for n in range(60)}


TRACK = "camera int, track_id long, embedding array<double>, caption_embedding array<double>, first_frame int, last_frame int, world_x double, world_y double, first_px_x double, first_px_y double, last_px_x double, last_px_y double"


def test_scores_with_captions_and_handoffs(spark):
    a = (0, 1, [1.0, 0.0], [1.0, 0.0], 0, 100, 0.0, 0.0, 0.0, 0.0, 50.0, 50.0)
    b = (0, 2, [0.6, 0.8], [1.0, 0.0], 106, 200, 0.0, 0.0, 60.0, 50.0, 90.0, 90.0)
    c = (1, 3, [0.6, 0.8], None, 300, 400, 0.0, 0.0, None, None, None, None)
    tracks = spark.createDataFrame([a, b, c], TRACK)
    own = {(r.a, r.b): round(r.score, 9) for r in I._scored(tracks, True, 0.0).collect()}
    assert own == {(1, 2): 0.85, (2, 1): 0.68}  # a handoff from 1 to 2; looks and captions alone the other way
    across = {(r.a, r.b): round(r.score, 9) for r in I.scored_pairs(tracks).collect()}
    assert across == {(1, 3): 0.6, (2, 3): 1.0}  # no caption: looks alone


def test_group_similarity_and_cluster_counts(spark):
    pairs = spark.createDataFrame([("g", x) for x in (0.9, 0.8, 0.7, 0.1)] + [("h", 0.5)], "g string, sim double")
    assert {r.g: round(r.sim, 9) for r in I.group_similarity(pairs, ["g"]).collect()} == {"g": 0.8, "h": 0.5}
    ids = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (0, 2, 1)], "camera int, track_id long, global_id long")
    assert tuple(I.cluster_counts(ids).first()) == (2, 1)
