"""Steps whose figures grew faster than the input, against brute force."""

from __future__ import annotations

from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from trackloom import catalog, plans
from trackloom.operators import evaluation, identity, matching, proximity, sampling, sightings, similar


def test_cooccurrence_in_blocks(spark, monkeypatch):
    """Dense sightings go block against block, without a shuffle of pairs, to the same counts."""
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(1, 40)), str(rng.integers(1, 4)), i, a := int(rng.integers(0, 900)), a + int(rng.integers(0, 300))) for i in range(300)] + [(7, "1", 900, 0, 5000)]
    df = spark.createDataFrame(rows, "global_id long, camera string, seg_idx long, start_frame long, end_frame long")
    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] == y[1] and max(x[3] - y[4], y[3] - x[4]) <= 9:
                want[x[0], y[0]] = want.get((x[0], y[0]), 0) + 1
    used, step = [], sightings._counted_in_blocks
    monkeypatch.setattr(sightings, "_counted_in_blocks", lambda *a: used.append(a[2]) or step(*a))
    for block in (7, 100):
        assert {(r.a, r.b): r.n_matches for r in sightings.cooccurrence(df, 9, block).collect()} == want
    names = df.withColumn("global_id", F.concat(F.lit("e"), "global_id"))
    assert {(r.a, r.b): r.n_matches for r in sightings.cooccurrence(names, 9, 7).collect()} == {tuple(sorted((f"e{a}", f"e{b}"))): n for (a, b), n in want.items()}
    assert used == [6, 1, 6]


def test_partners_among_near_copies(spark, tmp_path):
    """Vectors that come again under other ids, exactly or nearly, do not take each other's partner."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(8, 64))
    v = np.repeat(base, 5, axis=0) + rng.normal(size=(40, 64)) * np.tile([0, 0, 0.05, 0.05, 0.1], 8)[:, None]
    v /= np.linalg.norm(v, axis=1)[:, None]
    spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = str(tmp_path)
    assert {(r.a, r.b) for r in catalog.QUERIES["match_pairs"](spark, d).collect()} == {(4 * i, 4 * i + 1) for i in range(40)}
    assert {(r.track_id, r.root) for r in catalog.QUERIES["stitched_tracks"](spark, d).collect()} == {(4 * i + c, 4 * i) for i in range(40) for c in range(2)}
    ids = catalog.QUERIES["global_identities"](spark, d).collect()
    assert {(r.camera, r.track_id, r.global_id) for r in ids} == {(c, 4 * i + c, i) for i in range(40) for c in range(2)} and len(ids) == 80
    assert [tuple(r) for r in catalog.QUERIES["cluster_counts"](spark, d).collect()] == [(40, 40)]


def test_settled_pairs_are_in_a_best_matching(spark):
    """What best pairs settle leaves a rest that reaches the whole's greatest weight, by brute force on many small groups."""
    rng = np.random.default_rng(7)
    rows = [(k, f"g{i}", f"t{j}", float(rng.integers(1, 9)) if k % 2 else float(rng.random())) for k in range(60) for i in range(4) for j in range(4) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "k int, gt string, trk string, w double")

    def best(pairs):
        w = {(a, b): x for a, b, x in pairs}
        return max(sum(w.get((f"g{i}", f"t{j}"), 0.0) for i, j in enumerate(p)) for p in permutations(range(4)))

    sure = [tuple(r) for r in matching.settled(df, ["k"], "w").collect()]
    assert len(sure) > 20
    for k in range(60):
        own, mine = [r[1:] for r in rows if r[0] == k], [r[1:] for r in sure if r[0] == k]
        g, t = {x[0] for x in mine}, {x[1] for x in mine}
        assert len(g) == len(t) == len(mine)
        assert abs(sum(x[2] for x in mine) + best([x for x in own if x[0] not in g and x[1] not in t]) - best(own)) < 1e-9


def test_whole_groups_hold_one_group():
    """Sorted batches are cut at groups, so that a run of frames streams through a task."""
    x = pd.DataFrame({"scene": list("aaaaaaabbb"), "frame": [1, 1, 1, 2, 2, 3, 3, 3, 3, 4], "v": range(10)})
    parts = list(matching.whole_groups((x.iloc[i : i + 2] for i in range(0, 10, 2)), ["scene", "frame"]))
    assert pd.concat(parts)["v"].tolist() == list(range(10)) and max(map(len, parts)) <= 3
    seen = [set(zip(p["scene"], p["frame"], strict=True)) for p in parts]
    assert sum(map(len, seen)) == len(set().union(*seen)) == 5


def test_similarity_by_cells(spark):
    """Detections meet by cells to the pairs of all with all, at borders and below zero too."""
    rng = np.random.default_rng(8)
    side = lambda: [("s", int(rng.integers(0, 3)), i, float(rng.integers(-40, 40)) / 2, float(rng.integers(-6, 6)) * 1.5) for i in range(90)]
    g, t = side(), side()
    schema = "scene string, frame long, id long, x double, y double"
    want = {(a[2], b[2]): 1 - np.hypot(a[3] - b[3], a[4] - b[4]) / 2 for a in g for b in t if a[1] == b[1] and np.hypot(a[3] - b[3], a[4] - b[4]) < 2}
    sim = evaluation.similarity(spark.createDataFrame(g, schema), spark.createDataFrame(t, schema))
    got = {(r.gt, r.trk): r.sim for r in sim.collect()}
    assert got.keys() == want.keys() and sim.count() == len(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert "_cx" in sim._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_later_by_blocks(spark):
    """The highest similarities with later vectors, over blocks smaller than a group, to those of all pairs."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i % 3, 7 * i % 60, x.tolist()) for i, x in enumerate(v)], "label int, a long, embedding array<double>")
    got = {}
    for r in similar.nearest_later(df, "label", "a", "embedding", 3, 6).collect():
        got.setdefault((r.label, r.a), []).append(r.sim)
    rows = {7 * i % 60: (i % 3, x) for i, x in enumerate(v)}
    for a, (label, x) in rows.items():
        want = sorted((float(x @ y) for b, (other, y) in rows.items() if other == label and b > a), reverse=True)[:3]
        assert np.allclose(sorted(got.get((label, a), []), reverse=True)[:3], want)
    assert max(map(len, got.values())) <= 12


def test_boxes_meet_by_cells(spark):
    """Every overlapping pair once, boxes wider than a cell and left of zero among them; far ones do not meet."""
    rng = np.random.default_rng(10)
    rows = [("s", i, int(rng.integers(-200, 400)), int(rng.integers(-100, 300)), int(rng.integers(1, 90)), int(rng.integers(1, 90))) for i in range(150)]
    met = evaluation.meeting_boxes(spark.createDataFrame(rows, "s string, id long, l long, t long, w long, h long"), ["s"], "id")
    pairs = [(r.a, r.b) for r in met.collect()]
    want = {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and min(x[2] + x[4], y[2] + y[4]) > max(x[2], y[2]) and min(x[3] + x[5], y[3] + y[5]) > max(x[3], y[3])}
    assert len(pairs) == len(set(pairs)) and want <= set(pairs) and len(pairs) < 150 * 149 / 2 / 4


def test_dense_matching():
    """The weight of the matching on lists of pairs, with ties and empty rows too."""
    rng = np.random.default_rng(11)
    for k in range(200):
        n, m = rng.integers(1, 12, 2)
        w = rng.integers(0, 6, (n, m)).astype(float) if k % 2 else np.where(rng.random((n, m)) < 0.5, rng.random((n, m)), 0)
        i, j = matching.dense_matching(w)
        r, c = np.nonzero(w)
        took = matching.matching(r.tolist(), c.tolist(), w[r, c].tolist())
        assert len(set(i)) == len(i) and len(set(j)) == len(j) and (w[i, j] > 0).all() and abs(w[i, j].sum() - w[r, c][took].sum()) < 1e-9


def test_hota_of_crowded_frames(spark, monkeypatch):
    """Frames where more pairs meet than tracks have copies are matched as matrices, to the scores of lists of pairs."""
    rng = np.random.default_rng(12)
    schema = "scene string, frame long, id long, x double, y double"
    side = lambda: spark.createDataFrame([(s, f, i, *rng.random(2).tolist()) for s in "ab" for f in range(1, 9) for i in range(40) if rng.random() < 0.2 + 0.5 * (f == 3)], schema)
    g, t = side(), side()
    far = t.withColumn("x", F.col("x") + 50 * F.col("id"))
    assert evaluation.crowded(g, t, evaluation.meeting_pairs(g, t)) and not evaluation.crowded(g, far, evaluation.meeting_pairs(g, far))
    monkeypatch.setattr(evaluation, "similarity", None)
    got = {(r.scene, r.alpha): r for r in evaluation.hota(g, t).collect()}
    monkeypatch.undo()
    want = evaluation.hota(g, t, evaluation.similarity(g, t)).collect()
    assert len(got) == len(want) == 38 and all(np.allclose(got[r.scene, r.alpha][2:], r[2:]) for r in want)


def test_matches_in_blocks(spark, monkeypatch):
    """Block against block, chunk by chunk and without a shuffle of pairs, to the matches of the band join; ties, nulls and negative places too."""
    rng = np.random.default_rng(13)
    rows = [(i, str(rng.integers(1, 3)), int(rng.integers(0, 25)), int(rng.integers(0, 200)), float(rng.integers(-300, 300)) / 8, float(rng.integers(-60, 60)) / 8) for i in range(1500)]
    rows += [(1500, "1", 3, 40, None, 1.0), (1501, "1", 4, 41, float("nan"), 1.0), (1502, None, 5, 40, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "ordinal long, camera string, global_id long, frame long, wx double, wy double")
    want = sorted(tuple(r) for r in proximity.matches(proximity.band_pairs(d, 6, 3.0, 50), 3, 0.5).collect())
    for blocks, chunk in ((1, 1 << 21), (3, 50)):
        monkeypatch.setattr(proximity, "CHUNK", chunk)
        m = proximity.matches_of_all(d, 6, 3.0, 50, 3, 3, 0.5, blocks=blocks)
        assert sorted(tuple(r) for r in m.collect()) == want and len(want) > 200
    assert "Join" not in m._jdf.queryExecution().optimizedPlan().toString()
    order = lambda rows: {k: sorted((r[5], r[1]) for r in rows if (r[0], r[7]) == k)[:2] for k in {(r[0], r[7]) for r in rows}}
    top = [tuple(r) for r in proximity.matches_of_all(d, 6, 3.0, 50, 3, 3, 0.5, 2, 3).collect()]
    assert order(top) == order(want) and set(top) < set(want)


def test_hota_deals_pairs_to_more_tasks(spark, monkeypatch):
    """A task's share of the pairs does not grow with them, to the same scores."""
    schema = "scene string, frame long, id long, x double, y double"
    rng = np.random.default_rng(14)
    side = lambda: spark.createDataFrame([("s", f, i, 1.5 * i + rng.random(), 0.0) for f in range(1, 60) for i in range(5)], schema)
    g, t = side(), side()
    sim, dealt, step = evaluation.similarity(g, t), [], evaluation.checkpointed
    monkeypatch.setattr(evaluation, "checkpointed", lambda df: dealt.append(step(df)) or dealt[-1])
    want = evaluation.hota(g, t, sim).collect()
    monkeypatch.setattr(evaluation, "TASK_PAIRS", 50)
    got = evaluation.hota(g, t, sim).collect()
    assert [d.rdd.getNumPartitions() for d in dealt] == [4, -(-sim.count() // 50)]
    assert len(got) == 19 and all(np.allclose(a[2:], b[2:]) for a, b in zip(sorted(got), sorted(want), strict=True))


def test_nearest_of_others_in_tasks(spark, monkeypatch):
    """Points of other cameras are searched in tasks, without joins, to the distances of all pairs; keys with too many go by grids."""
    rng = np.random.default_rng(15)
    rows = [(int(k), i, "abc"[int(c)], float(x), float(y)) for i, (k, c, x, y) in enumerate(zip(rng.integers(0, 4, 400), rng.choice(3, 400, p=[0.8, 0.15, 0.05]), np.round(rng.exponential(40, 400) ** 2) / 4, rng.integers(0, 30, 400), strict=True))]
    rows += [(9, 500, "a", 1.0, 1.0), (9, 501, "a", 2.0, 1.0), (10, 502, "a", 1.0, 1.0), (10, 503, "b", 1.0, 1.0), (11, 504, "a", float("inf"), 0.0), (11, 505, "b", 3.0, 0.0), (11, 506, "a", 4.0, 0.0)]
    odd = [(1, 600, None, 5.0, 5.0), (1, 601, "a", None, 5.0), (None, 602, "b", 5.0, 5.0), (None, 603, "a", 5.0, 5.0)]
    df = spark.createDataFrame(rows + odd, "k long, id long, camera string, wx double, wy double")
    want = {a[1]: min(float(np.hypot(a[3] - b[3], a[4] - b[4])) for b in others) for a in rows if (others := [b for b in rows if a[0] == b[0] and a[2] != b[2]])}
    for chunk in (1 << 20, 7):
        monkeypatch.setattr(sampling, "CHUNK", chunk)
        near = sampling.nearest_of_others(df, ["k"])
        got = {r.id: r.d for r in near.collect()}
        assert got.keys() == want.keys() and all(got[i] == want[i] or abs(got[i] - want[i]) < 1e-9 for i in want)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()
    plain = df.where("k <> 11")  # one key goes by grids, the others in tasks
    got = {r.id: r.d for r in sampling.nearest_of_others(plain, ["k"], most=100).collect()}
    assert got.keys() == {i for i in want if i < 504} and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_whole_matching():
    """The weight of the matching on lists of pairs, for whole weights with many ties; large ones end soon."""
    rng = np.random.default_rng(16)
    for _ in range(300):
        n, m, top = (int(x) for x in rng.integers(1, (12, 12, 9)))
        w = np.where(rng.random((n, m)) < rng.random(), rng.integers(1, top + 1, (n, m)), 0)
        r, c = np.nonzero(w)
        held = matching.whole_matching(np.searchsorted(r, np.arange(n + 1)), c, w[r, c], m)
        took = held[held >= 0]
        assert (r[took] == np.flatnonzero(held >= 0)).all() and len(set(c[took].tolist())) == len(took)
        assert w[r, c][took].sum() == w[r, c][matching.matching(r.tolist(), c.tolist(), w[r, c].tolist())].sum()
    w = rng.poisson(0.5, (1500, 3000))
    w[np.arange(1500), np.arange(1500)] += 2
    r, c = np.nonzero(w)
    held = matching.whole_matching(np.searchsorted(r, np.arange(1501)), c, w[r, c], 3000)
    assert (held >= 0).all() and w[r, c][held].sum() >= np.diag(w).sum()


def test_large_groups_of_whole_weights(spark, monkeypatch):
    """Groups beyond the kernel on lists go to the one on arrays, without an auction, where weights are whole."""
    rng = np.random.default_rng(17)
    rows = [(k, f"g{i}", j, float(rng.integers(1, 5))) for k, n in (("a", 4), (None, 30), ("b", 30)) for i in range(n) for j in range(n) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "scene string, gt string, trk long, w double")
    for name in ("auctioned", "settled"):
        monkeypatch.setattr(matching, name, None)
    got = [tuple(r) for r in matching.of_any_size(df, ["scene"], "w", 100).collect()]
    assert set(got) <= set(rows)
    for k in ("a", None, "b"):
        mine, own = [r for r in got if r[0] == k], [r for r in rows if r[0] == k]
        best = matching.matching([int(r[1][1:]) for r in own], [r[2] for r in own], [r[3] for r in own])
        assert len({r[1] for r in mine}) == len({r[2] for r in mine}) == len(mine) and sum(r[3] for r in mine) == sum(own[i][3] for i in best)


def test_identity_of_crowded_scenes(spark, monkeypatch):
    """Crowded scenes are counted block against block, without a join of detections, to the scores of lists of pairs."""
    rng = np.random.default_rng(18)
    schema = "scene string, frame long, id long, x double, y double"
    side = lambda by: spark.createDataFrame([(s, f, by * i, *(2 * rng.random(2)).tolist()) for s in "abc" for f in range(1, 12) for i in range(30) if rng.random() < 0.6] + [(f"only{by}", 1, 1, 0.0, 0.0)], schema)
    g, t = side(1), side(3)
    want = sorted(tuple(r) for r in evaluation.identity(g, t, evaluation.similarity(g, t)).collect())
    monkeypatch.setattr(evaluation, "KERNEL_PAIRS", 100)
    monkeypatch.setattr(evaluation, "similarity", None)
    for task, held, most in ((1 << 24, 1 << 21, 1 << 25), (800, 50, 1 << 25), (800, 50, 10)):
        for name, value in (("TASK_MEETINGS", task), ("MEETINGS", held), ("LIST_PAIRS", most)):
            monkeypatch.setattr(evaluation, name, value)
        assert sorted(tuple(r) for r in evaluation.identity(g, t).collect()) == want and len(want) == 5 and want[0][1] > 30


TRACK = "camera int, track_id long, embedding array<double>, first_frame int, last_frame int, world_x double, world_y double"


def test_weak_pairs_take_part_in_the_matching(spark, monkeypatch):
    """Two pairs of 0.62 and 0.29 outweigh one of 0.65, so the 0.62 is matched, though 0.29 is far below the threshold."""
    a = [[1, 0, 0, 0], [0, 1, 0, 0]]
    b = [[0.65, 0.29, (1 - 0.65**2 - 0.29**2) ** 0.5, 0], [0.62, -0.1, 0, (1 - 0.62**2 - 0.1**2) ** 0.5]]
    rows = [(c, 10 * c + i, [float(x) for x in v], 100 * c, 100 * c + 50, 1.0, 1.0) for c, side in enumerate((a, b)) for i, v in enumerate(side)]
    tracks = spark.createDataFrame(rows, TRACK)
    monkeypatch.setattr(catalog, "track_features", lambda spark, d: tracks.withColumn("vec_id", F.lit(0)))
    assert [tuple(r) for r in catalog.QUERIES["match_pairs"](spark, "").collect()] == [(0, 11)]
    ids = {(r.camera, r.track_id): r.global_id for r in identity.resolved(tracks).collect()}
    assert ids[0, 0] == ids[1, 11] and len(set(ids.values())) == 3


def test_best_pairs_are_those_of_all_pairs(spark, monkeypatch):
    """Pairs that are settled early, and a rest that meets again, have the weight of all pairs; three cameras, one camera, pixels."""
    rng = np.random.default_rng(15)
    rows = []
    for i in range(120):
        v = np.eye(6)[i % 6] * (1.0 if i % 3 else 0.3) + rng.normal(size=6) * 0.25
        start = int(rng.integers(0, 4000))
        px = [float(x) for x in rng.uniform(0, 300, 4)] if i % 5 else [None] * 4
        rows.append((i % 3, i, [*(v / np.linalg.norm(v)).tolist(), *[0.0] * 4], start, start + int(rng.integers(0, 200)), *[float(x) for x in rng.uniform(0, 30, 2)], *px))
    # twins that nobody else is like: two over two cameras, two on one
    twin = lambda k, i, camera, start: (camera, i, np.eye(10)[6 + k].tolist(), start, start + 50, 5.0, 5.0, *[None] * 4)
    rows += [twin(k, 200 + 2 * k + j, j if k < 2 else 0, 100 * j) for k in range(4) for j in range(2)]
    tracks = spark.createDataFrame(rows, TRACK + ", first_px_x double, first_px_y double, last_px_x double, last_px_y double")
    sure, step = [], identity.settled
    monkeypatch.setattr(identity, "settled", lambda *a: sure.append(step(*a).count()) or step(*a))
    differs = 0
    for same in (False, True):
        whole = identity._scored(tracks, same, 0.0)
        want = {tuple(r) for r in identity.matched_pairs(whole, 0.6).select("cam_a", "a", "b").collect()}
        got = [tuple(r) for r in identity.best_pairs(tracks, same, 0.6).select("cam_a", "a", "b").collect()]
        assert set(got) == want and len(got) == len(want) > 20
        differs += want != {tuple(r) for r in identity.matched_pairs(whole.where("score >= 0.3"), 0.6).select("cam_a", "a", "b").collect()}
    assert differs and sum(sure) >= 6
    assert identity.best_pairs(tracks, False, 1.1).isEmpty() and identity.best_pairs(tracks.limit(0), False, 0.6).isEmpty()


def sightings_at(spark, path, rows):
    """Tables of events (event_id, user_id, minute, value), and DuckDB over them."""
    e = spark.createDataFrame(rows, "event_id long, user_id long, minute int, value double")
    e = e.select("event_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, minute)").alias("ts"), "user_id", F.lit("click").alias("event_type"), "value", F.lit('{"k": 1}').alias("props"))
    e.coalesce(1).write.parquet(f"{path}/events")
    next((path / "events").glob("*.parquet")).rename(path / "events.parquet")
    for name in ("part", "embeddings"):
        (path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    con = duckdb.connect()
    for name in ("events", "part", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return str(path), con


def test_report_lines_of_an_entity_that_many_came_near(spark, tmp_path):
    """1100 entities came near one: each has its line, and the one's own count is not cut either."""
    n = 1100  # each at a time of its own
    d, con = sightings_at(spark, tmp_path, [(4 * k, 0, 100 * k, 0.0) for k in range(n)] + [(4 * k + j + 1, k + 1, 100 * k + j, 1.0 + k % 7) for k in range(n) for j in range(3)])
    got = sorted(tuple(r) for r in plans.QUERIES["proximity_report_lines"](spark, d).select("target", "other", "line").collect())
    assert sum(r[0] == 0 for r in got) == 1100 and sum("1100 confirmed" in r[2] for r in got) == len(got) - 1100 > 300
    assert got == sorted(con.execute(f"SELECT target, other, line FROM ({plans.ORACLE_SQL['proximity_report_lines']})").fetchall())


def test_nearest_by_every_position(spark, tmp_path):
    """Who came near at a position that is not every third one is found too, and the nearest of all positions counts."""
    far = [(0, 7, 0, 0.0), (1, 8, 40, 900.0), (2, 8, 41, 1.0), (3, 7, 42, 5.0), (4, 8, 43, 4.5)]
    rng = np.random.default_rng(19)
    some = [(10 + i, 20 + int(rng.integers(0, 12)), 5000 + int(rng.integers(0, 400)), float(rng.integers(0, 200)) / 4) for i in range(400)]
    d, con = sightings_at(spark, tmp_path, far + some)
    got = sorted(tuple(r) for r in plans.QUERIES["proximity_topk_by_type"](spark, d).select("target", "match_type", "other", "distance_m").collect())
    assert [r for r in got if r[0] < 20] == [(7, "uncertain_proximity", 8, 0.5), (8, "uncertain_proximity", 7, 0.5)]
    assert got == sorted(con.execute(f"SELECT target, match_type, other, distance_m FROM ({plans.ORACLE_SQL['proximity_topk_by_type']})").fetchall())


def test_large_groups_of_any_weights(spark, monkeypatch):
    """Groups beyond the kernel on lists whose weights are not whole go to one on a matrix where it fits, whole or by component, without an auction."""
    rng = np.random.default_rng(20)
    rows = [(k, f"g{i}", j, float(rng.random())) for k, n in (("a", 4), (None, 30), ("b", 30)) for i in range(n) for j in range(n) if (i < 15) == (j < 15) and rng.random() < 0.8]
    df = spark.createDataFrame(rows, "scene string, gt string, trk long, w double")
    monkeypatch.setattr(matching, "auctioned", None)
    for cells in (1 << 24, 300):
        monkeypatch.setattr(matching, "MATRIX_CELLS", cells)
        got = [tuple(r) for r in matching.of_any_size(df, ["scene"], "w", 100).collect()]
        assert set(got) <= set(rows)
        for k in ("a", "b") if cells == 300 else ("a", None, "b"):
            mine, own = [r for r in got if r[0] == k], [r for r in rows if r[0] == k]
            best = matching.matching([int(r[1][1:]) for r in own], [r[2] for r in own], [r[3] for r in own])
            assert len({r[1] for r in mine}) == len({r[2] for r in mine}) == len(mine) and abs(sum(r[3] for r in mine) - sum(own[i][3] for i in best)) < 1e-9
