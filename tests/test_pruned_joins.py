"""The pivot index and the interval index against all pairs, with what they look at counted."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import identity, sightings, similar


def unit(rng, n, d=8):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("rows", [40, 1 << 14])
def test_similar_vectors(spark, rows, monkeypatch):
    """Clusters of near vectors: all pairs found, few others looked at, and copies bounded by the pivots."""
    monkeypatch.setattr(similar, "CELL_ROWS", rows)
    rng = np.random.default_rng(1)
    near = unit(rng, 12)[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.05
    vectors = np.vstack([near / np.linalg.norm(near, axis=1, keepdims=True), unit(rng, 60)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, None)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    sims = vectors @ vectors.T
    want = {(i, j) for i in range(0, 360, 3) for j in range(360) if sims[i, j] >= 0.8}
    got = similar.similar_vectors(queries, df, 0.8)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == want and got.count() == len(want)
    assert len(want) <= similar.looked_at(queries, df, "embedding", 0.8) < 0.5 * 120 * 360
    pivot = similar.pivots(df, "embedding")
    assert 1 < len(pivot) <= similar.PIVOTS
    assert similar.similar_vectors(queries, df.limit(0), 0.8).count() == similar.similar_vectors(queries.limit(0), df, 0.8).count() == 0


TRACK = "camera int, track_id long, embedding array<double>, first_frame int, last_frame int, world_x double, world_y double, first_px_x double, first_px_y double, last_px_x double, last_px_y double"


def test_scored_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    looks = unit(rng, 6, 4)
    rows = []
    for i in range(90):
        v = looks[i % 6] + rng.normal(size=4) * 0.1
        a = int(rng.integers(0, 3000))
        px = [float(x) for x in rng.uniform(0, 200, 4)] if i % 5 else [None] * 4
        rows.append((int(rng.integers(0, 3)), i, (v / np.linalg.norm(v)).tolist(), a, a + int(rng.integers(0, 300)), *[float(x) for x in rng.uniform(0, 40, 2)], *px))
    tracks = spark.createDataFrame(rows, TRACK)
    every = tracks.select(*[F.col(c).alias(f"{c}_a") for c in tracks.columns]).crossJoin(tracks.select(*[F.col(c).alias(f"{c}_b") for c in tracks.columns]))
    c = {x: F.col(x) for x in every.columns}
    metres = identity.distance(c["world_x_a"], c["world_y_a"], c["world_x_b"], c["world_y_b"])
    for same in (False, True):
        p = every.where("camera_a = camera_b AND track_id_a <> track_id_b" if same else "camera_a < camera_b")
        plausible = identity.plausibility(c["first_frame_a"], c["last_frame_a"], c["first_frame_b"], c["last_frame_b"], metres, F.lit(same))
        score = identity.dot(c["embedding_a"], c["embedding_b"]) * plausible
        score = F.greatest(score, identity.handoff(identity._gap(), identity._pixels())) if same else score
        for least in (0.0, 0.3, 0.7):
            want = {(r.a, r.b, round(r.s, 9)) for r in p.select(F.col("track_id_a").alias("a"), F.col("track_id_b").alias("b"), score.alias("s")).where(f"s > 0 AND s >= {least}").collect()}
            assert {(r.a, r.b, round(r.score, 9)) for r in identity._scored(tracks, same, least).collect()} == want and want


def test_cooccurrence_with_one_long_sighting(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(1, 30)), str(rng.integers(1, 3)), i, a := int(rng.integers(0, 50_000)), a + int(rng.integers(0, 40))) for i in range(400)] + [(99, "1", 0, 0, 31_536_000), (98, "1", 1, -70, -60), (97, "2", 2, 5, 5)]
    df = spark.createDataFrame(rows, "global_id long, camera string, seg_idx long, start_frame long, end_frame long")
    want = {}
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] == y[1] and max(x[3] - y[4], y[3] - x[4]) <= 50:
                want[x[0], y[0]] = want.get((x[0], y[0]), 0) + 1
    assert {(r.a, r.b): r.n_matches for r in sightings.cooccurrence(df, 50).collect()} == want
    levels = df.select(sightings.level_of(F.col("end_frame") - F.col("start_frame") + 51).alias("l")).distinct().count()
    assert levels <= 4
    assert sightings.cooccurrence(df.limit(0), 50).count() == 0


def test_nearest_of_others(spark):
    """Against all pairs: a dense slot with one far point of another camera, a slot of one camera, equal places, one point alone."""
    from trackloom.operators.sampling import nearest_of_others

    rng = np.random.default_rng(4)
    rows = [("a", i, int(rng.integers(0, 3)), *map(float, rng.normal(size=2))) for i in range(150)]
    rows += [("b", i, 1, float(x), float(x)) for i, x in enumerate(rng.uniform(0, 1, 120))] + [("b", 999, 2, 5000.0, -7.0)]
    rows += [("c", i, 1, 0.0, 0.0) for i in range(5)] + [("d", 1, 1, 2.0, 2.0), ("d", 2, 2, 2.0, 2.0), ("e", 1, 1, None, 2.0), ("e", 2, 2, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "slot string, id long, camera int, wx double, wy double")
    want = {}
    for s, i, c, x, y in rows:
        d = [np.hypot(x - p, y - q) for t, _, k, p, q in rows if t == s and k != c and p is not None] if x is not None else []
        if d:
            want[s, i] = min(d)
    got = {(r.slot, r.id): r.d for r in nearest_of_others(df, ["slot"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert nearest_of_others(df.limit(0), ["slot"]).count() == 0
