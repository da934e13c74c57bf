import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.operators import evaluation as E
from trackloom.operators import matching as M
from trackloom.operators import proximity as P
from trackloom.operators import sightings as S


def crowd(spark, frames=6, n=9, seed=4):
    rng = np.random.default_rng(seed)
    schema = "scene string, frame long, id long, x double, y double"
    sides = [[(s, f, i + shift, float(rng.uniform(0, 2)), float(rng.uniform(0, 2))) for s in "ab" for f in range(frames) for i in range(n) if rng.random() < 0.8] for shift in (0, 100)]
    return [spark.createDataFrame(rows, schema) for rows in sides]


@pytest.mark.parametrize("cells", [0, 1 << 12])
def test_clear_of_crowds_without_rows_of_pairs(spark, monkeypatch, cells):
    """frames are matched as matrices, and anew only where a pair goes on, with the same matches as from rows of pairs."""
    monkeypatch.setattr(E, "LISTED_CELLS", cells)
    monkeypatch.setattr(E, "DENSE_PAIRS", 1)
    truth, tracker = crowd(spark)
    sim = E.similarity(truth, tracker)
    want = sorted(map(tuple, E.clear_matches(truth, tracker, sim).collect()))
    assert sorted(map(tuple, E.matched_in_turn(truth, tracker).collect())) == want
    went_on = {(s, f + 1, g, t) for s, f, g, t in want} & set(want)
    assert went_on
    monkeypatch.setattr(E, "similarity", None)  # no pair is a row
    assert sorted(map(tuple, E.clear(truth, tracker).collect())) == sorted(map(tuple, E.clear(truth, tracker, sim).collect()))


def test_grown_matchings_are_best_and_proved():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m = rng.integers(1, 12, 2)
        w = np.where(rng.random((n, m)) < 0.6, rng.random((n, m)), 0)
        own, price, held = np.full(n, w.max()), np.zeros(m), np.full(n, -1)
        M.grown(w, own, price, held)
        i = np.flatnonzero(held >= 0)
        a, b = M.dense_matching(w)
        assert np.isclose(w[i, held[i]].sum(), w[a, b].sum()) and (own[:, None] + price - w).min() > -1e-9 and np.isclose(own.sum() + price.sum(), w[a, b].sum())


def walkers(spark, n=14, frames=30, seed=6):
    rng = np.random.default_rng(seed)
    rows = [(k, str(rng.integers(1, 3)), int(rng.integers(n)), int(rng.integers(frames)), float(rng.integers(0, 8)) / 4, float(rng.integers(0, 8)) / 4) for k in range(n * 20)]
    return spark.createDataFrame(rows, "ordinal long, camera string, global_id long, frame long, wx double, wy double")


def test_targets_of_a_task_stream_by(spark, monkeypatch):
    """F5, F6, F8, F9: a task of proximity holds the others alone; rows come out before all targets went in, and are those of the join."""
    d = walkers(spark)
    want = sorted(map(tuple, P.matches(P.band_pairs(d, 4, 1.0, 9), 3).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(P, "CHUNK", 5)
    try:
        assert sorted(map(tuple, P.matches_of_all(d, 4, 1.0, 9, reliable=3, blocks=2).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    taken = {}
    kind = type(d.groupBy("camera"))
    true = kind.applyInArrow
    monkeypatch.setattr(kind, "applyInArrow", lambda self, f, schema: taken.update(f=f) or true(self, f, schema))
    P.matches_of_all(d, 4, 1.0, 9, reliable=3, blocks=1)
    side = lambda right, ids: pa.RecordBatch.from_pydict({"x": [0] * len(ids), "y": [0] * len(ids), "right": [right] * len(ids), "global_id": ids, "camera": ["1"] * len(ids), "frame": [3] * len(ids), "wx": [1.0] * len(ids), "wy": [0.0] * len(ids), "dets": [5] * len(ids)})
    went = []
    rows = (went.append(k) or b for k, b in enumerate([side(True, list(range(40))), *[side(False, [i, i]) for i in range(40)]]))
    seen = [(len(went), len(b)) for b in taken["f"](rows)]
    assert sum(n for _, n in seen) == 40 * 39 and seen[0][0] < 10


def test_matching_that_asks_for_light_pairs_is_best():
    rng = np.random.default_rng(5)
    for least in (1, 2, 3, 5):
        for _ in range(60):
            n, m = rng.integers(1, 12, 2)
            w = np.where(rng.random((n, m)) < 0.7, rng.integers(1, 5, (n, m)), 0)
            r, c = np.nonzero(w >= least)
            below = lambda q, w=w: (np.flatnonzero((w[q] > 0) & (w[q] < least)), w[q][(w[q] > 0) & (w[q] < least)])  # noqa: B023
            held = M.lazy_matching(np.searchsorted(r, np.arange(n + 1)), c, w[r, c], m, least, below)
            i = np.flatnonzero(held >= 0)
            a, b = M.dense_matching(w.astype(float))
            assert len(set(held[i])) == len(i) and (w[i, held[i]] > 0).all() and w[i, held[i]].sum() == w[a, b].sum()


def test_identity_lists_only_the_pairs_that_fit(spark, monkeypatch):
    """pairs of few common detections are never rows of a table; the mapping is the best of all pairs."""
    truth, tracker = crowd(spark, 14, 12)
    want = sorted(map(tuple, E.identity(truth, tracker, E.similarity(truth, tracker)).collect()))
    listed = []
    true = E.overlaps
    monkeypatch.setattr(E, "overlaps", lambda *a, **k: listed.append(true(*a, **k)) or listed[-1])
    monkeypatch.setattr(E, "KERNEL_PAIRS", 0)
    monkeypatch.setattr(E, "LIST_PAIRS", 60)
    assert sorted(map(tuple, E.identity(truth, tracker).collect())) == want
    lists = listed[-1].select("scene", F.size("trks").alias("n"), F.array_min("ws").alias("w")).groupBy("scene").agg(F.sum("n"), F.min("w")).collect()
    assert lists and all(r[1] <= 60 and r[2] > 1 for r in lists)


def test_cooccurrence_copies_sightings_to_few_blocks(spark, monkeypatch):
    """a sighting is copied once a block, so blocks are few; two large ones are counted in strips of their matrix."""
    used, step = [], S._counted_in_blocks
    monkeypatch.setattr(S, "_counted_in_blocks", lambda *a: used.append(a[2]) or step(*a))
    S.cooccurrence(spark.range(40000).selectExpr("id AS global_id", "'1' AS camera", "0L AS start_frame", "9L AS end_frame"), 5)
    assert used == [8]  # never run: its rows are 800 million
    rng = np.random.default_rng(9)
    rows = [(int(g), str(rng.integers(1, 3)), int(a), int(a + rng.integers(0, 30))) for g in range(60) for a in rng.integers(0, 100, 6)]
    s = spark.createDataFrame(rows, "global_id long, camera string, start_frame long, end_frame long")
    want = {}
    for g, c, a, b in rows:
        for h, d, e, f in rows:
            if g < h and c == d and max(a - f, e - b) <= 5:
                want[g, h] = want.get((g, h), 0) + 1
    monkeypatch.setattr(S, "CELLS", 100)
    monkeypatch.setattr(S, "SMALL_BLOCK", 20)
    assert {(r.a, r.b): r.n_matches for r in S.cooccurrence(s, 5).collect()} == want and used == [8, 3]
