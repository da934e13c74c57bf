"""Operators for keys, groups and components larger than a task, against the plain forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import expressions as X
from trackloom.operators import lineage, matching, scans, sightings
from trackloom.operators.lineage import checkpointed


def dense(rows, cols, weights):
    """The greatest weight of a matching, by the matrix method: row by row, shortest augmenting paths over all columns."""
    n, m = max(rows) + 1, max(cols) + 1
    cost = np.zeros((n + 1, m + n + 1))
    for r, c, w in zip(rows, cols, weights):
        cost[r + 1, c + 1] = -w
    u, v, p = np.zeros(n + 1), np.zeros(m + n + 1), np.zeros(m + n + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        low, way, used = np.full(m + n + 1, np.inf), np.zeros(m + n + 1, int), np.zeros(m + n + 1, bool)
        while p[j0]:
            used[j0] = True
            cur = cost[p[j0]] - u[p[j0]] - v
            better = ~used & (cur < low)
            low[better], way[better] = cur[better], j0
            j1 = int(np.where(used, np.inf, low).argmin()) if not used.all() else 0
            low_ = np.where(used, np.inf, low)
            low_[0] = np.inf
            j1 = int(low_.argmin())
            d = low_[j1]
            np.add.at(u, p[used], d)
            v[used] -= d
            low[~used] -= d
            j0 = j1
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    return sum(-cost[p[j], j] for j in range(1, m + 1) if p[j])


def test_matching_equals_the_matrix_method():
    rng = np.random.default_rng(4)
    for k in range(60):
        n, m = rng.integers(2, 40, 2)
        edges = sorted({(int(rng.integers(n)), int(rng.integers(m))) for _ in range(int(rng.integers(1, 5 * n)))})
        w = [float(x) for x in (rng.random(len(edges)) if k % 2 else rng.integers(1, 5, len(edges)))]
        r, c = [e[0] for e in edges], [e[1] for e in edges]
        took = matching.matching(r, c, w)
        assert len({r[i] for i in took}) == len({c[i] for i in took}) == len(took)
        assert abs(sum(w[i] for i in took) - dense(r, c, w)) < 1e-9


def test_large_component_without_a_matrix():
    """100,000 pairs in one component; prices prove that no matching weighs more: a feasible dual of equal value."""
    rng = np.random.default_rng(5)
    n = 20_000
    edges = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, n, 5 * n), rng.integers(0, n, 5 * n))} | {(i, i) for i in range(n)} | {(i, (i + 1) % n) for i in range(n)})
    assert len(edges) > 100_000
    r, c = [e[0] for e in edges], [e[1] for e in edges]
    w = rng.integers(1, 1000, len(edges)).astype(float).tolist()
    took = matching.matching(r, c, w)
    assert len({r[i] for i in took}) == len({c[i] for i in took}) == len(took)
    mate_r, mate_c = {r[i]: i for i in took}, {c[i]: i for i in took}
    # no augmenting path or cycle of gain: Bellman-Ford over the residual graph finds no better
    gain = np.zeros(n)  # best gain of a path that ends with this column given up
    out = {}
    for i in range(len(edges)):
        out.setdefault(r[i], []).append(i)
    reach = {x: 0.0 for x in range(n) if x not in mate_r}
    for _ in range(40):
        new = {}
        for x, g in reach.items():
            for i in out.get(x, ()):
                total = g + w[i]
                if c[i] not in mate_c:
                    assert total <= 1e-9
                elif total > gain[c[i]] + 1e-9:
                    gain[c[i]] = total
                    y = r[mate_c[c[i]]]
                    assert total - w[mate_c[c[i]]] <= 1e-9
                    new[y] = max(new.get(y, -np.inf), total - w[mate_c[c[i]]])
        if not new:
            break
        reach = new


PAIR = "scene string, gt long, trk long, w double"


def test_groups_of_any_size(spark):
    """Kernel, components and auction give equal weights; the auction is exact on whole numbers."""
    rng = np.random.default_rng(6)
    rows = [(s, int(a), int(b), float(rng.integers(1, 9))) for s in ("x", "y", None) for a, b in {(int(rng.integers(6)), int(rng.integers(5))) for _ in range(14)}]
    df = spark.createDataFrame(rows, PAIR)
    of = lambda out: {r.scene: r.s for r in out.groupBy("scene").agg(F.sum("w").alias("s")).collect()}
    want = {s: dense(*zip(*[(g, t, w) for k, g, t, w in rows if k == s])) for s in ("x", "y", None)}
    assert of(matching.in_groups(df, ["scene"], "w")) == pytest.approx(want)
    assert of(matching.assigned(df, ["scene"], "w")) == pytest.approx(want) == of(matching.assigned(df, ["scene"], "w", split=True))
    by_parts = matching.of_any_size(df.where("scene IS NOT NULL"), ["scene"], "w", most=5)
    got = by_parts.collect()
    assert len({(r.scene, r.gt) for r in got}) == len({(r.scene, r.trk) for r in got}) == len(got)
    assert of(by_parts) == pytest.approx({k: v for k, v in want.items() if k})
    assert matching.of_any_size(df.limit(0), ["scene"], "w").count() == 0


@pytest.fixture()
def ranges(spark):
    """Small ranges stay apart, so that one key lies in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_sessions_over_ranges(spark, ranges, most):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(2)) or None, "c", int(rng.integers(3000)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "global_id int, camera string, frame long, ordinal long")
    got = {r.ordinal: r.seg for r in scans.sessions(df, ["global_id", "camera"], "frame", ["ordinal"], 6, "seg", most).collect()}
    for gid in (None, 1):
        last, seg = None, 0
        for _, _, f, o in sorted((r for r in rows if r[0] == gid), key=lambda r: (r[2], r[3])):
            seg += last is not None and f - last > 6
            last = f
            assert got[o] == seg
    assert sightings.segmented(df, 6).where("seg_idx > 3").count() == sum(v > 3 for v in got.values())


def test_ranks_and_front_over_ranges(spark, ranges):
    """One key over many tasks, against windows; equal values, nulls and an empty table."""
    rows = [("s" if i % 7 else None, (i * 37) % 500 if i % 11 else None, (i * 91) % 613, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "scene string, id int, y int, n int").repartition(9)
    want = df.select("scene", "id").distinct().withColumn("k", F.dense_rank().over(Window.partitionBy("scene").orderBy("id")) - 1)
    got = scans.dense_ranks(df, ["scene"], "id", "k", most=0)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("scene", "id", F.col("k").cast("long")).collect()))
    parts = checkpointed(df.repartitionByRange("scene", "id").withColumn("p", F.spark_partition_id()))
    assert parts.where("scene = 's'").select("p").distinct().count() > 1
    best = {}
    for s, x, y, _ in rows:
        if x is not None:
            best.setdefault(s, {})[x] = max(y, best.get(s, {}).get(x, -1))
    want = {(s, x, y) for s, m in best.items() for x, y in m.items() if all(y > b for a, b in m.items() if a > x)}
    assert {tuple(r) for r in scans.front(df, ["scene"], "id", "y").collect()} == want
    assert scans.front(df.limit(0), ["scene"], "id", "y").count() == 0
    assert scans.numbered(df, [], ["n"], "k", most=0).where("k <> n").count() == 0


def test_previous_value_over_ranges(spark, ranges):
    df = spark.range(500).select(F.lit("k").alias("k"), "id", F.when(F.col("id") % 3 > 0, F.col("id")).alias("v")).repartition(5)
    got = scans.scanned(df, ["k"], [F.desc("id")], {"last": ("last", F.col("v")), "total": ("sum", F.col("v")), "most": ("max", F.col("v"))}).collect()
    for r in got:
        assert r.last == (None if r.id == 499 or (r.id + 1) % 3 == 0 else r.id + 1)
        above = [i for i in range(r.id + 1, 500) if i % 3]
        assert (r.total, r.most) == (sum(above), max(above, default=None))


def test_quantiles(spark):
    rng = np.random.default_rng(8)
    for values in (rng.normal(size=701).tolist(), [3.0] * 40 + [5.0] * 3, [1.5], [float(x) for x in rng.integers(0, 4, 300)], [1e300, -1e300, 0.0, 1.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        for most in (0, 50):
            got = scans.quantiles(df, "v", [0.0, 0.1, 0.5, 1.0], most)
            assert all(abs(got[q] - np.quantile(values, q)) <= 1e-9 * max(1, abs(np.quantile(values, q))) for q in got) and len(got) == 4
    assert scans.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == {}


def brute_roots(nodes, links):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("hub", [3, 1 << 17])
def test_components_of_random_links(spark, hub):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (100, 2))] + [(5, 5), (200, 7), (200, 8), (200, 9), (200, 10), (200, 11)]
    nodes = list(range(120)) + [200]
    got = lineage.labelled(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long"), hub)
    assert {r.node: r.root for r in got.collect()} == brute_roots(nodes, links)


def test_star_and_chain(spark):
    """A star of 100,000 leaves around its greatest node, dealt to several tasks, and a chain of 400 nodes."""
    n = 100_000
    star = spark.range(n).select(F.col("id").alias("a"), F.lit(n).cast("long").alias("b"))
    chain = spark.range(n + 1, n + 400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = lineage.labelled(spark.range(n + 401).withColumnRenamed("id", "node"), star.union(chain), hub_rows=10_000)
    assert {(r.root, r["count"]) for r in got.groupBy("root").count().collect()} == {(0, n + 1), (n + 1, 400)}


def test_long_captions_are_linear(spark):
    import time

    text = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(text, False), (text + " x x x", True)], "c string, want boolean")
    began = time.time()
    assert all(r.got == r.want for r in df.select(X.degenerate(F.col("c")).alias("got"), "want").collect())
    assert time.time() - began < 20
