"""Short texts, of which half have no closed syncmer at five words."""

import random
from collections import Counter

from pyspark.sql import functions as F

from trackloom.llm import syncmers


def test_short_texts(spark):
    rows = [(n, f"{w}{t}", " ".join(f"{w}{t}x{i}" for i in range(n))) for n in range(1, 12) for t in range(40) for w in ("p", "q")]
    docs = spark.createDataFrame(rows, "n int, name string, text string").withColumn("s", syncmers.sketch(F.col("text"))).withColumn("a", syncmers.anchors(F.col("text")))
    got = docs.collect()
    assert [(r.n, r.name) for r in got if not r.s] == []
    assert len({(r.n, tuple(r.s)) for r in got}) == len(got)
    assert all(0 <= a.pos <= max(r.n - 5, 0) for r in got for a in r.a)
    pairs = docs.where("name LIKE 'p%'").withColumn("o", F.regexp_replace("text", "p", "q"))
    pairs = pairs.select(syncmers.likeness(F.col("s"), syncmers.sketch(F.col("o"))).alias("other"), syncmers.likeness(F.col("s"), syncmers.sketch(F.upper("text"))).alias("own"), syncmers.likeness(F.col("s"), syncmers.sketch(F.lit(""))).alias("none"))
    assert {tuple(r) for r in pairs.collect()} == {(0.0, 1.0, 0.0)}


def test_many_have_anchors_as_before(spark):
    text = " ".join(f"w{i}" for i in range(200))
    a = spark.range(1).select(syncmers.anchors(F.lit(text)).alias("a"), syncmers.anchors(F.lit("x " + text)).alias("b")).first()
    assert len(a.a) > 50 and {x.hash for x in a.a} <= {x.hash for x in a.b}


def test_order_counts(spark):
    """The same phrases in another order are less alike; an insertion in front hardly matters. Against the same rule in Python."""
    parts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefgh"]
    texts = {"own": " ".join(parts), "moved": " ".join(parts[::-1]), "longer": "x y z " + " ".join(parts), "other": " ".join(p.upper() + "x" for p in parts), "none": ""}
    df = spark.createDataFrame(list(texts.items()), "name string, text string").withColumn("s", syncmers.sketch(F.col("text")))
    s = {r.name: [(x.hash, x.pos) for x in r.s] for r in df.collect()}
    pairs = df.alias("x").join(df.alias("y")).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), syncmers.likeness(F.col("x.s"), F.col("y.s")).alias("like"), syncmers.as_text(F.col("x.s")).alias("t"))
    for r in pairs.collect():
        one, two = dict(s[r.a]), dict(s[r.b])
        low = sorted({*one, *two})[:64]
        at = [q for _, q in sorted((one[h], two[h]) for h in low if h in one and h in two)]
        want = sum(i == 0 or at[i - 1] <= q for i, q in enumerate(at)) / len(low) if low else 1.0
        assert abs(r.like - want) < 1e-12
        assert r.t == " ".join(f"{h & (2**64 - 1):016x}@{p}" for h, p in s[r.a])
    like = {(r.a, r.b): r.like for r in pairs.collect()}
    assert like["own", "own"] == 1 and like["own", "longer"] > 0.9 and 0.2 < like["own", "moved"] < 0.95 * like["own", "longer"] and like["own", "none"] == 0


def test_next_over_ranges(spark):
    """Ids in any order over many ranges, null and repeated ones among them."""
    import hashlib

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefg") + str(rng.randrange(50)) for _ in range(rng.randrange(40)))) for i in rng.sample(range(-10**12, 10**12), 500)]
    rows += [(None, "no number"), rows[7], rows[7], (rows[9][0], None)]
    want = Counter()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len({i for i, _ in rows}) == len(rows) - 3
    got = syncmers.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    for j, (i, t) in enumerate(order):
        t, q, nxt = t or "", len(t or "") // 4, order[(j + 1) % len(order)][1] or ""
        want[i, hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()] += 1
    tie = {rows[9][0]} | {order[(j - 1) % len(order)][0] for j, r in enumerate(order) if r[0] == rows[9][0]}  # two texts under one id: either may come first
    assert Counter((r.doc_id, r.edited_sha256) for r in got if r.doc_id not in tie) == Counter({k: n for k, n in want.items() if k[0] not in tie})
    assert len(got) == len(rows)
