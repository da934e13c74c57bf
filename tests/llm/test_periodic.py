"""Runs of words against a search of every period and place."""

import hashlib
import random
import zlib

from trackloom.llm import periodic
from trackloom.llm.queries import op11_periodic_runs

DIR = "/root/testdata/sf0.001"


def brute(w, least):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                out.setdefault((s, i - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def random_word(rng):
    w = [rng.randrange(rng.choice([1, 2, 2, 3, 4])) for _ in range(rng.randrange(50))]
    if rng.random() < 0.5:
        w[rng.randrange(len(w) + 1) : 0] = [rng.randrange(3) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 8)
    return w


def test_runs():
    rng = random.Random(5)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for w in [random_word(rng) for _ in range(1500)] + [fibonacci[-1], [0] * 100, [0, 1] * 50, fibonacci[-4] * 3, []]:
        assert periodic.runs(w) == brute(w, 2), w
        assert periodic.text_runs([str(x).encode() for x in w]) == brute(w, 12), w


def test_factors():
    rng = random.Random(6)
    for _ in range(300):
        w, at = random_word(rng), 0
        for b, n, e in periodic.factors(w):
            assert b == at and (e < 0) == (w[b] not in w[:b])
            if e >= 0:
                assert e < b and w[e : e + n] == w[b : b + n]
                assert b + n == len(w) or all(w[s : s + n + 1] != w[b : b + n + 1] for s in range(b))
            at = b + n
        assert at == len(w)


def kept(w, found):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]


def test_operator(spark):
    rng = random.Random(7)
    texts = [" ".join("abcdef"[x] for x in random_word(rng)) for _ in range(200)] + [None, "", " \n ", "x " * 20000, "a\tb\nc " * 9, "é\xa0é " * 12, "A a " * 8]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "n " * 15, "", 2), (3, texts[3], "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, _id int").repartition(3)
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(rows) and docs.columns[0] in got[0].asDict()
    by_id = {r.doc_id: r for r in got}
    for i, t, _, _ in rows:
        w = (t or "").encode().split()
        want = brute(w, 12) if len(w) < 1000 else [(0, len(w), 1)]
        r = by_id[i]
        assert [tuple(x) for x in r.runs] == want and r.n_words == len(w)
        assert r.collapsed.encode().split() == (kept(w, want) if len(w) < 1000 else w[:1])
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark):
    """The digest columns against brute force, whole texts; ids in ten of one have their words repeated first."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, DIR).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        w, h = (t or "").encode().split(), zlib.crc32(str(i).encode())
        n = len(w)
        if n > 1200:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = brute(w, 12)
        top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[i] == (i, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join("%d,%d,%d\n" % r for r in found).encode()), sha(b" ".join(kept(w, found))))
