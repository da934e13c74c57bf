"""Token alignment against tokens of whole texts whose ends are compared one by one."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import crosstoken

DIR = "/root/testdata/sf0.001"
ODD = [
    "hello", "  a", "\n", "\n\nb", " \n \nc", "a\n \nb \n", "x\ty \t z", "tab\tend\r\nnew\r\n", "<|endoftext|> <s> </s>", "e▁f", "日本 語 x", "\x1c \x1f a\x85 b", "½ ́a", "👍🏽 ok",
    "don't  I'll", ";\r\n x';\r", "<0x0A>", "a" * 3000, "nul\x00x y", "one, two; three: (four). 3.14, U.S.", None, "", " ", "ab" * 9000 + " end", "word next  wide　x",
]


def brute(pair, text):
    """(groups, links, n_a, n_b) of a text, ends compared one by one."""
    if not text:
        return "", [], 0, 0
    a, b = pair.whole(text)
    x, y = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
    if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
        return "", [], 0, 0
    said, links, i, j = [], [], 0, 0
    ends = set(np.cumsum([len(t) for t in x]).tolist())
    place = {e: k + 1 for k, e in enumerate(np.cumsum([len(t) for t in x]).tolist())}
    for k, e in enumerate(np.cumsum([len(t) for t in y]).tolist(), 1):
        if e in ends:
            p = place[e]
            said.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:k])))
            links.append((a[p - 1], b[k - 1]))
            i, j = p, k
    return ";".join(said), links, len(a), len(b)


def expected(texts):
    pair = crosstoken.aligner(crosstoken.A_FILE, crosstoken.B_FILE).pair
    found = [brute(pair, t) for t in texts]
    count = Counter(link for f in found for link in f[1])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return Counter(
        (n_a, n_b, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for g, links, n_a, n_b in found
    ), found


@pytest.mark.parametrize("shard", [crosstoken.SHARD_PAIRS, 4000])
def test_alignment(spark, shard):
    texts = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    rows = [(i, t) for i, t in enumerate(texts + ODD)] + [(None, "no id"), (7, texts[7]), (7, texts[7])]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _id string, n_a int").repartition(5)
    got = crosstoken.align_tokens(docs, shard_pairs=shard).collect()
    want, _ = expected([t for _, t in rows])
    assert Counter(tuple(r)[1:] for r in got) == want
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in got if r.doc_id is not None and rows[r.doc_id][1] in (None, "", "e▁f"))


def test_groups(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    _, found = expected(ODD)
    assert {r.doc_id: r.groups for r in crosstoken.token_groups(docs).collect()} == {i: f[0] for i, f in enumerate(found)}


def test_ends():
    """Groups of random ends against common ends."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n), int(rng.integers(0, n)), replace=False)) if n > 1 else np.zeros(0, int), n) for _ in range(2))
        x, y = crosstoken.group_ends(a, b)
        common = np.intersect1d(a, b)
        assert a[x - 1].tolist() == b[y - 1].tolist() == common.tolist()


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert crosstoken.align_tokens(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in crosstoken.align_tokens(nothing).collect()} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)}
    assert crosstoken.linked_pairs(nothing).agg(F.count("*")).first()[0] == 0
