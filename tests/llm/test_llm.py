"""The corpus operators against brute force, on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import chat, containment, importance, jaccard, licenses, lm, packing, personal, sharding, syncmers
from trackloom.llm.common import components

DIR = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, id string, key string, n_chars long"


def words(t):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w30", "x")
    rows = [(1, base), (2, base.upper()), (3, near), (4, None), (5, ""), (6, "one two"), (7, "ONE\ttwo"), (8, "w " * 50000), (9, base), (9, base), (10, " \n "), (11, "tie tie tie tie tie tie"), (12, base + " " + near)]
    return spark.createDataFrame([(i, t, "x", "y", len(t or "")) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    low = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and low[j] < low[i] and 100 * len(a & b) >= 75 * len(a | b):
                    low[i], changed = low[j], True
    return {(i, len(s), low[i]) for i, s in sets}


def test_jaccard(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in jaccard.jaccard_components(odd).collect()} == brute_components(rows)
    assert jaccard.jaccard_components(empty).count() == 0
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = jaccard.jaccard_components(docs).collect()
    assert {tuple(r) for r in got} == brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in jaccard.keep_representatives(docs).collect()} == {r.doc_id for r in got if r.component_id == r.doc_id}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(7, 7), (100, 99), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == (0 if i <= 20 else 21) for i in range(41)) and got[100] == 99


def test_containment(spark, odd, empty):
    docs, items = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")
    want = set()
    own = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    for r in items.collect():
        s = shingles(r.text)
        want |= {(i, r.item_id) for i, d in own if s and len(s & d) >= 0.75 * len(s)}
    got = containment.contained_items(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    some = spark.createDataFrame([(1, "w3 w4 w5 w6 w7 w8 w9 W10"), (2, None), (3, "one two"), (4, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in containment.contained_items(odd, some).collect()} == {(i, 1) for i in (1, 2, 3, 9, 12)} | {(6, 3), (7, 3)}
    assert containment.contained_items(empty, some).count() == 0 and containment.contained_items(odd, some.where("false")).count() == 0


def test_importance(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = importance.importance_resample(docs, labels)
    j = got.join(labels, "doc_id").collect()
    assert sum((r.quality == 1) == r.selected for r in j if not r.toxic) / sum(not r.toxic for r in j) > 0.9
    picked = importance.importance_resample(docs, labels, k=50).collect()
    best = sorted((r.gumbel_key for r in picked), reverse=True)[:50]
    assert {r.gumbel_key for r in picked if r.selected} == set(best)
    assert importance.importance_resample(empty, labels).count() == 0
    assert importance.importance_resample(odd, labels.where("false")).where("selected").count() == odd.count()


def test_best_cut():
    assert importance.best_cut([1, 2, 3, 4], [False, False, True, True]) == 2.5
    assert importance.best_cut([], []) == float("-inf")


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), list(BASE).index(k), m.end(), k))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_personal_base(spark, odd, empty):
    texts = ["é a.b@c.de_x@y.zz, 😀 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111-1111 1111 +1 (523) 555-1055 +12 ", "@a.b x@@y.z a@b a@-.- 00000000000000000255.1.1.1", "9" * 20000, "a" * 20000 + "@b", "4465758382889437 44657583", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None), (0, texts[0])], "doc_id long, text string")
    got = personal.find_personal(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert [(s.start, s.end, s.kind) for s in r.spans if s.kind != "context"] == base_spans(texts[r.doc_id] if r.doc_id < 99 else "")
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in personal.find_personal(docs).collect():
        assert [(s.start, s.end, s.kind) for s in r.spans if s.kind != "context"] == base_spans(text[r.doc_id])
    assert personal.find_personal(odd).count() == odd.count() and personal.find_personal(empty).count() == 0


def test_personal_context(spark):
    seeds = [(i, f"please call me at number 4111 1111 1111 1111 today or mail user{i}@host.org soon") for i in range(2)] + [(i, f"my own badge code is +1 (523) 555-10{i} thanks") for i in range(10, 16)]
    new = [(50, "my own badge code is ZX-99-1234 thanks"), (51, "the year is 1999-2004 ok")]
    got = {r.doc_id: r.spans for r in personal.find_personal(spark.createDataFrame(seeds + new, "doc_id long, text string")).collect()}
    assert [(s.kind, s.value) for s in got[50]] == [("context", "ZX-99-1234")] and not got[51]
    red = personal.redact(spark.createDataFrame(seeds + new, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in red.collect()}[50] == "my own badge code is <CONTEXT> thanks"


def test_personal_context_copies(spark):
    seeds = [(i, f"my own badge code is +1 (523) 555-10{i} thanks") for i in range(10, 16)] + [(30 + i, f"we met at place number {w}{i}{w}{i}{w}{i} there") for i, w in enumerate("abc")]
    new = [(50, "my own badge code is ZX-99-1234 thanks")]
    plain = [(60 + i, f"we met at place number {w} there") for i, w in enumerate(("one", "two", "three"))]
    copies = spark.createDataFrame([(1000 * n + i, t) for n in range(100) for i, t in seeds + new + plain], "doc_id long, text string")
    got = personal.find_personal(copies).where("exists(spans, s -> s.kind = 'context')").collect()
    assert sorted(r.doc_id for r in got) == [1000 * n + 50 for n in range(100)]


def test_personal_context_two_words(spark):
    names = "ann bob cat dan eve fay".split()
    seeds = [(i, f"{w} badge code +1 (523) 555-10{i + 10} {w}") for i, w in enumerate(names)]
    far = [(10 + i, f"{w} unit part {w}{i}{w}{i} {w}") for i, w in enumerate(names)]  # no seed reaches this context
    got = personal.find_personal(spark.createDataFrame(seeds + far + [(50, "zoe badge code ZX-99-1234 zoe")], "doc_id long, text string")).collect()
    assert {r.doc_id: [s.value for s in r.spans if s.kind == "context"] for r in got if any(s.kind == "context" for s in r.spans)} == {50: ["ZX-99-1234"]}


def test_packing(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 10**6)).union(spark.createDataFrame([(-1, "Émile's 12½ ΣΑΣ <|endoftext|>x İ café é")], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = packing.pack_documents(docs).collect()
    for r in got:
        ids = (t.encode(text[r.doc_id], add_special_tokens=False).ids if text[r.doc_id] else []) + [1]
        part = np.array(ids[r.start : r.start + 4096], "<u4")
        assert (r.start, r.length, r.ids_crc32) == (4096 * r.piece, len(part), zlib.crc32(part.tobytes()))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0] + [n for _, n in b])[:-1].tolist() and sum(n for _, n in b) <= 4096
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 4096) + 2
    assert packing.pack_documents(empty).count() == 0


def test_packing_by_ranks(monkeypatch):
    """Plain runs go to the faster library; its ids are the tokenizer's own, for every token of the vocabulary and for random runs."""
    import public_tokenizers

    cache = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert cache.ranked
    plain = [chr(c) for c in range(0x21, 0x100) if packing.PLAIN(chr(c))]
    rng = np.random.default_rng(3)
    runs = ["".join(rng.choice(plain[:94] if k % 2 else plain, int(n))) for k, n in enumerate(rng.integers(1, 40, 4000))]
    runs += ["".join(rng.choice(["th", "er", "in", "ou", "sh", "nd", "é", "ß", "'s", "7", "."], int(n))) for n in rng.integers(1, 12, 4000)]
    back = {x: b for b, x in enumerate(cache.letters)}
    for token in cache.tokenizer.get_vocab(with_added_tokens=False):
        word = bytes(back[c] for c in token.removesuffix("</w>")).decode(errors="ignore")
        runs += [x for x in (word, "q" + word, word + "s") if x and packing.PLAIN(x)]
    assert len(runs) > 100_000
    want = cache.tokenizer.encode_batch(runs, add_special_tokens=False)
    for run, w in zip(runs, want, strict=True):
        assert np.frombuffer(cache[run], "<u4").tolist() == w.ids, run
    # whole texts, whose new runs go in one call; odd runs and turns of the cache too
    odd, calls = ["", "x\x01y", "a\x00b", "<|endoftext|>x", "<b>", "Σ", "12½", "e\u0301", "w" * 70, "\x01"], []
    monkeypatch.setattr(packing, "CACHE_BYTES", 1 << 20)
    cache.clear()
    step = cache.ranked
    cache.ranked = lambda x: calls.append(x) or step(x)
    for k in range(0, 6000, 50):
        text = " \n".join([*runs[k : k + 50], odd[k // 50 % len(odd)], *runs[:20]])
        assert np.frombuffer(cache.of_text(text), "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert 120 <= len(calls) < 600


def test_sharding(spark, odd, empty):
    for n in (1, 2, 3, 7, 100, 5000):
        df = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 5).alias("p"))
        df = df.withColumn("back", sharding.row_of(F.col("p"), n, 5)).collect()
        assert sorted(r.p for r in df) == list(range(n)) and all(r.back == r.id for r in df)
    rows = sharding.feistel_shards(odd.select("doc_id", "key"), 4).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((i % 4, i // 4) for i in range(odd.count()))
    many = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"))
    assert sorted(r.row for r in sharding.feistel_shards(many, 40).collect()) == list(range(5000))
    assert sharding.feistel_shards(empty.select("doc_id"), 4).count() == 0
    clash = odd.select("doc_id", *[F.lit(1).alias(c) for c in ("_h", "_n", "_b", "_place", "place", "number")])
    assert sharding.feistel_shards(clash, 4).columns == [*clash.columns, "row", "shard", "slot"] and sharding.feistel_shards(clash, 4).count() == odd.count()


def test_syncmers(spark, odd, empty):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    text = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(text)
    for r in syncmers.fingerprint_documents(docs).collect():
        own, nxt = text[r.doc_id], text[order[(order.index(r.doc_id) + 1) % len(order)]]
        q = len(own) // 4
        assert r.edited_sha256 == hashlib.sha256((own[: len(own) - q] + nxt[:q]).encode()).hexdigest() and r.n_chars == len(own)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    got = {r.doc_id: r for r in syncmers.fingerprint_documents(odd).collect()}
    assert got[1].fingerprint == got[9].fingerprint and got[4].fingerprint == "" and len(got) == odd.select("doc_id").distinct().count()
    a = odd.where("doc_id = 1").select(syncmers.anchors(F.col("text")).alias("a"), syncmers.anchors(F.concat(F.lit("p q r "), "text")).alias("b"))
    assert a.select(syncmers.shift(F.col("a"), F.col("b"))).first()[0] == 3
    assert syncmers.fingerprint_documents(empty).count() == 0


def test_lm(spark, odd, empty):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    got = lm.score_documents(docs, held).collect()
    tok = {r.doc_id: words(r.text) + [None] for r in docs.collect()}
    c = Counter(w for i, t in tok.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for r in got:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tok[r.doc_id]), sum(c[w] > 0 for w in tok[r.doc_id]), n) and math.isclose(r.base_score, base, rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    parted = {r.doc_id: r.score for r in lm.score_documents(docs, held, shard_bytes=300_000).collect()}
    assert all(parted[r.doc_id] == r.score for r in got)  # whatever the shards
    # the model with exact counts: the filter's levels and false positives move a score by little
    pair, q, types = Counter(), Counter(), Counter()
    for i, t in tok.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            pair.update(zip([None, *t[:-1]], t))
    for (h, _), k in pair.items():
        q[h] += float(lm.count_of(lm.level_of(np.array([k])))[0])
        types[h] += 1
    level = {k: float(lm.count_of(lm.level_of(np.array([k])))[0]) for k in set(pair.values())}
    for r in got:
        t, score = tok[r.doc_id], 0.0
        for h, w in zip([None, *t[:-1]], t):
            p1 = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            known = level.get(pair[h, w], 0.0)
            score += math.log10((max(known - 0.75, 0) + 0.75 * types[h] * p1) / q[h] if q[h] else p1)
        assert math.isclose(score, r.score, rel_tol=0.02)
    assert lm.score_documents(odd, F.col("doc_id") > 3).count() == odd.count() and lm.score_documents(empty, F.lit(True)).count() == 0


def test_lm_many_parts(spark, monkeypatch):
    """Many small parts of the filter: the same scores but for false positives, and the same whatever the shards."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    one = {r.doc_id: r.score for r in lm.score_documents(docs, held).collect()}
    monkeypatch.setattr(lm, "PART_TOKENS", 5000)
    many = {r.doc_id: r.score for r in lm.score_documents(docs, held).collect()}
    assert all(math.isclose(one[i], many[i], rel_tol=0.02) for i in one)
    assert many == {r.doc_id: r.score for r in lm.score_documents(docs, held, shard_bytes=2_000_000).collect()}


def test_bloom_levels():
    c = np.arange(1, 500)
    q = lm.count_of(lm.level_of(c))
    assert (np.abs(q - c) / c < 0.35).all() and lm.level_of(np.array([0, 1, 2])).tolist() == [0, 1, 2] and q[:3].tolist() == [1, 2, 3]


def test_chat(spark):
    rows = [(1, 1, "assistant", "x<|end|>\n"), (1, 0, "user", "<|<\\|<"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "assistant", " é😀 </s>[INST] ok [/INST]<"), (3, 1, "assistant", "|b"), (3, 1, "assistant", "|b"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for i in (1, 2, 3, None):
        turns = [(r or "", t or "") for c, n, r, t in sorted((x for x in rows if x[0] == i), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[i].n_turns == len(turns) and got[i].loss_chars == len(loss)
        assert got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert all(chat.unescape(chat.escape(x)) == x for x in ("<|", "<\\|", "<\\\\|a<|", "\\", "<"))


def test_licenses(spark, odd, empty):
    s = licenses.SENTENCES
    mit = " ".join(s[k] + "." for k in ("mit-granted", "mit-notice", "mit-as-is"))
    rows = [(1, f"abc.\n{s['mit-by']}.\nxyz"), (2, mit.replace(", sublicense", ",\nsublicense")), (3, " ".join(s[k] + "." for k in ("mit-as-is", "mit-notice"))), (4, None), (5, ""), (6, "no licence here"), (7, f"{s['cc-by-nc-4']}. {s['reserved']}.")]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "", 7: "All-rights-reserved,CC-BY-NC-4.0"}
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(odd).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ids, seen = {r.doc_id for r in docs.collect()}, docs
    for name, stage in p.STAGES[:-1]:
        seen = stage(spark, seen, DIR)
        assert seen.columns == docs.columns
        now = {r.doc_id for r in seen.collect()}
        assert now <= ids and (name == "redact") == (now == ids) or name != "redact"
        ids = now
    assert {r.doc_id for r in p.run(spark, DIR).select("doc_id").distinct().collect()} == ids


def test_jaccard_near_group(spark, monkeypatch):
    """A large group of near copies around the threshold, with lists longer than a part and null ids."""
    monkeypatch.setattr(jaccard, "LIST_ROWS", 16)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"x{rng.integers(10**9)}" if rng.random() < rng.choice([0.005, 0.02, 0.04]) else w for w in base)) for i in range(150)]
    rows += [(None, rows[3][1]), (None, "alone with words of its own here"), (None, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df).collect()
    want = brute_components([r for r in rows if r[0] is not None])
    assert {tuple(r) for r in got if r.doc_id is not None} == want and len({c for _, _, c in want}) > 3
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == sorted([str({i: c for i, _, c in want}[3]), "None", "None", "None"])
    members, links = jaccard.jaccard_links(df)
    name = {r["class"]: r.doc_id for r in members.where("doc_id IS NOT NULL").collect()}
    sets = {i: shingles(dict(rows)[i]) for i in name.values()}
    linked = {tuple(sorted((name[r.a], name[r.b]))) for r in links.collect()}
    assert linked == {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    kept = jaccard.keep_representatives(df.withColumn("row", F.lit(1)).withColumn("i", F.lit(2))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept) == sorted([(False, c, dict(rows[:150])[c]) for c in {c for _, _, c in want}] + [(True, 0, "alone with words of its own here"), (True, 0, ""), (True, 0, "")])


def test_evolution_beats_best_fit():
    """Items that fit in threes without room: best-fit decreasing leaves room, the islands' evolution finds fewer bins."""
    rng = np.random.default_rng(5)
    a = rng.integers(1400, 1800, 40)
    b = rng.integers(1100, 1350, 40)
    lens = np.concatenate([a, b, 4096 - a - b]).astype(np.int32)
    seed = packing.Bins(lens, 4096).best_fit(np.argsort(-lens, kind="stable").tolist())
    population = packing.first_population(lens, 4096, np.random.default_rng(1))
    for e in range(packing.EPOCHS):
        population = packing.evolve(population, np.random.default_rng(e))
    assert len(population[0].items) < len(seed.items)


def test_packing_of_large_pieces(spark):
    """Pieces that cannot be paired end the descent after two levels; every one is placed."""
    pieces = spark.range(5000).select(F.col("id").alias("uid"), (F.col("id") % 1000 + 2100).alias("length"))
    got = packing.pack(pieces).collect()
    assert len(got) == len({r.sequence_id for r in got}) == 5000 and {r.offset for r in got} == {0}


def test_words_of_long_texts(monkeypatch):
    from trackloom.llm import shingles as sh

    texts = [b"ab " * 50 + b"x" * 500 + b" end", b"", None, b"y" * 300, b" a\nb ", b"z" * 90 + b" " * 90 + b"q"]
    want = sh.hashed_words(texts)
    monkeypatch.setattr(sh, "SLICE_BYTES", 64)
    got = sh.hashed_words(texts)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and want[1].tolist() == [0, 52, 52, 52, 53, 55, 57]


def test_stages_keep_odd_rows(spark):
    """Null ids, repeated ids, clashing columns and empty tables in the stage functions."""
    rows = [(1, "a b c d e f g h"), (1, "other words under the same number here"), (None, "no number but some words of its own"), (None, None), (2, ""), (3, "mail me at ann@host.org please"), (3, "mail me at ann@host.org please")]
    names = ["row", "own_id", "own_key", "key", "i", "k", "spans", "h"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(7) for n in names})
    none = df.where("false")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    item = spark.createDataFrame([(1, "some words of its own no"), (2, "b c d e f g")], "item_id long, text string")
    show = lambda d: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in d.collect()))
    every = show(df)
    assert show(importance.keep_selected(df, labels.where("false"))) == every
    assert show(containment.drop_contaminated(df, item)) == [x for x in every if not x[2].startswith("a b c")]
    assert show(personal.redact(df)) == [(a, b, c.replace("ann@host.org", "<EMAIL>")) for a, b, c in every]
    assert show(jaccard.keep_representatives(df)) == [x for i, x in enumerate(every) if i == 0 or x != every[i - 1]]
    for kept in (importance.keep_selected(none, labels), containment.drop_contaminated(none, item), personal.redact(none), jaccard.keep_representatives(none)):
        assert kept.columns == df.columns and kept.count() == 0


def test_personal_unknown_kind(spark):
    """A kind of identifier no seed resembles, after a word that never repeats: general patterns join it to the seeds."""
    rng = np.random.default_rng(2)
    cards = [4111111111111111, 5500005555555559, 340000000000009, 6011000990139424, 4012888888881881, 5105105105105100]
    rows = [(i, f"{'abcdef'[i]} word {n} then") for i, n in enumerate(cards)]
    far = "q" * 80
    rows += [(100 + i, f'{chr(97 + i)}x {far} token = "{"".join(rng.choice(list("0123456789abcdef"), 40))}" {chr(97 + i)}z') for i in range(5)]
    rows += [(200 + i, f"see page number {w} of it") for i, w in enumerate(("7", "12", "133", "9"))]
    got = {r.doc_id: [s.kind for s in r.spans] for r in personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == ["context"] for i in range(5)) and not any(got[200 + i] for i in range(4))


def test_personal_serial_numbers(spark):
    """Numbers of orders, stamps and numbers of books share their beginnings: no spans beside card numbers, while unknown kinds that vary are found."""
    rows = [(1, "my card number 4111 1111 1111 1111 expires"), (2, "my card number 5500 0000 0000 0004 expires")]
    rows += [(10 + i, f"the order number 98765432100{i:02d}1 shipped today") for i in range(20)]
    rows += [(50 + i, f"a nightly build stamp 2024{i + 1:02d}15{i:02d}3000 passed again") for i in range(6)]
    rows += [(70 + i, f"see the isbn 97803064061{i:02d} for more") for i in range(8)]
    got = personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    luhn = lambda t: sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, t[::-1]))) % 10 == 0
    for r in got:
        text = dict(rows)[r.doc_id]
        number = re.search("[0-9][0-9 ]+[0-9]", text)[0]
        assert [(s.kind, s.value) for s in r.spans] == ([("card", number)] if luhn(number.replace(" ", "")) else []), text


def test_personal_varied_brute(spark):
    """Which patterns vary enough, against a count of all pairs."""
    edges = [(f"{b}{i}", p, s) for p in range(6) for i in range(3 + p) for b, s in [(("same" if i % (p + 1) else f"x{i}yz"), i % 4 == p % 4)]]
    got = {tuple(r) for r in personal._varied(spark.createDataFrame(edges, "value string, pattern long, seed boolean"), 0.8).collect()}
    want = set()
    for p in range(6):
        own = [(v, s) for v, q, s in edges if q == p]
        unknown = [v[:4] for v, s in own if not s]
        pairs = [(a, b) for i, a in enumerate(unknown) for j, b in enumerate(unknown) if i != j]
        alike = sum(a == b for a, b in pairs)
        if not pairs or alike <= 0.2 * len(pairs) or len(own) - len(unknown) >= 0.8 * len(own):
            want.add((p, len(own)))
    assert got == want and 0 < len(want) < 6
