"""Exact Jaccard self-join of word-shingle sets with set-relation skipping.

Documents with equal shingle sets form a class, known by the class key (64 bits of the whole set). The join runs over
classes in four steps, all of them Spark shuffles over narrow rows:

1. A count array of fixed size (2^21 buckets) approximates how many sets hold each shingle; rare shingles come first in
   the global order, so what very many sets share falls outside the prefixes. Any order gives exact results.
2. Each class posts its prefix, (shingle, class, size, position), to the shingle's index list. Long lists are split by
   a salt that follows from the count array, so no task gets an unbounded list.
3. Each class is held against one head only: of the heads of its lists (each list's most central member) the one it
   shares most lists with. Verified links make components. This is the relation skip: members that are similar to a
   common head need no probe of each other.
4. For lists that hold more than one component, members of different components are probed. A list is sorted by size and
   position; blocks of one size are skipped whole where the position rules them out, and cut where it does so from some
   position on. A member's answers follow from its head's: a pair whose distances to a common head are known is decided
   by the triangle inequality of the Jaccard distance where that suffices, without touching the sets.

Before whole sets are fetched, parity bitmaps (a bit a shingle) rule out most pairs: an exact bound, not an estimate.
Step 4 covers every pair that steps 2 and 3 left open, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import checkpointed, components, dealt_join, small_batches, stored, struct_row
from trackloom.llm.shingles import U, distinct, mix, shingle_hashes

#: Size of the count array (log2); with one byte a bucket when broadcast it takes 2 MB whatever the input.
BUCKET_BITS = 21
CHUNK = 4096
#: Members of one index list that a single task takes before the list is salted.
LIST_ROWS = 4096
#: Pairs of one class that a single task verifies.
PAIRS_OF_A_KEY = 64
#: Rows at most of a table of such classes that is broadcast.
HOT_KEYS = 100_000
#: Places of the bitmaps that travel with the rows of lists.
SMALL_PLACES = 512
#: Bits (log2) of the filter that names the classes whose sets are to be fetched: 8 MB, whatever the input.
FILTER_BITS = 26


def _need(n: int, percent: int) -> int:
    """Least overlap that a set of n needs with anything at the threshold: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(F.col(text_col)).alias("h"))


FIRST = "id long, h long, n long, key long, bitmap binary, small binary, chunk long, counts binary"


def _first_pass(docs: DataFrame, k: int) -> DataFrame:
    """(id, h, n, key, bitmap, small) of every document, the bitmaps once per class and task; and, after a task's documents,
    its count array as rows (chunk, counts), into which each set goes once per task."""
    names, kinds = [f.split()[0] for f in FIRST.split(", ")], {"long": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in FIRST.split(", ")]

    def batch(rows: int, **cols: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([cols.get(n, pa.nulls(rows, t)) for n, t in zip(names, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = set(), np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            n, keys, maps, small, new = [], [], [], [], []
            for s in shingle_hashes(b.column("t").to_pylist(), k):
                s = distinct(s)
                key = set_key(s) if len(s) else None
                known = key is None or key in seen
                n.append(len(s))
                keys.append(key)
                maps.append(None if known else _bitmap(s))
                small.append(None if known else _small_bitmap(s))
                if not known:
                    seen.add(key)
                    new.append(s)
            if new:
                total += np.bincount((np.concatenate(new) >> U(64 - BUCKET_BITS)).view(np.int64), minlength=1 << BUCKET_BITS)
            yield batch(b.num_rows, id=b.column("id"), h=b.column("h"), n=pa.array(n, pa.int64()), key=pa.array(keys, pa.int64()), bitmap=pa.array(maps, pa.binary()), small=pa.array(small, pa.binary()))
        rows = np.minimum(total, 2**16 - 1).astype(np.uint16).reshape(-1, CHUNK)  # enough to tell frequent from rare
        full = np.flatnonzero(rows.any(axis=1))
        yield batch(len(full), chunk=pa.array(full), counts=pa.array([rows[i].tobytes() for i in full], pa.binary()))

    return docs.mapInArrow(run, FIRST)


def _levels(counts: DataFrame) -> bytes:
    """The level of each bucket: eight times the logarithm of its count. 2^21 bytes in all, fetched in one job."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint16).astype(np.int64) for x in table.column("counts").to_pylist())
        level = np.minimum(np.round(8 * np.log2(total + 1)), 255).astype(np.uint8)  # 2^32 is level 255
        return pa.table({"chunk": table.column("chunk")[:1], "level": pa.array([level.tobytes()], pa.binary())})

    out = bytearray(1 << BUCKET_BITS)
    for r in counts.groupBy("chunk").applyInArrow(add, "chunk long, level binary").collect():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = r.level
    return bytes(out)


def set_key(s: np.ndarray) -> int:
    """64 bits of a whole set (sorted, without repeats); equal sets have equal keys."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.bitwise_xor.reduce(s) if len(s) else 0], U) + mix(np.array([s.sum(dtype=U) + U(len(s))], U)))[0].view(np.int64))


def _postings(df: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """(token, salt, parts, key, size, pos, mid): the prefix of each class, once per task. The count array decides order, salt and parts.

    mid is the mean level of the prefix: a text in the midst of many near copies has few shingles of its own, so the
    rarest of its shingles are still frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(levels.value, np.uint8)
        seen = set()
        for b in batches:
            token, keys, sizes, pos, mid = [], [], [], [], []
            for s in shingle_hashes(b.column("t").to_pylist(), k):
                s = distinct(s)
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                n = len(s)
                prefix = n - _need(n, percent) + 1
                rank = level[(s >> U(64 - BUCKET_BITS)).view(np.int64)]
                order = np.lexsort((s, rank))[:prefix]
                mid.append(np.full(prefix, int(rank[order].mean()), np.int16))
                s = s[order]
                token.append(s)
                keys.append(np.full(prefix, key, np.int64))
                sizes.append(np.full(prefix, n, np.int32))
                pos.append(np.arange(prefix, dtype=np.int32))
            if token:
                token, keys = np.concatenate(token), np.concatenate(keys)
                many = np.exp2(level[(token >> U(64 - BUCKET_BITS)).view(np.int64)] / 8.0)
                parts = np.maximum(1, np.ceil(many / LIST_ROWS)).astype(U)
                salt = np.where(parts > 1, (mix(token ^ keys.view(U)) % parts).astype(np.int32), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_longs(token), pa.array(salt), pa.array(parts.astype(np.int32)), pa.array(keys), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(pos)), pa.array(np.concatenate(mid))], ["token", "salt", "parts", "key", "size", "pos", "mid"])

    return df.select("t").mapInArrow(run, "token long, salt int, parts int, key long, size int, pos int, mid short")


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], by: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted batches, cut so that no run of equal `by` is split between two."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        x = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
        if not len(x[names[0]]):
            continue
        if held is not None:
            x = {n: np.concatenate([held[n], x[n]]) for n in names}
        last = np.ones(len(x[names[0]]), bool)
        for n in by:
            last &= x[n] == x[n][-1]
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        held = {n: v[cut:] for n, v in x.items()}
        if cut:
            yield {n: v[:cut] for n, v in x.items()}
    if held is not None:
        yield held


def _starts(*cols: np.ndarray) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _heads(posted: DataFrame) -> DataFrame:
    """Rows of lists with at least two classes, each with the list's head: the most central member, ties by a hash of the key, the same in all lists."""
    names = ("token", "salt", "parts", "key", "size", "pos", "mid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(batches, names, ("token", "salt")):
            once = _starts(x["token"], x["salt"], x["key"])  # the same class from several tasks
            x = {n: v[once] for n, v in x.items()}
            new = _starts(x["token"], x["salt"])
            at = np.flatnonzero(new)
            length = np.diff(np.append(at, len(new)))
            last = np.lexsort((mix(x["key"].view(U)), x["mid"], np.cumsum(new)))[at + length - 1]
            head = np.repeat(x["key"][last], length)
            # a salted list of one still has to meet its other salts
            keep = (np.repeat(length, length) > 1) | (x["salt"] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[n][keep]) for n in names[:-1]] + [pa.array(head[keep])], [*names[:-1], "head"])

    dealt = posted.repartition("token", "salt").sortWithinPartitions("token", "salt", "key")
    return dealt.mapInArrow(run, "token long, salt int, parts int, key long, size int, pos int, head long")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of lists that hold more than one component; those of salted lists all, as no task sees a whole one."""
    names = tuple(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(batches, names, ("token", "salt")):
            at = np.flatnonzero(_starts(x["token"], x["salt"]))
            several = np.minimum.reduceat(x["comp"], at) != np.maximum.reduceat(x["comp"], at)
            keep = np.repeat(several, np.diff(np.append(at, len(x["comp"])))) | (x["salt"] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[n][keep]) for n in names], list(names))

    return rows.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(run, rows.schema)


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... over length[0] numbers, then from first[1], and so on."""
    total = np.cumsum(length)
    return np.arange(total[-1]) + np.repeat(first - np.append(0, total[:-1]), length) if len(total) else np.zeros(0, np.int64)


def _candidates(size: np.ndarray, pos: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the members after i that may link with i) of a list that is sorted by size, then position.

    The list falls into blocks of equal size. For a block, the least overlap is one number, so a block is skipped as a
    whole where i stands too far back in its own set, and from the position on at which its members do.
    """
    new = _starts(size)
    at = np.flatnonzero(new)
    sizes, stop, block = size[at].astype(np.int64), np.append(at[1:], len(size)), np.cumsum(new) - 1
    place = (block << 32) + pos
    for i in range(len(size) - 1):
        n, r = int(size[i]), np.arange(block[i], np.searchsorted(sizes, int(size[i]) * 100 // percent, side="right"))
        need = -((-percent * (n + sizes[r])) // (100 + percent))  # ceil(t / (1 + t) (|x| + |y|))
        r, need = r[n - pos[i] >= need], need[n - pos[i] >= need]
        first = np.maximum(at[r], i + 1)
        last = np.minimum(np.searchsorted(place, (r << 32) + np.maximum(sizes[r] - need, -1), side="right"), stop[r])
        yield i, _ranges(first, np.maximum(last - first, 0))


def _probes(rows: DataFrame, percent: int, across: bool = True) -> DataFrame:
    """(a, b, sure): members of one list that the bounds leave possible; with `across`, only those in different components.

    A member's answers follow from its head's where that suffices: by the triangle inequality of the Jaccard distance a
    pair under one head is out when the distances to it differ by more than the limit, and in (sure) when their sum does
    not exceed it. Rows of a long list come in cells, pairs of its blocks, so that no task gets a whole one.
    """
    names = ("token", "cell", "key", "size", "pos", "comp", "head", "dist", "small", "part", "same")
    limit = (100 - percent) / 100

    def kept(x: dict[str, np.ndarray], bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = x["same"][i] | (x["part"][i] != x["part"][j])
        if across:
            ok &= x["comp"][i] != x["comp"][j]
        known = x["head"][i] == x["head"][j]
        ok &= ~(known & (np.abs(x["dist"][i] - x["dist"][j]) > limit + 1e-9))
        i, j, known = i[ok], j[ok], known[ok]
        # the sets differ in at least as many shingles as their parity bits
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) if len(i) else np.zeros(0, np.int64)
        ok = differ * (100 + percent) <= (100 - percent) * (x["size"][i].astype(np.int64) + x["size"][j])
        i, j, known = i[ok], j[ok], known[ok]
        return x["key"][i], x["key"][j], known & (x["dist"][i] + x["dist"][j] <= limit - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _runs(batches, names, ("token", "cell")):
            at = np.flatnonzero(_starts(x["token"], x["cell"]))
            length = np.diff(np.append(at, len(x["token"])))
            bits = np.frombuffer(b"".join(x["small"]), U).reshape(len(x["token"]), -1)
            # most lists have two members: all of them at once
            i = at[length == 2]
            n, m = x["size"][i].astype(np.int64), x["size"][i + 1].astype(np.int64)
            need = -((-percent * (n + m)) // (100 + percent))
            i = i[(m * percent <= n * 100) & (n - x["pos"][i] >= need) & (m - x["pos"][i + 1] >= need)]
            found = [kept(x, bits, i, i + 1)]
            for lo, k in zip(at[length > 2].tolist(), length[length > 2].tolist(), strict=True):
                for i, j in _candidates(x["size"][lo : lo + k], x["pos"][lo : lo + k], percent):
                    if len(j):
                        found.append(kept(x, bits, np.full(len(j), lo + i), lo + j))
            a, b, sure = (np.concatenate(c) for c in zip(*found, strict=True))
            _, once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
            a, b, sure = a[once], b[once], sure[once]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure)], ["a", "b", "sure"])

    dealt = rows.repartition("token", "cell").sortWithinPartitions("token", "cell", "size", "pos", "key")
    return dealt.select(*names).mapInArrow(run, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def _in_cells(rows: DataFrame) -> DataFrame:
    """rows with cell, part and same: a list is one cell, a salted one has a cell for each pair of its parts."""
    part = F.greatest("salt", F.lit(0))
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("cell", F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
    return rows.withColumn("same", F.col("cell") % (F.col("parts") + 1) == 0).drop("parts", "other", "salt")


def _key_filter(keys: DataFrame) -> bytes:
    """A bit for the hash of each key, 2^FILTER_BITS of them: of bounded size, and never without a key that is in it."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = mix(b.column("key").to_numpy().view(U)) >> U(64 - FILTER_BITS)
            yield pa.RecordBatch.from_arrays([_longs(h >> U(16)), _longs(h & U(0xFFFF))], ["chunk", "bit"])

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    placed = keys.distinct().mapInArrow(place, "chunk long, bit long").distinct()
    out = np.zeros((1 << FILTER_BITS - 16, 1 << 13), np.uint8)
    for r in placed.groupBy("chunk").applyInArrow(fill, "chunk long, bits binary").collect():  # 8 MB at most, in one job
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes()


def _bitmap(s: np.ndarray) -> bytes:
    """Parity bits: bit i tells whether an odd number of the set's shingles fall to place i; at least four times as many places as shingles."""
    places = max(64, 1 << max(4 * len(s) - 1, 0).bit_length())
    return np.packbits(np.bincount((s & U(places - 1)).view(np.int64), minlength=places).astype(np.uint8) & 1).tobytes()


def _small_bitmap(s: np.ndarray) -> bytes:
    """Parity bits of SMALL_PLACES places, which travel with the rows of lists."""
    return np.packbits(np.bincount((s & U(SMALL_PLACES - 1)).view(np.int64), minlength=SMALL_PLACES).astype(np.uint8) & 1).tobytes()


def _sets(docs: DataFrame, k: int, pairs: DataFrame) -> DataFrame:
    """(key, tokens, in_a, in_b): the classes in columns a and b of pairs (and perhaps a few more), once per task; tokens sorted, eight bytes each."""
    sc = docs.sparkSession.sparkContext
    wanted = [sc.broadcast(_key_filter(pairs.select(F.col(x).alias("key")))) for x in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(w.value, np.uint8) for w in wanted]
        seen = set()
        for b in batches:
            own, blobs, named = [], [], []
            for s in shingle_hashes(b.column("t").to_pylist(), k):
                s = distinct(s)
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                h = int(mix(np.array([key], np.int64).view(U))[0] >> U(64 - FILTER_BITS))
                there = [bool(x[h >> 3] >> (7 - (h & 7)) & 1) for x in bits]
                if any(there):
                    seen.add(key)
                    own.append(key)
                    blobs.append(s.tobytes())
                    named.append(there)
            flags = [pa.array([x[i] for x in named], pa.bool_()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(blobs, pa.binary()), *flags], ["key", "tokens", "in_a", "in_b"])

    return docs.select("t").mapInArrow(run, "key long, tokens binary, in_a boolean, in_b boolean")


def _with_sets(pairs: DataFrame, sets_a: DataFrame, sets_b: DataFrame) -> DataFrame:
    """(a, b, x, y): pairs with what the tables (key, tokens) have for a and for b.

    A key with very many pairs is dealt to several tasks, its set copied to each. Such keys are at most one in
    PAIRS_OF_A_KEY pairs; their table is broadcast only if it is small.
    """

    def join(left: DataFrame, sets: DataFrame, key: str, name: str) -> DataFrame:
        hot = checkpointed(pairs.groupBy(key).count().where(F.col("count") > PAIRS_OF_A_KEY).select(F.col(key).alias("hot_key"), F.ceil(F.col("count") / PAIRS_OF_A_KEY).cast("int").alias("parts")))
        n = hot.count()
        own = sets.select(F.col("key").alias(key), F.col("tokens").alias(name))
        if not n:
            return left.join(own, key)
        hot = F.broadcast(hot) if n <= HOT_KEYS else hot
        parts = F.coalesce("parts", F.lit(1))
        own = own.join(hot, F.col(key) == F.col("hot_key"), "left").select(key, name, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        dealt = left.join(hot, F.col(key) == F.col("hot_key"), "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("parts", "hot_key")
        return dealt.join(own, [key, "part"]).drop("part")

    return join(join(pairs, sets_b, "b", "y"), sets_a, "a", "x").select("a", "b", "x", "y")


def _possible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the bitmaps do not rule out: sets differ in at least as many shingles as their bitmaps in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y, n, m in zip(b.column("x"), b.column("y"), b.column("x_n").to_pylist(), b.column("y_n").to_pylist(), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                if len(s) > len(t):
                    s, t = t, s
                t = np.bitwise_xor.reduce(t.reshape(-1, len(s)), axis=0)  # parities of fewer places
                keep.append(int(np.bitwise_count(s ^ t).sum()) * (100 + percent) <= (100 - percent) * (n + m))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return _with_sets(pairs, maps, maps).select("a", "b", F.col("x.bitmap").alias("x"), F.col("y.bitmap").alias("y"), F.col("x.n").alias("x_n"), F.col("y.n").alias("y_n")).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, total, linked) of every pair, by exact intersection of the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, total = [], []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(t) < len(s):
                    s, t = t, s
                at = np.minimum(np.searchsorted(t, s), len(t) - 1)
                n = int((t[at] == s).sum())
                shared.append(n)
                total.append(len(s) + len(t) - n)
            n, u = np.array(shared, np.int64), np.array(total, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(n), pa.array(u), pa.array(100 * n >= percent * u)], ["a", "b", "shared", "total", "linked"])

    both = _with_sets(pairs, sets.where("in_a"), sets.where("in_b"))
    found = both.mapInArrow(run, "a long, b long, shared long, total long, linked boolean")
    return found.dropDuplicates(["a", "b"])  # a class may come from several tasks


class Join:
    """The join's tables over one input: classes, their index lists, the star pairs and the components that these make."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> None:
        small_batches(df.sparkSession)
        self.docs, self.k, self.percent = _docs(df, id_col, text_col), k, percent
        first = stored(_first_pass(self.docs, k))
        levels = df.sparkSession.sparkContext.broadcast(_levels(first.where("chunk IS NOT NULL").select("chunk", "counts")))
        self.lists = stored(_heads(_postings(self.docs, k, percent, levels)))
        self.own = first.where("chunk IS NULL").drop("chunk", "counts")
        self.maps = self.own.where("bitmap IS NOT NULL").dropDuplicates(["key"]).select("key", F.struct("n", "bitmap").alias("tokens"))
        # each class goes to the one head that it shares most lists with, so there are no more star pairs than classes
        shared = self.lists.where("key <> head").groupBy("head", "key").agg(F.count("*").alias("n"))
        self.stars = stored(shared.groupBy(F.col("key").alias("b")).agg(F.max_by("head", F.struct("n", "head")).alias("a")))
        self.tried = self.verified(self.stars)
        self.links = self.tried.where("linked").select("a", "b")
        self.label = stored(components(self.links))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, shared, total, linked) of the pairs that the bitmaps leave possible."""
        possible = stored(_possible(pairs, self.maps, self.percent))
        return stored(_verified(possible, _sets(self.docs, self.k, possible), self.percent))

    def probed(self, across: bool) -> DataFrame:
        """(a, b, sure) of the pairs that are still possible and no star pairs; with `across` only between components."""
        star = self.tried.select(F.col("b").alias("key"), F.col("a").alias("star"), (1 - F.col("shared") / F.col("total")).alias("dist"))
        about = self.label.withColumnRenamed("node", "key").join(star, "key", "full")  # what is known of a class, in one row
        rows = self.lists.join(about, "key", "left").withColumn("comp", F.coalesce("component", "key"))
        known = F.when(F.col("head") == F.col("key"), 0.0).when(F.col("head") == F.col("star"), F.col("dist")).otherwise(F.lit(float("nan")))
        rows = rows.select("token", "salt", "parts", "key", "size", "pos", "head", "comp", F.coalesce(known, F.lit(float("nan"))).alias("dist"))
        rows = _open(rows) if across else rows
        rows = rows.join(self.own.where("small IS NOT NULL").groupBy("key").agg(F.first("small").alias("small")), "key")
        done = self.stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return stored(_probes(_in_cells(rows), self.percent, across).join(done, ["a", "b"], "left_anti"))

    def labelled(self) -> DataFrame:
        """own with comp: the key that names the component; null without words."""
        late = self.verified(self.probed(True).select("a", "b")).where("linked").select("a", "b")
        label = components(self.links.union(late)).select(F.col("node").alias("key"), "component")
        return dealt_join(self.own.drop("bitmap", "small"), stored(label), "key", "left").withColumn("comp", F.coalesce("component", "key"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the least id that links reach, its own included).

    Two documents link when 100 * |A and B| >= percent * |A or B| over their sets of distinct k-word shingles. Null and
    empty texts have no shingles (n_shingles 0) and link with nothing: component_id is their own id. A text of 1 to k-1
    words is one shingle. Equal texts and repeated rows with one id fall into one class and one component. Rows with a
    null id come out with component_id null unless their component has an id. An empty table gives an empty result.
    Other columns of df, whatever their names, are neither read nor returned. Shingles and sets are known by 64-bit
    hashes: among n of them two fall together with a probability of about n^2 / 2^65.
    """
    own = stored(Join(df, id_col, text_col, k, percent).labelled())
    least = stored(own.where("comp IS NOT NULL").groupBy("comp").agg(F.min("id").alias("component_id")))
    found = dealt_join(own, least, "comp", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """All links, as (members, links): members (id, n_shingles, class), links (a, b) between different classes, a < b, each once.

    Equal sets are one class, so copies are not expanded; documents without words have a null class and no links. Pairs
    that the triangle over a common head decides are not verified. There may be as many links as pairs of classes in a
    dense group: components need jaccard_components only, which never lists them.
    """
    join = Join(df, id_col, text_col, k, percent)
    pairs = join.probed(False)
    late = join.verified(pairs.where("NOT sure").select("a", "b")).where("linked").select("a", "b")
    links = join.links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(late).union(pairs.where("sure").select("a", "b"))
    return join.own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("key").alias("class")), links.distinct()


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """df with one document of each component: the one with the least id, a null id last, ties by a hash of the text.

    Rows that repeat the kept document's id and text stay once. Documents without words link with nothing and stay, all
    of them, whatever their ids. All columns come back as they were; an empty table gives an empty result.
    """
    own = stored(Join(df, id_col, text_col, k, percent).labelled())
    order = F.struct(F.col("id").isNull(), "id", "h")
    kept = own.where("comp IS NOT NULL").groupBy("comp").agg(F.min(order).alias("m")).select(F.col("m.id").alias("i"), F.col("m.h").alias("h")).distinct()
    keyless = own.where("comp IS NULL").select(F.col("id").alias("i"), "h").distinct()
    rows = struct_row(df).withColumns({"own_id": F.col(f"row.`{id_col}`").cast("long"), "own_h": F.xxhash64(F.col(f"row.`{text_col}`"))})
    at = lambda t: rows.join(t, rows.own_id.eqNullSafe(t.i) & rows.own_h.eqNullSafe(t.h), "left_semi")
    return at(kept).dropDuplicates(["own_id", "own_h"]).union(at(keyless)).select("row.*")


__all__ = ["jaccard_components", "jaccard_links", "keep_representatives", "set_key"]
