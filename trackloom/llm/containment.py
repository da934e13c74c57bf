"""Benchmark decontamination: size-partitioned MinHash containment search of short items inside long documents.

Items are parted by size into classes [S, 2S) of shingles, S a power of two. For each class a document is a row of
windows of three S-shingle blocks, one window starting at each block; a passage of a class's item lies whole inside one
of them, so the Jaccard similarity of item and window is at least 1/3 for a whole passage, however long the document.
Each window and item has a MinHash signature of `perms` values; one equal value makes a candidate (bands of one row),
which a passage with containment c misses with a probability of about (1 - c/4)^perms: under 3e-6 at 0.75 and 64.
Candidates are verified by the exact containment of the item's shingle set in the whole document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import small_batches, struct_row
from trackloom.llm.shingles import U, distinct, shingle_hashes

PERMS = 64
#: Text of one broadcast group of items; more items are searched group by group.
ITEM_BYTES = 32 << 20
#: Shingles that a worker hashes at once.
SLICE = 1 << 19
LAST = np.uint32(0xFFFFFFFF)


def _coefficients(perms: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 2**31, perms, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, perms, dtype=np.uint32)


class ItemIndex:
    """Signatures and shingle sets of the items, by size class."""

    def __init__(self, items: list[tuple[int, bytes | None]], k: int, perms: int) -> None:
        self.mul, self.add = _coefficients(perms)
        self.ids, self.sets, size = [], [], []
        for (i, _), s in zip(items, shingle_hashes([t for _, t in items], k), strict=True):
            if len(s):
                self.ids.append(i)
                self.sets.append(distinct(s))
                size.append(len(s))
        self.classes: dict[int, list] = {}
        step = np.array([1 << (n.bit_length() - 1) for n in size], np.int64)
        for s in sorted(set(step.tolist())):
            own = np.flatnonzero(step == s)
            sig = np.array([[((self.sets[i].astype(np.uint32) ^ b) * a).min() for a, b in zip(self.mul, self.add, strict=True)] for i in own], np.uint32)
            byperm = []
            for p in range(perms):
                order = np.argsort(sig[:, p], kind="stable")
                table = np.zeros(1 << 16, bool)
                table[sig[:, p] >> np.uint32(16)] = True
                byperm.append((sig[order, p], own[order], table))
            self.classes[s] = byperm


def _candidates(index: ItemIndex, shingles: list[np.ndarray]) -> set[tuple[int, int]]:
    """(document's place, item's place): a window and the item have a MinHash value in common."""
    found: set[tuple[int, int]] = set()
    steps = sorted(index.classes)
    if not steps or not shingles:
        return found
    base = steps[0]
    # every document is padded to whole blocks of the finest class, and two empty blocks keep windows inside it
    blocks = np.array([-(-len(s) // base) for s in shingles])
    room = blocks + 2
    at = np.concatenate([[0], np.cumsum(room)])
    flat = np.zeros(at[-1] * base, np.uint32)
    void = np.ones(at[-1] * base, bool)
    for s, a in zip(shingles, at[:-1] * base, strict=True):
        flat[a : a + len(s)] = s.astype(np.uint32)
        void[a : a + len(s)] = False
    doc = np.repeat(np.arange(len(shingles)), room)
    lanes = np.ascontiguousarray(flat.reshape(-1, base).T)
    gone = np.ascontiguousarray(void.reshape(-1, base).T)
    some = gone.any()
    # coarser blocks join two finer ones of the same document; where that is depends on the document's own blocks
    plans = []
    for s in steps:
        width = s // base
        starts = np.concatenate([np.arange(a, b, width) for a, b in zip(at[:-1], at[1:], strict=True)]) if width > 1 else None
        plans.append((s, starts, doc if starts is None else doc[starts]))
    for p in range(len(index.mul)):
        v = (lanes ^ index.add[p]) * index.mul[p]
        if some:
            v[gone] = LAST
        fine = np.minimum.reduce(v, axis=0)
        for s, starts, owner in plans:
            m = fine if starts is None else np.minimum.reduceat(fine, starts)
            # windows of three blocks; those over the end of a document are cut at it
            w = m.copy()
            for d in (1, 2):
                if len(m) > d:
                    same = owner[d:] == owner[:-d]
                    w[:-d] = np.where(same, np.minimum(w[:-d], m[d:]), w[:-d])
            values, items, table = index.classes[s][p]
            hit = np.flatnonzero(table[w >> np.uint32(16)])
            if len(hit):
                lo, hi = np.searchsorted(values, w[hit], "left"), np.searchsorted(values, w[hit], "right")
                for h, a, b in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                    if w[h] != LAST:
                        found.update((int(owner[h]), int(i)) for i in items[a:b])
    return found


def _slices(shingles: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    first, held, size = 0, [], 0
    for i, s in enumerate(shingles):
        if held and size + len(s) > SLICE:
            yield first, held
            first, held, size = i, [], 0
        held.append(s)
        size += len(s)
    if held:
        yield first, held


def _item_groups(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, bytes | None]]]:
    """All items, in groups whose texts together stay under ITEM_BYTES (a single longer text is a group of its own)."""
    held, size = [], 0
    for r in items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        if held and size + len(r.t) > ITEM_BYTES:
            yield held
            held, size = [], 0
        held.append((r.i, bytes(r.t)))
        size += len(r.t)
    if held:
        yield held


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.75, k: int = 5, perms: int = PERMS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every item whose share of shingles inside a document reaches the threshold.

    Sets of distinct k-word shingles, A-Z lower-cased; an item of 1 to k-1 words is one shingle and only in documents of
    just these words. Null and empty texts, of items or documents, contain nothing. Repeated documents give a row each,
    repeated items too. Empty tables give an empty result. Items are broadcast in groups of at most ITEM_BYTES of text.
    Other columns are not read.
    """
    small_batches(docs.sparkSession)
    schema = f"{id_col} long, {item_id} long, n_shared long, n_item long, containment double"
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    out = None
    for group in _item_groups(items, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(ItemIndex(group, k, perms))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                ids, rows = b.column("id").to_pylist(), []
                shingles = list(shingle_hashes(b.column("t").to_pylist(), k))
                for first, part in _slices(shingles):
                    sets: dict[int, np.ndarray] = {}
                    for d, i in sorted(_candidates(index, part)):
                        if d not in sets:
                            sets[d] = distinct(part[d])
                        own, item = sets[d], index.sets[i]
                        at = np.minimum(np.searchsorted(own, item), len(own) - 1)
                        n = int((own[at] == item).sum())
                        if n >= threshold * len(item):
                            rows.append((ids[first + d], index.ids[i], n, len(item), n / len(item)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [id_col, item_id, "n_shared", "n_item", "containment"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.75, text_col: str = "text") -> DataFrame:
    """The documents that contain no item at the threshold, with all their columns, whatever their names.

    Each is judged by its text alone: rows without an id like all others, rows with one text alike. Null and empty texts
    contain nothing and stay. Empty tables give back docs, or nothing.
    """
    keyed = docs.select(F.xxhash64(text_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = contained_items(keyed, items, threshold).select(F.col("doc_id").alias("key")).distinct()
    rows = struct_row(docs).withColumn("own_key", F.xxhash64(F.col(f"row.`{text_col}`")))
    return rows.join(found, rows.own_key == found.key, "left_anti").select("row.*")
