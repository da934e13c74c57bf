"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces; pieces shorter than a sequence are dealt into blocks of bounded size, and each block is
packed by a grouping genetic algorithm (Falkenauer 1996): crossover injects whole well-filled bins of one parent into the
other, bins that now hold a document twice are dissolved, and the displaced documents are best-fitted. Several islands
work on every block; between epochs each island's elite migrates to the next island. Bins with much room left are then
dissolved and their pieces go to the next level, dealt into fewer blocks, until one block is left.

All that moves between tasks are ids and lengths; texts are read once, where they lie.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import small_batches, stored

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Pieces in a block, on average.
BLOCK = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION, CHILDREN = 2, 2, 3, 4, 3
#: Tasks that evolve islands for each core of the cluster, at most.
TASKS_A_CORE = 32
#: Bins with more than this share of room are dissolved into the next level.
ROOM = 0.004
#: Bytes, about, of the runs without blanks that a worker remembers, half of them those it met last; and their parts.
CACHE_BYTES, CACHE_PARTS = 64 << 20, 50_000
#: A run of these characters needs no normalization but lower case; its parts are those of the tokenizer's own pattern.
PLAIN = re.compile("[!-~\xa1-\xac\xae-\xb4\xb6-\xff]*").fullmatch
LETTERS, DIGITS = "a-z\xaa\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}\x01]+|\x01").findall

_caches: dict[str, WordIds] = {}


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else 256 and on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """A run without blanks -> its token ids, four bytes each.

    The tokenizer never joins what a blank or line feed parts, so ids of the runs in a row are the ids of the text. Runs
    of plain characters go part by part to the faster library where ids are in order of the merges, else to the
    tokenizer's model; all others go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts: dict[str, list[int]] = {}
        self.letters = _byte_letters()
        self.special = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        self.ranked = self._ranked(path)
        self.cut = self.ranked("\x01\0")[0] if self.ranked else None  # plain runs have no such character
        self[""] = b""

    def _ranked(self, path: str) -> Callable[[str], list[int]] | None:
        """Ids of parts that each end with a null, which stands for the mark of a word's end; None where ids are no ranks."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, mark = self.tokenizer.get_vocab(with_added_tokens=False), model.get("end_of_word_suffix")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        joined = ["".join([a.removesuffix(mark), b]) for a, b in merges] if mark else []
        base = {x for x in self.letters} | {x + (mark or "") for x in self.letters}
        # 512 letters, then what the merges make, each once
        if not mark or {vocab.get(x, -1) for x in base} != set(range(512)) or any(vocab[x] > 255 for x in self.letters) or [vocab.get(x) for x in joined] != list(range(512, 512 + len(joined))):
            return None
        byte, null = {x: b for b, x in enumerate(self.letters)}, self.letters[0]
        spelt = lambda x: bytes([byte[c] for c in x.removesuffix(mark)]) + (b"\0" if x.endswith(mark) else b"")
        ranks = {spelt(x): vocab[x] for x in [*base, *joined] if null not in x or x == null}
        return tiktoken.Encoding("words", pat_str="[^\0]+\0", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            ids = [x.id for x in self.model.tokenize("".join([self.letters[b] for b in part.encode()]))]
            if len(self.parts) < CACHE_PARTS:
                self.parts[part] = ids
        return ids

    def of_text(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each; its new runs are encoded in one call."""
        runs = text.replace("\n", " ").split(" ")
        got = list(map(self.get, runs))
        if None in got:
            if self.ranked:
                self._learn({r for r, x in zip(runs, got, strict=True) if x is None and len(r) <= 64})
            got = [self[r] if x is None else x for r, x in zip(runs, got, strict=True)]
        return b"".join(got)

    def _learn(self, runs: set[str]) -> None:
        new = [r for r in runs if r not in self.older]
        joined = "\x01".join(new)
        if "<" in joined or not PLAIN(joined.replace("\x01", "")) or joined.count("\x01") >= max(len(new), 1):
            new = [r for r in new if PLAIN(r) and not ("<" in r and any(x in r for x in self.special))]
            joined = "\x01".join(new)
        if not new:
            return
        ids = np.array(self.ranked("\0".join([*PARTS(joined.lower()), ""])), "<u4")
        cuts, packed = np.flatnonzero(ids == self.cut).tolist(), ids.tobytes()
        self.update((run, packed[4 * a + 4 : 4 * b]) for run, a, b in zip(new, [-1, *cuts], [*cuts, len(ids)], strict=True))
        self.held += 220 * len(new) + len(joined) + len(packed)
        self._turn()

    def _turn(self) -> None:
        if self.held > CACHE_BYTES // 2:
            self.older, self.held = dict(self), 0
            self.clear()

    def __missing__(self, run: str) -> bytes:
        packed = self.older.get(run)
        if packed is None:
            packed = self._ids(run)
        if len(run) <= 64:
            self.held += 220 + len(run) + len(packed)  # the two objects and their place in the dictionary
            self._turn()
            self[run] = packed
        return packed

    def _ids(self, run: str) -> bytes:
        if PLAIN(run) and not ("<" in run and any(x in run for x in self.special)):
            parts = PARTS(run.lower())
            ids = self.ranked("\0".join([*parts, ""])) if self.ranked else [i for part in parts for i in self._part(part)]
        else:
            ids = self.tokenizer.encode(run, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def word_ids(tokenizer: str) -> WordIds:
    if tokenizer not in _caches:
        import public_tokenizers

        _caches[tokenizer] = WordIds(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
    return _caches[tokenizer]


def token_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and then END_ID, cut only where they exceed the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_ids(tokenizer)
        names, kinds = ["id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for b in batches:
            rows = []
            for i, text in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), strict=True):
                ids = cache.of_text(text) + end if text else end
                for p, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    rows.append((i, p, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return source.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Groups of items with their room, for one individual."""

    def __init__(self, lens: np.ndarray, capacity: int) -> None:
        self.lens, self.capacity, self.items, self.room = lens, capacity, [], []

    def add(self, items: list[int]) -> None:
        self.items.append(items)
        self.room.append(self.capacity - int(self.lens[items].sum()))

    def best_fit(self, items: list[int]) -> Bins:
        """Each item into the bin that it leaves least room in, else into a new one."""
        lens = self.lens
        held = sorted((r << 24) | b for b, r in enumerate(self.room) if r)
        for i in items:
            n = int(lens[i])
            at = bisect_left(held, n << 24)
            if at < len(held):
                b = held.pop(at) & 0xFFFFFF
                self.items[b].append(i)
                self.room[b] -= n
            else:
                b = len(self.items)
                self.items.append([i])
                self.room.append(self.capacity - n)
            if self.room[b]:
                insort(held, (self.room[b] << 24) | b)
        return self

    def fitness(self) -> tuple[int, float]:
        fill = 1 - np.array(self.room) / self.capacity
        return -len(self.items), float((fill * fill).sum())

    def assignment(self) -> np.ndarray:
        out = np.empty(len(self.lens), np.int32)
        for b, items in enumerate(self.items):
            out[items] = b
        return out

    @staticmethod
    def of(assignment: np.ndarray, lens: np.ndarray, capacity: int) -> Bins:
        out = Bins(lens, capacity)
        order = np.argsort(assignment, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(assignment[order])) + 1):
            out.add(part.tolist())
        return out


def crossover(a: Bins, b: Bins, rng: np.random.Generator) -> Bins:
    """a with about half of b's best-filled bins injected."""
    rank = np.argsort(b.room, kind="stable")[: max(1, len(b.room) // 2)]
    inject = [b.items[i] for i in rank[rng.random(len(rank)) < rng.uniform(0.2, 0.8)]]
    taken = np.zeros(len(a.lens), bool)
    for items in inject:
        taken[items] = True
    child, displaced = Bins(a.lens, a.capacity), []
    for items in inject:
        child.add(list(items))
    for items in a.items:
        if taken[items].any():
            displaced += [i for i in items if not taken[i]]
        else:
            child.add(list(items))
    return child.best_fit(sorted(displaced, key=lambda i: (-int(a.lens[i]), i)))


def mutate(x: Bins, rng: np.random.Generator) -> Bins:
    """Some of the emptiest bins, and as many others by chance, are dissolved and best-fitted anew."""
    n = max(1, len(x.room) // 16)
    gone = set(np.argsort(x.room)[::-1][:n].tolist()) | set(rng.integers(0, len(x.room), n).tolist())
    out, displaced = Bins(x.lens, x.capacity), []
    for b, items in enumerate(x.items):
        if b in gone:
            displaced += items
        else:
            out.add(list(items))
    return out.best_fit(sorted(displaced, key=lambda i: (-int(x.lens[i]), i)))


def first_population(lens: np.ndarray, capacity: int, rng: np.random.Generator) -> list[Bins]:
    """Best-fit decreasing, then orders that noise disturbs more and more."""
    out = []
    for i in range(POPULATION):
        key = lens * (1 + rng.normal(0, 0.05 * i, len(lens)))
        out.append(Bins(lens, capacity).best_fit(np.argsort(-key, kind="stable").tolist()))
    return out


def evolve(population: list[Bins], rng: np.random.Generator) -> list[Bins]:
    """GENERATIONS of crossover and mutation; none once the best individual has as few bins as the lengths allow."""
    floor = -(-int(population[0].lens.sum()) // population[0].capacity)
    for _ in range(GENERATIONS):
        if len(population[0].items) == floor:
            break
        children = []
        for _ in range(CHILDREN):
            i, j = rng.choice(len(population), 2, replace=False) if len(population) > 1 else (0, 0)
            child = crossover(population[i], population[j], rng)
            children.append(mutate(child, rng) if rng.random() < 0.5 else child)
        population = sorted(population + children, key=Bins.fitness, reverse=True)[:POPULATION]
    return population


STATE = "block long, island int, uids binary, lens binary, pop binary, elite binary, bins long, fill double"


def _epoch(state: DataFrame, capacity: int, seed: int, first: bool) -> DataFrame:
    """Each island evolves; from the second epoch on, it first takes in the elite of the island before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                rng = np.random.default_rng([seed, r["block"] & 0xFFFFFFFF, r["island"]])
                lens = np.frombuffer(r["lens"], np.int32)
                if first:
                    population = first_population(lens, capacity, rng)
                else:
                    pop = [*np.frombuffer(r["pop"], np.int32).reshape(-1, len(lens)), np.frombuffer(r["migrant"], np.int32)]
                    population = sorted((Bins.of(x, lens, capacity) for x in pop), key=Bins.fitness, reverse=True)[:POPULATION]
                population = evolve(population, rng)
                bins, fill = population[0].fitness()
                rows.append({n: r[n] for n in ("block", "island", "uids", "lens")} | {"pop": np.concatenate([x.assignment() for x in population]).tobytes(), "elite": population[0].assignment().tobytes(), "bins": -bins, "fill": fill})
            yield pa.RecordBatch.from_pylist(rows, STATE_ARROW)

    return state.mapInArrow(run, STATE)


STATE_ARROW = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("uids", pa.binary()), ("lens", pa.binary()), ("pop", pa.binary()), ("elite", pa.binary()), ("bins", pa.int64()), ("fill", pa.float64())])


def _pack_level(items: DataFrame, blocks: int, capacity: int, level: int, last: bool, seed: int) -> DataFrame:
    """(uid, length, sequence_id, offset); sequence_id null for pieces of bins that go to the next level."""

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by([("uid", "ascending")])
        return pa.table({"block": table.column("block")[:1], "uids": pa.array([table.column("uid").to_numpy().astype(np.int64).tobytes()], pa.binary()), "lens": pa.array([table.column("length").to_numpy().astype(np.int32).tobytes()], pa.binary())})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                uids, lens, own = (np.frombuffer(r[n], t) for n, t in (("uids", np.int64), ("lens", np.int32), ("elite", np.int32)))
                order = np.argsort(own, kind="stable")
                total = np.cumsum(lens[order], dtype=np.int64) - lens[order]
                new = np.concatenate([[True], np.diff(own[order]) > 0])
                offset = total - np.repeat(total[new], np.diff(np.append(np.flatnonzero(new), len(own))))
                fill = np.bincount(own, lens)[own[order]]
                done = np.full(len(own), True) if last else fill >= capacity * (1 - ROOM)
                seq = (np.int64(level) << np.int64(58)) + (np.int64(r["block"]) << np.int64(22)) + own[order]
                yield pa.RecordBatch.from_arrays([pa.array(uids[order]), pa.array(lens[order].astype(np.int64)), pa.array(seq, mask=~done), pa.array(offset)], ["uid", "length", "sequence_id", "offset"])

    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block"))
    gathered = dealt.groupBy("block").applyInArrow(gather, "block long, uids binary, lens binary")
    state = gathered.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    # an explicit number of tasks: the islands' states are small, their work is not
    tasks = min(TASKS_A_CORE * items.sparkSession.sparkContext.defaultParallelism, blocks * ISLANDS)
    spread = lambda d: d.repartition(tasks, "block", "island")
    state = stored(_epoch(spread(state), capacity, seed, True))
    for e in range(1, EPOCHS):
        migrants = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("elite").alias("migrant"))
        state = stored(_epoch(spread(state.join(migrants, ["block", "island"])), capacity, seed + e, False))
    best = state.groupBy("block").agg(F.max_by(F.struct("uids", "lens", "elite"), F.struct(-F.col("bins"), "fill", "island")).alias("b"))
    return best.select("block", "b.*").mapInArrow(place, "uid long, length long, sequence_id long, offset long")


def pack(pieces: DataFrame, capacity: int = 4096, seed: int = 11) -> DataFrame:
    """pieces (with a unique long `uid` and `length`, 1 to capacity) -> (uid, sequence_id, offset)."""
    whole = pieces.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, items, level = whole, pieces.where(F.col("length") < capacity).select("uid", "length"), 0
    n, before = items.count(), None
    while n:
        blocks = -(-n // BLOCK)
        # a level that places less than a tenth of its pieces shows that the rest cannot be filled up: the next is the last
        last = blocks == 1 or (before is not None and 10 * n > 9 * before)
        placed = stored(_pack_level(items, blocks, capacity, level, last, seed + 100 * level))
        out = out.union(placed.where("sequence_id IS NOT NULL").select("uid", "sequence_id", "offset"))
        items = placed.where("sequence_id IS NULL").select("uid", "length")
        before, n, level = n, items.count(), level + 1
    return out


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str = TOKENIZER, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text has the end id alone. Only documents of more than `capacity` ids are cut, into whole sequences
    and a rest. Repeated rows are packed one by one. Sequence ids are any numbers; offsets of a sequence are gapless from
    0. An empty table gives an empty result. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    pieces = stored(token_pieces(docs, capacity, tokenizer, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()))
    placed = pack(pieces.select("uid", "length"), capacity, seed)
    return pieces.join(placed, "uid").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
