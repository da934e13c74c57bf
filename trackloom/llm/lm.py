"""Language-model scoring with a log-frequency Bloom filter.

A bigram model with absolute counts of words and quantised counts of word pairs, all of them, once seen ones too: a count
c has the level 1 + floor(log_b(c)), and the filter holds (pair, 1) to (pair, level) (Talbot and Osborne 2007). Scoring
probes (pair, 1), (pair, 2), ... until one is missing, which gives the level and so the quantised count q. With Q(h) the
sum and T(h) the number of the quantised counts of a context h, and a discount D (absolute discounting),

    p(w | h) = (max(q(h, w) - D, 0) + D T(h) p1(w)) / Q(h),   p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

and p1(w) where the context was never seen. The filter and the word table grow with the corpus, in parts of some million
tokens: pairs by their hash, words by ranges of theirs. Shards are ranges of parts, each about `shard_bytes` at most. All
are broadcast and lie on the workers' disks; a task asks them one after the other about a million tokens at a time, so it
holds one shard, and the texts are read once. Where a pair's bits lie does not depend on the shards, so scores do not either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import small_batches, stored
from trackloom.llm.shingles import U, hashed_words, mix

END = int(mix(np.array([0xE0D], U))[0])
BASE_OF_LEVELS = 1.5
SEGMENT_BITS = 20
BITS_PER_ENTRY = 12
DISCOUNT = 0.75
#: What one broadcast holds at most, about.
SHARD_BYTES = 64 << 20
#: Tokens that are counted at once, and scored at once.
FLUSH, BLOCK = 2_000_000, 1_000_000


def level_of(count: np.ndarray) -> np.ndarray:
    """1 + floor(log_b(c)) for counts of at least 1, 0 below."""
    return np.where(count >= 1, 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE_OF_LEVELS) + 1e-9), 0).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The count in the middle of a level; 0 for level 0."""
    low, high = np.ceil(BASE_OF_LEVELS ** (level - 1.0) - 1e-9), np.ceil(BASE_OF_LEVELS**level - 1e-9)
    return np.where(level > 0, (low + np.maximum(low, high - 1)) / 2, 0.0)


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h) * U(0x9E3779B97F4A7C15) + w)


def _bits(key: np.ndarray, level: int | np.ndarray) -> list[np.ndarray]:
    """Three places in a segment for (key, level)."""
    x = mix(key + U(0xD1B54A32D192ED03) * np.asarray(level).astype(U))
    return [((x >> U(SEGMENT_BITS * i)) & U((1 << SEGMENT_BITS) - 1)).view(np.int64) for i in range(3)]


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by END; the token before each (END before the first); where texts begin."""
    h, at = hashed_words(texts)
    out = np.insert(h, at[1:], U(END))
    at = at + np.arange(len(at))
    return out, np.concatenate([[U(END)], out[:-1]]) if len(out) else out, at


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in the fewest bytes each that hold the largest."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes() if len(x) else b""


def _unpacked(held: list[bytes], keys: list[bytes]) -> np.ndarray:
    """What _packed made of as many numbers as there are eight-byte keys beside them."""
    return np.concatenate([np.frombuffer(x, f"u{8 * len(x) // len(k)}").astype(np.int64) for x, k in zip(held, keys, strict=True)])


def _keys(held: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(held), U)


def _by_part(part: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    """(part, its rows of each column) of the parts that have any."""
    order = np.argsort(part, kind="stable")
    found, at = np.unique(part[order], return_index=True)
    cols = [c[order] for c in cols]
    for p, low, high in zip(found.tolist(), at, np.append(at[1:], len(part)), strict=True):
        yield p, *[c[low:high] for c in cols]


def _word_part(w: np.ndarray, parts: int) -> np.ndarray:
    """Parts of the words are ranges of their hashes, so parts one after the other are in order."""
    return ((w >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _pair_part(key: np.ndarray, parts: int) -> np.ndarray:
    return (mix(key) % U(parts)).view(np.int64)


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.Table.from_pylist(rows, pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]))


COUNTS = "part int, h binary, key binary, c binary"


def _counts(docs: DataFrame, parts: int) -> DataFrame:
    """Partial counts, what a task counted of a part in one row: pairs (context h, key) in the parts from 0, words (key) in those from `parts` on."""

    def counted(w: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        word, c = np.unique(w, return_counts=True)
        rows = [{"part": parts + p, "key": x.tobytes(), "c": _packed(n)} for p, x, n in _by_part(_word_part(word, parts), word, c)]
        key, first, c = np.unique(pair_key(h, w), return_index=True, return_counts=True)
        rows += [{"part": p, "h": x.tobytes(), "key": k.tobytes(), "c": _packed(n)} for p, x, k, n in _by_part(_pair_part(key, parts), h[first], key, c)]
        return _table(COUNTS, rows).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, hs, size = [], [], 0
        for b in batches:
            w, h, _ = tokens(b.column("t").to_pylist())
            ws.append(w)
            hs.append(h)
            size += len(w)
            if size >= FLUSH:
                yield counted(np.concatenate(ws), np.concatenate(hs))
                ws, hs, size = [], [], 0
        if size:
            yield counted(np.concatenate(ws), np.concatenate(hs))

    return docs.select("t").mapInArrow(run, COUNTS)


class Shard:
    """Some parts of the model: words in order with count, context sum and number of followers, and the filter's segments of the pair parts from `first` on; `at`: where each part's begin."""

    def __init__(self, words: np.ndarray, known: list[np.ndarray], segments: np.ndarray, first: int, at: np.ndarray, parts: int) -> None:
        self.words, self.known, self.segments, self.first, self.at, self.parts = words, known, segments, first, at, parts

    def words_of(self, word: np.ndarray) -> np.ndarray:
        """(count, context sum, followers) of each word, in three rows; 0 where this shard has none."""
        if not len(self.words):
            return np.zeros((3, len(word)))
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        c, total, types = (x[at].astype(float) for x in self.known)
        return np.where(self.words[at] == word, np.stack([c, total / 2, types]), 0.0)

    def pairs_of(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The level of each pair, by probes until one is missing; 0 where the pair's part is in another shard."""
        level = np.zeros(len(w), np.int16)
        key = pair_key(h, w)
        part = _pair_part(key, self.parts)
        size = np.diff(self.at)
        live = np.flatnonzero((part >= self.first) & (part < self.first + len(size)))
        live = live[size[part[live] - self.first] > 0]
        key, part = key[live], part[live]
        seg = self.at[part - self.first] + _segment(key, part, size[part - self.first])
        j = 1
        while len(live):
            hit = np.ones(len(live), bool)
            for place in _bits(key, j):
                hit &= (self.segments[seg, place >> 3] >> (place & 7) & 1).astype(bool)
            live, key, seg = live[hit], key[hit], seg[hit]
            level[live] = j
            j += 1
        return level


def _segment(key: np.ndarray, part: np.ndarray | int, size: np.ndarray | int) -> np.ndarray:
    """Which of a part's segments holds a pair."""
    return (mix(key ^ np.asarray(part).astype(U)) % np.asarray(size).astype(U)).view(np.int64)


REDUCED = "part int, seg int, bits binary, key binary, c binary, sum binary, types binary"
KNOWN = "part int, key binary, c binary, sum binary, types binary, n long, v long"


def _reduced(rows: DataFrame, parts: int) -> DataFrame:
    """What the partial counts come to, each part in one task, whose pairs are bounded as there are as many parts as they need.

    Of a pair part: its filter's segments (part, seg, bits), and twice the sum of quantised counts and the number of pairs
    of its contexts (key, sum, types), a row for each word part. Of a word part: counts of words (key, c).
    """

    def reduce(t: pa.Table) -> pa.Table:
        part, held, counts = t.column("part")[0].as_py(), t.column("key").to_pylist(), t.column("c").to_pylist()
        key, first, back = np.unique(_keys(held), return_index=True, return_inverse=True)
        c = np.rint(np.bincount(back, _unpacked(counts, held))).astype(np.int64)
        if part >= parts:
            return _table(REDUCED, [{"part": part - parts, "key": key.tobytes(), "c": _packed(c)}])
        level = level_of(c)
        n = (int(level.sum()) * BITS_PER_ENTRY >> SEGMENT_BITS) + 1
        seg = _segment(key, part, n)
        bits = np.zeros((n, 1 << SEGMENT_BITS), bool)
        for j in range(1, int(level.max()) + 1):
            some = level >= j
            for where in _bits(key[some], j):
                bits[seg[some], where] = True
        out = [{"part": part, "seg": i, "bits": np.packbits(x, bitorder="little").tobytes()} for i, x in enumerate(bits)]
        context, back, types = np.unique(_keys(t.column("h").to_pylist())[first], return_inverse=True, return_counts=True)
        total = np.rint(np.bincount(back, 2 * count_of(level))).astype(np.int64)
        out += [{"part": p, "key": k.tobytes(), "sum": _packed(s), "types": _packed(y)} for p, k, s, y in _by_part(_word_part(context, parts), context, total, types)]
        return _table(REDUCED, out)

    return rows.groupBy("part").applyInArrow(reduce, REDUCED)


def _known(found: DataFrame) -> DataFrame:
    """One row a word part: its words in order, with count, twice the sum of quantised counts and number of pairs; n tokens, v words."""

    def merge(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        word = np.unique(_keys([r["key"] for r in rows]))
        total = {x: np.zeros(len(word), np.int64) for x in ("c", "sum", "types")}
        for r in rows:
            at = np.searchsorted(word, _keys([r["key"]]))
            for x, have in total.items():
                if r[x] is not None:
                    have[at] += _unpacked([r[x]], [r["key"]])
        return _table(KNOWN, [{"part": rows[0]["part"], "key": word.tobytes(), "n": int(total["c"].sum()), "v": len(word)} | {x: _packed(y) for x, y in total.items()}])

    return found.where("key IS NOT NULL").drop("seg", "bits").groupBy("part").applyInArrow(merge, KNOWN)


#: Tokens of the training texts for each part of the filter.
PART_TOKENS = 1 << 20


def train(docs: DataFrame, shard_bytes: int = SHARD_BYTES):
    """(N, V, number of shards, function from a shard's number to the Shard) of the model of docs (column t: binary).

    A shard is a range of parts; the driver holds one at a time, and no list of the parts.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("t") + 1), F.lit(0))).first()[0]
    parts = max(1, size // (6 * PART_TOKENS))  # a word and its blank take about six bytes
    found = stored(_reduced(_counts(docs, parts), parts))
    known = stored(_known(found))
    table = sum((F.octet_length(x) for x in ("key", "c", "sum", "types")), F.lit(0)).cast("long")
    n, v, held = known.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "v", table)]).first()
    held += found.where("bits IS NOT NULL").count() << SEGMENT_BITS - 3
    shards = min(parts, max(1, -(-held // shard_bytes)))

    def shard(i: int) -> Shard:
        first, last = i * parts // shards, (i + 1) * parts // shards
        here = F.col("part").between(first, last - 1)
        rows = known.where(here).sort("part").drop("n", "v").toArrow()
        keys = rows.column("key").to_pylist()
        cols = [_unpacked(rows.column(x).to_pylist(), keys) if keys else np.zeros(0, np.int64) for x in ("c", "sum", "types")]
        cols = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in cols]
        bits = found.where(here & F.col("bits").isNotNull()).select("part", "seg", "bits").toArrow()
        part, seg = bits.column("part").to_numpy(), bits.column("seg").to_numpy()
        at = np.append(0, np.cumsum(np.bincount(part - first, minlength=last - first))).astype(np.int64)
        segments = np.zeros((len(part), 1 << SEGMENT_BITS - 3), np.uint8)
        for to, x in zip((at[part - first] + seg).tolist(), bits.column("bits"), strict=True):
            segments[to] = np.frombuffer(x.as_buffer(), np.uint8)
        return Shard(_keys(keys), cols, segments, first, at, parts)

    return n, v, shards, shard


def _score(at: np.ndarray, known: np.ndarray, level: np.ndarray, n: int, v: int, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n_known, base, score) of each text. known: what words_of tells of each token; end: of the end, which comes before the first."""
    c = known[0]
    p1 = (c + 0.5) / (n + 0.5 * (v + 1))
    total, types = np.concatenate([end.reshape(3, 1), known[:, :-1]], axis=1)[1:]
    p = np.where(total > 0, (np.maximum(count_of(level) - DISCOUNT, 0) + DISCOUNT * types * p1) / np.maximum(total, 1), p1)
    of = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else np.zeros(0)  # noqa: E731  each text has a token: END
    return of((c > 0).astype(np.int64)), of(np.log10(p1)), of(np.log10(p))


def _opened(held, shards: int) -> Shard:
    """A worker keeps the only shard; of several it reads one after the other from its disk and keeps none."""
    path = getattr(held, "_path", None)
    return held.value if shards == 1 or path is None else held.load_from_path(path)


def score_documents(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `training` is a boolean column: the documents to learn from. A null or empty text is one token, the end. Equal texts
    score alike; repeated rows give a row each. If nothing is there to learn from, all counts are 0. An empty table gives
    an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), (~training).alias("held_out"), F.col(text_col).cast("binary").alias("t"))
    n, v, shards, shard = train(source.where("NOT held_out"), shard_bytes)
    held = []
    for i in range(shards):
        held.append(spark.sparkContext.broadcast(shard(i)))
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def block(rows: list[pa.RecordBatch], ws: list[np.ndarray], hs: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        w, h, at = np.concatenate(ws), np.concatenate(hs), np.append(0, np.cumsum(np.concatenate(sizes)))
        word, back = np.unique(w, return_inverse=True)
        known, level = np.zeros((3, len(word))), np.zeros(len(w), np.int16)
        for b in held:
            model = _opened(b, shards)
            known += model.words_of(word)
            level += model.pairs_of(h, w)
            del model
        end = known[:, np.searchsorted(word, U(END))]
        n_known, base, score = _score(at, known[:, back], level.astype(np.int64), n, v, end)
        ids = [pa.concat_arrays([r.column(x) for r in rows]) for x in ("id", "held_out")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(np.diff(at)), pa.array(n_known.astype(np.int64)), pa.array(base.astype(float)), pa.array(score.astype(float))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[list, ...] = ([], [], [], [])
        for b in batches:
            if not len(b):
                continue
            w, h, at = tokens(b.column("t").to_pylist())
            for to, x in zip(got, (b.select(["id", "held_out"]), w, h, np.diff(at)), strict=True):
                to.append(x)
            if sum(map(len, got[1])) >= BLOCK:
                yield block(*got)
                got = ([], [], [], [])
        if got[0]:
            yield block(*got)

    scored = source.mapInArrow(run, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
