"""Alignment of the tokens of two tokenizers over the same bytes, and how often their ids are linked in the corpus.

A static interval index over B's tokens (their begins and ends, sorted) is stabbed by bisection for each token of A: the
B tokens that it overlaps. A gap between two B tokens is spanned when some A token overlaps both sides of it; gaps never
spanned become the borders of groups, within which tokens correspond only as a whole.

Neither tokenizer joins what lies on both sides of a cut between a character that is no white space and a blank or line
feed, or between a letter and a mark that no piece of B holds behind a letter. So each text is cut there into chunks, the
chunks of many texts are encoded and aligned together, and what a chunk gives is remembered up to a bound in bytes. A text
with a chunk whose tokens do not spell its bytes is encoded whole instead, as is every text where B's vocabulary is not so.

Two passes over the texts: the first counts chunks in each task and adds up the links of their id pairs, merged by key;
the second gives every document its groups and its sums over the counts. The counts are broadcast in shards of at most
SHARD_PAIRS pairs each, one pass for each shard (a pass adds what its shard knows), so no worker holds more.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import small_batches, stored

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: White space other than blank and line feed: a chunk that ends with one is not cut from the next.
OTHER = re.compile(r"[^\S \n]").search
#: Characters whose class no version of Unicode has changed.
LATIN = re.compile("[\x00-\xff]*").fullmatch
#: Bytes, about, that a worker's remembered chunks take, and pairs in a broadcast shard (17 bytes each).
CACHE_BYTES, SHARD_PAIRS = 96 << 20, 2 << 20
#: Distinct chunks that a task of the first pass counts before it gives out their links, and characters of texts handled at once.
HELD, SLICE = 400_000, 4 << 20
BLANK = "▁"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: the printable ones themselves, the others from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(rest)): b for b in range(256)}


class Pair:
    """The two tokenizers, the bytes of their ids, and where texts can be cut for both."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        a_file, b_file = _path(a_file), _path(b_file)
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        byte = _byte_of_letter()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        with open(a_file, encoding="utf-8") as f:
            merges = [m if isinstance(m, list) else m.split(" ") for m in json.load(f)["model"]["merges"]]
        # where ids are in order of the merges, they are ranks, and plain text may go through the faster library
        self.ranked = all(vocab["".join(m)] == 256 + i for i, m in enumerate(merges)) and len(vocab) >= 256 + len(merges)
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))} if self.ranked else {}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.ranked else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_size = np.array([len(x) for x in self.b_bytes])
        held = [p for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i)]
        self.apart = not any("\n" in p or BLANK in p.lstrip(BLANK) for p in held)
        self.marks = "".join(m for m in ",.;:!?" if not any(x.isalpha() and y == m for p in held for x, y in zip(p, p[1:], strict=False)))
        m = re.escape(self.marks)
        self.chunks = re.compile(rf"[ \n]*(?:[{LETTERS}]+(?=[{m}])|[^ \n]+)|[ \n]+" if m else r"[ \n]*[^ \n]+|[ \n]+").findall
        # where a cut stands before every blank, line feed, comma and full stop, a plain split does
        self.uneven = re.compile(rf"[^{LETTERS}][,.]|[ \n][ \n]|[\x01\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search if {*",."} <= {*self.marks} else None
        ascii_ = "".join(f"{chr(c)} {chr(c)}  x{chr(c)}" for c in range(1, 128))
        self.plain = self.spelt(" " + ascii_, *self.whole(ascii_))  # ASCII is always spelt

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        # the libraries may know different versions of Unicode, so only old letters go the faster way
        return [self.fast.encode_ordinary(t) if self.ranked and LATIN(t) else self.a.encode(t, add_special_tokens=False).ids for t in texts]

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        """B's tokens without the blank that B adds: no piece goes over a line feed, so what follows one is encoded on its own."""
        return [x[2:] for x in self.b.encode(["\n" + t for t in texts], num_threads=1)]

    def whole(self, text: str) -> tuple[list[int], list[int]]:
        """The tokens of a text, A's with a blank before it, B's with its own."""
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)

    def spelt(self, text: str, a: list[int], b: list[int]) -> bool:
        want = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == want and b"".join([self.b_bytes[i] for i in b]) == want


def _path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(past the last A token, past the last B token) of each group, for sorted token ends over the same bytes; a token begins where the one before ends."""
    n = len(b_ends)
    a_begins, b_begins = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    low, high = np.searchsorted(b_ends, a_begins, "right"), np.searchsorted(b_begins, a_ends, "left")  # B tokens low to high - 1 overlap the A token
    over = high - low > 1
    change = np.zeros(n + 2, np.int64)
    np.add.at(change, low[over] + 1, 1)
    np.add.at(change, high[over], -1)
    past_b = np.flatnonzero(np.cumsum(change[: n + 1])[1:] == 0) + 1  # gap i lies before B token i
    return np.searchsorted(a_ends, b_ends[past_b - 1]) + 1, past_b


class Aligner:
    """Chunks' tokens, aligned many at a time, with what was found remembered."""

    def __init__(self, a_file: str, b_file: str) -> None:
        self.pair = Pair(a_file, b_file)
        n_a, n_b = len(self.pair.a_size), len(self.pair.b_size)
        self.said = [f"{i}{c}" for c, n in ((",", n_a), ("|", n_a), (",", n_b), (";", n_b), ("\n", n_b)) for i in range(n)]
        self.begin = np.cumsum([0, n_a, n_a, n_b, n_b]).tolist()
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.rows = np.zeros((1024, 5), np.int64)  # valid, n_a, n_b, n_links, place of the sums
        self.sums = np.zeros((1024, 2), np.int64)
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        """The parts of a blank and the text that are encoded each on its own; one part where cutting is not safe."""
        if self.pair.uneven and not self.pair.uneven(text) and text[0] not in " \n,." and text[-1] not in " \n":
            return (" " + text.replace(" ", "\x01 ").replace("\n", "\x01\n").replace(",", "\x01,").replace(".", "\x01.")).split("\x01")
        parts = self.pair.chunks(" " + text)
        if OTHER(text):
            whole: list[str] = []
            for p in parts:
                if whole and whole[-1][-1].isspace():
                    whole[-1] += p
                else:
                    whole.append(p)
            parts = whole
        return parts

    def aligned(self, a: list[list[int]], b: list[list[int]], texts: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(groups of each, if wanted; codes of the links of all; links of each) of tokens that spell the same bytes, none empty.

        All are laid end to end: an end is one for both tokenizers, so no group goes over it.
        """
        count_a, count_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids_a, ids_b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        past_a, past_b = group_ends(np.cumsum(self.pair.a_size[ids_a]), np.cumsum(self.pair.b_size[ids_b]))
        links = (ids_a[past_a - 1] << 32) | ids_b[past_b - 1]
        last = np.searchsorted(past_b, np.cumsum(count_b))  # the last group of each
        each = np.diff(last, prepend=-1)
        if not texts:
            return [], links, each
        in_a, in_b = np.diff(past_a, prepend=0), np.diff(past_b, prepend=0)
        begin = np.cumsum(in_a + in_b) - in_a - in_b
        at_a = np.repeat(begin - past_a + in_a, in_a) + np.arange(len(ids_a))
        at_b = np.repeat(begin + in_a - past_b + in_b, in_b) + np.arange(len(ids_b))
        code_a, code_b = ids_a + self.begin[0], ids_b + self.begin[2]
        code_a[past_a - 1] += self.begin[1] - self.begin[0]
        code_b[past_b - 1] += self.begin[3] - self.begin[2]
        code_b[past_b[last] - 1] += self.begin[4] - self.begin[3]
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[at_a], code[at_b] = code_a, code_b
        return "".join(map(self.said.__getitem__, code.tolist())).split("\n")[:-1], links, each

    def encoded(self, parts: list[str]) -> tuple[list[bool], list[list[int]], list[list[int]]]:
        a, b = self.pair.ids_a(parts), self.pair.ids_b(parts)
        data = [p.encode() for p in parts]
        size = np.array([len(d) for d in data])
        every = b"".join(data)
        for ids, table, sizes in ((a, self.pair.a_bytes, self.pair.a_size), (b, self.pair.b_bytes, self.pair.b_size)):
            flat = [i for x in ids for i in x]
            past = np.cumsum([len(x) for x in ids])
            total = np.append(0, np.cumsum(sizes[flat]))[past] if flat else np.zeros(len(past), np.int64)
            if not np.array_equal(np.diff(total, prepend=0), size) or b"".join([table[i] for i in flat]) != every:
                return [self.pair.spelt(*x) for x in zip(parts, a, b, strict=True)], a, b
        return [True] * len(parts), a, b

    def learn(self, parts: list[str], sums_of) -> None:
        """Remember chunks that are not known yet; sums_of: codes of links -> two numbers each, added up by chunk."""
        valid, a, b = self.encoded(parts)
        good = [i for i, v in enumerate(valid) if v]
        groups, links, each = self.aligned([a[i] for i in good], [b[i] for i in good], True) if good else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        first = len(self.groups)
        while first + len(parts) > len(self.rows):
            self.rows, self.sums = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.sums, np.zeros_like(self.sums)])
        said = [""] * len(parts)
        for i, g in zip(good, groups, strict=True):
            said[i] = g
        at = first + np.array(good, np.int64)
        self.rows[at] = np.stack([np.ones(len(good), np.int64), [len(a[i]) for i in good], [len(b[i]) for i in good], each, at], axis=1) if good else 0
        if good:
            self.sums[at] = np.stack([np.add.reduceat(x, np.cumsum(each) - each) for x in sums_of(links)], axis=1)
        self.groups += said
        self.place |= {p: first + i for i, p in enumerate(parts)}
        self.held += 330 * len(parts) + sum(map(len, parts)) + sum(map(len, said))

    def safe(self, valid: bool) -> bool:
        return valid and self.pair.apart


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    key = (a_file, b_file)
    if key not in _aligners:
        _aligners[key] = Aligner(a_file, b_file)
    return _aligners[key]


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, at most SLICE characters together unless one alone is longer."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > SLICE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def linked_pairs(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, text_col: str = "text") -> DataFrame:
    """(a, b, n): how many links of the corpus hold the ids a and b; added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = aligner(a_file, b_file), Counter()

        def batch_of(links: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
            code, at = np.unique(links, return_inverse=True)
            n = np.zeros(len(code), np.int64)
            np.add.at(n, at, weight)
            return pa.RecordBatch.from_arrays([pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

        def counted() -> Iterator[pa.RecordBatch]:
            """The links of the chunks counted; where tokens do not spell a chunk, its texts were left to be encoded whole."""
            parts = list(seen)
            for k in range(0, len(parts), HELD // 8):
                some = parts[k : k + HELD // 8]
                _, a, b = own.encoded(some)
                _, links, each = own.aligned(a, b, False)
                yield batch_of(links, np.repeat(np.array([seen[p] for p in some]), each))
            seen.clear()

        known: dict[str, bool] = {}  # chunks that are not plain, and whether their tokens spell them
        for batch in batches:
            for text in batch.column("t").to_pylist():
                if not text:
                    continue
                parts = own.chunks(text)
                odd = [p for p in parts if not own.pair.plain or not p.isascii() or "\x00" in p] if not (own.pair.plain and text.isascii() and "\x00" not in text) else []
                new = list({p for p in odd if p not in known})
                known |= dict(zip(new, own.encoded(new)[0], strict=True)) if new else {}
                if own.pair.apart and all(known[p] for p in odd):
                    seen.update(parts)
                else:
                    a, b = own.pair.whole(text)
                    if own.pair.spelt(" " + text, a, b):
                        links = own.aligned([a], [b], False)[1]
                        yield batch_of(links, np.ones(len(links), np.int64))
                if len(known) > HELD:
                    known.clear()
                if len(seen) > HELD:
                    yield from counted()
        yield from counted()

    source = docs.select(F.col(text_col).alias("t"))
    return source.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _measured(source: DataFrame, shard: Broadcast, number: int, a_file: str, b_file: str) -> DataFrame:
    """(_id, _key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one pass; the sums are over the pairs of this shard alone, all else is zero or null but in the first pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = aligner(a_file, b_file), number == 0
        codes, counts, best = shard.value
        own.forget()  # what is remembered holds sums over another shard

        def sums_of(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(codes):
                return np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
            at = np.minimum(np.searchsorted(codes, links), len(codes) - 1)
            hit = codes[at] == links
            return np.where(hit, best[at], 0), np.where(hit, counts[at], 0)

        def row_of(text: str | None, parts: list[str]) -> tuple:
            if not text:
                return 0, 0, 0, 0, 0, ""
            at = np.fromiter(map(own.place.__getitem__, parts), np.int64, len(parts))
            rows = own.rows[at]
            if own.safe(bool(rows[:, 0].all())):
                _, n_a, n_b, n_links, _ = rows.sum(axis=0).tolist()
                return n_a, n_b, n_links, *own.sums[at].sum(axis=0).tolist(), ";".join([own.groups[i] for i in at.tolist()])
            a, b = own.pair.whole(text)
            if not own.pair.spelt(" " + text, a, b):
                return 0, 0, 0, 0, 0, ""
            groups, links, _ = own.aligned([a], [b], True)
            return len(a), len(b), len(links), *[int(x.sum()) for x in sums_of(links)], groups[0]

        for batch in batches:
            out = []
            for texts in _slices(batch.column("_text").to_pylist()):
                if own.held > CACHE_BYTES:
                    own.forget()
                parts = [own.chunks(t) if t else [] for t in texts]
                new = {p for x in parts for p, i in zip(x, map(own.place.get, x), strict=True) if i is None}
                if new:
                    own.learn(list(new), sums_of)
                for row in map(row_of, texts, parts):
                    out.append((*row[:5], (hashlib.sha256(row[5].encode()).hexdigest() if row[5] else "") if first else None))
            n_a, n_b, n_links, n_best, count, sha = zip(*out, strict=True) if out else ([],) * 6
            longs = [pa.array(x if first or i > 2 else [0] * len(x), pa.int64()) for i, x in enumerate((n_a, n_b, n_links, n_best, count))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_key"), longs[0], longs[1], longs[2], longs[2], longs[3], longs[4], pa.array(sha, pa.string())], names)

    names = ["_id", "_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = source.schema["_id"].dataType.simpleString()
    return source.mapInArrow(run, f"_id {kind}, _key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_tokens(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text", shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document; see the module for groups and links.

    A link holds the A and the B token that end a group together. n_best counts the links whose pair is linked as often
    as any pair of their B id in the corpus, ties included; count_sum adds the pairs' counts up. A null or empty text and
    one whose tokens do not spell its bytes (as where it holds U+2581) have no tokens: zeros and an empty groups_sha256.
    Every row gives a row; repeated rows count as often as they stand. An empty table gives an empty result. Other columns
    are not read. `token_groups` gives the groups themselves.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    pairs = linked_pairs(docs, a_file, b_file, text_col)
    top = pairs.groupBy(F.col("b").alias("_b")).agg(F.max("n").alias("_most"))  # at most one row for each id of B
    scored = stored(pairs.join(top, F.col("b") == F.col("_b")).select("a", "b", "n", (F.col("n") == F.col("_most")).alias("best")))
    n_shards = max(1, -(-scored.count() // shard_pairs))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    source = source.withColumn("_key", F.xxhash64(F.col("_id"), F.col("_text")) if n_shards > 1 else F.lit(0).cast("long"))
    out = None
    for k in range(n_shards):
        own = scored.where(F.pmod(F.xxhash64("a", "b"), F.lit(n_shards)) == k) if n_shards > 1 else scored
        table = own.select(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("code"), "n", "best").toArrow()
        code = table.column("code").to_numpy()
        order = np.argsort(code)
        shard = sc.broadcast((code[order], table.column("n").to_numpy()[order], table.column("best").to_numpy()[order]))
        part = _measured(source, shard, k, a_file, b_file)
        out = part if out is None else out.unionByName(part)
    if n_shards > 1:
        # rows of one id and text are one key; they are equal, so their sums are dealt back by their number
        firsts = out.where("groups_sha256 IS NOT NULL").groupBy("_id", "_key").agg(F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")])
        sums = out.groupBy("_id", "_key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        both = firsts.join(sums.select(F.col("_id").alias("_i"), F.col("_key").alias("_k"), "n_best", "count_sum"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")))
        both = both.withColumns({c: F.floor(F.col(c) / F.col("_rows")) for c in ("n_best", "count_sum")})
        out = both.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_groups(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): each document's groups as `a1,a2|b1;a3|b2`; empty without tokens. Nulls and empty tables as in align_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_file, b_file)
        for batch in batches:
            said = []
            for text in batch.column("_text").to_pylist():
                a, b = own.pair.whole(text) if text else ([], [])
                said.append(own.aligned([a], [b], True)[0][0] if text and own.pair.spelt(" " + text, a, b) else "")
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(said, pa.string())], ["_id", "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(run, f"_id {kind}, groups string").withColumnRenamed("_id", id_col)
