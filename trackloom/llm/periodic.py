"""Runs of repeated words (maximal periodicities) by the method of Kolpakov and Kucherov.

A text's words are cut into Lempel-Ziv factors, each the longest stretch that also begins earlier, read off a suffix
automaton. Main's algorithm finds, with Z arrays over a window of two factors, the runs that touch each border between
factors; a run strictly inside a factor is copied from the factor's earlier occurrence. All of it is linear in the words.

Every word of a run of twelve words or more lies in a window of six words that comes again in the text, as the run's
length less its period is six at least. So a text falls apart into stretches covered by such windows, no run leaves its
stretch, and only stretches of twelve words and more are factorised; the windows are compared by hashes, which can only
keep too many.

Documents are rows of a table that Spark deals; one text is handled in one task, whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has this many words at least, and two periods.
LEAST = 12
#: Words of the windows that every run is covered with: LEAST / 2, so that a run's repeated part holds one.
WINDOW = LEAST // 2
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Automaton:
    """Suffix automaton of a sequence of small integers; `first[v]` is where the earliest occurrence of v's strings ends."""

    def __init__(self, word: list[int]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.first = [-1]
        link, length = [-1], [0]
        nxt, first, last = self.next, self.first, 0
        for i, c in enumerate(word):
            cur = len(nxt)
            nxt.append({})
            first.append(i)
            length.append(i + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    own = len(nxt)
                    nxt.append(nxt[q].copy())
                    first.append(first[q])
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = own
                        p = link[p]
                    link[q] = link[cur] = own
            last = cur


def factors(word: list[int]) -> Iterator[tuple[int, int, int]]:
    """(begin, length, earlier begin) of the Lempel-Ziv factors; a symbol seen for the first time is a factor of its own, earlier begin -1."""
    a = Automaton(word)
    nxt, first = a.next, a.first
    i, n = 0, len(word)
    while i < n:
        v, j, seen = 0, i, -1
        while j < n:
            v = nxt[v][word[j]]
            if first[v] >= j:
                break
            seen = first[v]
            j += 1
        if j == i:
            yield i, 1, -1
            i += 1
        else:
            yield i, j - i, seen - (j - i) + 1
            i = j


def z_array(s: list[int]) -> list[int]:
    """For each place of s, how far the text from there agrees with s."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _at_border(w: list[int], border: int, back: int, ahead: int) -> Iterator[tuple[int, int, int]]:
    """Main's algorithm: (begin, past end, period) of repetitions with two periods that begin at `border` or before it and end there or behind it.

    Only `back` words before the border and `ahead` behind are looked at.
    """
    u, v = w[border - back : border], w[border : border + ahead]
    mark = [-1]
    u_back = u[::-1]
    v_own = z_array(v)  # v against its own later parts
    u_own = z_array(u_back)  # u's end against its own earlier parts
    u_in_v = z_array(u_back + mark + (u + v)[::-1])  # u's end against what ends p words behind the border
    v_in_u = z_array(v + mark + u + v)  # v against what begins p words before the border
    n, m = len(u), len(v)
    for p in range(1, m + 1):  # a whole period lies behind the border
        before, after = u_in_v[n + 1 + m - p] if n else 0, v_own[p] if p < m else 0
        if before + after >= p:
            yield border - before, border + p + after, p
    for p in range(1, n + 1):  # a whole period lies before it
        before, after = u_own[p] if p < n else 0, v_in_u[m + 1 + n - p] if m else 0
        after = min(after, m)
        if before + after >= p:
            yield border - p - before, border + after, p


def runs(word: list[int], least: int = 2) -> list[tuple[int, int, int]]:
    """(begin, length, smallest period) of all runs of at least `least` symbols, in order of begin, then period."""
    n = len(word)
    found: dict[tuple[int, int], int] = {}
    by_begin: dict[int, list[int]] = {}

    def add(a: int, e: int, p: int) -> None:
        old = found.get((a, e))
        if old is None:
            by_begin.setdefault(a, []).append(e)
        if old is None or p < old:
            found[a, e] = p

    last = 0
    for b, size, earlier in (*factors(word), (n, 0, -1)):
        if b:
            for a, e, p in _at_border(word, b, min(b, 2 * last + size + 1), min(size + 1, n - b)):
                # what could go on is found whole at another border
                if e - a >= least and (a == 0 or word[a - 1] != word[a - 1 + p]) and (e == n or word[e] != word[e - p]):
                    add(a, e, p)
        if size >= least and earlier >= 0 and by_begin:
            shift = b - earlier
            for a in range(b + 1, b + size - least + 1):
                for e in by_begin.get(a - shift, ()):
                    if e + shift < b + size:
                        add(a, e + shift, found[a - shift, e])
        last = size
    return sorted(((a, e - a, p) for (a, e), p in found.items()), key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, past end) of the stretches of LEAST words and more that windows which come again cover; all runs lie inside one each."""
    m = len(hashes) - WINDOW + 1
    if m < 2:
        return
    h = np.zeros(m, np.uint64)
    for i in range(WINDOW):
        h = h * FACTOR + hashes[i : i + m]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return
    at = np.flatnonzero(np.isin(h, twice))
    cut = np.flatnonzero(np.diff(at) > WINDOW) + 1
    for part in np.split(at, cut):
        if part[-1] + WINDOW - part[0] >= LEAST:
            yield int(part[0]), int(part[-1]) + WINDOW


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(begin, length, period) of the runs of LEAST words and more of a text."""
    if len(words) < LEAST:
        return []
    out = []
    hashes = np.array(list(map(hash, words)), np.int64).view(np.uint64)
    for a, e in stretches(hashes):
        part = hashes[a:e]
        again = list(stretches(part)) if e - a < len(words) else [(0, e - a)]  # windows that come again only elsewhere no longer count
        for x, y in again:
            number: dict[bytes, int] = {}
            out += [(a + x + s, n, p) for s, n, p in runs([number.setdefault(w, len(number)) for w in words[a + x : a + y]], LEAST)]
    return out


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that any run holds after its first period."""
    keep, at = [], 0
    for a, e in sorted((s + p, s + n) for s, n, p in found):
        keep += words[at:a] if a > at else []
        at = max(at, e)
    return keep + words[at:] if found else words


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs: array of (start, length, period), collapsed): the runs of each text's words by start, then period, and the text without its repetitions.

    Words are what bytes 0x20 and 0x09-0x0D part; collapsed joins by one blank the words that are in no run, or in the
    first period of every run that they are in. A null or empty text has no words, no runs and an empty collapsed text.
    Every row gives a row, repeated ones and null ids too. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for b in batches:
            sizes, spans, texts = [], [], []
            for text in b.column("_text").cast(pa.binary()).to_pylist():
                words = text.split() if text else []  # bytes are split at just these six
                found = text_runs(words)
                sizes.append(len(words))
                spans.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(b" ".join(kept_words(words, found)))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(texts, pa.binary()).cast(pa.string())], ["_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = source.mapInArrow(run, f"_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("_id", id_col)
