"""Word shingles of whole texts as 64-bit hashes, in numpy, for use inside Spark tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes of text that are hashed at once; a longer text is cut at a blank. Hashing takes about 30 bytes for each.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random odd number for each byte, A-Z like a-z, and which bytes part words: 0x20 and 0x09-0x0D, as the contract has it."""
    value = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    value[65:91] = value[97:123]
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    value[blank] = 0
    return value, blank


VALUE, BLANK = _tables()
BASE = 0x2545F4914F6CDD1D
LAST_BLANK = re.compile(rb".*[\x20\x09-\x0D]", re.DOTALL)
NEXT_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _grown(power: np.ndarray, n: int) -> np.ndarray:
    """BASE^0 to at least BASE^(n-1), modulo 2^64, from a shorter such array."""
    while len(power) < n:
        power = np.concatenate([power, power * U(pow(BASE, len(power), 1 << 64))])
    return power


POWERS = _grown(np.array([1], U), 1 << 12)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of at most SLICE_BYTES, cut at blanks; a longer word stays whole."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = LAST_BLANK.match(text, at, at + SLICE_BYTES) or NEXT_BLANK.search(text, at + SLICE_BYTES)
        if not cut:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def _slices(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(places of the texts, their parts) of at most SLICE_BYTES together."""
    places: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        for part in _parts(t or b""):
            if held and size + len(part) > SLICE_BYTES:
                yield places, held
                places, held, size = [], [], 0
            places.append(i)
            held.append(part)
            size += len(part)
    if held:
        yield places, held


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts as one array of 64-bit hashes, and where each text's begin (one more entry than texts).

    A word's hash is a polynomial of its bytes' numbers, mixed with its length; all words of a slice are hashed together.
    """
    found, words = [], np.zeros(len(texts), np.int64)
    for places, part in _slices(texts):
        buf = np.frombuffer(b" ".join(part) + b" ", np.uint8)
        blank = BLANK[buf]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
        first, past = edge[0::2], edge[1::2]
        bounds = np.cumsum([len(t) + 1 for t in part])
        np.add.at(words, places, np.diff(np.searchsorted(first, bounds), prepend=0))
        if len(first):
            length = past - first
            power = _grown(POWERS, int(length.max()))
            inside = np.arange(len(buf)) - np.repeat(np.append(first, len(buf)), np.diff(np.concatenate([[0], first[1:], [len(buf)]])).tolist() + [0])
            inside[blank] = 0
            inside[: first[0]] = 0
            h = np.add.reduceat(VALUE[buf] * power[inside], first)
            found.append(mix(h ^ (length.astype(U) * U(0x9E3779B97F4A7C15))))
    return (np.concatenate(found) if found else np.zeros(0, U)), np.append(0, np.cumsum(words))


def shingle_hashes(texts: list[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
    """For each text its k-word shingles in order, repeats included; a text of 1 to k-1 words is one shingle, without words none."""
    h, at = hashed_words(texts)
    p = U(0x9E3779B97F4A7C15)
    s = np.full(max(len(h) - k + 1, 0), k, U)
    for i in range(k):
        s = s * p + h[i : len(h) - k + 1 + i]
    s = mix(s)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield s[a : b - k + 1]
        elif b > a:
            one = np.full(1, b - a, U)
            for x in h[a:b]:
                one = one * p + x
            yield mix(one)
        else:
            yield h[:0]


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted without repeats."""
    if len(s) < 2:
        return s
    s = np.sort(s)
    keep = np.empty(len(s), bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]
