"""Byte-level word scanning shared by the text operators.

A word is a maximal run of bytes that are ASCII letters, digits or >= 0x80 once A-Z is lowered; on UTF-8 that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  Word hashes come from one prefix sum of ``byte * P**position`` (mod 2**64), so
no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACE = 32
FOLD = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else SPACE
    for c in range(256)
)
SEGMENT = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int, name: str) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        got = _powers[name] = np.cumprod(steps)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (every input bit reaches every output bit)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Words of several texts, one after the other; ``first[i]:first[i+1]`` are those of text i.

    ``start``/``end`` are byte positions in the text's UTF-8 form; ``prefix`` hashes the first bytes of each word.
    """

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    prefix: np.ndarray | None = None


def _scan(block: bytes, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Words of a folded block that begins and ends with a space."""
    a = np.frombuffer(block, np.uint8)
    w = a != SPACE
    edges = np.flatnonzero(w[1:] != w[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    c = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(a * _power(_BASE, len(a), "base"), out=c[1:])
    back = _power(_INVERSE, len(a), "inverse")[start]
    h = mix((c[end] - c[start]) * back)
    p = None
    if prefix:
        cut = np.minimum(end, start + prefix)
        p = mix((c[cut] - c[start]) * back + np.uint64(1))
    return h, start, end, p


def _segments(folded: bytes) -> Iterator[tuple[int, int]]:
    """Cuts a long text at spaces; a longer word stays whole."""
    at = 0
    while len(folded) - at > SEGMENT:
        cut = folded.rfind(b" ", at, at + SEGMENT)
        if cut <= at:
            cut = folded.find(b" ", at + SEGMENT)
            if cut < 0:
                break
        yield at, cut
        at = cut
    yield at, len(folded)


def words(texts: list[bytes], prefix: int = 0) -> Words:
    folded = [t.translate(FOLD) for t in texts]
    hs, ss, es, ps, counts = [], [], [], [], np.zeros(len(texts), np.int64)
    i = 0
    while i < len(folded):
        j, size = i, 0
        while j < len(folded) and (j == i or size + len(folded[j]) <= SEGMENT):
            size += len(folded[j]) + 1
            j += 1
        if j == i + 1 and size > SEGMENT + 1:
            parts = [(folded[i][a:b], a) for a, b in _segments(folded[i])]
            for part, shift in parts:
                h, s, e, p = _scan(b" " + part + b" ", prefix)
                hs.append(h), ss.append(s - 1 + shift), es.append(e - 1 + shift), ps.append(p)
                counts[i] += len(h)
        else:
            h, s, e, p = _scan(b" " + b" ".join(folded[i:j]) + b" ", prefix)
            lens = np.fromiter((len(x) + 1 for x in folded[i:j]), np.int64, j - i)
            offs = np.concatenate(([1], 1 + np.cumsum(lens)))
            at = np.searchsorted(s, offs)
            counts[i:j] = np.diff(at)
            base = np.repeat(offs[:-1], counts[i:j])
            hs.append(h), ss.append(s - base), es.append(e - base), ps.append(p)
        i = j
    first = np.concatenate(([0], np.cumsum(counts)))
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    return Words(join(hs, np.uint64), join(ss, np.int64), join(es, np.int64), first, join(ps, np.uint64) if prefix else None)


def groups(texts: list[bytes], limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together (a longer text stands alone), so that arrays stay small."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their bounds by text; a text of fewer words, but not none, has one shingle."""
    n = np.diff(w.first)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(first[-1], np.uint64)
    odd = np.uint64(0xA24BAED4963EE407)
    long = np.flatnonzero(n >= k)
    if len(long):
        total = len(w.hashes) - k + 1
        acc = np.zeros(total, np.uint64)
        for i in range(k):
            acc = acc * odd + w.hashes[i : i + total]
        keep = np.ones(len(w.hashes) + 1, bool)
        last = w.first[1:]
        for i in range(1, k):
            keep[np.maximum(last - i, w.first[:-1])] = False  # windows that would run into the next text
        keep = keep[:total] if total else keep[:0]
        for d in np.flatnonzero(n < k):
            keep[w.first[d] : min(w.first[d + 1], total)] = False
        out_at = np.repeat(np.arange(len(n)), counts)
        out[(n >= k)[out_at]] = mix(acc[keep])
    for d in np.flatnonzero((n < k) & (n > 0)):
        h = np.uint64(n[d])
        with np.errstate(over="ignore"):
            for x in w.hashes[w.first[d] : w.first[d + 1]]:
                h = h * odd + x
        out[first[d]] = mix(np.array([h], np.uint64))[0]
    return out, first
