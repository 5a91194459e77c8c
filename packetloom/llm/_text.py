"""Vectorised word and shingle hashing over batches of texts.

Texts are hashed in slabs of a few megabytes: a word's hash is a polynomial in its bytes,
taken from one running sum over the slab, so no Python object is made per word. Memory is
bounded by the slab, plus 8 bytes a word of the text at hand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLAB = 2 << 20
_Q = np.uint64(0x9E3779B97F4A7C15)
_Q_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = 0xD6E8FEB86659FD93

#: Words as maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and return; A-Z lower-cased.
SPACED = bytes(0x20 if b in (0x20, *range(0x09, 0x0E)) else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words as runs of ASCII letters and digits and of non-ASCII bytes; A-Z lower-cased.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0x20 for b in range(256))


def strings(column: pa.Array) -> list[str | None]:
    """A text column's values; bytes that are no UTF-8 become replacement characters."""
    return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _Q) | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, SLAB + (SLAB >> 2))
        up, down = np.full(n, _Q), np.full(n, _Q_INV)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def _segments(data: bytes) -> list[bytes]:
    """Pieces of at most a slab, cut at spaces; a longer word stays whole."""
    out, at = [], 0
    while len(data) - at > SLAB:
        cut = data.rfind(b" ", at + 1, at + SLAB)
        cut = cut if cut > at else data.find(b" ", at + SLAB)
        if cut < 0:
            break
        out.append(data[at:cut])
        at = cut
    out.append(data[at:])
    return out


def _hash_slab(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all pieces, and the number of words of each."""
    buf = np.frombuffer(b" ".join(pieces) + b" ", dtype=np.uint8)
    word = buf != 0x20
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(len(buf) + 1)
    run = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=run[1:])
    h = mix64((run[ends] - run[starts]) * down[starts])
    begin = np.cumsum([0] + [len(p) + 1 for p in pieces])
    return h, np.diff(np.searchsorted(starts, begin))


def word_hashes(texts: list[bytes | None], table: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, one after another, and offsets: text i has h[off[i]:off[i + 1]]."""
    slabs: list[list[tuple[int, bytes]]] = [[]]
    room = SLAB
    for i, t in enumerate(texts):
        for piece in _segments((t or b"").translate(table)):
            if len(piece) > room and slabs[-1]:
                slabs.append([])
                room = SLAB
            slabs[-1].append((i, piece))
            room -= len(piece) + 1
    hashes, counts = [np.empty(0, np.uint64)], np.zeros(len(texts), np.int64)
    for slab in slabs:
        if slab:
            h, n = _hash_slab([p for _, p in slab])
            hashes.append(h)
            np.add.at(counts, [i for i, _ in slab], n)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)])


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, with offsets, in order and with repeats.

    A text of 1 to k - 1 words has its whole sequence as one shingle; one without words has none.
    """
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_off = np.concatenate([[0], np.cumsum(count)])
    if not len(h):
        return np.empty(0, np.uint64), out_off
    s = h * np.uint64(1)
    weight = 1
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(1, k):
        weight = weight * _C % (1 << 64)
        s += padded[j : j + len(h)] * np.uint64(weight)
    keep = np.zeros(len(h) + 1, np.int64)
    np.add.at(keep, off[:-1], np.where(count > 0, 1, 0))
    np.add.at(keep, off[:-1] + count, np.where(count > 0, -1, 0))
    out = s[np.cumsum(keep[:-1]) > 0]
    for i in np.flatnonzero((n > 0) & (n < k)):
        v = 0
        for j, x in enumerate(h[off[i] : off[i + 1]].tolist()):
            v += x * pow(_C, j, 1 << 64)
        out[out_off[i]] = np.uint64((v + int(n[i])) % (1 << 64))
    return mix64(out), out_off


def groups_of(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about limit at most, one item at least."""
    out, start, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > start and total + s > limit:
            out.append((start, i))
            start, total = i, 0
        total += s
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
