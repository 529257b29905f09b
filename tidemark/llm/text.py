"""Words and word shingles of many texts at once, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A word's hash is a
polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed with its length.
"""

from __future__ import annotations

import numpy as np

_TO = bytes(0x20 if b in (0x20, *range(0x09, 0x0E)) else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
#: bytes hashed at once; a longer text is hashed alone
BLOCK = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = max(n, BLOCK + 1)
        p = np.empty(size, np.uint64)
        p[0], k = 1, 1
        while k < size:
            m = min(k, size - k)
            p[k : k + m] = p[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
        _powers[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with their starts and ends in data, which is translated already."""
    buf = np.frombuffer(data, np.uint8)
    inside = buf != 0x20
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_INVERSE, len(buf)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_BASE, len(buf) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), starts, ends


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """For each UTF-8 text the hashes of its words in order (none for a null)."""
    out: list[np.ndarray] = []
    none = np.empty(0, np.uint64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or b"") + 1 <= BLOCK):
            size += len(texts[j] or b"") + 1
            j += 1
        group = [t or b"" for t in texts[i:j]]
        data = b" ".join(group).translate(_TO)
        if not data.strip():
            out += [none] * len(group)
        else:
            h, starts, _ = _hash_block(data)
            lengths = np.array([len(t) + 1 for t in group])
            cuts = np.searchsorted(starts, np.cumsum(lengths))
            low = 0
            for c in cuts:
                out.append(h[low:c])
                low = c
        i = j
    return out


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """In order, not distinct; fewer words than size make one shingle, no words none."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    h = words[: n - k + 1] * np.uint64(0x2545F4914F6CDD1D)
    for i in range(1, k):
        h = (h + words[i : n - k + 1 + i]) * np.uint64(0x9FB21C651E98DF25 + 2 * i)
        h ^= h >> np.uint64(29)
    return mix(h + np.uint64(k))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted and distinct."""
    h = np.sort(shingle_hashes(words, size))
    if len(h) > 1:
        h = h[np.concatenate([[True], h[1:] != h[:-1]])]
    return h


def words(text: str | None) -> list[str]:
    """The words themselves, for exact checks."""
    return [w for w in (text or "").encode("utf-8", "replace").translate(_TO).decode().split(" ") if w]


def shingles(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def hash_spans(data: bytes) -> np.ndarray:
    """Hashes of the runs of bytes other than 0x20, in order."""
    return _hash_block(data)[0] if data else np.empty(0, np.uint64)
