"""Word shingles as 64-bit hashes, shared by the near-duplicate operator and its tests.

Words are the maximal runs of bytes other than space and ``\\x09-\\x0D`` after lower-casing A-Z; that is what
``bytes.lower().split()`` does. A document with fewer words than the shingle length has its whole word
sequence as its one shingle; without words it has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser; bijective on uint64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class WordHashes(dict):
    """Word (bytes) to 64-bit hash, filled on demand; emptied when it holds ``bound`` words."""

    bound = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 0x5EED)
        return h


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str | None], cache: WordHashes, width: int = 5) -> list[np.ndarray]:
    """For each whole text its distinct shingles, as sorted uint64 hashes. One pass over all words of the batch."""
    split = [words(t) for t in texts]
    n = np.array([len(ws) for ws in split], np.int64)
    ends = np.cumsum(n)
    h = np.fromiter((cache[w] for ws in split for w in ws), _U, int(ends[-1]) if len(n) else 0)
    full = np.zeros(0, _U)
    if len(h) >= width:
        full = np.full(len(h) - width + 1, _U(width))
        for k in range(width):
            full = _mix(full * _U(0x9E3779B97F4A7C15) + h[k : k + len(full)])
    out = []
    for start, end in zip((ends - n).tolist(), ends.tolist()):
        if end - start >= width:
            out.append(np.unique(full[start : end - width + 1]))
        elif end == start:
            out.append(np.empty(0, _U))
        else:  # the whole sequence as one
            one = np.full(1, _U(end - start))
            for k in range(start, end):
                one = _mix(one * _U(0x9E3779B97F4A7C15) + h[k : k + 1])
            out.append(one)
    return out


def intersection_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = max(len(b) - 1, 0)
    return int((b[at] == a).sum()) if len(b) else 0
