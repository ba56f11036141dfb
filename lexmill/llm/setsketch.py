"""SetSketch registers (Ertl, 2021) over sets of 64-bit element hashes, computed in batches with numpy.

Register i of a set is ``clip(floor(1 - log_b(min over elements of x_i)), 0, q + 1)`` with x_i exponential of
rate ``a``. Registers of a union are the element-wise maximum of the registers. For ``b`` near 1 the
probability that two sets agree in a register is their Jaccard similarity, so register values can be banded;
the counts of greater, smaller and equal registers give a maximum-likelihood estimate of the similarity.

An element's m exponentials are drawn in ascending order (sums of spaced exponentials) and dealt to registers by
a pseudo-random permutation, so that drawing stops once they exceed every minimum of the set.
"""

from __future__ import annotations

import numpy as np

from lexmill.llm.shingles import _mix

_U = np.uint64
#: A prime, so that any stride from 1 to M - 1 permutes the registers.
M = 163
BASE = 1.001
RATE = 20.0
LIMIT = 65_534


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, one row of M for each set; an empty set has zeros."""
    n = np.array([len(s) for s in sets], np.int64)
    low = np.full((len(sets), M), np.inf)
    flat = low.ravel()
    if n.sum():
        seed = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), n)
        h = _mix(seed ^ _U(0xA0761D6478BD642F))
        at = (h % _U(M)).astype(np.int64)
        stride = ((h // _U(M)) % _U(M - 1)).astype(np.int64) + 1
        x = np.zeros(len(seed))
        with np.errstate(over="ignore"):
            for j in range(M):
                x += -np.log(_uniform(_mix(seed + _U((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))))) / (RATE * (M - j))
                np.minimum.at(flat, doc * M + at, x)
                alive = x < low.max(axis=1)[doc]
                if not alive.all():
                    seed, doc, at, stride, x = seed[alive], doc[alive], at[alive], stride[alive], x[alive]
                    if not len(x):
                        break
                at = at + stride
                at[at >= M] -= M
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(low) / np.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, 0), 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def jaccard(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sets of known sizes; rows of a and b are registers.

    The log-likelihood is concave in the similarity; its maximum is found by golden-section search.
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = M - more - less
    total = np.maximum(na + nb, 1)
    u, v = na / total, nb / total
    hi = np.where((u > 0) & (v > 0), np.minimum(u / np.maximum(v, 1e-300), v / np.maximum(u, 1e-300)), 0.0)
    lo = np.zeros_like(hi)

    def value(j: np.ndarray) -> np.ndarray:
        p = -np.log1p(-np.maximum(u - v * j, 0) * (BASE - 1) / BASE) / np.log(BASE)
        r = -np.log1p(-np.maximum(v - u * j, 0) * (BASE - 1) / BASE) / np.log(BASE)
        safe = lambda x: np.log(np.maximum(x, 1e-12))
        return more * safe(p) + less * safe(r) + same * safe(1 - p - r)

    g = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        left = value(c) > value(d)
        hi, lo = np.where(left, d, hi), np.where(left, lo, c)
    return (lo + hi) / 2
