"""Pre-tokenisation without regular expressions, for the pattern of byte-level BPE vocabularies.

The pattern splits off contractions, runs of letters, of numbers and of other characters, each with one leading space,
and white space. It is recognised by a small automaton: every code point gets a symbol from its class and its right
neighbours; a transition maps the state before a code point to the state after it. Transitions compose associatively, so a
batch is cut into equal blocks whose composed transition functions are built side by side, the blocks' entry states follow
from a scan over these functions, and a second sweep marks where tokens start.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Code points with the property White_Space.
SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE = range(4)
# Symbols: the four classes (SPACE: followed by white space or the end), then white space before something else (the space
# character; any other), then an apostrophe that starts a contraction of one or of two letters.
JOIN, LAST, SHORT, LONG = 4, 5, 6, 7
# States after a code point: in a run of a class; a space that joins what follows; within a contraction with one or two
# letters to come; a finished token.
PENDING, ONE, TWO, DONE = 4, 5, 6, 7
STATES = 8


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and start[symbol, state]; symbols from 8 on are those of a text's first code point."""
    to, start = np.zeros((16, STATES), np.uint8), np.ones((16, STATES), bool)
    for symbol in range(8):
        for state in range(STATES):
            if state in (ONE, TWO):
                to[symbol, state], start[symbol, state] = (DONE if state == ONE else ONE), False
                continue
            same = OTHER if symbol in (SHORT, LONG) else symbol
            joins = symbol not in (JOIN, LAST) and (state == same or (state == PENDING and same != SPACE))
            start[symbol, state] = not joins
            to[symbol, state] = {JOIN: PENDING, LAST: DONE, SHORT: OTHER if joins else ONE, LONG: OTHER if joins else TWO}.get(symbol, same)
        to[symbol + 8] = to[symbol, DONE]
    return to, start


_NEXT, _START = _transitions()


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[:] = kinds
    table[SPACES] = SPACE
    return table


def _symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 3, bool)
    first[starts] = True
    first[n:] = True
    after = np.concatenate([points, np.zeros(3, points.dtype)])
    symbol = kind.copy()
    follows = np.concatenate([kind[1:], [SPACE]]) != SPACE
    last = (kind == SPACE) & follows & ~first[1 : n + 1]
    symbol[last] = np.where(points[last] == 32, JOIN, LAST)
    quote = np.flatnonzero((points == 39) & ~first[1 : n + 1])
    c1, c2, two = after[quote + 1], after[quote + 2], ~first[quote + 2]
    is_ = lambda c, letters: np.isin(c, [ord(x) for x in letters])
    symbol[quote[is_(c1, "stmd")]] = SHORT
    symbol[quote[two & ((is_(c1, "rv") & is_(c2, "e")) | (is_(c1, "l") & is_(c2, "l")))]] = LONG
    symbol[starts] += 8
    return symbol


def token_starts(points: np.ndarray, starts: np.ndarray, block: int = 256) -> np.ndarray:
    """Positions at which tokens start. points: code points of many texts, one after the other; starts: where each
    (non-empty) text begins."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    symbol = _symbols(points, starts)
    wide = -(-n // block)
    lanes = np.zeros(wide * block, np.uint8)
    lanes[:n] = symbol
    lanes = np.ascontiguousarray(lanes.reshape(wide, block).T)
    to = _NEXT.ravel()
    functions = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], wide, axis=1)
    for k in range(block):  # composes the functions of all blocks side by side; most soon map all states to one
        if k % 8 == 4 and len(functions) > 1 and (functions == functions[0]).all():
            functions = functions[:1]
        functions = to[lanes[k] * np.uint8(STATES) + functions]
    entry = np.empty(wide, np.uint8)
    composed, state = np.broadcast_to(functions, (STATES, wide)).T.tolist(), DONE
    for i in range(wide):
        entry[i] = state
        state = composed[i][state]
    begins, marks = _START.ravel(), np.empty((block, wide), bool)
    for k in range(block):
        at = lanes[k] * np.uint8(STATES) + entry
        marks[k], entry = begins[at], to[at]
    return np.flatnonzero(marks.T.ravel()[:n])
