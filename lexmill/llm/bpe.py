"""Byte-level BPE over whole texts: encoding with byte offsets, and decoding.

Texts are pre-tokenised in batches (see ``pretokens``); the distinct slices of a batch are merged side by side in arrays, and
their ids kept in a bounded cache.
Ranks are read on the driver from a file in the tiktoken format whose path is a parameter, and broadcast: a vocabulary's
size is fixed and does not grow with the data.
"""

from __future__ import annotations

import base64
import functools
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

from lexmill.llm.batches import bound_batches, release, text_batches
from lexmill.llm.pretokens import token_starts


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


#: Slices of up to these many bytes are merged side by side, in arrays of that width; longer ones one by one, with a heap.
WIDTHS = (8, 16, 32, 64)
_NONE = np.iinfo(np.int32).max


class Merges:
    """What two neighbouring ids merge to: an entry for each way of cutting a token into two tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        made = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(made), np.int64)
        self.ids = np.array([made[k] for k in self.keys.tolist()], np.int32)
        self.keys, self.ids = np.append(self.keys, np.iinfo(np.int64).max), np.append(self.ids, np.int32(_NONE))
        self.bytes = self.of(np.repeat(self.byte, 256), np.tile(self.byte, 256))

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, _NONE where there is none; an id of -1 merges with nothing."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ids[at], np.int32(_NONE))

    def merge(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """A token stays as it is, in other slices again and again the leftmost pair of least rank is merged. Gives an order
        of the slices, the ids of all in that order, and how many ids each has."""
        whole = [self.ranks.get(p) for p in pieces]
        order = [i for i, r in enumerate(whole) if r is not None]
        rest = [i for i, r in enumerate(whole) if r is None]
        ids, sizes = [np.array([whole[i] for i in order], np.int32)], [np.ones(len(order), np.int64)]
        length = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
        low = 0
        for width in WIDTHS:
            some = [rest[k] for k in np.flatnonzero((length > low) & (length <= width)).tolist()]
            if some:
                order += some
                flat, size = self._side_by_side([pieces[i] for i in some], width)
                ids.append(flat)
                sizes.append(size)
            low = width
        for k in np.flatnonzero(length > low).tolist():
            order.append(rest[k])
            ids.append(np.array(_heap(pieces[rest[k]], self.ranks), np.int32))
            sizes.append(np.array([len(ids[-1])]))
        return order, np.concatenate(ids), np.concatenate(sizes)

    def _side_by_side(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """One merge in every slice at a time. A part is known by the column in which it begins; the last column is always
        empty (-1), so it stands for what is left of the first part, too."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        column = np.arange(width + 1, dtype=np.int16)
        ids, rank = np.full((n, width + 1), -1, np.int32), np.full((n, width + 1), _NONE, np.int32)
        ids[:, :-1] = np.where(column[:-1] < size[:, None], self.byte[raw], -1)
        rank[:, :-2] = np.where(column[1:-1] < size[:, None], self.bytes[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]], _NONE)
        left, right = np.tile(column - 1, (n, 1)), np.tile(column + 1, (n, 1))
        row = np.arange(n)
        while len(row):
            at = rank[row].argmin(1)
            best = rank[row, at]
            on = best != _NONE
            row, at, best = row[on], at[on], best[on]
            gone = right[row, at]
            after = right[row, gone]
            before = left[row, at]
            ids[row, at], ids[row, gone] = best, -1
            right[row, at], left[row, after] = after, at
            rank[row, gone] = _NONE
            rank[row, at] = self.of(best, ids[row, after])
            rank[row, before] = self.of(ids[row, before], best)
        kept = ids >= 0
        return ids[kept], kept.sum(1)


def _heap(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long slice, in n log n."""
    ends = list(range(1, len(piece) + 1))  # end of the part that begins here; 0: no part begins here
    before = list(range(-1, len(piece)))
    heap = []

    def offer(i: int) -> None:
        if (j := ends[i]) < len(piece) and (rank := ranks.get(piece[i : ends[j]])) is not None:
            heapq.heappush(heap, (rank, i, ends[j]))

    for i in range(len(piece) - 1):
        offer(i)
    while heap:
        rank, i, end = heapq.heappop(heap)
        if not ends[i] or ends[i] >= end or ends[ends[i]] != end:
            continue  # one of the two parts has changed since
        ends[ends[i]], ends[i] = 0, end
        if end < len(piece):
            before[end] = i
            offer(i)
        if (left := before[i]) >= 0:
            offer(left)
    out, i = [], 0
    while i < len(piece):
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


@functools.lru_cache(1)
def _factors() -> np.ndarray:
    return np.random.default_rng(3).integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)


def slice_hashes(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices of code points that begin at ``starts``, one after the other."""
    place = np.arange(len(points), dtype=np.int64) - np.repeat(starts, sizes)
    mixed = (points + np.uint64(0x9E3779B97F4A7C15)) * _factors()[place & 1023]
    if int(sizes.max()) > 1024:
        mixed += (place >> 10).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    out = np.add.reduceat(mixed, starts) + sizes.astype(np.uint64)
    return out ^ (out >> np.uint64(29))


class Encoder:
    """Ids of slices, merged together for many slices and remembered by 64-bit hashes of the slices, in arrays; emptied before it would
    hold more than ``bound`` slices, or sixteen times as many ids."""

    bound = 500_000
    #: Code points whose slices are looked up at a time.
    many = 1 << 20

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self._clear()

    def _clear(self) -> None:
        self.known, self.number = np.empty(0, np.uint64), np.empty(0, np.int32)  # hashes in order, and their slices' numbers
        self.flat, self.begin, self.size = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ascending hashes are among the known ones, and whether they are."""
        at = np.searchsorted(self.known, keys)
        there = np.zeros(len(keys), bool)
        inside = at < len(self.known)
        there[inside] = self.known[at[inside]] == keys[inside]
        return at, there

    def _learn(self, keys: np.ndarray, pieces: list[bytes], at: np.ndarray) -> None:
        """Merge slices that aren't known; ``at``: where their hashes belong."""
        order, ids, size = self.merges.merge(pieces)
        number = np.empty(len(pieces), np.int32)
        number[order] = np.arange(len(self.begin), len(self.begin) + len(pieces))
        self.known, self.number = np.insert(self.known, at, keys), np.insert(self.number, at, number)
        self.begin = np.concatenate([self.begin, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.flat = np.concatenate([self.flat, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has. Null is like an empty text."""
        texts = [t or "" for t in texts]
        length = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(length)
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = token_starts(points, (ends - length)[length > 0])
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        sizes = np.diff(np.append(starts, len(points)))
        ids, counts, low = [], [], 0
        while low < len(starts):  # a long text by groups of its slices
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + self.many)))
            flat, n_ids = self._ids(whole, points[starts[low] : starts[high - 1] + sizes[high - 1]], starts[low:high], sizes[low:high])
            ids.append(flat)
            counts.append(n_ids)
            low = high
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), np.diff(total[np.searchsorted(starts, np.concatenate([[0], ends]))])

    def _ids(self, whole: str, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of successive slices, one after the other, and how many each has."""
        keys, first, which = np.unique(slice_hashes(points, starts - starts[0], sizes), return_index=True, return_inverse=True)
        at, there = self._find(keys)
        if not there.all():
            if len(self.known) + len(keys) > self.bound or len(self.flat) > 16 * self.bound:
                self._clear()
                at, there = self._find(keys)
            new = np.flatnonzero(~there)
            begin, size = starts[first[new]].tolist(), sizes[first[new]].tolist()
            self._learn(keys[new], [whole[i : i + n].encode("utf-8", "surrogatepass") for i, n in zip(begin, size)], at[new])
            at, _ = self._find(keys)
        number = self.number[at][which]
        n_ids = self.size[number].astype(np.int64)
        end = np.cumsum(n_ids)
        return self.flat[np.repeat(self.begin[number] - end + n_ids, n_ids) + np.arange(end[-1])], n_ids


_loaded: dict[str, object] = {}


def _once(key: str, make):
    """What a Python worker builds once for a broadcast value."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def _token_table(ranks: dict[bytes, int]) -> pa.Array:
    """Token bytes in the order of their ids; null for ids that are not given."""
    out = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return pa.array(out, pa.binary())


class Tokenizer:
    """Column functions over a vocabulary: ``encode`` gives the ids, ``offsets`` where each id's bytes begin in the UTF-8
    text, ``decode`` the bytes of ids."""

    def __init__(self, spark: SparkSession, path: str):
        bound_batches(spark)
        self.ranks: Broadcast = spark.sparkContext.broadcast(load_ranks(path))
        self.key = path

    def encode(self, text: Column) -> Column:
        """array<int>; empty for a null or empty text."""
        ranks, key = self.ranks, self.key

        @arrow_udf("array<int>")
        def ids(column: pa.Array) -> pa.Array:
            encoder = _once(key + "#encode", lambda: Encoder(ranks.value))
            flat, counts = [], [np.zeros(1, np.int64)]
            for group in text_batches(column):
                some, many = encoder.encode(group)
                flat.append(some)
                counts.append(many)
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(values, pa.int32()))

        return ids(text)

    def decode(self, ids: Column) -> Column:
        """binary; null ids give null."""
        ranks, key = self.ranks, self.key

        @arrow_udf("binary")
        def text(column: pa.Array) -> pa.Array:
            release()
            table = _once(key + "#decode", lambda: _token_table(ranks.value))
            tokens = table.take(column.flatten())  # its data are the bytes of all rows, one after the other
            if tokens.null_count:
                raise ValueError("an id that the vocabulary does not have")
            size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            token_at = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1, tokens.offset * 4) if len(tokens) else np.zeros(1, np.int32)
            at = np.ascontiguousarray(token_at[np.concatenate([[0], np.cumsum(size)])])
            rows = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(at), tokens.buffers()[2]])
            return pc.if_else(column.is_valid(), rows, pa.scalar(None, pa.binary())) if column.null_count else rows

        return text(ids)

    def offsets(self, ids: Column) -> Column:
        """array<int>: the byte at which each id's token begins in the encoded text; with it a span of ids maps to bytes."""
        ranks, key = self.ranks, self.key

        @arrow_udf("array<int>")
        def begins(column: pa.Array) -> pa.Array:
            size = _once(key + "#size", lambda: _token_sizes(ranks.value))
            count = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size[column.flatten().to_numpy(zero_copy_only=False)]) if count.sum() else np.empty(0, np.int64)
            begin = np.concatenate([[0], ends])
            at = np.concatenate([[0], np.cumsum(count)])
            flat = begin[:-1] - np.repeat(begin[at[:-1]], count)
            rows = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
            return pc.if_else(column.is_valid(), rows, pa.scalar(None, rows.type)) if column.null_count else rows

        return begins(ids)


def _token_sizes(ranks: dict[bytes, int]) -> np.ndarray:
    """Bytes of each id's token."""
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        out[i] = len(token)
    return out
