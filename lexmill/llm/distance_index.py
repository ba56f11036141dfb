"""Exact inner-product search by one-dimensional distance keys.

A vector x becomes (x, sqrt(R**2 - |x|**2)), R the largest norm; then the Euclidean distance to a query (q, 0) falls as the
inner product grows. Every augmented vector belongs to its nearest pivot, and its key is (pivot, distance to it): rows are stored
sorted by that key, in shards of at most SHARD_ROWS. By the triangle inequality a vector within ``r`` of a query has a key within
``r`` of the query's own distance to the pivot, so a search scans key intervals that widen round by round, each row once, until the
k-th best found lies within the radius: nothing outside can beat it.

Queries are a table too. A round joins chunks of open queries to the shards that their key intervals touch; both are bounded,
so a common vector, or a query set that grows with the table, is spread over many tasks. Only pivots (fitted on a bounded sample) and
two radii come from the driver.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.batches import bound_batches
from lexmill.session import Scratch

#: Pivots, and rows of the sample that they are fitted on.
PIVOTS, SAMPLE = 32, 2_000
SHARD_ROWS, CHUNK_ROWS = 16_384, 1_024
#: Vectors of a chunk that meet a shard at a time.
SLICE = 128
#: Rows of the table of shard bounds (some 40 bytes each) that may be broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def integers(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of every component as a double; null for a null vector and where a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def matrix(column: pa.Array, dims: int = 0) -> np.ndarray:
    """Rows of integers; shorter vectors are filled with zeros, which change no inner product."""
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = np.diff(ends)
    dims = max(dims, int(width.max(initial=0)))
    if (width == dims).all():
        return flat.reshape(len(width), dims).astype(np.int64)
    out = np.zeros((len(width), dims), np.int64)
    for i in range(len(width)):
        out[i, : width[i]] = flat[ends[i] : ends[i + 1]]
    return out


def _packed(m: np.ndarray) -> np.ndarray:
    small = m.size == 0 or (m.min() >= -(1 << 31) and m.max() < 1 << 31)
    return m.astype(np.int32) if small else m


@dataclass
class Geometry:
    """Pivots in the augmented space and the largest norm."""

    pivots: np.ndarray
    radius: float

    @property
    def dims(self) -> int:
        return self.pivots.shape[1] - 1

    @property
    def slack(self) -> float:
        """More than what rounding adds to a distance."""
        return 1e-6 * (1.0 + self.radius)

    def rows(self, m: np.ndarray) -> np.ndarray:
        """Distance of every augmented row to every pivot."""
        x = m.astype(np.float64)
        rest = np.sqrt(np.maximum(self.radius**2 - (x * x).sum(axis=1), 0.0))
        return self._to(np.concatenate([x, rest[:, None]], axis=1))

    def queries(self, m: np.ndarray) -> np.ndarray:
        return self._to(np.concatenate([m.astype(np.float64), np.zeros((len(m), 1))], axis=1))

    def _to(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.pivots], axis=1) if len(x) else np.zeros((0, len(self.pivots)))

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Inner products as int64, exact: in doubles as long as no partial sum leaves their integers."""
        if self.radius**2 < 1 << 52:
            return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T


def _fit(sample: np.ndarray, radius: float, pivots: int, seed: int = 11) -> tuple[np.ndarray, float, float]:
    """Pivots by k-means over the augmented sample; how far a row's fifth neighbour in it lies; the spread of distances."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float64)
    x = np.concatenate([x, np.sqrt(np.maximum(radius**2 - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)
    centres = x[rng.choice(len(x), min(pivots, len(x)), replace=False)]
    for _ in range(8):
        own = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) if x.size < 1 << 20 else np.array([((centres - r) ** 2).sum(axis=1).argmin() for r in x])
        centres = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c for j, c in enumerate(centres)])
    asked = sample[:256].astype(np.float64)
    apart = np.sqrt(np.maximum((asked * asked).sum(axis=1)[:, None] + radius**2 - 2 * asked @ sample.astype(np.float64).T, 0.0))
    near = np.partition(apart, min(5, apart.shape[1] - 1), axis=1)[:, min(5, apart.shape[1] - 1)]
    return centres, float(np.median(near)), float(apart.std())


class Index:
    """An index over (id bigint, label bigint, v array<bigint>); v has no null. Every row is indexed; the sample only places pivots."""

    def __init__(self, rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE):
        bound_batches(rows.sparkSession)
        self.scratch = scratch = Scratch(rows.sparkSession)
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        norm, dims, self.size = rows.agg(F.max(square), F.max(F.size("v")), F.count("*")).first()
        drawn = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()]
        drawn = matrix(pa.array(drawn, pa.list_(pa.int64())), dims or 0) if drawn else np.zeros((1, 0), np.int64)
        radius = math.sqrt(norm or 0.0)
        centres, self.first, self.step = _fit(drawn, radius, pivots)
        self.geometry = geometry = Geometry(centres, radius)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = geometry.rows(matrix(batch.column("v"), geometry.dims))
                own = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far[np.arange(len(own)), own], pa.float64())], [*batch.schema.names, "pivot", "key"])

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = 0
            for batch in batches:
                pivot = batch.column("pivot").to_numpy(zero_copy_only=False)
                ends = [*(np.flatnonzero(np.diff(pivot)) + 1).tolist(), len(pivot)]
                start = 0
                for end in ends:
                    for at in range(start, end, SHARD_ROWS):
                        part = batch.slice(at, min(SHARD_ROWS, end - at))
                        key = part.column("key").to_numpy(zero_copy_only=False)
                        data = pickle.dumps((part.column("id").to_numpy(zero_copy_only=False), part.column("label").to_numpy(zero_copy_only=False), key, _packed(matrix(part.column("v"), geometry.dims))), protocol=5)
                        row = [[(TaskContext.get().partitionId() << 32) + made], [int(pivot[at])], [key[0]], [key[-1]], [data]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary()))], ["shard", "pivot", "low", "high", "rows"])
                        made += 1
                    start = end

        rows = rows.select("id", "label", "v")
        stored = rows.mapInArrow(keyed, "id bigint, label bigint, v array<bigint>, pivot int, key double")
        stored = scratch.write(stored, "keyed")
        order = stored.repartitionByRange("pivot", "key", "id").sortWithinPartitions("pivot", "key", "id")
        self.shards = scratch.write(order.mapInArrow(shards, "shard bigint, pivot int, low double, high double, rows binary"), "shards")
        scratch.drop(stored)
        bounds = self.shards.select("shard", "pivot", "low", "high")
        self.bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds

    def _distance(self, score: Column) -> Column:
        """Of a query to a row of that score; null for a null score."""
        return F.when(score.isNotNull(), F.sqrt(F.greatest(F.col("square") + F.lit(self.geometry.radius**2) - 2 * score, F.lit(0.0))))

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """queries: id, slot int (with id the query's key), label, v, low, high (bounds of the score, null for none). The k rows of the best
        scores within the bounds, of the same label or of any other, the query's own id left out: id, slot, found_id, score, rank."""
        scratch, geometry = self.scratch, self.geometry
        bound_batches(queries.sparkSession)
        state = scratch.write(self._opened(queries), "queries")
        found = scratch.write(state.select("id", "slot", F.col("id").alias("found_id"), F.lit(0).cast("long").alias("score"), F.lit(1).alias("rank")).limit(0), "found")
        best = Window.partitionBy("id", "slot").orderBy(F.desc("score"), "found_id")
        while open_rows := state.count():
            chunks = self._chunks(state, open_rows)
            needs = chunks.select("chunk", F.inline("needs"))
            touched = needs.join(self.bounds, "pivot").where("high >= start AND low <= stop AND NOT (low >= past AND high <= until)").select("chunk", "shard")
            tiles = touched.join(chunks.select("chunk", "queries"), "chunk").join(self.shards.select("shard", "pivot", "rows"), "shard")
            hits = tiles.select("queries", "pivot", "rows").mapInArrow(_scanner(geometry, k, same), "id bigint, slot int, found_id bigint, score bigint")
            ranked = found.drop("rank").unionByName(hits).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            last, found = found, scratch.write(ranked, "found")
            kth = found.where(F.col("rank") == k).select("id", "slot", F.col("score").alias("kth"))
            ahead = state.join(kth, ["id", "slot"], "left").withColumns({"least": F.col("kth"), "reached": F.col("radius")}).drop("kth")
            certain = F.least("limit", F.coalesce(self._distance(F.col("least")), F.col("limit")))
            ahead = ahead.withColumn("certain", certain + F.lit(geometry.slack)).where("reached < certain")
            ahead = ahead.withColumn("radius", F.least("certain", F.greatest(2 * F.col("reached"), F.col("reached") + F.lit(self.step + geometry.slack)))).drop("certain")
            before, state = state, scratch.write(ahead, "queries")
            scratch.drop(last, before, chunks)
        return found

    def _opened(self, queries: DataFrame) -> DataFrame:
        """With distances to the pivots, the radius to begin with, the one beyond which no score is within the bounds, and the one
        within which none is."""
        geometry = self.geometry

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = matrix(batch.column("v"), geometry.dims)
                far = pa.array(list(geometry.queries(m)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, far, pa.array((m.astype(np.float64) ** 2).sum(axis=1))], [*batch.schema.names, "far", "square"])

        rows = queries.select("id", "slot", "label", "v", "low", "high").mapInArrow(run, "id bigint, slot int, label bigint, v array<bigint>, low bigint, high bigint, far array<double>, square double")
        limit = F.coalesce(self._distance(F.col("low")), F.sqrt("square") + F.lit(geometry.radius)) + F.lit(geometry.slack)
        inner = F.coalesce(self._distance(F.col("high")) - F.lit(geometry.slack), F.lit(0.0))
        rows = rows.withColumns({"limit": limit, "inner": inner})
        begin = F.when(F.col("high").isNull(), F.lit(self.first)).otherwise(F.col("inner") + F.lit(self.step)) + F.lit(geometry.slack)
        return rows.withColumns({"radius": F.least("limit", begin), "reached": F.lit(-1.0), "least": F.lit(None).cast("long")}).where("low IS NULL OR high IS NULL OR low <= high")

    def _chunks(self, state: DataFrame, count: int) -> DataFrame:
        """One row per chunk of queries with near keys: the queries, and the key intervals they need of each pivot."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = 0
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK_ROWS):
                    batch = whole.slice(at, CHUNK_ROWS)
                    number = lambda c, b=batch: b.column(c).to_numpy(zero_copy_only=False)
                    bound = lambda c, none, b=batch: b.column(c).fill_null(none).to_numpy(zero_copy_only=False)
                    far = np.array(batch.column("far").to_pylist(), np.float64)
                    radius, reached, inner = number("radius"), number("reached"), number("inner")
                    ids, first, of = np.unique(number("id"), return_index=True, return_inverse=True)
                    vectors = _packed(matrix(batch.column("v").take(pa.array(first))))
                    lowest = np.maximum(bound("low", -(1 << 62)), bound("least", -(1 << 62)))
                    data = pickle.dumps((number("id"), number("slot"), number("label"), lowest, bound("high", 1 << 62), far, radius, reached, of, vectors), protocol=5)
                    start = np.maximum(far - radius[:, None], inner[:, None] - far).min(axis=0)
                    stop = (far + radius[:, None]).max(axis=0)
                    done = (reached >= 0).all()  # keys between past and until are behind every query of the chunk
                    past, until = ((far - reached[:, None]).max(axis=0), (far + reached[:, None]).min(axis=0)) if done else (np.ones_like(start), np.zeros_like(start))
                    needs = [{"pivot": j, "start": a, "stop": b, "past": c, "until": d} for j, (a, b, c, d) in enumerate(zip(start.tolist(), stop.tolist(), past.tolist(), until.tolist()))]
                    kind = pa.list_(pa.struct([("pivot", pa.int32()), *((c, pa.float64()) for c in ("start", "stop", "past", "until"))]))
                    yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + made], pa.int64()), pa.array([needs], kind), pa.array([data], pa.binary())], ["chunk", "needs", "queries"])
                    made += 1

        nearest = F.array_position("far", F.array_min("far"))
        order = state.withColumn("home", nearest).withColumn("off", F.array_min("far"))
        order = order.repartitionByRange(max(1, math.ceil(count / CHUNK_ROWS)), "home", "off", "id", "slot").sortWithinPartitions("home", "off", "id", "slot")
        return self.scratch.write(order.mapInArrow(run, "chunk bigint, needs array<struct<pivot:int,start:double,stop:double,past:double,until:double>>, queries binary"), "chunks")


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties by id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        kept = np.flatnonzero(score >= cut)
        return kept[np.lexsort((ids[kept], -score[kept]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _scanner(geometry: Geometry, k: int, same: bool):
    """Scans (queries, pivot, rows): of each query the k best rows of the shard within bounds that the round's key interval adds."""

    def tile(queries: bytes, pivot: int, rows: bytes) -> list[tuple[np.ndarray, ...]]:
        id_, slot, label, low, high, far, radius, reached, of, vectors = pickle.loads(queries)
        ids, labels, keys, m = pickle.loads(rows)
        at = far[:, pivot]
        begin, end = np.searchsorted(keys, at - radius, "left"), np.searchsorted(keys, at + radius, "right")
        gone = reached >= 0
        skip, go_on = np.where(gone, np.searchsorted(keys, at - reached, "left"), begin), np.where(gone, np.searchsorted(keys, at + reached, "right"), begin)
        left = np.flatnonzero((end > begin) & ((skip > begin) | (end > go_on)))
        out = []
        for first in range(0, len(vectors), SLICE):
            asked = left[(of[left] >= first) & (of[left] < first + SLICE)]
            if not len(asked):
                continue
            a, b = int(begin[asked].min()), int(end[asked].max())
            scores = geometry.products(vectors[first : first + SLICE], m[a:b])
            for q in asked:
                s = scores[of[q] - first]
                near = labels[a:b] == label[q] if same else labels[a:b] != label[q]
                ok = near & (s >= low[q]) & (s <= high[q]) & (ids[a:b] != id_[q])
                ok[: begin[q] - a] = False
                ok[max(skip[q] - a, 0) : max(go_on[q] - a, 0)] = False
                ok[end[q] - a :] = False
                places = np.flatnonzero(ok)
                places = places[_top(s[places], ids[a:b][places], k)]
                if len(places):
                    out.append((np.full(len(places), id_[q]), np.full(len(places), slot[q]), ids[a:b][places], s[places]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if hits := tile(*(batch.column(c)[i].as_py() for c in ("queries", "pivot", "rows"))):
                    columns = [np.concatenate(c) for c in zip(*hits)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["id", "slot", "found_id", "score"])

    return run
