"""Near-duplicate detection: SetSketch registers, banded; likelihood estimate; exact verification.

Plan, in order:

1. Every whole text becomes its set of 5-word shingles (64-bit hashes); per row only the set's size, a 128-bit digest,
   M 16-bit registers and a parity sketch leave the task.
2. Rows of equal sets form a class. All later steps see one row per class, so exact copies cost nothing more.
3. Registers are cut into BANDS bands of ROWS registers; classes that agree in a band share a bucket. At a similarity of
   0.75 a pair misses all buckets with probability (1 - 0.75**4)**40 = 2.5e-7.
4. Star rounds: each class against one class of each of its buckets, a row per class and bucket. Verified links form components. In
   the first round all buckets take part; in each further one, with other centres, those that hold several components and
   more than LARGE classes, as long as there are any and a round joins some of them.
5. Cross round: in buckets that still hold several components, the classes outside a bucket's largest component meet each other and
   those inside, in blocks; emitted are only pairs that may be linked by size, parity bound and likelihood estimate, from the pair's
   first bucket only, a few thousand at a time. Verified links join the components. No bucket is capped.

The parity sketch of a set has at least two bits for each element; a bit is the parity of the elements hashed to it. Two
sketches differ in at most as many bits as the sets differ in elements, so the filter loses no link. Pairs that the cross round would emit
are held against sketches of sixteen bits an element first, in which hardly two elements meet: nearly all that still pass are links,
so what a bucket emits follows its links and not its pairs.
The estimate's standard error is 0.034; pairs below SURE (0.2 under the threshold) are not verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import bound_batches, join_hot, raw, text_batches, words_of
from lexmill.llm.components import components
from lexmill.llm.setsketch import M, jaccard, sketch
from lexmill.llm.shingles import WordHashes, intersection_size, shingle_sets
from lexmill.session import Scratch

BANDS, ROWS = 40, 4
#: Classes of a bucket that one task compares with as many others at a time.
BLOCK = 2048
#: Classes of a bucket beyond which a further star round comes before comparing in blocks.
LARGE = 16 * 2048
#: Candidate pairs that are estimated and emitted at a time.
STEP = 20_000
#: Bytes of the table of candidates (class digest and least id, see CANDIDATE_BYTES) that may be broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
CANDIDATE_BYTES = 80
SURE = 0.20


#: Bits for each element of the parity sketches: of all classes, and of those that share a bucket.
COARSE, FINE = 2, 16


def parity(hashes: np.ndarray, each: int = COARSE) -> np.ndarray:
    """Parity sketch: 2**k bits, at least 64 and at least ``each`` for each element, as uint64 words."""
    bits = 64
    while bits < each * len(hashes):
        bits *= 2
    odd = np.bincount(((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(words: np.ndarray) -> np.ndarray:
    """Half as long; the top hash bits choose a position, so neighbouring bits fold together."""
    bits = np.unpackbits(words.view(np.uint8), bitorder="little").reshape(-1, 2).sum(axis=1) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


SIGNATURE = "doc_id {id}, n_shingles bigint, node binary, regs binary, odd binary"


def _digests(sets: list[np.ndarray]) -> list[bytes | None]:
    return [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """One row per document: set size, set digest, registers and parity sketch (all null but the size for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            start = 0
            for texts in text_batches(batch.column(1)):
                sets = shingle_sets(texts, cache, width)
                regs = [r.tobytes() if len(s) else None for r, s in zip(sketch(sets), sets)]
                odd = [parity(s).tobytes() if len(s) else None for s in sets]
                columns = [batch.column(0).slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.binary()) for x in (_digests(sets), regs, odd))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "regs", "odd"])
                start += len(texts)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SIGNATURE.format(id=rows.schema["doc_id"].dataType.simpleString()))


def _registers(column: pa.Array) -> np.ndarray:
    data, at = raw(column)
    return data[at[0] : at[-1]].view(np.uint16).reshape(-1, M)


def _pairs(batch: pa.RecordBatch, ok: np.ndarray) -> pa.RecordBatch:
    return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _similar(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of (a, b): those that may be linked by size, parity bound and estimate."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"), F.col("odd").alias(f"o{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b", "na", "nb", "ra", "rb", "oa", "ob")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            ok = jaccard(_registers(batch.column("ra")), _registers(batch.column("rb")), na, nb) >= percent / 100 - SURE
            left, right = words_of(batch.column("oa")), words_of(batch.column("ob"))
            for i in np.flatnonzero(ok):
                x, y = left[i], right[i]
                while len(x) > len(y):
                    x = _folded(x)
                while len(y) > len(x):
                    y = _folded(y)
                ok[i] = (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * int(na[i] + nb[i])
            yield _pairs(batch, ok)

    return both.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b): those whose full sets have 100 * intersection >= percent * union."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (p, q) in enumerate(zip(words_of(batch.column("ha")), words_of(batch.column("hb")))):
                common = intersection_size(p, q)
                ok[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield _pairs(batch, ok)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb").mapInArrow(run, "a binary, b binary")


class _Part:
    """The rows of one part: a block of classes that meet each other, or two blocks that meet."""

    def __init__(self, rows: pa.RecordBatch, percent: int):
        self.rows, self.percent, self.band = rows, percent, rows.column("band")[0].as_py()
        self.n = rows.column("n_shingles").to_numpy(zero_copy_only=False)
        self.label = rows.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.left = rows.column("left").to_numpy(zero_copy_only=False).astype(bool)
        self.regs, self.odd, self.fine = _registers(rows.column("regs")), words_of(rows.column("odd")), words_of(rows.column("fine"))

    def _near(self, p: np.ndarray) -> np.ndarray:
        """Which of some pairs their fine sketches allow: pairs of one size of sketch side by side."""
        size = np.array([[len(self.fine[i]), len(self.fine[j])] for i, j in p]).reshape(-1, 2)
        ok = np.zeros(len(p), bool)
        for a, b in np.unique(size, axis=0):
            at = np.flatnonzero((size == (a, b)).all(axis=1))
            for k in range(0, len(at), step := max(1, 1_000_000 // int(max(a, b)))):
                some = at[k : k + step]
                sides = [[self.fine[i] for i in p[some, c]] for c in (0, 1)]
                for c, (mine, other) in enumerate(((a, b), (b, a))):
                    while mine > other:
                        sides[c], mine = [_folded(x) for x in sides[c]], mine // 2
                differ = np.bitwise_count(np.stack(sides[0]) ^ np.stack(sides[1])).sum(axis=1, dtype=np.int64)
                ok[some] = (100 + self.percent) * differ <= (100 - self.percent) * (self.n[p[some, 0]] + self.n[p[some, 1]])
        return ok

    def candidates(self) -> Iterator[np.ndarray]:
        """Pairs of rows of different labels that size and parity bound allow, some at a time."""
        n, label, left, alone = self.n, self.label, self.left, self.left.all()
        size = np.array([len(x) for x in self.odd])
        for s in np.unique(size):
            at = np.flatnonzero((size == s) | (size == 2 * s))
            words = np.stack([self.odd[i] if size[i] == s else _folded(self.odd[i]) for i in at])
            step = max(1, 1_000_000 // max(1, words.size))
            for k in range(0, len(at), step):
                i = at[k : k + step]
                differ = np.bitwise_count(words[k : k + step, None, :] ^ words[None, :, :]).sum(axis=2, dtype=np.int64)
                ok = (100 + self.percent) * differ <= (100 - self.percent) * (n[i][:, None] + n[at][None, :])
                ok &= (label[i][:, None] != label[at][None, :]) & ((size[i][:, None] == s) | (size[at][None, :] == s))
                ok &= 100 * np.minimum(n[i][:, None], n[at][None, :]) >= self.percent * np.maximum(n[i][:, None], n[at][None, :])
                ok &= (i[:, None] < at[None, :]) if alone else (left[i][:, None] & ~left[at][None, :])
                x, y = np.nonzero(ok)
                for z in range(0, len(x), STEP):
                    yield np.stack([i[x[z : z + STEP]], at[y[z : z + STEP]]], axis=1)

    def found(self) -> Iterator[pa.RecordBatch]:
        for p in self.candidates():
            a, b = self.regs[p[:, 0]], self.regs[p[:, 1]]
            agree = (a[:, : BANDS * ROWS] == b[:, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(axis=2)
            p = p[(agree.argmax(axis=1) == self.band) & (jaccard(a, b, self.n[p[:, 0]], self.n[p[:, 1]]) >= self.percent / 100 - SURE)]
            p = p[self._near(p)] if len(p) else p
            if len(p):
                node, label = self.rows.column("node"), self.rows.column("label")
                yield pa.RecordBatch.from_arrays([c.take(pa.array(p[:, k])) for c in (node, label) for k in (0, 1)], ["a", "b", "la", "lb"])


def _cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """From rows (bucket, band, part, left, node, label, n_shingles, regs, odd, fine), sorted by bucket and part, the pairs of
    different labels that may be linked. Left rows of a part meet its other rows, or each other if all are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held.clear()
                yield from _Part(whole, percent).found()

        for batch in (b for b in batches if b.num_rows):
            keys = list(zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if keys[start] != key:
                    yield from close()
                    key = keys[start]
                held.append(batch.slice(start, end - start))
        yield from close()

    return members.mapInArrow(run, "a binary, b binary, la binary, lb binary")


def _relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(node, label) after links (la, lb) between labels."""
    joined = components(found, "la", "lb").select(F.col("node").alias("label"), F.col("label").alias("top"))
    return labels.join(joined, "label", "left").select("node", F.coalesce("top", "label").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least id reachable over links, itself included), kept.

    Links: ``100 * intersection >= percent * union`` of shingle sets. Null, empty and word-free texts have an empty set, no
    links, and stay. Repeated rows get equal results; rows of a repeated id with other texts are classed by their texts.
    A null id is never a component's id unless the component has no other. Other columns are not read. An empty table gives
    an empty one. A text of any length is one row of one batch.
    """
    bound_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(signatures(docs, id_col, text_col, width), "signatures")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"), F.first("odd").alias("odd"))
    nodes = scratch.write(nodes, "classes")
    bands = nodes.select("node", F.posexplode(F.array(*[F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS) for i in range(BANDS)])).alias("band", "value"))
    bands = bands.select(F.xxhash64("band", "value").alias("bucket"), "band", "node")
    shared = bands.groupBy("bucket").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    shared = scratch.write(shared.select("bucket", "first"), "shared")
    # both sides are shuffled as they are, so adaptive execution can split a frequent bucket
    members = scratch.write(bands.join(shared.select("bucket", "first"), "bucket"), "buckets")

    ids = members.select("node").distinct().join(nodes.select("node", "least_id"), "node")
    ids = scratch.write(ids, "candidates")
    placed = F.broadcast(ids) if ids.count() * CANDIDATE_BYTES <= BROADCAST_BYTES else ids

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            start = 0
            for texts in text_batches(batch.column(0)):
                sets, node = shingle_sets(texts, cache, width), batch.column(1).slice(start, len(texts)).to_pylist()
                start += len(texts)
                right = [i for i, d in enumerate(_digests(sets)) if d == node[i]]
                columns = ([node[i] for i in right], [sets[i].tobytes() for i in right], [parity(sets[i], FINE).tobytes() for i in right])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["node", "hashes", "fine"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    sets = texts.join(placed, F.col("doc_id").eqNullSafe(F.col("least_id"))).select("text", "node").mapInArrow(full, "node binary, hashes binary, fine binary").dropDuplicates(["node"])
    sets = scratch.write(sets, "sets")

    star = members.where("first < node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    linked = components(_verified(_similar(star, nodes, percent), sets, percent))
    labels = ids.select("node").join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    labels = scratch.write(labels, "labels")

    def mixed_buckets(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their labels; and (bucket, n, top, most) of the buckets with several: rows, largest label, rows of that one."""
        labelled = members.select("bucket", "band", "node").join(labels, "node")
        by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("k"))
        mixed = by_label.groupBy("bucket").agg(F.sum("k").alias("n"), F.max_by("label", F.struct("k", "label")).alias("top"), F.max("k").alias("most")).where("n > most")
        return labelled, scratch.write(mixed, "mixed")

    labelled, mixed = mixed_buckets(labels)
    turn = 0
    while True:
        large = mixed.where(F.col("n") > LARGE)
        size = large.agg(F.count("*"), F.sum("n")).first()
        if not size[0]:
            break
        turn += 1
        mine = labelled.join(large.select("bucket"), "bucket")
        centre = mine.groupBy("bucket").agg(F.min_by(F.struct("node", "label"), F.xxhash64(F.lit(turn), "node")).alias("c"), F.count("*").alias("n"))
        pairs = join_hot(mine, centre, "bucket", size[1]).where(F.col("label") != F.col("c.label")).select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.label").alias("la"), F.col("label").alias("lb"))
        pairs = scratch.write(pairs.distinct(), "star")
        found = scratch.write(_verified(_similar(pairs.select("a", "b"), nodes, percent), sets, percent).join(pairs, ["a", "b"]).select("la", "lb").distinct(), "links")
        done = not found.take(1)
        old_labels, old_mixed = labels, mixed
        if not done:
            labels = scratch.write(_relabelled(labels, found), "labels")
            labelled, mixed = mixed_buckets(labels)
            scratch.drop(old_labels, old_mixed)
        scratch.drop(pairs, found)
        if done:
            break

    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parted = mixed.select("bucket", "n", "top", blocks(F.col("most")).alias("tops"), blocks(F.col("n") - F.col("most")).alias("rest"))
    inside = F.col("label") == F.col("top")
    pair = lambda i, j: F.concat_ws("-", i.cast("string"), j.cast("string"))
    others = F.sequence(F.lit(0), F.col("rest") - 1)
    at = F.pmod(F.xxhash64("node"), F.when(inside, F.col("tops")).otherwise(F.col("rest"))).cast("int")
    to_others = F.transform(others, lambda o: F.struct(F.concat(F.lit("t"), pair(F.col("own"), o)).alias("part"), F.lit(True).alias("left")))
    to_tops = F.transform(F.sequence(F.lit(0), F.col("tops") - 1), lambda t: F.struct(F.concat(F.lit("t"), pair(t, F.col("own"))).alias("part"), F.lit(False).alias("left")))
    among = F.transform(others, lambda o: F.struct(pair(F.least(o, F.col("own")), F.greatest(o, F.col("own"))).alias("part"), (F.col("own") <= o).alias("left")))
    parts = (
        labelled.join(parted.drop("n"), "bucket")
        .withColumn("own", at)
        .select("bucket", "band", "node", "label", F.inline(F.when(F.col("label") == F.col("top"), to_others).otherwise(F.concat(to_tops, among))))
    )
    sketches = nodes.select("node", "n_shingles", "regs", "odd").join(sets.select("node", "fine"), "node")
    whole = parts.join(sketches, "node").repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    cross = scratch.write(_cross_pairs(whole, percent), "pairs")
    found = scratch.write(_verified(cross.select("a", "b"), sets, percent).join(cross, ["a", "b"]).select("la", "lb").distinct(), "links")
    classes = nodes.select("node", "least_id").join(_relabelled(labels, found), "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("top"))
    scratch.drop(members, shared, ids, sets, mixed, cross)

    tops = classes.groupBy("top").agg(F.min("least_id").alias("component"))
    classes = classes.join(tops, "top").select("node", "component")
    out = rows.select("doc_id", "n_shingles", "node").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
