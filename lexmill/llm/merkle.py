"""Merkle manifest of a dataset: one root over all rows, a proof for each row.

Leaves are digests of rows; those of a group, in order, form a tree of ARITY children a node, and the groups' roots, in order of
the groups, another one above. Nodes of a tree are dealt to blocks of BLOCK consecutive ones, arrays of a fixed size that
collapse LEVELS levels with sequence, transform, slice and aggregate; the block roots are the nodes of the next round, so a tree of n
leaves takes log(n) / log(BLOCK) rounds, and no task holds more than a block. Everything is DataFrame functions.

Places in a group come from a range partitioning and the counts of its partitions, not from a window: a group of any size is
spread over many tasks. A leaf's path (the siblings left and right of it, level by level) is handed down from parent
blocks to child blocks, one row for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexmill.session import Scratch

ARITY, LEVELS = 3, 5
BLOCK = ARITY**LEVELS
#: Rows of the table of counts by partition and group that may be broadcast (some 100 bytes a row); beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(scratch: Scratch, nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with pos (from 0, in the group ``g``) and n (rows of the group). ``order`` tells any two rows apart that differ in digest."""
    spread = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    stored = scratch.write(spread.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "places")
    counts = stored.groupBy("part", "g").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "g", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy("g")).alias("n"))
    starts = scratch.write(starts, "starts")
    few = F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts
    return stored.join(few, ["part", "g"]).withColumn("pos", F.col("row") - F.col("first") + F.col("before")).drop("part", "row", "first", "before")


def _levels(digests: Column, height: Column) -> Column:
    """array<array<string>>: the block's nodes, then the nodes of each level above, ``height`` of them."""

    def above(levels: Column, _: Column) -> Column:
        runs = lambda last: F.transform(F.sequence(F.lit(0), F.floor((F.size(last) - 1) / ARITY)), lambda k: F.sha2(F.array_join(F.slice(last, (k * ARITY + 1).cast("int"), ARITY), ""), 256))
        return F.concat(levels, F.array(_let(F.element_at(levels, -1), runs)))

    return F.aggregate(F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), height), F.array(digests).cast("array<array<string>>"), above)


def _path(levels: Column, place: Column, height: Column) -> Column:
    """array<struct<left, right>>: the siblings of the node at ``place`` of the block, from the lowest level up."""
    powers = F.array(*[F.lit(ARITY**i) for i in range(LEVELS)])

    def siblings(i: Column) -> Column:
        def around(at: Column) -> Column:
            own = at % ARITY
            level = F.get(levels, i)
            left = F.array_join(F.slice(level, at - own + 1, own), "")
            right = F.array_join(F.slice(level, at + 2, F.lit(ARITY - 1) - own), "")
            return F.struct(left.alias("left"), right.alias("right"))

        return _let(F.floor(place / F.get(powers, i)).cast("int"), around)

    return F.transform(F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), height), siblings)


def _tree(scratch: Scratch, nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes: g, pos, n, digest and ``held`` (a struct that is passed through). Returns g, pos, digest, held and, as ``above`` gives them
    for the roots (g, digest) of all groups, path (from the node to the top), subroot and root."""
    block = F.floor(F.col("pos") / BLOCK)
    items = F.sort_array(F.collect_list(F.struct("pos", "digest", "held")))
    blocks = nodes.groupBy("g", block.alias("block")).agg(F.max("n").alias("n"), items.alias("items"))
    #: A group within one block ends where one node remains; blocks of a larger one collapse all levels.
    height = F.lit(0)
    for i in range(LEVELS):
        height = height + F.when(F.col("n") > ARITY**i, 1).otherwise(0)
    blocks = blocks.withColumn("height", height)
    levels = _levels(F.col("items.digest"), F.col("height"))
    blocks = scratch.write(blocks.withColumn("top", F.get(F.element_at(levels, -1), F.lit(0))), "blocks")
    roots = blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
    if (blocks.agg(F.max("n")).first()[0] or 0) <= BLOCK:
        upper = above(roots.select("g", "digest")).withColumn("pos", F.lit(0).cast("long"))
    else:
        upper = _tree(scratch, roots.withColumn("held", F.struct(F.lit(0).alias("none"))), above)
    upper = upper.select("g", F.col("pos").alias("block"), F.col("path").alias("rest"), "subroot", "root")

    def item(known: Column) -> Column:
        one = lambda x, k: F.struct(x["pos"].alias("pos"), x["digest"].alias("digest"), x["held"].alias("held"), F.concat(_path(known, k, F.col("height")), F.col("rest")).alias("path"))
        return F.transform("items", one)

    both = blocks.join(upper, ["g", "block"])
    return both.select("g", "subroot", "root", F.inline(_let(levels, item)))


def manifest(docs: DataFrame, leaf: Column, tampered: Column, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """Per row: doc_id, leaf, subroot (of its group), root, proof_sha256 (digest of all siblings from the leaf to the root, left to
    right), folded_root (from ``tampered``, where not null, else the leaf, and the siblings) and verified (whether it is the root).

    ``leaf`` and ``tampered`` are digests over the columns of ``docs``. Leaves of a group ascend by id, null first, those of one
    id by leaf; equal rows are leaves of their own. Groups ascend bytewise, null first. An empty table gives no row. A text is
    hashed where it is read and never moves; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    leaves = scratch.write(docs.select(group.alias("g"), F.col(id_col).alias("doc_id"), leaf.alias("leaf"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("twin")), "leaves")
    placed = _places(scratch, leaves, ["doc_id", "leaf", "twin"]).select("g", "pos", "n", F.col("leaf").alias("digest"), F.struct("doc_id", "tampered").alias("held"))

    def alone(roots: DataFrame) -> DataFrame:
        return roots.select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def over_groups(subroots: DataFrame) -> DataFrame:
        nodes = scratch.write(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "subroots")
        nodes = _places(scratch, nodes, ["name"]).select("g", "pos", "n", "digest", F.struct("name").alias("held"))
        return _tree(scratch, nodes, alone).select(F.col("held.name").alias("g"), "path", F.col("digest").alias("subroot"), "root")

    found = _tree(scratch, placed, over_groups)
    fold = F.aggregate("path", F.coalesce("held.tampered", "digest"), lambda node, s: digest(s["left"], node, s["right"]))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = found.select(F.col("held.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: What a leaf of ``documents`` is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_leaf(text: Column) -> Column:
    return digest(*[encoded(text if c == "text" else F.col(c)) for c in FIELDS])


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``; where 2 divides the CRC-32 of the decimal id, the tampered leaf lacks the text's line feeds.
    Rows without id are not tampered with."""
    without = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, document_leaf(F.replace("text", F.lit("\n"), F.lit(""))))
    return manifest(docs, document_leaf(F.col("text")), without)
