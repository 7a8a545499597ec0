"""Merkle manifest of a dataset: a digest for every row, a tree for every group, and a proof for every row.

The leaves of a group are its rows in key order.  While a level has several nodes, every `FAN` consecutive ones (a run; the last may be
shorter) have a parent: the digest of theirs in order.  What remains is the group's subroot; subroots in group order make one
more tree, whose end is the root.

Nodes are numbered by a range partitioning and the row counts of its parts, then cut into blocks of `FAN ** DEPTH` consecutive
nodes, which no run crosses.  Within a block, levels are columns: a node stands in the row of its first leaf, lag and lead by
one and two nodes' width supply its siblings, masked by its slot and by the length of its run, and the row of a first child
hashes the parent.  One shuffle by block makes `DEPTH` levels; the block's top nodes go on as the rows of the next round.  So the
largest window has `FAN ** DEPTH` rows, however large a group is.  Siblings come down the same way: the proof of a row is that inside
its block and that of the block's top node.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoquarry.plans.storage import settle

FAN, DEPTH = 3, 5
BLOCK = FAN**DEPTH
PATH = "array<struct<left:string,right:string>>"


def digest_of(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*fields: Column) -> Column:
    """Digest of the fields of a row: each `-` if null, else its length in UTF-8 bytes, a colon, and its text."""
    texts = [field.cast("string") for field in fields]
    return digest_of(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(path, leaf, lambda digest, s: digest_of(s["left"], digest, s["right"]))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf's to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def number(nodes: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, int]:
    """Add `pos`, from 0, in the order of each group, and `n`, the group's rows; and the largest `n`.

    Rows are sorted by range partitioning, so a group may fill many tasks; ties are broken by row, so copies may too.
    Positions follow from the row's place in its part and the counts of (group, part).
    """
    keys = [group, *order, "__row"]
    placed = nodes.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    placed = placed.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    placed = settle(placed, "numbered")
    counts = settle(placed.groupBy(group, "__part").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("rows")), "counts")
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        group, "__part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("__shift"),
        F.sum("rows").over(Window.partitionBy(group)).alias("n"),
    )
    largest = counts.groupBy(group).agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0] or 0
    numbered = placed.join(shifts, [group, "__part"]).withColumn("pos", F.col("__at") + F.col("__shift"))
    return numbered.drop("__at", "__part", "__shift"), largest


def _climbed(nodes: DataFrame, group: str) -> DataFrame:
    """Nodes (group, pos, n, digest, ...) with `block`, the `path` to the top of the block, and, in its first row, `top`."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).withColumn("top", F.col("digest"))
    inside = Window.partitionBy(group, "block").orderBy("pos")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    levels = []
    for level in range(DEPTH):
        width = FAN**level
        node, nodes_here = F.floor(F.col("pos") / width), F.ceil(F.col("n") / width)
        slot = F.pmod(node, F.lit(FAN))
        run = F.least(F.lit(FAN), nodes_here - (node - slot))
        first_leaf = F.col("pos") % width == 0
        left = [F.when(slot >= k, F.lag("top", k * width).over(inside)).otherwise("") for k in range(FAN - 1, 0, -1)]
        right = [F.when(slot + k < run, F.lead("top", k * width).over(inside)).otherwise("") for k in range(1, FAN)]
        siblings = F.when(first_leaf & (nodes_here > 1), F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right")))
        rows = rows.withColumn(f"__{level}", siblings)
        parent = F.when(nodes_here > 1, digest_of(F.col("top"), F.col(f"__{level}.right"))).otherwise(F.col("top"))
        rows = rows.withColumn("top", F.when(first_leaf & (slot == 0), parent))
        # the node above a row is the last one begun
        rows = rows.withColumn(f"__{level}", F.last(f"__{level}", ignorenulls=True).over(so_far))
        levels.append(f"__{level}")
    return rows.withColumn("path", F.filter(F.array(*levels), lambda s: s.isNotNull()).cast(PATH)).drop(*levels)


def _proven(nodes: DataFrame, group: str, largest: int, subroots) -> DataFrame:
    """Nodes with their whole `path`, `subroot` and `root`; `subroots` adds these to nodes that are alone in their group."""
    if largest <= 1:
        return subroots(nodes)
    climbed = _climbed(nodes, group)
    tops = climbed.where(F.col("pos") % BLOCK == 0).select(group, F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("digest"))
    above = _proven(settle(tops, "tops"), group, -(-largest // BLOCK), subroots)
    above = above.select(group, F.col("pos").alias("block"), F.col("path").alias("__above"), "subroot", "root")
    joined = climbed.drop("top").join(above, [group, "block"])
    return joined.withColumn("path", F.concat("path", "__above")).drop("block", "__above")


def prove(leaves: DataFrame, group: str, order: Sequence[str], leaf: str = "leaf") -> DataFrame:
    """Add `path`, `subroot` and `root` to the rows of a table with digests.

    The leaves of a group are its rows by the columns `order` (nulls first; rows equal in all of them are in any order, so
    `order` should end with `leaf`), groups are in the bytewise order of their text, a null group first and apart from an empty text.
    `path` holds, for each level from the leaf's to the root's, the digests of the siblings to the `left` and the `right`, joined.
    A row alone in its group is its subroot, a subroot alone is the root.  No rows give no rows.
    """
    names = [name for name in leaves.columns if name not in ("path", "subroot", "root")]
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    source = leaves.select(F.struct(*names).alias("__held"), key.alias("__group"), F.col(leaf).alias("digest"), *[F.col(c).alias(f"__{i}o") for i, c in enumerate(order)])
    rows, largest = number(source, "__group", [f"__{i}o" for i in range(len(order))])

    def subroots(alone: DataFrame) -> DataFrame:
        """One node for each group: proofs in the tree of all groups."""
        found = settle(alone.select("__group", F.col("digest").alias("subroot")), "subroots")
        tree, most = number(found.select(F.lit(0).alias("__all"), "__group", F.col("subroot").alias("digest")), "__all", ["__group"])
        ends = _proven(tree, "__all", most, lambda one: one.select("*", F.array().cast(PATH).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root")))
        return alone.join(found, "__group").join(ends.select("__group", "path", "root"), "__group")

    return _proven(rows.select("__held", "__group", "digest", "pos", "n"), "__group", largest, subroots).select("__held.*", "path", "subroot", "root")


def manifest(df: DataFrame, key: str = "doc_id", group: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), **carried: Column) -> DataFrame:
    """(key, group, leaf, path, subroot, root) of every row, and the columns `carried`, computed from the row.

    `leaf` covers the columns `fields`; integers count as decimal text.  Repeated rows are leaves each, a null key comes
    first in its group.  The texts are read once; what is sorted and shuffled are digests.
    """
    marks = [df[name] for name in dict.fromkeys((key, group))]
    leaves = df.select(*marks, leaf_digest(*[df[name] for name in fields]).alias("leaf"), *[value.alias(name) for name, value in carried.items()])
    return prove(settle(leaves, "leaves"), group, [key, "leaf"])
