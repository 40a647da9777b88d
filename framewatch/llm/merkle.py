"""Merkle manifest of a table: a hash tree for each group of rows, one more over their roots, and for each row what proves it.

A level is a table of nodes (tree, place, digest), written to the shared folder by
slot (place modulo arity). The nodes of slot zero equijoin the others at computed
sibling indices (place xor 1 where the tree is binary, place plus the slot offset
otherwise) and emit the parents, each with the run of digests it is made of. From
the root down a node gets the path of its parent and its own run in front of it.

Digests are SHA-256 of lowercase hex texts, kept as 32 bytes. Places come from one
range partitioning and a sum of counts by partition, so that a tree that holds
most rows is spread like any other. A task holds one range of rows, never a tree.

Nulls: a null field hashes as ``-``, a null group is a tree of its own and the first,
null orders stand before others. Rows with equal order stand by their leaf; equal
rows each have a place. An empty table has no tree and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewatch.llm.common import kept

ARITY = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(column: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes' count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of a row's fields as lowercase hex."""
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.translate(text, _UPPER, _LOWER)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _placed(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """``leaves`` (tree, digest and others) with ``place`` within the tree by ``order``, and the tree's ``size``."""
    base = kept(leaves.withColumn("__row", F.monotonically_increasing_id()), "leaves")
    keys = [F.col("tree"), *order, F.col("digest"), F.col("__row")]
    dealt = kept(base.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__row", F.monotonically_increasing_id()), "ordered")
    dealt = dealt.withColumn("__part", F.expr("shiftright(__row, 33)"))
    parts = dealt.groupBy("tree", "__part").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(by_tree).alias("size"))
    return dealt.join(parts, ["tree", "__part"]).withColumn("place", F.col("__row") - F.col("__first") + F.col("__before")).drop("__row", "__part", "__first", "__before")


def _parents(nodes: DataFrame, arity: int) -> DataFrame:
    """The nodes above those of trees that have more than one."""
    up = nodes.filter("slot = 0 and size > 1").select("tree", "place", "size", F.col("digest").alias("__d0"))
    for d in range(1, arity):
        zero = F.col("place").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("place") - d
        up = up.join(nodes.filter((F.col("slot") == d) & (F.col("size") > 1)).select("tree", zero.alias("place"), F.col("digest").alias(f"__d{d}")), ["tree", "place"], "left")
    run = F.concat(*(F.coalesce(F.col(f"__d{d}"), F.lit(b"")) for d in range(arity)))
    up = up.select("tree", F.expr(f"place div {arity}").alias("place"), F.ceil(F.col("size") / arity).cast("long").alias("size"), run.alias("run"))
    return up.withColumn("digest", F.unhex(F.sha2(_hex(F.col("run")), 256)))


def _levels(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """All levels from the leaves (tree, place, size, digest) up, each written by slot; a tree of one node goes no higher."""
    nodes = leaves.withColumn("run", F.lit(b"").cast("binary"))
    levels = []
    while True:
        nodes = kept(nodes.withColumn("slot", (F.col("place") % arity).cast("int")), "level", by="slot")
        levels.append(nodes)
        if (nodes.agg(F.max("size")).first()[0] or 1) <= 1:
            return levels
        nodes = _parents(nodes, arity)


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree's root."""
    out = None
    for nodes in levels:
        one = nodes.filter("size = 1").select("tree", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame | None:
    """``path``, ``subroot`` and ``root`` of every node (tree, place) of ``levels``' lowest.

    ``tops`` has for each tree the path above its root. A path is the list of runs
    from a node to the root, each as the digests left and right of it.
    """
    above = None
    for nodes in reversed(levels):
        here = nodes.select("tree", "place", "size", "run")
        above = here.join(tops, "tree") if above is None else _below(here, above, tops, arity)
        above = above.select("tree", "place", "run", "path", "subroot", "root")
    return above


def _below(nodes: DataFrame, above: DataFrame | None, tops: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with the path that goes on to their parents'; of a tree's root, what ``tops`` has."""
    ends = nodes.filter("size = 1").join(tops, "tree")
    if above is None:
        return ends
    parents = above.withColumnRenamed("place", "__up").withColumnRenamed("run", "__run")
    inner = nodes.filter("size > 1").withColumn("__up", F.expr(f"place div {arity}")).join(parents, ["tree", "__up"])
    return ends.unionByName(inner.withColumn("path", _step(arity)).drop("__up", "__run"))


def _step(arity: int) -> Column:
    """The path of a node at ``place`` from its parent's ``__run`` and ``path``."""
    before = (F.col("place") % arity).cast("int") * 32
    return F.concat(F.array(F.struct(F.substring(F.col("__run"), F.lit(1), before).alias("left"), F.substring(F.col("__run"), before + 33, F.lit(arity * 32)).alias("right"))), F.col("path"))


def manifest(rows: DataFrame, tree: str, order: list[Column], digest: str, arity: int = ARITY) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` (lowercase hex) and ``path`` for ``fold`` and ``siblings``.

    ``tree`` names the group, ``order`` the order of leaves in it, ``digest`` the column of leaf digests in hex. Further columns stay.
    """
    own = [c for c in rows.columns]
    packed = rows.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), *(o.alias(f"__o{i}") for i, o in enumerate(order)), F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("")).alias("tree"), F.unhex(F.col(digest)).alias("digest"))
    leaves = kept(_placed(packed, [F.col(f"__o{i}") for i in range(len(order))]), "leaves")
    levels = _levels(leaves.select("tree", "place", "size", "digest"), arity)

    # the tree over the trees' roots, by name
    subs = kept(_placed(_roots(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), [F.col("name")]), "subroots")
    crown = _levels(subs.select("tree", "place", "size", "digest"), arity)
    top = _roots(crown).select("tree", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    tops = kept(_below(subs, _paths(crown[1:], top, arity), top, arity).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "crown")

    out = _below(leaves, _paths(levels[1:], tops, arity), tops, arity)
    return out.select("row.*", _hex(F.col("subroot")).alias("subroot"), _hex(F.col("root")).alias("root"), "path")


def siblings(path: Column) -> Column:
    """All digests of a path in hex, level by level, left to right, joined."""
    return F.array_join(F.transform(path, lambda s: _hex(F.concat(s["left"], s["right"]))), "")


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf digest (hex) leads to along a path."""
    return F.aggregate(path, digest, lambda held, s: F.sha2(F.concat(_hex(s["left"]), held, _hex(s["right"])), 256))
