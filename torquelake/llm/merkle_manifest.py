"""Merkle manifest of a table: a digest of every row, a proof that it belongs to its group's tree, one root.

1. Rows become leaves; within a group (say a language) they are ordered and numbered without gaps: a range
   partition by (group, order) is written once, offsets of the partitions come from its counts.
2. Aligned blocks of ``FANOUT ** HEIGHT`` consecutive leaves are each traversed in postorder in one place. A
   visit returns its subtree's digest; on the way back every leaf below a child gets the child's siblings
   appended to its path. Block roots are the leaves of the next traversal, again in aligned blocks, until each
   group has one node, its subroot. Traversals are as many as the height of the tree over ``HEIGHT``.
3. The subroots are leaves of one more tree of the same kind, whose root is the manifest's root.
4. Paths of upper nodes are appended to those below, from the top down, by joins on (group, block).

A group that holds a third of all rows is as evenly spread as any, since blocks and not groups are dealt out; a
block holds at most ``FANOUT ** HEIGHT`` leaves. Only digests and keys are shuffled, never texts.

Defined results: null values count as ``-``; a null group is a group of its own and comes first; null order keys
come first; rows of equal order keys are ordered by their leaf, so equal rows are interchangeable; a group of one
leaf has that leaf as its subroot and an empty path there; an empty table gives an empty result; texts of any
length are hashed whole; further columns are ignored unless carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from torquelake.llm.common import materialize, tune

#: Children of a node, and levels of a block that is traversed in one place.
FANOUT, HEIGHT = 8, 4
#: Siblings of a node and of each node above it, those left of it and those right of it.
PATH = "array<struct<left: string, right: string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes after their count and a colon."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the framed fields in their order."""
    return F.sha2(F.concat(*[framed(f) for f in fields]).cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def traverse(leaves: list[str], levels: int, fanout: int = FANOUT) -> tuple[str, list[list[tuple[str, str]]]]:
    """The digest over ``levels`` levels above ``leaves`` and for each leaf its (left, right) siblings, lowest level first."""
    paths: list[list[tuple[str, str]]] = [[] for _ in leaves]

    def visit(first: int, last: int, level: int) -> str:
        if not level:
            return leaves[first]
        spans = [(a, min(a + fanout ** (level - 1), last)) for a in range(first, last, fanout ** (level - 1))]
        nodes = [visit(a, b, level - 1) for a, b in spans]
        for k, (a, b) in enumerate(spans):
            step = ("".join(nodes[:k]), "".join(nodes[k + 1 :]))
            for path in paths[a:b]:
                path.append(step)
        return hashlib.sha256("".join(nodes).encode()).hexdigest()

    return visit(0, len(leaves), levels), paths


def levels_above(total: int, at_most: int, fanout: int = FANOUT) -> int:
    """Levels until one node is left, or ``at_most``."""
    n = 0
    while total > 1 and n < at_most:
        total, n = -(-total // fanout), n + 1
    return n


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with pos (0, 1, 2... by ``order`` within each group) and total (rows of the group); a written table."""
    placed = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = materialize(placed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), f"{name}-ordered")
    runs = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    parts = Window.partitionBy(group)
    runs = runs.withColumns({"_before": F.sum("_n").over(parts.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), "total": F.sum("_n").over(parts)})
    out = placed.join(runs, [group, "_part"]).withColumn("pos", F.col("_at") - F.col("_first") + F.coalesce("_before", F.lit(0)))
    return out.drop("_part", "_at", "_first", "_n", "_before")


def _climb(nodes: DataFrame, group: str, name: str, height: int) -> DataFrame:
    """One traversal: ``nodes`` (group, pos, total, digest, further columns) with path, block and the digest of the block, a written table."""
    size = FANOUT**height
    schema = nodes.schema

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table["pos"].to_numpy(), kind="stable"))
        top, paths = traverse(table["digest"].to_pylist(), levels_above(table["total"][0].as_py(), height))
        steps = [s for p in paths for s in p]
        pairs = pa.StructArray.from_arrays([pa.array([x for x, _ in steps], pa.string()), pa.array([y for _, y in steps], pa.string())], ["left", "right"])
        ends = np.cumsum([0, *map(len, paths)]).astype(np.int32)
        return table.append_column("path", pa.ListArray.from_arrays(ends, pairs)).append_column("top", pa.array([top] * len(paths)))

    made = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "block long", f"path {PATH}", "top string"])
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / size)).groupBy(group, "block")
    return materialize(blocks.applyInArrow(run, made), f"{name}-paths")


def _trees(nodes: DataFrame, group: str, name: str, height: int) -> DataFrame:
    """``nodes`` with their whole path in their group's tree and its root: (..., path, subroot)."""
    size = FANOUT**height
    levels = [_climb(nodes, group, name, height)]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > size:
        roots = levels[-1].where(F.col("pos") % size == 0)
        up = roots.select(group, F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("digest"))
        levels.append(_climb(up, group, f"{name}-{len(levels)}", height))
        most = -(-most // size)
    above = levels.pop().withColumnRenamed("top", "subroot")
    while levels:
        upper = above.select(group, F.col("pos").alias("block"), F.col("path").alias("_up"), "subroot")
        above = levels.pop().drop("top").join(upper, [group, "block"]).withColumn("path", F.concat("path", "_up")).drop("_up")
    return above.drop("block")


def manifest(rows: DataFrame, leaf: Column, group: str, order: list[str], carry: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """Every row's group, ``order`` columns and ``carry`` with its leaf, path (up to the root), subroot and root.

    ``height``: levels of a block. Any gives the same result.
    """
    tune(rows.sparkSession)
    carry = carry or {}
    keys = {f"_k{i}": F.col(f"`{c}`") for i, c in enumerate(order)}
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first, then bytewise
    leaves = rows.select(key.alias("_group"), *[v.alias(k) for k, v in keys.items()], leaf.alias("digest"), *[v.alias(f"_c{i}") for i, v in enumerate(carry.values())])
    leaves = numbered(materialize(leaves, "merkle-leaves"), "_group", [*keys, "digest"], "merkle")
    trees = _trees(leaves, "_group", "merkle", height)

    # One node a group: the lowest leaf stands for it.
    subroots = trees.where("pos = 0").select("_group", F.col("subroot").alias("digest"), F.lit(0).alias("_all"))
    top = _trees(numbered(materialize(subroots, "merkle-subroots"), "_all", ["_group"], "merkle-top"), "_all", "merkle-top", height)
    top = top.select("_group", F.col("path").alias("_up"), F.col("subroot").alias("root"))
    return trees.join(top, "_group").select(
        F.when(F.col("_group") != "", F.substring("_group", 2, 2**31 - 1)).cast(rows.schema[group].dataType).alias(group),
        *[F.col(k).alias(c) for k, c in zip(keys, order, strict=True)], *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("digest").alias("leaf"), F.concat("path", "_up").alias("path"), "subroot", "root",
    )
