"""Merkle manifest of a table: persistent binary hash trees with path copying.

Every group of rows has a tree over its leaves in id order; the groups' roots
have one more tree, whose root stands for the table.  At each level two
consecutive nodes become one, and a last node without a partner becomes one by
itself.

Leaves are dealt into aligned blocks of ``BLOCK`` consecutive ones, and so are
the blocks' tops, level upon level, until one node is left.  A block is one task's
group of a size that no key can raise.  The way up computes tops only; the way
down hands each block the path from its top to the root.  Inside a block the tree
is persistent: a tampered leaf makes a new version that copies the leaf's
ancestors in the block and shares all other nodes, and goes on as a version of
the upper levels by the block's path.

Positions come from a range partitioning and the counts of its partitions, so a
group may hold any share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import ship_by_value, stored

LEVELS = 10
BLOCK = 1 << LEVELS


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class PersistentTree:
    """Nodes are only ever added: (digest, left, right), ``right`` being None for
    a node without a partner, both for a leaf.  A version is the number of its
    top node."""

    def __init__(self, leaves: Iterable[str], height: int):
        self.nodes: list[tuple[str, int | None, int | None]] = []
        self.height = height
        level = [self._add(x) for x in leaves]
        for _ in range(height):
            level = [self._join(*level[i:i + 2]) for i in range(0, len(level), 2)]
        self.first_version = level[0]

    def _add(self, value: str, left: int | None = None, right: int | None = None) -> int:
        self.nodes.append((value, left, right))
        return len(self.nodes) - 1

    def _join(self, left: int, right: int | None = None) -> int:
        values = [self.nodes[i][0] for i in (left, right) if i is not None]
        return self._add(digest(*values), left, right)

    def top(self, version: int) -> str:
        return self.nodes[version][0]

    def _ancestors(self, version: int, at: int) -> list[int]:
        """Nodes from the top to the parent of leaf ``at``."""
        found, node = [], version
        for level in reversed(range(self.height)):
            found.append(node)
            node = self.nodes[node][2 if at >> level & 1 else 1]
        return found

    def changed(self, version: int, at: int, leaf: str) -> int:
        """A version with another leaf at ``at``: its ancestors are copied."""
        new = self._add(leaf)
        for level, old in enumerate(reversed(self._ancestors(version, at))):
            _, left, right = self.nodes[old]
            new = self._join(left, new) if at >> level & 1 else self._join(new, right)
        return new

    def path(self, version: int, at: int) -> list[str]:
        """For each level from the leaf up: "<" or ">" (the sibling's side) and its
        digest, or "" where the node has no partner."""
        out = []
        for level, node in enumerate(reversed(self._ancestors(version, at))):
            _, left, right = self.nodes[node]
            out.append("<" + self.top(left) if at >> level & 1 else ">" + self.top(right) if right is not None else "")
        return out


def proof(path: Iterable[str]) -> str:
    """Digest of the siblings of a path."""
    return digest(*(step[1:] for step in path))


def fold(value: str, path: Iterable[str]) -> str:
    """The root that a node's digest and its path lead to."""
    for step in path:
        value = digest(step[1:], value) if step[:1] == "<" else digest(value, step[1:])
    return value


def _height(n: int) -> int:
    """Levels to go up inside a block of a group with ``n`` nodes."""
    return min(LEVELS, (n - 1).bit_length())


def _tree(block: pa.Table) -> tuple[pa.Table, PersistentTree]:
    block = block.sort_by("pos")
    return block, PersistentTree(block["value"].to_pylist(), _height(block["n"][0].as_py()))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows``, written out, with ``pos`` (from 0 by ``order`` within the group)
    and ``n`` (rows of the group).  ``order`` must tell all rows apart.

    A range partitioning by group and order holds each group in consecutive
    partitions; a row's place is the count of those before and its place within
    its own.  The table of counts has a row per partition and group in it.
    """
    dealt = rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt)
    counts = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_k").over(before), F.lit(0)), "n": F.sum("_k").over(Window.partitionBy(group))})
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    placed = dealt.withColumn("_own", own).join(counts.drop("_k"), [group, "_part"])
    return placed.withColumn("pos", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def _by_block(nodes: DataFrame):
    return nodes.withColumn("block", F.shiftright("pos", LEVELS)).groupBy("grp", "block")


def block_tops(nodes: DataFrame) -> DataFrame:
    """``grp``, ``pos``, ``n``, ``value`` of the blocks' tops from those of the
    nodes below."""
    def tops(key: tuple, block: pa.Table) -> pa.Table:
        n = block["n"][0].as_py()
        _, tree = _tree(block)
        return pa.table({"grp": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()),
                         "value": [tree.top(tree.first_version)]})

    return _by_block(nodes.select("grp", "pos", "n", "value")).applyInArrow(tops, "grp string, pos long, n long, value string")


def _upwards(nodes: DataFrame) -> list[DataFrame]:
    """The tables of tops above ``nodes``, written out; the last has one row per
    group.  Each has a node per ``BLOCK`` of the one below."""
    tables = [stored(block_tops(nodes))]
    while (tables[-1].agg(F.max("n")).first()[0] or 1) > 1:
        tables.append(stored(block_tops(tables[-1])))
    return tables


def _downwards(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``grp``, ``pos`` and ``path`` (to the root) of every node, from the paths of
    the blocks' tops in ``above``."""
    def own_paths(key: tuple, block: pa.Table) -> pa.Table:
        block, tree = _tree(block)
        paths = [tree.path(tree.first_version, at) for at in range(len(block))]
        return pa.table({"grp": block["grp"], "pos": block["pos"], "own": pa.array(paths, pa.list_(pa.string()))})

    own = _by_block(nodes.select("grp", "pos", "n", "value")).applyInArrow(own_paths, "grp string, pos long, own array<string>")
    top = above.select("grp", F.col("pos").alias("_top"), F.col("path").alias("_path"))
    joined = own.withColumn("_top", F.shiftright("pos", LEVELS)).join(top, ["grp", "_top"])
    return joined.select("grp", "pos", F.concat("own", "_path").alias("path"))


def _paths(nodes: DataFrame, tables: list[DataFrame], top_paths: DataFrame) -> DataFrame:
    """Paths of the rows of ``tables[0]``, given those of ``tables[-1]``."""
    paths = top_paths
    for table in reversed(tables[:-1]):
        paths = _downwards(table, paths)
    return paths


RESULT = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied int"


def manifest(docs: DataFrame, leaf: Column, tampered: Column, *, group_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, the group's ``subroot``, the
    table's ``root``, ``proof_sha256`` (digest of the siblings from leaf to root),
    ``folded_root`` (the root that the tampered leaf, or the own one where
    ``tampered`` is null, leads to over the original siblings), ``verified``
    (whether that is the root) and ``copied`` (nodes that the row's version does
    not share, 0 without a version).

    ``leaf`` and ``tampered`` are hexadecimal digests as columns of ``docs``; leaf
    must not be null.  A null group is a group and comes first; null ids come
    first within theirs; rows that share an id are ordered by leaf, and rows alike
    in both as they come, their results being interchangeable.  An empty table
    gives no rows; other columns are ignored.
    """
    grp = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    rows = stored(docs.select(grp.alias("grp"), F.col(id_col).cast("long").alias("id"), leaf.alias("value"), tampered.alias("tampered"),
                              F.monotonically_increasing_id().alias("tie")))
    leaves = stored(ranked(rows, "grp", ["id", "value", "tie"]).drop("tie"))
    tops = _upwards(leaves)
    subroots = tops[-1].select("grp", F.col("value").alias("subroot"))
    # the groups' roots are the leaves of one more tree
    upper = stored(ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("subroot").alias("value")), "grp", ["name"]))
    upper_tops = _upwards(upper)
    root = upper_tops[-1].select(F.col("value").alias("root"))
    none = F.array().cast("array<string>").alias("path")
    upper_paths = _downwards(upper, _paths(upper, upper_tops, upper_tops[-1].select("grp", "pos", none)))
    named = upper.join(upper_paths, ["grp", "pos"]).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path")
    paths = _paths(leaves, tops, named)
    paths = paths.join(subroots, "grp").select("grp", F.col("pos").alias("block"), "path", "subroot", root.scalar().alias("root"))

    def versions(block: pa.Table, above: pa.Table) -> pa.Table:
        if not len(block) or not len(above):
            raise ValueError("a block without a path")
        block, tree = _tree(block)
        up, subroot, top = above["path"][0].as_py(), above["subroot"][0].as_py(), above["root"][0].as_py()
        proofs, folded, copied = [], [], []
        first = tree.first_version
        for at, new in enumerate(block["tampered"].to_pylist()):
            path = tree.path(first, at)
            proofs.append(proof(path + up))
            if new is None:
                folded.append(fold(block["value"][at].as_py(), path + up))
                copied.append(0)
            else:
                size = len(tree.nodes)
                version = tree.changed(first, at, new)
                folded.append(fold(tree.top(version), up))
                copied.append(len(tree.nodes) - size + len(up))
                del tree.nodes[size:]  # the version is told; the others start from the first one
        k = len(block)
        return pa.table({"id": block["id"], "leaf": block["value"], "subroot": [subroot] * k, "root": [top] * k, "proof_sha256": proofs,
                         "folded_root": folded, "verified": [f == top for f in folded], "copied": pa.array(copied, pa.int32())})

    out = _by_block(leaves).cogroup(paths.groupBy("grp", "block")).applyInArrow(versions, RESULT)
    return out.withColumnRenamed("id", id_col)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


ship_by_value(__name__)
