"""Merkle manifest of a table with a witness for every row.

Rows are leaves of one tree per group (a column such as lang), in ascending key; the groups' subroots are the leaves of the
tree over groups. Two consecutive nodes become the hash of both, a node without a partner the hash of itself, until one is left.

Leaves are appended to their tree in aligned blocks of 2 ** BLOCK_BITS. While a block takes them in, every open subtree holds
the partial witnesses of its leaves; the completion of its sibling extends them. The block's root is then appended to the next
tree in the same way, by blocks again, until a tree has one node, so that no task sees more than a block. On the way back each
block's nodes get the rest of their witness from the node above.

Hashes are lowercase hexadecimal sha256 digests, of hexadecimal text where nodes are hashed; stored as 32 bytes.

Defined results: a null field counts as `-`; null keys come first and are never tampered with; rows with equal keys are ordered
by their leaf, equal rows are leaves of their own; the null group comes first and differs from the empty string; empty and very
long texts are hashed as they are; an empty table gives an empty manifest; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from counterlake.llm.store import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A block holds up to 2 ** 12 leaves: 384 bytes of witness for each.
BLOCK_BITS = 12
_NODE = pa.binary()


def encoded(column: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(encoded(c) for c in fields.values())), 256))


def parent(*nodes: bytes) -> bytes:
    return hashlib.sha256(b"".join(n.hex().encode() for n in nodes)).digest()


class OpenTree:
    """Appends nodes from left to right; holds the open subtrees, largest first, each with its first leaf's place."""

    def __init__(self, levels: int):
        """levels: how high the root stands above the nodes; a block of a larger tree is raised to that tree's next level."""
        self.levels = levels
        self.witness: list[list[bytes]] = []
        self.open: list[tuple[int, int, bytes]] = []  # level, first leaf, root

    def append(self, node: bytes) -> None:
        first, level = len(self.witness), 0
        self.witness.append([])
        while self.open and self.open[-1][0] == level:
            first, level, node = self._join(first, level, node)
        self.open.append((level, first, node))

    def _join(self, first: int, level: int, node: bytes) -> tuple[int, int, bytes]:
        """The sibling on the left is complete too: each side's witnesses are extended by the other's root."""
        _, left, root = self.open.pop()
        for k in range(left, first):
            self.witness[k].append(node)
        for k in range(first, len(self.witness)):
            self.witness[k].append(root)
        return left, level + 1, parent(root, node)

    def close(self) -> bytes:
        """Raises the last subtree, alone or with open siblings, to the root."""
        level, first, node = self.open.pop()
        while level < self.levels:
            if self.open and self.open[-1][0] == level:
                first, level, node = self._join(first, level, node)
            else:
                level, node = level + 1, parent(node)
        return node


def _appended(nodes: DataFrame, bits: int) -> DataFrame:
    """Adds path and top to nodes of (tree, place, size, node): the witness inside the block, and the block's root."""
    kept = [f for f in nodes.schema.fields if f.name != "block"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        size = table["size"][0].as_py()
        tree = OpenTree(bits if size > 1 << bits else (size - 1).bit_length())
        for node in table["node"].to_pylist():
            tree.append(node)
        top = tree.close()
        paths = pa.array([b"".join(w) for w in tree.witness], _NODE)
        return table.select([f.name for f in kept]).append_column("path", paths).append_column(
            "top", pa.array([top] * len(table), _NODE))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", path binary, top binary"
    return nodes.withColumn("block", F.shiftright("place", bits)).groupBy("tree", "block").applyInArrow(
        run, schema)


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Adds place (from 0) and size within tree, in the order of tree and ``order``.

    Range partitions keep a large tree in many tasks; only one count per tree and partition meets the others.
    """
    ordered = stored(nodes.withColumn("tie", F.monotonically_increasing_id()), "merkle-nodes")
    ordered = ordered.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").withColumn(
        "number", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("part", F.shiftright("number", 33)).drop("tie"), "merkle-ordered")
    parts = ordered.groupBy("tree", "part").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy("tree").orderBy("part")
    parts = parts.select("tree", "part", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"),
                         F.sum("n").over(W.partitionBy("tree")).alias("size"))
    return ordered.join(parts, ["tree", "part"]).withColumn("place", F.col("number") + F.col("shift")).drop("part", "number", "shift")


def grown(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Stored blocks of nodes (tree, place, size, node), then of their roots, and so on until every tree has one node."""
    levels = []
    while True:
        levels.append(stored(_appended(nodes, bits), "merkle-blocks"))
        if (levels[-1].agg(F.max("size")).first()[0] or 0) <= 1 << bits:
            return levels
        size = F.shiftright(F.col("size") + ((1 << bits) - 1), bits)  # a tree of one block is left with its root
        nodes = levels[-1].filter(F.col("place") % (1 << bits) == 0).select(
            "tree", F.shiftright("place", bits).alias("place"), size.alias("size"), F.col("top").alias("node"))


def extended(levels: list[DataFrame], tops: DataFrame, bits: int) -> DataFrame:
    """The lowest level with whole paths. tops: what the single node of each tree is extended by (tree, more and others)."""
    above = levels[-1].join(tops, "tree")
    above = above.withColumn("path", F.concat("path", "more")).drop("more", "top", "node")
    for level in levels[-2::-1]:
        rest = above.select("tree", F.col("place").alias("block"), F.col("path").alias("more"), *tops.drop("tree", "more").columns)
        above = level.drop("top").withColumn("block", F.shiftright("place", bits)).join(rest, ["tree", "block"]).withColumn(
            "path", F.concat("path", "more")).drop("more", "block")
    return above


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS,
             bits: int = BLOCK_BITS) -> DataFrame:
    """Per row: tree, place, size, key, leaf, forged (the leaf of the tampered row, or null), path (all siblings from the leaf to
    the root, 32 bytes each), subroot, root, and of the group's leaf group_place and groups."""
    columns = {f: F.col(f) for f in fields}
    tampered = F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 0
    name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(
        name.alias("tree"), F.col(key).cast("long").alias("key"), leaf(columns).alias("node"),
        F.when(tampered, leaf(columns | {"n_chars": F.col("n_chars").cast("decimal(20)") + 1})).alias("forged"))
    levels = grown(placed(leaves, "key", "node"), bits)
    levels[0] = levels[0].withColumn("leaf", F.col("node"))
    subroots = levels[-1].filter("place = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("node"))
    groups = grown(placed(subroots, "name"), bits)
    root = groups[-1].filter("place = 0").select("tree", F.col("top").alias("root"), F.lit(b"").alias("more"))
    groups[0] = groups[0].withColumn("subroot", F.col("node"))
    tops = extended(groups, root, bits).select(
        F.col("name").alias("tree"), F.col("path").alias("more"), "subroot", "root", F.col("place").alias("group_place"),
        F.col("size").alias("groups"))
    return extended(levels, tops, bits)


def folded(node: bytes, path: bytes, trees: tuple[tuple[int, int], ...]) -> bytes:
    """The root that a leaf and its siblings give. trees: place and size of the leaf, then of its subroot."""
    at = 0
    for place, size in trees:
        while size > 1:
            if place & 1 or place + 1 < size:
                sibling = path[at:at + 32]
                at += 32
                node = parent(sibling, node) if place & 1 else parent(node, sibling)
            else:
                node = parent(node)
            place, size = place >> 1, (size + 1) >> 1
    return node


def verified(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of a manifest: its digests as text, and what folding the tampered or else the original leaf gives."""
    names = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in names[1:]}
            columns = ("leaf", "forged", "path", "place", "size", "group_place", "groups", "subroot", "root")
            for node, forged, path, place, size, above, groups, subroot, root in zip(*(batch[c].to_pylist() for c in columns)):
                top = folded(node if forged is None else forged, path, ((place, size), (above, groups)))
                for n, value in zip(names[1:], (node, subroot, root, hashlib.sha256(path.hex().encode()).digest(), top)):
                    out[n].append(value.hex())
            yield pa.RecordBatch.from_arrays([batch["key"], *(pa.array(v, pa.string()) for v in out.values())], names=names)

    schema = f"`{key}` long, " + ", ".join(f"{n} string" for n in names[1:])
    return rows.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))

