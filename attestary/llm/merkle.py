"""A Merkle manifest of a dataset by incremental witnesses.

Nodes are appended in order. Two complete subtrees of one height that stand side by side merge at once, and every node below
them gets the other one's root as the next entry of its witness, so a witness is partial as long as its subtree is open.
At the end the last, open subtrees rise: a node without a sibling is hashed alone.

Spark spreads this by position. Rows are ordered by range partitions, counts ahead of each give their positions, and every
aligned block of `block` positions is appended to a tree of its own. The blocks' roots are the next nodes to append, in blocks
again, until one root is left; the witnesses found above are then added to those below. So no tree, however many of the
rows it has, passes through one task."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import tidy, written

#: A witness entry: where the sibling stands, and its 32 bytes.
_LEFT, _RIGHT, _ALONE, _ENTRY = 0, 1, 2, 33
_PART_BITS = 33  # monotonically_increasing_id counts rows in the lower bits


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """A row's leaf, 32 bytes: each value as its UTF-8 byte count, a colon and itself, or - for null, hashed together."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in (doc_id, source, lang, n_chars, text)]).cast("binary"), 256))


def _hash(*nodes: bytes) -> bytes:
    return sha256("".join([n.hex() for n in nodes]).encode()).digest()


class OpenSubtrees:
    """Up to `most` nodes appended in order. open: (height, first and end of its nodes, root) of each subtree that has no
    sibling yet, falling in height; seen: the nodes' witnesses as far as they go."""

    def __init__(self, most: int, height: int = 0):
        self.count, self.open = 0, []
        self.seen = np.zeros((most, max(height, (most - 1).bit_length()), _ENTRY), np.uint8)

    def append(self, node: bytes) -> None:
        self.open.append((0, self.count, self.count + 1, node))
        self.count += 1
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._merge()

    def _extend(self, tree: tuple, where: int, sibling: bytes) -> None:
        height, first, end, _ = tree
        self.seen[first:end, height] = np.frombuffer(bytes([where]) + sibling, np.uint8)

    def _merge(self) -> None:
        right, left = self.open.pop(), self.open.pop()
        self._extend(left, _RIGHT, right[3])
        self._extend(right, _LEFT, left[3])
        self.open.append((left[0] + 1, left[1], right[2], _hash(left[3], right[3])))

    def close(self, height: int) -> tuple[bytes, np.ndarray]:
        """Let the open subtrees rise to one of `height` at least: (its root, the witnesses by node)."""
        while len(self.open) > 1 or self.open[-1][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._merge()
            else:
                last = self.open.pop()
                self._extend(last, _ALONE, bytes(32))
                self.open.append((last[0] + 1, *last[1:3], _hash(last[3])))
        height, _, _, root = self.open[0]
        return root, self.seen[: self.count, :height].reshape(self.count, -1)


def _grow(block: int):
    """The rows of one block of one tree -> the same rows with their witnesses, and the block's root on the first of them."""
    height = (block - 1).bit_length()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        up_to = height if rows.column("total")[0].as_py() > block else 0  # the blocks of a tree that has several meet at one height
        tree = OpenSubtrees(rows.num_rows, up_to)
        for node in rows.column("node").to_pylist():
            tree.append(node)
        root, seen = tree.close(up_to)
        ends = np.arange(rows.num_rows + 1, dtype=np.int32) * seen.shape[1]
        witness = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(seen))])
        roots = pa.array([root] + [None] * (rows.num_rows - 1), pa.binary())
        return rows.drop_columns(["block"]).append_column("witness", witness).append_column("block_root", roots)

    return run


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(tree, …) -> with `position` in the tree's order, from 0, and `total`, the tree's rows. What stands in `order` must
    tell rows apart, or they are equal in all that counts."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("part", F.shiftright("at", _PART_BITS)), "ranged")
    parts = ranged.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "part", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), F.sum("n").over(Window.partitionBy("tree")).alias("total"))
    return ranged.join(parts, ["tree", "part"]).withColumn("position", F.col("at") - F.col("first") + F.col("ahead")).drop("at", "part", "first", "ahead")


def _grown(nodes: DataFrame, block: int) -> tuple[list[DataFrame], DataFrame]:
    """nodes(tree, position, total, node, …) -> (by level the rows with the witnesses of their own blocks, the leaves first;
    (tree, node) of the trees' roots)."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels = []
    while True:
        own = nodes.withColumn("block", F.floor(F.col("position") / block))
        shape = StructType([f for f in own.schema.fields if f.name != "block"]).add("witness", BinaryType()).add("block_root", BinaryType())
        levels.append(written(own.groupBy("tree", "block").applyInArrow(_grow(block), shape), "witnesses"))
        nodes = levels[-1].where("block_root is not null").select(
            "tree", F.floor(F.col("position") / block).alias("position"), F.ceil(F.col("total") / block).alias("total"), F.col("block_root").alias("node")
        )
        if most <= block:
            return levels, nodes.select("tree", "node")
        most = -(-most // block)


def _completed(levels: list[DataFrame], block: int, crown: DataFrame | None = None) -> DataFrame:
    """The leaves with whole witnesses, those found above added level by level. crown(tree, above, …): what stands above a tree's
    root, and more to know of it. No level's join has more than a block of rows for a key, the crown's included, as it is
    joined to the highest level."""
    upper, key = crown, ["tree"]
    for rows in reversed(levels):
        rows = rows.drop("block_root").withColumn("block", F.floor(F.col("position") / block))
        if upper is not None:
            rows = rows.join(upper, key).withColumn("witness", F.concat("witness", "above")).drop("above")
        known = [c for c in (crown.columns if crown is not None else []) if c not in ("tree", "above")]
        whole = rows.drop("block")
        upper, key = whole.select("tree", F.col("position").alias("block"), F.col("witness").alias("above"), *known), ["tree", "block"]
    return whole


def manifest(leaves: DataFrame, block: int = 4096) -> DataFrame:
    """leaves(lang, doc_id, leaf binary, …) -> the rows with subroot, root and witness: in each lang a tree over the leaves
    by ascending doc_id, over the subroots by lang one more. A witness has an entry of 33 bytes a level, through the
    subroot to the root: where the sibling stands (0 left, 1 right, 2 none), then its 32 bytes.

    A null lang is a tree of its own and comes first, as do null ids; rows that share an id follow each other by leaf, so equal rows
    have one leaf and one place each; an empty table gives an empty manifest. Further columns are kept, but the names that
    the result needs must be free. `block` is a power of two."""
    if block < 2 or block & (block - 1):
        raise ValueError("a block must be a power of two")
    carried = [c for c in leaves.columns if c not in ("lang", "doc_id", "leaf")]
    rows = leaves.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), F.col("leaf").alias("node"),
        F.struct("lang", "doc_id", *carried).alias("row"), F.col("doc_id").alias("key"), F.monotonically_increasing_id().alias("copy"),
    )
    # copy only parts equal rows among the ranges; written first, as the ranges' bounds come from a pass of their own
    levels, subroots = _grown(_placed(written(rows, "leaves"), ["key", "node", "copy"]).drop("key", "copy"), block)
    top, root = _grown(_placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "node"), ["own"]), block)
    crown = _completed(top, block).join(root.select("tree", F.col("node").alias("root")), "tree")
    crown = crown.select(F.col("own").alias("tree"), F.col("witness").alias("above"), F.col("node").alias("subroot"), "root")
    out = _completed(levels, block, crown)
    return out.select("row.*", F.col("node").alias("leaf"), "subroot", "root", "witness")


def _follow(claimed: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            folded, proofs = [], []
            for node, witness in zip(batch.column(claimed).to_pylist(), batch.column("witness").to_pylist()):
                siblings = []
                for at in range(0, len(witness), _ENTRY):
                    where, sibling = witness[at], witness[at + 1 : at + _ENTRY]
                    if where == _ALONE:
                        node = _hash(node)
                        continue
                    siblings.append(sibling)
                    node = _hash(sibling, node) if where == _LEFT else _hash(node, sibling)
                folded.append(node)
                proofs.append(_hash(*siblings))
            more = [pa.array(folded, pa.binary()), pa.array(proofs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "folded_root", "proof"])

    return run


def checked(rows: DataFrame, claimed: str = "leaf") -> DataFrame:
    """A manifest's rows with folded_root, what the leaf in the column `claimed` and the witness lead to, proof, a hash of the
    witness's siblings, and verified, whether that is the root. A null claimed leaf counts as no bytes: not verified."""
    rows = rows.withColumn(claimed, F.coalesce(claimed, F.lit(b"")))
    out = rows.mapInArrow(tidy(_follow(claimed)), StructType([*rows.schema.fields]).add("folded_root", BinaryType()).add("proof", BinaryType()))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
