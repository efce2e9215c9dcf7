"""Merkle manifest of a dataset as a persistent tree: changed leaves make versions that copy their ancestors only.

The leaves of a group are numbered in order of their ids. A block is an aligned run of ``fan_out ** 4`` leaves, which is
a whole subtree of four levels, and the tops of blocks are the leaves of the next round, until each group has one node;
the groups' nodes make one more tree. Every round is one distributed pass over bounded blocks. What a node's ancestors
need besides the node itself are its siblings, level by level; they are put together from the top down, one path per
block. A changed leaf then copies its ancestors within its block, and the copy of the block's top goes on along the path
of the block. All other nodes are shared with the first version.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import stored
from echolens.operators.ordinals import with_position


@dataclass(frozen=True)
class Shape:
    """Nodes of a run, and levels of a block; with the defaults a block has at most 4,096 leaves."""

    fan_out: int = 8
    height: int = 4

    @property
    def block(self) -> int:
        return self.fan_out**self.height


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest (hex) of a row's fields, each ``-`` if null, else its length in bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def block_levels(nodes: list[str], first: bool, shape: Shape) -> list[list[str]]:
    """The levels of one block, its nodes first, its top last.

    The first block of a group has its final top where one node is left, because there is no other block if it is not
    full. Any other block is part of a larger tree and has all levels, also over a single node.
    """
    levels, n = [nodes], shape.fan_out
    while len(levels) <= shape.height and not (first and len(levels[-1]) == 1):
        row = levels[-1]
        levels.append([digest("".join(row[i : i + n])) for i in range(0, len(row), n)])
    return levels


def _siblings(levels: list[list[str]], fan_out: int) -> list[list[tuple[str, str]]]:
    """For each node below the top, what stands left and right of it in its run."""
    out = []
    for row in levels[:-1]:
        sides = []
        for i in range(len(row)):
            start = i - i % fan_out
            sides.append(("".join(row[start:i]), "".join(row[i + 1 : start + fan_out])))
        out.append(sides)
    return out


def _in_order(table, kind: str) -> tuple[list[int], list[str]]:
    """Places and digests of a block's rows, by place."""
    place = table.column("_place").to_numpy()
    order = np.argsort(place, kind="stable")
    return order.tolist(), [x.hex() for x in table.column(kind).take(order).to_pylist()]


def _tops(shape: Shape) -> Callable:
    """A block's rows to the row of its top."""

    def tops(table):
        import pyarrow as pa

        _, nodes = _in_order(table, "_node")
        block = table.column("_block")[0].as_py()
        top = block_levels(nodes, block == 0, shape)[-1][0]
        return pa.table(
            {"_group": table.column("_group").slice(0, 1), "_place": pa.array([block], pa.int64()), "_node": pa.array([bytes.fromhex(top)])}
        )

    return tops


def _paths(shape: Shape) -> Callable:
    """A block's rows with what stands left and right of each one's ancestors in the block."""

    def paths(table):
        import pyarrow as pa

        order, nodes = _in_order(table, "_node")
        block = table.column("_block")[0].as_py()
        sides = _siblings(block_levels(nodes, block == 0, shape), shape.fan_out)
        found = [[x for k, row in enumerate(sides) for x in row[i // shape.fan_out**k]] for i in range(len(nodes))]
        ordered = table.select(["_group", "_place", "_block"]).take(order)
        return ordered.append_column("_path", pa.array(found, pa.list_(pa.string())))

    return paths


def _versions(shape: Shape) -> Callable:
    """The leaves of a block with their proofs and, for changed ones, the copied ancestors up to the root."""

    def versions(leaves, above):
        import pyarrow as pa

        order, nodes = _in_order(leaves, "_node")
        block = leaves.column("_block")[0].as_py()
        sides = _siblings(block_levels(nodes, block == 0, shape), shape.fan_out)
        flat = above.column("_path")[0].as_py()
        upper = list(zip(flat[::2], flat[1::2]))
        proof_above = "".join(flat)
        changed = leaves.column("_changed").take(order).to_pylist()
        proofs, folded, copies = [], [], []
        for i, (node, new) in enumerate(zip(nodes, changed)):
            path = [row[i // shape.fan_out**k] for k, row in enumerate(sides)]
            proofs.append(digest("".join([x for pair in path for x in pair]) + proof_above))
            here, made = new.hex() if new else node, []
            for left, right in (*path, *upper):
                here = digest(left + here + right)
                made.append(here)
            folded.append(here)
            copies.append(made if new else None)
        n = len(nodes)
        return pa.table(
            {
                "_id": leaves.column("_id").take(order),
                "_group": leaves.column("_group").take(order),
                "_place": leaves.column("_place").take(order),
                "leaf": nodes,
                "subroot": pa.array([above.column("subroot")[0].as_py()] * n),
                "root": pa.array([above.column("root")[0].as_py()] * n),
                "proof_sha256": proofs,
                "folded_root": folded,
                "changed_leaf": pa.array([c.hex() if c else None for c in changed], pa.string()),
                "copies": pa.array(copies, pa.list_(pa.string())),
            }
        )

    return versions


@dataclass(frozen=True)
class Manifest:
    """``leaves`` (numbered, stored) and ``blocks``: one row per block of leaves with its path to the root."""

    leaves: DataFrame
    blocks: DataFrame
    shape: Shape

    def verified(self) -> DataFrame:
        """One row per leaf: ``_id, _group, _place, leaf, subroot, root, proof_sha256, folded_root, changed_leaf, copies``.

        ``folded_root`` is the root of the leaf's version: worked out from the changed leaf, or from the leaf itself, and
        the siblings of the first version. ``copies`` are the digests of the copied ancestors, parent first, root last;
        null where nothing has changed.
        """
        kind = dict(self.leaves.dtypes)["_id"]
        return (
            self.leaves.groupBy("_group", "_block")
            .cogroup(self.blocks.groupBy("_group", "_block"))
            .applyInArrow(
                _versions(self.shape),
                f"_id {kind}, _group string, _place long, leaf string, subroot string, root string, proof_sha256 string, "
                "folded_root string, changed_leaf string, copies array<string>",
            )
        )

    def copied_nodes(self) -> DataFrame:
        """The nodes that versions do not share: ``version`` (id of the changed leaf), ``level`` (1 is above the leaves) and ``digest``."""
        rows = self.verified().where(F.col("copies").isNotNull())
        return rows.select(F.col("_id").alias("version"), F.posexplode("copies").alias("_at", "digest")).select(
            "version", (F.col("_at") + 1).alias("level"), "digest"
        )


def _rounds(nodes: DataFrame, shape: Shape) -> tuple[list[DataFrame], DataFrame]:
    """Paths of each round's nodes within their blocks, lowest first, and the last node of each group.

    ``nodes`` are ``_group, _place, _node``, stored.
    """
    rounds = []
    while (nodes.agg(F.max("_place")).first()[0] or 0) > 0:
        blocks = nodes.withColumn("_block", F.floor(F.col("_place") / shape.block).cast("long"))
        rounds.append(
            blocks.groupBy("_group", "_block").applyInArrow(
                _paths(shape), "_group string, _place long, _block long, _path array<string>"
            )
        )
        nodes = stored(_block_tops(blocks, shape), "merkle-tops")
    return rounds, nodes


def _block_tops(blocks: DataFrame, shape: Shape) -> DataFrame:
    return blocks.groupBy("_group", "_block").applyInArrow(_tops(shape), "_group string, _place long, _node binary")


def _down(rounds: list[DataFrame], last: DataFrame) -> DataFrame:
    """``_group, _place, _path`` and the rest of ``last`` for the nodes of the first round, joined from the top down."""
    rest = [F.col(c) for c in last.columns if c not in ("_group", "_place", "_path")]
    for paths in reversed(rounds):
        upper = last.select("_group", F.col("_place").alias("_block"), F.col("_path").alias("_above"), *rest)
        last = paths.join(upper, ["_group", "_block"]).select(
            "_group", "_place", F.concat("_path", "_above").alias("_path"), *rest
        )
    return last


def merkle_manifest(
    docs: DataFrame,
    fields: Sequence[str],
    id_col: str = "doc_id",
    group_col: str = "lang",
    tampered: Column | None = None,
    replaced: Mapping[str, Column] | None = None,
    shape: Shape = Shape(),
) -> Manifest:
    """The tree over ``docs`` and the versions that changed rows make.

    A leaf is the digest of ``fields`` (``leaf_digest``). Within a group, leaves ascend by id, null ids first, rows with
    one id by digest; rows that are equal in all fields have equal leaves, each a place of its own. While a group has
    several nodes, every ``shape.fan_out`` consecutive ones (the last run may have fewer) become their digest. The groups'
    last nodes, in order of the group's UTF-8 bytes, null first, make the tree of the root in the same way.
    Where ``tampered`` holds (null: it does not), the row's version has the leaf of the ``replaced`` fields, which may
    be the same one. An empty table has no leaves, blocks or root. Other columns are not read, whatever their names.

    Groups and blocks meet no join on a group alone: leaves are numbered over range partitions, so a group of a third of
    all rows spreads over many tasks, and a block has at most ``shape.block`` rows.
    """
    held = [F.col(f"`{c}`") for c in fields]
    changed = [(replaced or {}).get(c, F.col(f"`{c}`")) for c in fields]
    leaves = stored(
        docs.select(
            F.col(f"`{id_col}`").alias("_id"),
            # Null first, and otherwise in the order of the bytes.
            F.coalesce(F.concat(F.lit("="), F.col(f"`{group_col}`").cast("string")), F.lit("")).alias("_group"),
            F.unhex(leaf_digest(held)).alias("_node"),
            F.when(F.lit(False) if tampered is None else tampered, F.unhex(leaf_digest(changed))).alias("_changed"),
        ),
        "merkle-leaves",
    )
    order = [F.col("_id").asc_nulls_first(), F.col("_node"), F.col("_changed")]
    placed = with_position(leaves, order, ["_group"], "_place").withColumn("_place", F.col("_place") - 1)
    placed = placed.withColumn("_block", F.floor(F.col("_place") / shape.block).cast("long"))
    tops = stored(_block_tops(placed, shape), "merkle-tops")
    rounds, subroots = _rounds(tops, shape)
    # The groups are the leaves of the last tree.
    numbered = with_position(subroots.select(F.col("_group").alias("_name"), "_node"), [F.col("_name")], (), "_place")
    numbered = stored(
        numbered.select(F.lit("").alias("_group"), (F.col("_place") - 1).alias("_place"), "_node", "_name"), "merkle-subroots"
    )
    above, root = _rounds(numbered.select("_group", "_place", "_node"), shape)
    none = F.array().cast("array<string>")
    top = root.select("_group", F.lit(0).cast("long").alias("_place"), none.alias("_path"), F.hex("_node").alias("root"))
    groups = numbered.join(_down(above, top), ["_group", "_place"]).select(
        F.col("_name").alias("_group"), F.lit(0).cast("long").alias("_place"), "_path",
        F.lower(F.hex("_node")).alias("subroot"), F.lower("root").alias("root"),
    )
    blocks = _down(rounds, groups).withColumnRenamed("_place", "_block")
    return Manifest(placed, stored(blocks, "merkle-blocks"), shape)
