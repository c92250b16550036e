"""Merkle manifest of a dataset: a tree over the rows of each group, a tree over the groups' roots, and each row's proof.

The rows of a group are put in order and numbered; every ``fanout`` consecutive nodes become their parent until one is left. A superblock is
the ``fanout ** levels`` nodes whose number has the same quotient, and one task's call collapses that many levels of it (``applyInPandas``).
The roots of the superblocks are nodes of a smaller table, which is reduced in the same way until each tree has one node. On the way down,
each superblock meets the one row of its own root, and the proofs of its nodes are its lower levels followed by the proof of that row. The
lower levels are hashed a second time rather than kept, since a proof is much longer than a row. This pass hands over Arrow tables, as pandas
would turn kept integers with nulls into floating numbers.

A group may hold any share of all rows: superblocks are of fixed size and the numbers come from ranges (``in_order``).

Edge cases: rows of a null group are a tree of their own, which is the first; rows with a null or equal order follow each other by digest, and repeated rows
are leaves of their own; a lone row is its group's root; an empty table has no rows, no tree and no root; null fields and empty fields
have different digests; texts of any length are hashed whole; kept columns that are named like a result are called ``<name>_kept``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameline.llm.common import kept, written
from frameline.operators.ordering import in_order

FANOUT = 16
LEVELS = 2  # that a superblock collapses: 256 nodes
WIDTH = 64  # letters of a digest


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256, as lower-case hex, of the fields one after the other: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _runs(level: list[str], fanout: int) -> list[str]:
    return ["".join(level[k : k + fanout]) for k in range(0, len(level), fanout)]


def _collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, at, full, short) of each superblock: its root after exactly so many levels, and as the only one of its tree, which stops at one node."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        level = block["full"].tolist()
        short = block["short"].iloc[0] if len(level) == 1 else None
        for _ in range(levels):
            level = [_digest(r) for r in _runs(level, fanout)]
            short = level[0] if short is None and len(level) == 1 else short
        return pd.DataFrame({"tree": block["tree"].iloc[:1], "at": block["bucket"].iloc[:1], "full": level, "short": short})

    wide = nodes.select("tree", "at", F.expr(f"at div {fanout**levels}").alias("bucket"), "full", "short")
    return written(wide.groupBy("tree", "bucket").applyInPandas(run, "tree long, at long, full string, short string"), "merkle-up")


def _proofs(nodes: DataFrame, above: DataFrame, keep: list[str], fanout: int, levels: int) -> DataFrame:
    """Proofs of nodes (tree, at, full, keep) below the superblocks' roots ``above`` (tree, at, alone, subroot, root, lefts, rights)."""
    fields = [nodes.schema[k] for k in ("tree", "at", *keep)]
    schema = T.StructType([*fields, T.StructField("full", T.StringType()), T.StructField("alone", T.BooleanType()), *(above.schema[c] for c in ("subroot", "root", "lefts", "rights"))])

    def run(block: pa.Table, top: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        top = top.to_pylist()[0]
        level, places = block.column("full").to_pylist(), np.arange(block.num_rows)
        lefts, rights = ([[] for _ in range(block.num_rows)] for _ in range(2))
        alone = top["alone"] and block.num_rows == 1
        for _ in range(levels):
            if top["alone"] and len(level) == 1:
                break
            runs = _runs(level, fanout)
            for k, place in enumerate(places.tolist()):
                siblings, own = runs[place // fanout], WIDTH * (place % fanout)
                lefts[k].append(siblings[:own])
                rights[k].append(siblings[own + WIDTH :])
            level, places = [_digest(r) for r in runs], places // fanout
        made = {"full": block.column("full"), "alone": [alone] * block.num_rows, "subroot": [top["subroot"]] * block.num_rows, "root": [top["root"]] * block.num_rows}
        made |= {"lefts": [x + top["lefts"] for x in lefts], "rights": [x + top["rights"] for x in rights]}
        arrays = [*(block.column(f.name).combine_chunks() for f in fields), *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, kinds[n]) for n, c in made.items())]
        return pa.table(dict(zip(schema.names, arrays, strict=True)))

    kinds = {"alone": pa.bool_(), "subroot": pa.string(), "root": pa.string(), "lefts": pa.list_(pa.string()), "rights": pa.list_(pa.string())}
    below = nodes.select("tree", "at", *keep, "full", F.expr(f"at div {fanout**levels}").alias("bucket")).groupBy("tree", "bucket")
    return below.cogroup(above.withColumnRenamed("at", "bucket").groupBy("tree", "bucket")).applyInArrow(run, schema)


def _reduce(leaves: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The tables of nodes from the leaves to the one in which each tree has one node."""
    steps = [leaves]
    while True:
        steps.append(_collapse(steps[-1], fanout, levels))
        if not steps[-1].agg(F.max("at")).first()[0]:
            return steps


def merkle_proofs(rows: DataFrame, group: str, order: str, digest: str, keep: Sequence[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(keep, leaf, subroot, root, lefts, rights) of every row, for digests in lower-case hex.

    ``lefts`` and ``rights`` hold, for each level from the row to the root over all groups, the siblings' digests before and behind the node, joined.
    """
    own = [f"__k{k}" for k in range(len(keep))]
    plain = rows.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(digest).alias("full"), *[F.col(f"`{k}`").alias(o) for k, o in zip(keep, own, strict=True)])
    placed = in_order(plain, ["group"], ["order", "full"], label="merkle-leaves")
    leaves = placed.select(F.col("group_at").alias("tree"), F.col("row_at").alias("at"), "full", F.col("full").alias("short"), *own)
    steps = _reduce(leaves, fanout, levels)
    subroots = steps[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.col("short").alias("full"), "short")
    upper = _reduce(subroots, fanout, levels)
    none = F.array().cast("array<string>")
    above = upper[-1].select("tree", "at", F.lit(True).alias("alone"), F.lit(None).cast("string").alias("subroot"), F.col("short").alias("root"), none.alias("lefts"), none.alias("rights"))
    for step in reversed(upper[:-1]):
        above = written(_proofs(step, above, [], fanout, levels).drop("full"), "merkle-down")
    above = above.select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("alone"), "subroot", "root", "lefts", "rights")
    tops = steps[-1].select("tree", "short")
    above = above.drop("subroot").join(tops, "tree").select("tree", "at", "alone", F.col("short").alias("subroot"), "root", "lefts", "rights")
    for step in reversed(steps[1:-1]):
        above = written(_proofs(step, above, [], fanout, levels).drop("full"), "merkle-down")
    found = _proofs(leaves, above, own, fanout, levels)
    made = ["leaf", "subroot", "root", "lefts", "rights"]
    names = kept(keep, made)
    renamed = found.select(*[F.col(o).alias(k) for k, o in zip(keep, own, strict=True)], F.col("full").alias("__leaf"), *[F.col(m).alias(f"__{m}") for m in made[1:]])
    return renamed.select(*names, *[F.col(f"__{m}").alias(m) for m in made])


def fold_proof(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and the siblings of its proof give."""
    steps = F.zip_with(lefts, rights, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["a"], node, s["b"]), 256))


def proof_digest(lefts: Column, rights: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)), ""), 256)
