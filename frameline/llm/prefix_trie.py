"""The trie of the turns that conversations share at their start, by prefix doubling.

Equal turns get equal names, then equal pairs of neighbouring names, equal pairs of pairs, and so on: after as many rounds as the longest conversation
has binary digits, every aligned block of a power of two turns has a name. Names are dense and in order (``in_order``), an absent half is 0, and so the
last name of a conversation is its place in lexicographic order. Equal conversations are one class from then on, which counts for all its members. A
prefix of d turns is made of one block for each binary digit of d; rounds by the number of digits name the prefixes, and rows of equal
depth and name are a node.

In lexicographic order the conversations of a node are neighbours, and nodes by their first class and depth are in preorder, in which a subtree is
a run. Sums over subtrees are therefore differences of running totals, however deep the trie is.

One conversation, turn, opening or class may hold any share of all rows: names come from sorted ranges without a join back, and joins to
facts about a key split off the keys that hold over a thousandth of the rows (fewer than a thousand keys, whose facts are broadcast).

Edge cases: null roles and texts are empty; rows without a conversation are left out; turns of equal number follow each other by the digest of
role and text, repeated rows are turns of their own; conversations without turns are members of the root alone; a table without conversations has no
nodes, not even a root; texts of any length are compared by SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameline.llm.common import written
from frameline.operators.ordering import in_order

CHUNK = 128  # ids that are joined before they are hashed


def lookup(rows: DataFrame, keys: list[str], facts: DataFrame) -> DataFrame:
    """Inner join of rows with facts, one for each key. Keys with over a thousandth of the rows, fewer than a thousand, are joined by broadcast."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    limit = sizes.agg(F.sum("__n")).first()[0] or 0
    frequent = written(sizes.filter(F.col("__n") > limit // 1000 + 1).select(*keys), "frequent")
    if frequent.isEmpty():
        return rows.join(facts, keys)
    hot = rows.join(F.broadcast(facts.join(F.broadcast(frequent), keys)), keys)
    return hot.unionByName(rows.join(F.broadcast(frequent), keys, "left_anti").join(facts, keys))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars) of the turns of each conversation, numbered from 0 by turn, nulls first."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return in_order(turns, ["conv_id"], ["turn", "digest"], label="turns").select("conv_id", F.col("row_at").alias("place"), "digest", "chars")


def rebuilt_turns(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Turns of each conversation c after its first h are replaced by the first h of conversation c - c % every; h is crc32(c) % most."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    firsts = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    borrowers = turns.filter("place = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    borrowed = borrowers.join(firsts, "base").filter(F.col("place") < h).select(*turns.columns)  # a base serves fewer than 2 * every conversations
    both = borrowed.union(turns.filter(F.col("place") >= h))
    return in_order(both, ["conv_id"], ["place"], label="rebuilt").select("conv_id", F.col("row_at").alias("place"), "digest", "chars")


def named_blocks(turns: DataFrame) -> list[DataFrame]:
    """For each power of two a table (conv_id, block, name, chars, n, whole) of the aligned blocks of so many turns; the last has a block for each conversation."""
    first = in_order(turns, ["digest"], ["conv_id", "place"], label="blocks")
    levels = [first.select("conv_id", F.col("place").alias("block"), (F.col("group_at") + 1).alias("name"), "chars", F.lit(1).cast("long").alias("n"), F.lit(True).alias("whole"))]
    while levels[-1].agg(F.max("block")).first()[0]:
        half = lambda odd: F.max(F.when(F.col("block") % 2 == odd, F.col("name")))
        pairs = levels[-1].groupBy("conv_id", F.expr("block div 2").alias("pair")).agg(
            half(0).alias("left"), F.coalesce(half(1), F.lit(0)).alias("right"), F.max_by("chars", "block").alias("chars"), F.sum("n").alias("n"), (F.bool_and("whole") & (F.count(F.lit(1)) == 2)).alias("whole")
        )
        placed = in_order(pairs, ["left", "right"], ["conv_id", "pair"], label="blocks")
        levels.append(placed.select("conv_id", F.col("pair").alias("block"), (F.col("group_at") + 1).alias("name"), "chars", "n", "whole"))
    return levels


def named_prefixes(levels: list[DataFrame], classes: DataFrame) -> DataFrame:
    """(conv_id, depth, node, chars, rank, copies, length) of every prefix of one conversation of each class; equal prefixes of a depth have equal nodes."""
    last = [
        t.filter("whole AND block % 2 = 0").select("conv_id", F.shiftleft(F.col("block") + 1, k).alias("depth"), F.shiftleft("block", k).alias("before"), "name", "chars") for k, t in enumerate(levels)
    ]  # the last block of each prefix: the lowest digit of its depth
    ends = written(reduce(DataFrame.union, last), "block-ends")  # lookup reads it more than once
    steps = written(lookup(ends, ["conv_id"], classes.filter("length > 0")), "steps")
    digits = F.bit_count("depth")
    named = [steps.filter(digits == 1).withColumn("node", F.col("name")).drop("name", "before")]
    for k in range(2, (steps.agg(F.max(digits)).first()[0] or 0) + 1):
        shorter = named[-1].select("conv_id", F.col("depth").alias("before"), F.col("node").alias("shorter"))
        placed = in_order(steps.filter(digits == k).join(shorter, ["conv_id", "before"]), ["depth", "shorter", "name"], ["conv_id"], label="prefixes")
        named.append(placed.withColumn("node", F.col("group_at")).select(named[0].columns))
    return reduce(DataFrame.union, named)


def ends_digests(members: DataFrame) -> DataFrame:
    """(rank, ends_sha256): SHA-256 of each class's ids in order, joined by commas. Ids are joined in chunks before a class meets in one task, which reads them as a stream."""
    placed = in_order(members, ["rank"], ["conv_id"], label="members").withColumn("chunk", F.expr(f"row_at div {CHUNK}"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = placed.groupBy("rank", "chunk").agg(ids.alias("ids")).repartition("rank").sortWithinPartitions("rank", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for rank, ids in zip(batch.column("rank").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if rank == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = rank, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["rank", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], names=["rank", "ends_sha256"])

    return chunks.mapInArrow(run, "rank long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node of the trie over conversations ``convs`` (conv_id, once each) and their ``turns`` (conv_id, place from 0, digest, chars).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member; the number of turns; the parent's smallest
    member; members; children; childless nodes of the subtree; what sharing saves in the subtree, of each node's last turn once for every
    member but one; digest of the ids of the members that end here.
    """
    levels = named_blocks(turns)
    top = levels[-1].select("conv_id", F.col("name").alias("rank"), "n")
    members = written(convs.join(top, "conv_id", "left").select("conv_id", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("n", F.lit(0)).alias("n")), "members")
    classes = members.groupBy("rank").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("length"))
    classes = written(classes, "classes")
    prefixes = written(named_prefixes(levels, classes), "prefixes")
    ended = F.max(F.when(F.col("depth") == F.col("length"), F.col("rank"))).alias("ended")
    facts = [F.sum("copies").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.max("chars").alias("chars"), ended]
    root = classes.withColumns({"depth": F.lit(0).cast("long"), "node": F.lit(0).cast("long"), "chars": F.lit(0).cast("long")})
    nodes = written(prefixes.groupBy("depth", "node").agg(*facts).union(root.groupBy("depth", "node").agg(*facts)), "nodes")

    of_shorter = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    linked = nodes.filter("depth > 0").select("conv_id", "depth").join(of_shorter, ["conv_id", "depth"], "left")
    linked = written(linked.select("conv_id", "depth", (F.col("depth") - 1).alias("above"), F.coalesce("parent", F.lit(0)).alias("parent")), "linked")
    children = linked.groupBy(F.col("above").alias("depth"), F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    named = nodes.select(F.col("depth").alias("above"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = lookup(linked, ["above", "parent"], named).select("conv_id", "depth", "parent_conv_id")

    counted = nodes.join(children, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    counted = counted.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    placed = in_order(counted, [], ["low", "depth"], totals=["leaf", "saved"], label="preorder")
    upto = placed.groupBy(F.col("low").alias("high")).agg(*[F.max(F.col(f"{c}_before") + F.col(c)).alias(f"{c}_upto") for c in ("leaf", "saved")])
    summed = lookup(placed.drop("low"), ["high"], upto)
    ends = summed.filter("ended IS NOT NULL").join(ends_digests(members.select("conv_id", "rank")).withColumnRenamed("rank", "ended"), "ended")
    empty = F.sha2(F.lit(""), 256).alias("ends_sha256")
    done = ends.unionByName(summed.filter("ended IS NULL").select("*", empty)).join(parents, ["conv_id", "depth"], "left")
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaf_upto") - F.col("leaf_before")).alias("n_leaves"), (F.col("saved_upto") - F.col("saved_before")).alias("saved_tokens"), "ends_sha256",
    )
