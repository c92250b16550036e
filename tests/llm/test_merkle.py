"""The Merkle manifest against a plain walk over sorted leaves."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from frameline.llm.merkle import fold_proof, leaf_digest, merkle_proofs, proof_digest


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def walk(nodes: list[str], fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root and, for each node, the siblings before and behind it at each level."""
    proofs, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k : k + fanout] for k in range(0, len(level), fanout)]
        for k, p in enumerate(places):
            run = runs[p // fanout]
            proofs[k].append(("".join(run[: p % fanout]), "".join(run[p % fanout + 1 :])))
        level, places = [H("".join(r)) for r in runs], [p // fanout for p in places]
    return level[0], proofs


def manifest(rows: list[tuple], fanout: int) -> list[tuple]:
    leaves = sorted(((r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, H("".join(map(framed, r)))), r) for r in rows) if rows else []
    groups: dict = {}
    for key, row in leaves:
        groups.setdefault(key[:2], []).append((key[-1], row))
    tops = {g: walk([leaf for leaf, _ in found], fanout) for g, found in groups.items()}
    root, upper = walk([t[0] for t in tops.values()], fanout) if tops else (None, [])
    out = []
    for above, (g, found) in zip(upper, groups.items(), strict=True):
        for (leaf, row), proof in zip(found, tops[g][1], strict=True):
            out.append((row[0], leaf, tops[g][0], root, [a for a, _ in proof + above], [b for _, b in proof + above]))
    return sorted(out, key=repr)


ROWS = [(k, f"s{k % 3 if k % 2 else 0}", "en", k * 7, f"text {k} ü") for k in range(400)]
ROWS += [(None, None, None, None, None), (None, "s0", None, 1, ""), (None, "s0", None, 1, None), (7, "alone", "en", 3, "x" * 200_000), (8, "", "en", 0, "empty source"), (3, "s0", "en", 21, "other"), (9, "é", "fr", None, "l")]
ROWS += [ROWS[5]] * 40  # repeated rows are leaves of their own
KIND = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize(("fanout", "levels"), [(16, 2), (2, 3), (3, 1)])
def test_roots_and_proofs(spark, fanout, levels):
    docs = spark.createDataFrame(ROWS, KIND).repartition(7)
    leaves = docs.withColumn("digest", leaf_digest([F.col(c) for c in docs.columns]))
    out = merkle_proofs(leaves, "source", "doc_id", "digest", ["doc_id"], fanout, levels)
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["lefts"], r["rights"]) for r in out.collect()), key=repr)
    assert got == manifest(ROWS, fanout)
    folded = out.select((fold_proof(F.col("leaf"), F.col("lefts"), F.col("rights")) == F.col("root")).alias("good"), (fold_proof(F.sha2(F.col("leaf"), 256), F.col("lefts"), F.col("rights")) == F.col("root")).alias("bad"))
    assert folded.filter("NOT good OR bad").count() == 0
    wanted = {H("".join(a + b for a, b in zip(r[4], r[5], strict=True))) for r in got}
    assert {r[0] for r in out.select(proof_digest(F.col("lefts"), F.col("rights"))).collect()} == wanted


def test_many_groups_are_reduced_like_rows(spark):
    rows = [(k, f"g{k // 2}", "en", 1, "t") for k in range(700)]
    docs = spark.createDataFrame(rows, KIND)
    out = merkle_proofs(docs.withColumn("digest", leaf_digest([F.col(c) for c in docs.columns])), "source", "doc_id", "digest", ["doc_id"])
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["lefts"], r["rights"]) for r in out.collect()), key=repr)
    assert got == manifest(rows, 16)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", "leaf of it", 2.5), (2, "a", None, None)], "doc_id long, source string, leaf string, root double")
    leaves = docs.withColumn("digest", leaf_digest([F.col("doc_id")]))
    out = merkle_proofs(leaves, "source", "doc_id", "digest", ["doc_id", "leaf", "root"])
    assert out.columns == ["doc_id", "leaf_kept", "root_kept", "leaf", "subroot", "root", "lefts", "rights"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert (rows[1]["leaf_kept"], rows[1]["root_kept"], rows[2]["root_kept"]) == ("leaf of it", 2.5, None) and rows[1]["leaf"] == H("1:1")
    assert rows[1]["root"] == rows[2]["subroot"] == H(H("1:1") + H("1:2"))
    assert merkle_proofs(leaves.limit(0), "source", "doc_id", "digest", ["doc_id"]).count() == 0
