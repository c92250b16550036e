"""The prefix trie against a dictionary of prefixes in plain Python."""

from __future__ import annotations

import hashlib
import zlib

from frameline.llm.prefix_trie import lookup, numbered_turns, prefix_trie, rebuilt_turns

KIND = "conv_id long, turn long, role string, text string"


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def in_turns(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    found: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found.setdefault(c, []).append((turn is not None, turn or 0, H(f"{len(role.encode())}:{role}{text}"), (role, text)))
    return {c: [t[-1] for t in sorted(ts)] for c, ts in found.items()}


def rebuilt(convs: dict[int, list]) -> dict[int, list]:
    out = {}
    for c, turns in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def trie(convs: dict[int, list]) -> list[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {n: 0 for n in members}
    for n in members:
        if n:
            kids[n[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for n, cs in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(cs) - 1) * len(n[-1][1]) if n else 0
    ends = {n: ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(n)) for n, cs in members.items()}
    return sorted((min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), kids[n], leaves[n], saved[n], H(ends[n])) for n, cs in members.items())


def nodes(df) -> list[tuple]:
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def odd_rows() -> list[tuple]:
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{'hello' if c % 3 else 'bye'} {t if c % 5 else (c, t)}") for c in [*range(0, 40), *range(100, 130), -7, -100, -107] for t in range(c % 9)]
    rows += [(500, t, "user", str(t % 2)) for t in range(150)] + [(501, t, "user", str(t % 2)) for t in range(149)]  # deep, one the other's start
    rows += [(600, None, None, None), (600, None, "user", None), (600, 3, "", "z"), (600, 3, "user", "a"), (600, 3, "user", "a"), (601, 9, "x" * 300, "é" * 100_000)]  # nulls, ties, repeated rows, a long text
    rows += [(700 + k, t, "user", f"copy {t}") for k in range(60) for t in range(7)]  # a class of copies
    rows += [(None, 1, "user", "no conversation")]
    return rows


def test_nodes_of_rebuilt_conversations(spark):
    rows = odd_rows()
    turns = numbered_turns(spark.createDataFrame(rows, KIND).repartition(5))
    wanted = rebuilt(in_turns(rows))
    assert any(not t for t in wanted.values()), "a conversation without turns is among them"
    assert nodes(prefix_trie(rebuilt_turns(turns), turns.filter("place = 0").select("conv_id"))) == trie(wanted)


def test_chunks_of_many_copies_are_hashed_as_one_list(spark):
    rows = [(k, t, "user", f"copy {t}") for k in range(700) for t in range(3)]
    turns = numbered_turns(spark.createDataFrame(rows, KIND))
    assert nodes(prefix_trie(turns, turns.filter("place = 0").select("conv_id"))) == trie(in_turns(rows))


def test_no_conversations_and_only_empty_ones(spark):
    turns = numbered_turns(spark.createDataFrame([], KIND))
    convs = turns.select("conv_id")
    assert prefix_trie(rebuilt_turns(turns), convs).count() == 0
    assert nodes(prefix_trie(turns, spark.createDataFrame([(10,), (9,)], "conv_id long"))) == [(9, 0, None, 2, 0, 1, 0, H("9,10"))]


def test_other_columns_do_not_matter(spark):
    rows = [(1, 0, "user", "a", "x", 3), (2, 0, "user", "a", "y", 4)]
    turns = numbered_turns(spark.createDataFrame(rows, f"{KIND}, digest string, place int"))
    assert nodes(prefix_trie(turns, turns.filter("place = 0").select("conv_id"))) == trie({1: [("user", "a")], 2: [("user", "a")]})


def test_lookup_splits_frequent_keys(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS v")
    facts = spark.range(3000).selectExpr("id AS k", "id * 2 AS fact")
    got = {r["v"]: r["fact"] for r in lookup(rows, ["k"], facts).collect()}
    assert got == {v: 2 * (7 if v % 3 == 0 else v) for v in range(3000)}
