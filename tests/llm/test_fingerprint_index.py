"""The index over fingerprints: all pairs within the radius, and few others."""

from __future__ import annotations

import random

from frameline.llm.decontaminate import PAIR, PRINT, RADIUS, meeting_fingerprints, near_fingerprints


def long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_all_within_the_radius_meet_and_under_one_in_a_hundred_others(spark):
    chance = random.Random(3)
    assert 8 * (PAIR + 1) > RADIUS  # pigeonhole over the eight pairs of blocks
    items = [(k, 40 + k % 2, [chance.getrandbits(64) for _ in PRINT]) for k in range(120)]
    windows = []
    for k in range(600):
        _, size, words = items[k % 120]
        bits = chance.sample(range(256), chance.choice([0, 20, 40, RADIUS - 1, RADIUS, RADIUS, RADIUS + 1, 80]))
        near = [w ^ sum(1 << (b % 64) for b in bits if b // 64 == n) for n, w in enumerate(words)]
        windows.append((k, size, near if k % 2 else [chance.getrandbits(64) for _ in PRINT]))
    frame = lambda rows, name: spark.createDataFrame([(k, size, *map(long, words)) for k, size, words in rows], f"{name} int, size int, " + ", ".join(f"{p} long" for p in PRINT))
    pairs = {(a, b): sum((x ^ y).bit_count() for x, y in zip(p, q, strict=True)) for a, s, p in windows for b, t, q in items if s == t}
    w, i = frame(windows, "window"), frame(items, "item")
    assert {(r["window"], r["item"]) for r in near_fingerprints(w, i).collect()} == {p for p, apart in pairs.items() if apart <= RADIUS}
    met = {(r["window"], r["item"]) for r in meeting_fingerprints(w, i).collect()}
    far = [p for p, apart in pairs.items() if apart > 90]
    assert len(far) > 30_000 and sum(p in met for p in far) < 0.01 * len(far)
