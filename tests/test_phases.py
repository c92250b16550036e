"""Parameters of planted motions of several phases are recovered; breaks equal those found by trying each anew."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameline.functions.vectors import above_floor, dot, floor_run
from frameline.operators import phases

FPS = 96.0


def track(spark, rows, kind="k int, t double, x double, z double"):
    return spark.createDataFrame(rows, kind).repartition(3)


def one(df):
    return {r["k"]: r for r in df.collect()}


def test_vectors(spark):
    r = spark.range(1).select(dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(-1.0))).alias("d"), above_floor(F.lit(0.1), 1.0, F.lit(0.5)).alias("y"), floor_run(F.lit(4.0), F.lit(3.0), F.lit(20.0), F.lit(0.1)).alias("long"), floor_run(F.lit(40.0), F.lit(3.0), F.lit(20.0), F.lit(0.1)).alias("set")).first()
    down = 9.81 * (math.sin(math.radians(20)) - 0.1 * math.cos(math.radians(20)))
    assert (r["d"], r["y"], r["set"]) == (1.0, 1.5, 40.0) and r["long"] == pytest.approx(2 * down * 3 * math.cos(math.radians(20)) ** 2 / (2 * 0.981) + 1.5)


def test_breaks_equal_every_break_tried_anew(spark):
    chance, rows = random.Random(5), []
    for k, n in ((1, 40), (2, 7), (3, 6), (4, 5), (5, 0), (6, 25)):
        rows += [(k, i / 10, chance.gauss(3 * abs(i - n / 3), 2) if k != 6 else 4.0) for i in range(n)]
    rows += [(1, 99.0, None), (1, None, 3.0)]
    got = one(phases.best_break(spark.createDataFrame(rows, "k int, t double, v double"), ["k"], "t", "v"))
    assert sorted(got) == [1, 2, 3, 6]
    for k in (1, 2, 3):
        pts = sorted((t, v) for q, t, v in rows if q == k and t is not None and v is not None)
        costs = []
        for cut in range(3, len(pts) - 2):
            fits = [np.polyfit(*zip(*part, strict=True), 1, full=True) for part in (pts[:cut], pts[cut:])]
            costs.append((sum(float(f[1][0]) if len(f[1]) else 0.0 for f in fits), pts[cut][0], fits[0][0][0], fits[1][0][0]))
        least = min(costs)
        assert got[k]["break_at"] == least[1] and [got[k][c] for c in ("squares", "slope_before", "slope_after")] == pytest.approx([least[0], least[2], least[3]], abs=1e-6)
    assert got[6]["break_at"] == pytest.approx(0.3) and got[6]["n_before"] == 3  # all breaks are equal: the first


def ramp(mu, g=9.81, degrees=20.0, length=3.0, seconds=6.0):
    """Along a ramp, then along the floor: (t, x, z)."""
    a, s = math.radians(degrees), math.sin(math.radians(degrees))
    down = g * (s - mu * math.cos(a))
    end = math.sqrt(2 * length / down)
    speed = down * end
    for i in range(int(seconds * FPS)):
        t = i / FPS
        way = 0.5 * down * t * t if t < end else length
        run = 0.0 if t < end else speed * (t - end) - 0.5 * mu * g * (t - end) ** 2 if t - end < speed / (mu * g) else speed * speed / (2 * mu * g)
        if t - end < speed / (mu * g):
            yield t, way * math.cos(a) + run, 5 - way * s


def test_friction_of_ramp_and_floor(spark):
    rows = [(k, t, x, z) for k, mu in ((1, 0.12), (2, 0.24)) for t, x, z in ramp(mu)]
    got = one(phases.ramp_and_floor(track(spark, rows), ["k"], "t", "x", "z"))
    for k, mu in ((1, 0.12), (2, 0.24)):
        assert got[k]["mu"] == pytest.approx(mu, abs=2e-3) and got[k]["ramp_error"] < 0.02


def test_friction_of_slides_that_stop_and_that_do_not(spark):
    rows = []
    for k, mu, v0 in ((1, 0.3, 5.0), (2, 0.04, 5.0), (3, 0.0, 2.0)):
        end = v0 / (mu * 9.81) if mu else math.inf
        rows += [(k, i / FPS, v0 * min(i / FPS, end) - 0.5 * mu * 9.81 * min(i / FPS, end) ** 2, 0.0) for i in range(400)]
    rows += [(4, i / FPS, 1.0, 0.0) for i in range(9)] + [(5, 0.0, 1.0, 0.0)]
    got = one(phases.slide_friction(track(spark, rows), ["k"], "t", "x"))
    assert got[1]["mu"] == pytest.approx(0.3, rel=1e-2) and got[1]["v0"] == pytest.approx(5.0, rel=1e-6) and got[1]["stops_at"] == pytest.approx(5 / (0.3 * 9.81), abs=2 / FPS)
    assert got[2]["mu"] == pytest.approx(0.04, abs=1e-9) and got[2]["stops_at"] is None and got[3]["mu"] == pytest.approx(0.0, abs=1e-9)
    assert got[4]["mu"] is None and 5 not in got


def bounces(e, g=9.81, v=6.0, seconds=6.0):
    t0 = 0.0
    while t0 < seconds and v > 0.3:
        flight = 2 * v / g
        yield t0, flight, v
        t0, v = t0 + flight, v * e


def test_restitution_on_a_tilted_plane(spark):
    rows, tilt, keep = [], math.radians(8.0), 0.9
    for k, e in ((1, 0.8), (2, 0.6)):
        gn, gt = 9.81 * math.cos(tilt), -9.81 * math.sin(tilt)
        s, vt = 0.0, 1.5
        for t0, flight, v in bounces(e, gn):
            for i in range(math.ceil(t0 * FPS), math.ceil((t0 + flight) * FPS)):
                u = i / FPS - t0
                d, along = v * u - 0.5 * gn * u * u, s + vt * u + 0.5 * gt * u * u
                rows.append((k, i / FPS, 1.0 + along * math.cos(tilt) - d * math.sin(tilt), 2.0 + along * math.sin(tilt) + d * math.cos(tilt)))
            s, vt = s + vt * flight + 0.5 * gt * flight * flight, keep * (vt + gt * flight)
    got = one(phases.tilted_restitution(track(spark, rows), ["k"], "t", "x", "z", 8.0, (1.0, 2.0), reach=0.2))
    for k, e in ((1, 0.8), (2, 0.6)):
        assert got[k]["e"] == pytest.approx(e, abs=1e-6) and got[k]["retention"] == pytest.approx(keep, abs=1e-6) and got[k]["n_impacts"] >= 3


def test_gravity_of_a_projectile_by_two_estimates(spark):
    rows = [(1, i / FPS, 0.0, v * (i / FPS - t0) - 0.5 * 7.5 * (i / FPS - t0) ** 2) for t0, flight, v in bounces(0.74, 7.5) for i in range(math.ceil(t0 * FPS), math.ceil((t0 + flight) * FPS))]
    rows += [(2, i / FPS, 0.0, 3.0 - 0.5 * 4.9 * (i / FPS) ** 2) for i in range(90)]  # does not land
    got = one(phases.projectile_gravity(track(spark, rows), ["k"], "t", "z", 0.0, 0.2))
    assert [got[1][c] for c in ("g_fit", "g_gap", "g")] == pytest.approx([7.5] * 3, abs=1e-6) and got[1]["disagreement"] < 1e-6
    assert got[2]["g"] == pytest.approx(4.9, abs=1e-6) and got[2]["g_gap"] is None and got[2]["disagreement"] is None


def swing(rows, k, angle, length=2.3):
    for i in range(int(10 * FPS)):
        t = i / FPS
        rows += [(k, t, "pivot", 0.5, 4.8), (k, t, "ball", 0.5 + length * math.sin(angle(t)), 4.8 - length * math.cos(angle(t)))]


def test_angles_past_half_a_turn_and_gravity_of_a_swing(spark):
    rows, gamma = [], 0.12
    damped = math.sqrt(9.81 / 2.3 - gamma * gamma)
    swing(rows, 1, lambda t: 0.4 * math.exp(-gamma * t) * math.cos(damped * t))
    swing(rows, 2, lambda t: 1.3 * t * t - 0.5 * t)  # turns over, again and again
    swing(rows, 3, lambda t: -2.0 * t)
    rows += [(1, 99.0, "ball", 1.0, 1.0), (4, 0.0, "pivot", None, 1.0)]
    angles = phases.unwrapped_angles(track(spark, rows, "k int, t double, part string, x double, z double"), ["k"], "t", "part", F.lit("ball"), F.lit("pivot"), "x", "z")
    turned = {(r["k"], r["t"]): r["angle"] for r in angles.filter("k IN (2, 3)").collect()}
    assert all(a == pytest.approx(1.3 * t * t - 0.5 * t if k == 2 else -2.0 * t, abs=1e-9) for (k, t), a in turned.items()) and max(turned.values()) > 100
    got = one(phases.swing_recovery(angles, ["k"], "t", "angle", 2.3))
    assert got[1]["gamma"] == pytest.approx(gamma, abs=5e-3) and got[1]["g"] == pytest.approx(9.81, rel=5e-3)
    assert got[1]["ratio"] == pytest.approx(math.exp(-gamma * math.pi / damped), rel=5e-3)


def test_two_balls(spark):
    rows, e, c, v0 = [], 0.7, 0.25, 3.0
    hit = 1.003
    before = v0 * math.exp(-c * hit)
    way = lambda v, t: v / c * (1 - math.exp(-c * t))
    at = way(v0, hit)
    v1, v2 = before * (1 - e) / 2, before * (1 + e) / 2
    for i in range(400):
        t = i / FPS
        rows += [(1, t, "one", way(v0, t) if t < hit else at + way(v1, t - hit), 0.0), (1, t, "two", at if t < hit else at + way(v2, t - hit), 0.0), (2, t, "one", t, 0.0)]
    got = one(phases.two_ball_collision(track(spark, rows, "k int, t double, part string, x double, z double"), ["k"], "t", "part", F.lit("one"), F.lit("two"), "x"))
    assert sorted(got) == [1] and got[1]["hit_at"] == pytest.approx(hit, abs=1 / FPS)
    assert got[1]["e"] == pytest.approx(e, abs=1e-2) and [got[1][k] for k in ("c_1", "c_2", "c")] == pytest.approx([c] * 3, abs=1e-4)
    rest = [(3, i / FPS, p, float(i) if p == "one" and i < 50 else 50.0, 0.0) for i in range(100) for p in ("one", "two")]
    still = one(phases.two_ball_collision(track(spark, rest, "k int, t double, part string, x double, z double"), ["k"], "t", "part", F.lit("one"), F.lit("two"), "x"))[3]
    assert still["v1_after"] == 0.0 and still["c_1"] is None


def test_wall(spark):
    rows, mu, g, e = [], 0.18, 7.5, 0.6
    floor, wall = None, None
    path = list(ramp(mu, g, seconds=9.0))
    start = 3.0 * math.cos(math.radians(20))
    for t, x, z in path:
        if x > start + 2.0:
            break
        rows.append((1, t, x, z))
        floor, wall = t, x
    down = g * (math.sin(math.radians(20)) - mu * math.cos(math.radians(20)))
    speed = math.sqrt(2 * 3.0 * down) - mu * g * (floor - math.sqrt(2 * 3.0 / down))
    back = e * speed
    for i in range(1, int(back / (mu * g) * FPS)):
        rows.append((1, floor + i / FPS, wall - back * i / FPS + 0.5 * mu * g * (i / FPS) ** 2, path[-1][2]))
    got = one(phases.wall_recovery(track(spark, rows), ["k"], "t", "x", "z"))[1]
    assert got["g"] == pytest.approx(g, rel=1e-2) and got["mu"] == pytest.approx(mu, rel=1e-2) and got["e"] == pytest.approx(e, rel=2e-2)
    assert got["a_back"] == pytest.approx(got["a_floor"], rel=1e-2) and got["mu_rolling"] == pytest.approx(mu * g / 9.81, rel=1e-2)


def test_empty_tracks(spark):
    rows = track(spark, [])
    pairs = track(spark, [], "k int, t double, part string, x double, z double")
    assert phases.ramp_and_floor(rows, ["k"], "t", "x", "z").count() == phases.wall_recovery(rows, ["k"], "t", "x", "z").count() == 0
    assert phases.tilted_restitution(rows, ["k"], "t", "x", "z", 8.0, (0.0, 0.0), 0.1).count() == phases.projectile_gravity(rows, ["k"], "t", "z", 0.0, 0.1).count() == 0
    assert phases.two_ball_collision(pairs, ["k"], "t", "part", F.lit("a"), F.lit("b"), "x").count() == 0


def test_half_a_turn_goes_round_as_the_c_library_says(spark):
    def about(places, k=1):
        return [(k, float(i), part, x, z) for i, place in enumerate(places) for part, x, z in (("pivot", 0.0, 0.0), ("ball", *place))]

    # across the pivot: by Java's atan2 the way there is the other way round
    rows = about([(9.48, 20.740000000000002), (-18.96, -41.480000000000004)]) + about([(0.1, 0.3)] + [(0.3, -0.1), (0.1, 0.3), (-0.3, 0.1), (-0.1, -0.3), (0.3, -0.1), (0.1, 0.3)] * 200, k=2)
    angles = phases.unwrapped_angles(track(spark, rows, "k int, t double, part string, x double, z double"), ["k"], "t", "part", F.lit("ball"), F.lit("pivot"), "x", "z")
    found = {(r["k"], r["t"]): r["angle"] for r in angles.collect()}
    first, second = math.atan2(9.48, -20.740000000000002), math.atan2(-18.96, 41.480000000000004)
    step = second - first
    assert found[1, 0.0] == first and found[1, 1.0] == pytest.approx(first + step - 2 * math.pi * math.floor(step / (2 * math.pi) + 0.5), abs=1e-12)
    home = [a for (k, t), a in found.items() if k == 2 and t % 6 == 0]
    turns = [(a - math.atan2(0.1, -0.3)) / (2 * math.pi) for a in home]
    assert len(home) == 201 and sorted(round(n) for n in turns) == list(range(min(map(round, turns)), max(map(round, turns)) + 1))
    assert all(a == math.atan2(0.1, -0.3) - 2 * math.pi * -round(n) for a, n in zip(home, turns, strict=True))
