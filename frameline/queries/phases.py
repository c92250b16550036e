"""Parameters of motions of several phases, recovered from the trajectory view, by the methods documented for each experiment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.functions.vectors import above_floor, floor_run
from frameline.operators import phases
from frameline.queries.motion import _A, _B, _C, _quad
from frameline.views import TRAJ_SQL, table, trajectory

KEYS = ["object"]
RAMP, TILT, PLANE, LENGTH, LEVEL, REACH = 20.0, 8.0, (50.0, 60.0), 2.3, 60.0, 70.0


def _track(spark: SparkSession, d: str) -> DataFrame:
    return trajectory(spark, d).select("object", (F.col("frame") / 24.0).alias("t"), "frame", "x", "z")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring objects as two rows of one scene at each frame."""
    return _track(spark, d).select(F.expr("object div 2").alias("pair"), (F.col("object") % 2).alias("part"), "t", "x", "z")


def _rounded(df: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Floating columns at so many decimals."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kinds[c] == "double" and c not in keys else F.col(c) for c in df.columns])


def speed_break(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(phases.best_break(phases.speeds(_track(spark, d), KEYS, "t", ["x", "z"], "v"), KEYS, "t", "v"), KEYS, 3)


def ramp_floor_friction(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(phases.ramp_and_floor(_track(spark, d), KEYS, "t", "x", "z", RAMP), KEYS, 3)


def slide_friction(spark: SparkSession, d: str) -> DataFrame:
    """Steps of under 60 a second count as rest."""
    return _rounded(phases.slide_friction(_track(spark, d), KEYS, "t", "x", still=60.0), KEYS, 3)


def ball_heights(spark: SparkSession, d: str) -> DataFrame:
    """Where a ball is drawn: never deeper than its place on the floor."""
    rows = trajectory(spark, d)
    return rows.select("event_id", above_floor(F.col("z"), LEVEL, F.col("object") % 5 / 10.0).alias("height"))


def floor_lengths(spark: SparkSession, d: str) -> DataFrame:
    """The floor that each part's block needs, by its ramp and friction."""
    size = F.col("p_size").cast("double")
    run = floor_run(F.lit(6.0), size / 10, 10 + F.col("p_partkey") % 3 * 10.0, size / 100)
    return _rounded(table(spark, d, "part").select("p_partkey", run.alias("floor_run")), ["p_partkey"], 6)


def tilted_restitution(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(phases.tilted_restitution(_track(spark, d), KEYS, "t", "x", "z", TILT, PLANE, reach=10.0), KEYS, 3)


def projectile_gravity(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(phases.projectile_gravity(_track(spark, d), KEYS, "t", "z", LEVEL, REACH), KEYS, 2)


def unwrapped_angles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(phases.unwrapped_angles(_pairs(spark, d), ["pair"], "t", "part", F.lit(1), F.lit(0), "x", "z"), ["pair"], 6)


def swing_recovery(spark: SparkSession, d: str) -> DataFrame:
    angles = phases.unwrapped_angles(_pairs(spark, d), ["pair"], "t", "part", F.lit(1), F.lit(0), "x", "z")
    return _rounded(phases.swing_recovery(angles, ["pair"], "t", "angle", LENGTH), ["pair"])


def two_ball_collision(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(phases.two_ball_collision(_pairs(spark, d), ["pair"], "t", "part", F.lit(0), F.lit(1), "x"), ["pair"])


def wall_recovery(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(phases.wall_recovery(_track(spark, d), KEYS, "t", "x", "z", RAMP), KEYS, 3)


QUERIES = {f.__name__: f for f in (speed_break, ramp_floor_friction, slide_friction, ball_heights, floor_lengths, tilted_restitution, projectile_gravity, unwrapped_angles, swing_recovery, two_ball_collision, wall_recovery)}

_K = f"{TRAJ_SQL}, k AS (SELECT object, frame / 24.0::DOUBLE AS t, x, z FROM traj), steps AS (SELECT object, t - dt / 2 AS t, dx / dt AS v, sqrt(dx * dx + dz * dz) / dt AS speed FROM (SELECT object, t, t - lag(t) OVER w AS dt, x - lag(x) OVER w AS dx, z - lag(z) OVER w AS dz FROM k WINDOW w AS (PARTITION BY object ORDER BY t)) WHERE dt > 0)"


def _breaks(rows: str) -> str:
    """All breaks of each track, each fitted anew from the rows on either side."""
    side = lambda f, op: f"{f}(CASE WHEN b.t {op} a.t THEN b.speed END, CASE WHEN b.t {op} a.t THEN b.t END)"
    left = " + ".join(f"greatest({side('regr_syy', op)} - coalesce({side('regr_slope', op)} * {side('regr_sxy', op)}, 0), 0)" for op in ("<", ">="))
    return f"""tried AS (SELECT a.object, a.t AS break_at, count(CASE WHEN b.t < a.t THEN 1 END) AS n_before, count(CASE WHEN b.t >= a.t THEN 1 END) AS n_after, {side('regr_slope', '<')} AS slope_before, {side('regr_slope', '>=')} AS slope_after, {left} AS squares
        FROM {rows} a JOIN {rows} b ON a.object = b.object GROUP BY a.object, a.t HAVING count(CASE WHEN b.t < a.t THEN 1 END) >= 3 AND count(CASE WHEN b.t >= a.t THEN 1 END) >= 3),
    best AS (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY object ORDER BY squares, break_at) = 1)"""


def _flights(rows: str, height: str, reach: float) -> str:
    return f"""marked AS (SELECT *, coalesce({height} < p AND {height} <= n AND {height} <= {reach}, FALSE) AS contact FROM (SELECT *, lag({height}) OVER w AS p, lead({height}) OVER w AS n FROM {rows} WINDOW w AS (PARTITION BY object ORDER BY t))),
    parts AS (SELECT * FROM (SELECT *, count(CASE WHEN contact THEN 1 END) OVER (PARTITION BY object ORDER BY t ROWS UNBOUNDED PRECEDING) AS flight FROM marked) WHERE NOT contact)"""


def _ends(height: str, level: float) -> str:
    a, b, c = _A.format(least=3), _B, _C
    return f"""fit AS (SELECT object, flight, a, b - 2*a*m AS b, c - b*m + a*m*m AS c FROM (SELECT object, flight, n, m, {a} AS a, {b} AS b, {c} AS c FROM {_quad(f'SELECT object, flight, t, {height} AS v FROM parts', 'object, flight')}) WHERE n >= 4 AND a < -1e-12),
    ends AS (SELECT object, flight, a, (-b + speed) / (2*a) AS started, (-b - speed) / (2*a) AS ended, speed FROM (SELECT *, sqrt(CASE WHEN b*b - 4*a*(c - {level}) > 0 THEN b*b - 4*a*(c - {level}) END) AS speed FROM fit) WHERE speed IS NOT NULL)"""


_COS, _SIN = math.cos(math.radians(TILT)), math.sin(math.radians(TILT))
_RC, _RS = math.cos(math.radians(RAMP)), math.sin(math.radians(RAMP))
_ANGLES = f"""{TRAJ_SQL}, met AS (SELECT object // 2 AS pair, frame / 24.0::DOUBLE AS t, max(CASE WHEN object % 2 = 1 THEN x END) AS bx, max(CASE WHEN object % 2 = 1 THEN z END) AS bz, max(CASE WHEN object % 2 = 0 THEN x END) AS px, max(CASE WHEN object % 2 = 0 THEN z END) AS pz FROM traj GROUP BY object // 2, frame),
    raw AS (SELECT pair, t, atan2(bx - px, pz - bz) AS a FROM met WHERE bx IS NOT NULL AND px IS NOT NULL), d AS (SELECT pair, t, a, a - lag(a) OVER (PARTITION BY pair ORDER BY t) AS s FROM raw),
    u AS (SELECT pair, t, sum(coalesce(s - 2 * pi() * floor(s / (2 * pi()) + 0.5), a)) OVER (PARTITION BY pair ORDER BY t ROWS UNBOUNDED PRECEDING) AS angle FROM d)"""
ORACLE_SQL = {
    "speed_break": f"WITH {_K}, {_breaks('steps')} SELECT object, round(break_at, 3) AS break_at, n_before, n_after, round(slope_before, 3) + 0.0 AS slope_before, round(slope_after, 3) + 0.0 AS slope_after, round(squares, 3) AS squares FROM best",
    "ramp_floor_friction": f"""WITH {_K}, {_breaks('steps')}, f AS (SELECT *, greatest(0, -slope_after / 9.81::DOUBLE) AS mu FROM best)
        SELECT object, round(break_at, 3) AS break_at, round(slope_before, 3) + 0.0 AS a_ramp, round(-slope_after, 3) + 0.0 AS a_floor, round(mu, 3) AS mu, round(abs(slope_before - 9.81::DOUBLE * ({_RS}::DOUBLE - {_RC}::DOUBLE * mu)) / abs(9.81::DOUBLE * ({_RS}::DOUBLE - {_RC}::DOUBLE * mu)), 3) AS ramp_error FROM f""",
    "slide_friction": f"""WITH {_K}, h AS (SELECT object, min(CASE WHEN abs(v) < 60 THEN t END) AS stop FROM steps GROUP BY object), b AS (SELECT object, min(t) AS start FROM k GROUP BY object),
        u AS (SELECT s.object, stop, start, s.t - start AS tau, abs(v) AS v, stop IS NULL OR s.t < stop AS used FROM steps s JOIN h ON s.object = h.object JOIN b ON s.object = b.object),
        f AS (SELECT object, stop, start, CASE WHEN count(CASE WHEN used THEN 1 END) >= 3 THEN regr_intercept(CASE WHEN used THEN v END, CASE WHEN used THEN tau END) END AS v0, CASE WHEN count(CASE WHEN used THEN 1 END) >= 3 THEN regr_slope(CASE WHEN used THEN v END, CASE WHEN used THEN tau END) END AS a FROM u GROUP BY object, stop, start),
        m AS (SELECT *, CASE WHEN stop IS NULL THEN -a / 9.81::DOUBLE WHEN stop - start > 1e-12 THEN v0 / (9.81::DOUBLE * (stop - start)) END AS raw FROM f)
        SELECT object, round(stop, 3) AS stops_at, round(v0, 3) + 0.0 AS v0, round(CASE WHEN raw IS NOT NULL THEN greatest(0::DOUBLE, raw) END, 3) AS mu FROM m""",
    "ball_heights": f"WITH {TRAJ_SQL} SELECT event_id, greatest(z, object % 5 / 10.0::DOUBLE + {LEVEL}::DOUBLE) AS height FROM traj",
    "floor_lengths": """WITH p AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS len, radians(10 + p_partkey % 3 * 10.0::DOUBLE) AS a, p_size / 100.0::DOUBLE AS mu FROM part),
        v AS (SELECT *, sqrt(2 * greatest(0.08::DOUBLE, 9.81::DOUBLE * (sin(a) - mu * cos(a))) * len) * cos(a) AS v FROM p) SELECT p_partkey, round(greatest(6::DOUBLE, v * v / (2 * greatest(1e-6::DOUBLE, mu * 9.81::DOUBLE)) + 1.5::DOUBLE), 6) AS floor_run FROM v""",
    "tilted_restitution": f"""WITH {_K}, turned AS (SELECT object, t, (x - {PLANE[0]}) * {_COS}::DOUBLE + (z - {PLANE[1]}) * {_SIN}::DOUBLE AS s, (x - {PLANE[0]}) * {-_SIN}::DOUBLE + (z - {PLANE[1]}) * {_COS}::DOUBLE AS h FROM k),
        {_flights('turned', 'h', 10.0)}, {_ends('h', 0.0)},
        slides AS (SELECT object, flight, a AS sa, b - 2*a*m AS sb FROM (SELECT object, flight, n, m, {_A.format(least=3)} AS a, {_B} AS b FROM {_quad('SELECT object, flight, t, s AS v FROM parts', 'object, flight')})),
        j AS (SELECT e.object, e.flight, speed AS vn, 2 * sa * started + sb AS vt, 2 * sa * ended + sb AS arriving FROM ends e JOIN slides s ON e.object = s.object AND e.flight = s.flight),
        i AS (SELECT n.object, n.vn, p.vn AS un, n.vt, p.arriving AS ut FROM j n JOIN j p ON p.object = n.object AND p.flight = n.flight - 1)
        SELECT object, count(*) AS n_impacts, round(sum(vn * un) / sum(un * un), 3) AS e, round(CASE WHEN sum(ut * ut) > 1e-12 THEN sum(vt * ut) / sum(ut * ut) END, 3) + 0.0 AS retention FROM i GROUP BY object""",
    "projectile_gravity": f"""WITH {_K}, {_flights('k', 'z', REACH)}, {_ends('z', LEVEL)},
        p AS (SELECT object, -2 * max(CASE WHEN flight = 0 THEN a END) AS g_fit, max(CASE WHEN flight = 0 THEN ended END) AS one, coalesce(max(CASE WHEN flight = 2 THEN started END), max(CASE WHEN flight = 1 THEN ended END)) AS two, max(CASE WHEN flight = 1 THEN speed END) AS speed FROM ends GROUP BY object),
        q AS (SELECT object, g_fit, CASE WHEN two - one > 1e-12 THEN 2 * speed / (two - one) END AS g_gap FROM p), r AS (SELECT *, coalesce((g_fit + g_gap) / 2, g_fit, g_gap) AS g FROM q)
        SELECT object, round(g_fit, 2) AS g_fit, round(g_gap, 2) AS g_gap, round(g, 2) AS g, round(abs(g_fit - g_gap) / g, 2) AS disagreement FROM r WHERE g IS NOT NULL""",
    "unwrapped_angles": f"WITH {_ANGLES} SELECT pair, round(t, 6) AS t, round(angle, 6) + 0.0 AS angle FROM u",
    "swing_recovery": f"""WITH {_ANGLES}, tops AS (SELECT pair, t, a FROM (SELECT pair, t, abs(angle) AS a, lag(abs(angle)) OVER w AS p, lead(abs(angle)) OVER w AS n FROM u WINDOW w AS (PARTITION BY pair ORDER BY t)) WHERE a > p AND a >= n AND a > 0),
        dec AS (SELECT pair, count(*) AS n_peaks, CASE WHEN count(*) >= 3 THEN -regr_slope(ln(a), t) END AS gamma, avg(a / b) AS ratio FROM (SELECT *, lag(a) OVER (PARTITION BY pair ORDER BY t) AS b FROM tops) GROUP BY pair),
        cr AS (SELECT pair, CASE WHEN count(*) >= 2 THEN (max(c) - min(c)) / (count(*) - 1) END AS period FROM (SELECT pair, pt + (t - pt) * -p / (angle - p) AS c FROM (SELECT pair, t, angle, lag(angle) OVER w AS p, lag(t) OVER w AS pt FROM u WINDOW w AS (PARTITION BY pair ORDER BY t)) WHERE p < 0 AND angle >= 0) GROUP BY pair)
        SELECT dec.pair, n_peaks, round(gamma, 4) + 0.0 AS gamma, round(period, 4) AS period, round({LENGTH}::DOUBLE * ((2 * pi() / period) ** 2 + gamma ** 2), 4) AS g, round(ratio, 4) AS ratio FROM dec LEFT JOIN cr ON dec.pair = cr.pair""",
    "two_ball_collision": f"""WITH {TRAJ_SQL}, m AS (SELECT object // 2 AS pair, frame / 24.0::DOUBLE AS t, max(CASE WHEN object % 2 = 0 THEN x END) AS x1, max(CASE WHEN object % 2 = 1 THEN x END) AS x2 FROM traj GROUP BY object // 2, frame),
        n AS (SELECT * FROM m WHERE x1 IS NOT NULL AND x2 IS NOT NULL), h AS (SELECT pair, t AS hit FROM n QUALIFY row_number() OVER (PARTITION BY pair ORDER BY abs(x2 - x1), t) = 1),
        s AS (SELECT pair, t, lag(t) OVER w AS pt, (x1 - lag(x1) OVER w) / (t - lag(t) OVER w) AS v1, (x2 - lag(x2) OVER w) / (t - lag(t) OVER w) AS v2 FROM n WINDOW w AS (PARTITION BY pair ORDER BY t)),
        k AS (SELECT s.pair, hit, (t + pt) / 2 - hit AS tau, v1, v2, CASE WHEN pt > hit THEN 1 WHEN t < hit THEN 0 END AS side FROM s JOIN h ON s.pair = h.pair),
        o AS (SELECT pair, min(hit) AS hit_at, {", ".join(f"CASE WHEN count(CASE WHEN side = {side} AND abs({v}) > 1e-12 THEN tau END) >= 3 THEN sign(sum(CASE WHEN side = {side} THEN {v} END)) * exp(regr_intercept(CASE WHEN side = {side} AND abs({v}) > 1e-12 THEN ln(abs({v})) END, CASE WHEN side = {side} THEN tau END)) WHEN count(CASE WHEN side = {side} AND abs({v}) > 1e-12 THEN 1 END) = 0 AND count(CASE WHEN side = {side} THEN 1 END) >= 3 THEN 0 END AS {speed}, CASE WHEN count(CASE WHEN side = {side} AND abs({v}) > 1e-12 THEN tau END) >= 3 THEN -regr_slope(CASE WHEN side = {side} AND abs({v}) > 1e-12 THEN ln(abs({v})) END, CASE WHEN side = {side} THEN tau END) END AS {drag}" for v, side, speed, drag in (("v1", 0, "v_before", "c_0"), ("v1", 1, "v1_after", "c_1"), ("v2", 1, "v2_after", "c_2")))}
            FROM k WHERE side IS NOT NULL GROUP BY pair)
        SELECT pair, round(hit_at, 4) AS hit_at, round(v_before, 4) + 0.0 AS v_before, round(v1_after, 4) + 0.0 AS v1_after, round(v2_after, 4) + 0.0 AS v2_after, round(CASE WHEN abs(v_before) > 1e-12 THEN (v2_after - v1_after) / v_before END, 4) + 0.0 AS e, round(c_1, 4) + 0.0 AS c_1, round(c_2, 4) + 0.0 AS c_2, round(coalesce((c_1 + c_2) / 2, c_1, c_2), 4) + 0.0 AS c FROM o""",
    "wall_recovery": f"""WITH {_K}, q AS (SELECT *, lag(v) OVER w AS p, lag(t) OVER w AS pt FROM steps WINDOW w AS (PARTITION BY object ORDER BY t)), h AS (SELECT object, min(t) AS hit, arg_min(pt, t) AS last FROM q WHERE p > 0 AND v < 0 GROUP BY object),
        early AS (SELECT s.* FROM steps s JOIN h ON s.object = h.object WHERE s.t < h.last), {_breaks('early')},
        f AS (SELECT s.object, s.t - hit AS tau, abs(v) AS v, hit, break_at, slope_before, coalesce(s.t < last AND s.t >= break_at, FALSE) AS floor, s.t > hit AND v < 0 AS back FROM steps s JOIN h ON s.object = h.object LEFT JOIN best ON best.object = s.object),
        r AS (SELECT object, hit, break_at, slope_before AS a_ramp, {", ".join(f"CASE WHEN count(CASE WHEN {p} THEN 1 END) >= 3 THEN -regr_slope(CASE WHEN {p} THEN v END, CASE WHEN {p} THEN tau END) END AS a_{p}, CASE WHEN count(CASE WHEN {p} THEN 1 END) >= 3 THEN regr_intercept(CASE WHEN {p} THEN v END, CASE WHEN {p} THEN tau END) END AS v_{p}" for p in ("floor", "back"))} FROM f GROUP BY object, hit, break_at, slope_before),
        g AS (SELECT *, (a_ramp + {_RC}::DOUBLE * a_floor) / {_RS}::DOUBLE AS g FROM r)
        SELECT object, round(hit, 3) AS hit_at, round(break_at, 3) AS break_at, round(a_ramp, 3) + 0.0 AS a_ramp, round(a_floor, 3) + 0.0 AS a_floor, round(a_back, 3) + 0.0 AS a_back, round(CASE WHEN abs(v_floor) > 1e-12 THEN abs(v_back / v_floor) END, 3) AS e, round(g, 3) + 0.0 AS g, round(CASE WHEN abs(g) > 1e-12 THEN a_floor / g END, 3) + 0.0 AS mu, round(a_floor / 9.81::DOUBLE, 3) + 0.0 AS mu_rolling FROM g""",
}
