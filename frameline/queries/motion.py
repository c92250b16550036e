"""Alignment, errors, velocities, events and fits over the trajectory views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.operators import align, fits, sequences
from frameline.views import PRED_SQL, TRAJ_SQL, prediction, r6, table, trajectory

KEYS = ["object"]
BY_VIEW = ["object", "view"]


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = trajectory(spark, d)
    return t, prediction(t)


def position_mse(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return align.position_error(align.align_by_frame(t, p, KEYS), KEYS).withColumn("mse", r6("mse"))


def align_by_frame(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    rows = align.align_by_frame(t, p, KEYS)
    return rows.select("object", "frame", "event_id", *[r6(c).alias(c) for c in ("x", "y", "z", "p_x", "p_y", "p_z")])


def velocities(spark: SparkSession, d: str) -> DataFrame:
    return align.velocities(trajectory(spark, d), KEYS).select("object", "step", F.round("time_s", 7).alias("time_s"), *[r6(c).alias(c) for c in ("vx", "vy", "vz")])


def velocity_mse(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return align.velocity_error(t, p, KEYS).select("object", "n_steps", F.round("mse", 4).alias("mse"))


def velocity_mse_strict(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return align.velocity_error(t, p, KEYS, strict=True).select("object", "n_steps", F.round("mse", 4).alias("mse"))


def object_intersection(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return align.common_objects(t, p.filter("event_id % 3 = 0"))


def event_min_time(spark: SparkSession, d: str) -> DataFrame:
    return align.min_height_times(trajectory(spark, d), KEYS).withColumn("event_time", r6("event_time"))


def event_time_errors(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    return align.event_time_errors(t, p, KEYS).withColumn("abs_error_s", r6("abs_error_s"))


def closest_approach(spark: SparkSession, d: str) -> DataFrame:
    t = trajectory(spark, d).withColumn("pair", F.floor(F.col("object") / 2))
    return align.closest_approach(t, ["pair"]).select("pair", "first", "second", r6("time_s").alias("time_s"), r6("distance").alias("distance"))


def quadratic_fit(spark: SparkSession, d: str) -> DataFrame:
    t = trajectory(spark, d).withColumn("s", F.col("frame") / 24.0)
    f = fits.quadratic_fit(t, KEYS, "s", "z")
    return f.select("object", "n", *[F.round(c, 4).alias(c) for c in ("a", "b", "c", "rmse", "r2")])


def linear_fit(spark: SparkSession, d: str) -> DataFrame:
    t = trajectory(spark, d).withColumn("s", F.col("frame") / 24.0)
    f = fits.linear_fit(t, BY_VIEW, "s", "x").filter("n >= 3")
    return f.select("object", "view", "n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "rmse")])


def param_errors(spark: SparkSession, d: str) -> DataFrame:
    t, p = _both(spark, d)
    seconds = F.col("frame") / 24.0
    a, b = (fits.recovered_parameters(x.withColumn("time_s", seconds), KEYS) for x in (t, p))
    b = b.select("object", F.col("g").alias("g_hat"), F.col("mu").alias("mu_hat"))
    both = a.join(b, "object")
    return both.select(
        "object", F.round("g", 4).alias("g"), F.round("g_hat", 4).alias("g_hat"), F.round(F.abs(F.col("g_hat") - F.col("g")), 4).alias("g_abs"), F.round(fits.relative_error(F.col("g_hat"), F.col("g")), 3).alias("g_rel")
    )


def zone_fit(spark: SparkSession, d: str) -> DataFrame:
    t = trajectory(spark, d).withColumn("time_s", F.col("frame") / 24.0)
    return fits.zone_fit(t, KEYS, 50.0).select("object", F.round("mu_1", 4).alias("mu_1"), F.round("mu_2", 4).alias("mu_2"))


def dtw_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return sequences.dtw_distance(pairs, ["vec_id"], "a", "b").withColumn("dtw", r6("dtw"))


def dtw_trajectory(spark: SparkSession, d: str) -> DataFrame:
    def series(rows: DataFrame, name: str) -> DataFrame:
        points = F.array_sort(F.collect_list(F.struct("frame", "event_id", F.array("x", "y", "z").alias("p"))))
        return rows.groupBy("object").agg(F.flatten(F.transform(points, lambda s: s["p"])).alias(name))

    t, p = _both(spark, d)
    return sequences.dtw_distance(series(t, "a").join(series(p, "b"), "object"), KEYS, "a", "b", axes=3).withColumn("dtw", r6("dtw"))


_QUAD = """(SELECT {keys}, n, m, s1, s2, s3, s4, v0, v1, v2, vv, s4*(s2*n-s1*s1) - s3*(s3*n-s1*s2) + s2*(s3*s1-s2*s2) AS w FROM (
    SELECT {keys}, any_value(m) AS m, CAST(count(*) AS DOUBLE) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4,
        sum(v) AS v0, sum(v*u) AS v1, sum(v*u*u) AS v2, sum(v*v) AS vv
    FROM (SELECT {keys}, t - avg(t) OVER (PARTITION BY {keys}) AS u, avg(t) OVER (PARTITION BY {keys}) AS m, v FROM ({rows}))
    GROUP BY {keys}))"""
_A = "CASE WHEN n >= {least} AND abs(w) > 1e-12 * greatest(s4*s2*n, 1e-12) THEN (v2*(s2*n-s1*s1) - s3*(v1*n-s1*v0) + s2*(v1*s1-s2*v0)) / w END"
_B = "CASE WHEN n >= 3 AND abs(w) > 1e-12 * greatest(s4*s2*n, 1e-12) THEN (s4*(v1*n-s1*v0) - v2*(s3*n-s1*s2) + s2*(s3*v0-v1*s2)) / w END"
_C = "CASE WHEN n >= 3 AND abs(w) > 1e-12 * greatest(s4*s2*n, 1e-12) THEN (s4*(s2*v0-v1*s1) - s3*(s3*v0-v1*s2) + v2*(s3*s1-s2*s2)) / w END"


def _quad(rows: str, keys: str = "object") -> str:
    return _QUAD.format(keys=keys, rows=rows)


_VEL = """SELECT object, row_number() OVER (PARTITION BY object ORDER BY frame, event_id) AS step, time_s, dx/dt AS vx, dy/dt AS vy, dz/dt AS vz
    FROM (SELECT object, frame, event_id, lead(time_s) OVER w - time_s AS dt, time_s + (lead(time_s) OVER w - time_s) / 2 AS time_s,
            lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz
        FROM {t} WINDOW w AS (PARTITION BY object ORDER BY frame, event_id)) WHERE dt > 1e-9"""
_VMSE = """SELECT a.object, count(*) AS n_steps, round(avg((a.vx-b.vx)**2 + (a.vy-b.vy)**2 + (a.vz-b.vz)**2), 4) AS mse
    FROM ({a}) a JOIN ({b}) b ON a.object = b.object AND a.step = b.step GROUP BY a.object"""

QUERIES = {
    f.__name__: f
    for f in (position_mse, align_by_frame, velocities, velocity_mse, velocity_mse_strict, object_intersection, event_min_time, event_time_errors, closest_approach, quadratic_fit, linear_fit, param_errors, zone_fit, dtw_embeddings, dtw_trajectory)
}
ORACLE_SQL = {
    "position_mse": f"WITH {PRED_SQL} SELECT t.object, count(*) AS n_frames, round(avg((t.x-p.x)**2 + (t.y-p.y)**2 + (t.z-p.z)**2), 6) AS mse FROM traj t JOIN pred p ON t.object = p.object AND t.frame = p.frame GROUP BY t.object",
    "align_by_frame": f"WITH {PRED_SQL} SELECT t.object, t.frame, t.event_id, round(t.x,6) AS x, round(t.y,6) AS y, round(t.z,6) AS z, round(p.x,6) AS p_x, round(p.y,6) AS p_y, round(p.z,6) AS p_z FROM traj t JOIN pred p ON t.object = p.object AND t.frame = p.frame",
    "velocities": f"WITH {TRAJ_SQL} SELECT object, step, round(time_s,7) AS time_s, round(vx,6) AS vx, round(vy,6) AS vy, round(vz,6) AS vz FROM ({_VEL.format(t='traj')})",
    "velocity_mse": f"WITH {PRED_SQL} " + _VMSE.format(a=_VEL.format(t="traj"), b=_VEL.format(t="pred")),
    "velocity_mse_strict": f"WITH {PRED_SQL}, both_t AS (SELECT t.* FROM traj t JOIN pred p ON t.object = p.object AND t.frame = p.frame) " + _VMSE.format(a=_VEL.format(t="both_t"), b=_VEL.format(t="pred")),
    "object_intersection": f"WITH {PRED_SQL} SELECT object FROM traj INTERSECT SELECT object FROM pred WHERE event_id % 3 = 0",
    "event_min_time": f"WITH {TRAJ_SQL} SELECT object, round(time_s, 6) AS event_time FROM traj QUALIFY row_number() OVER (PARTITION BY object ORDER BY z, frame) = 1",
    "event_time_errors": f"WITH {PRED_SQL}, a AS (SELECT object, time_s FROM traj QUALIFY row_number() OVER (PARTITION BY object ORDER BY z, frame) = 1), b AS (SELECT object, time_s FROM pred QUALIFY row_number() OVER (PARTITION BY object ORDER BY z, frame) = 1) SELECT a.object, round(abs(a.time_s - b.time_s), 6) AS abs_error_s FROM a JOIN b ON a.object = b.object",
    "closest_approach": f"""WITH {TRAJ_SQL}, g AS (SELECT CAST(floor(object / 2) AS BIGINT) AS pair, min(object) AS first, max(object) AS second FROM traj GROUP BY 1 HAVING count(DISTINCT object) = 2)
        SELECT pair, first, second, round(time_s, 6) AS time_s, round(sqrt(d2), 6) AS distance FROM (
            SELECT g.*, a.frame, a.time_s, (a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2 AS d2 FROM g JOIN traj a ON a.object = g.first JOIN traj b ON b.object = g.second AND a.frame = b.frame)
        QUALIFY row_number() OVER (PARTITION BY pair ORDER BY d2, frame) = 1""",
    "quadratic_fit": f"WITH {TRAJ_SQL}, f AS (SELECT object, n, m, {_A.format(least=3)} AS a, {_B} AS b, {_C} AS c, v0, v1, v2, vv FROM {_quad('SELECT object, frame / 24.0::DOUBLE AS t, z AS v FROM traj')}) "
    "SELECT object, CAST(n AS BIGINT) AS n, round(a, 4) AS a, round(b - 2*a*m, 4) AS b, round(c - b*m + a*m*m, 4) AS c, round(sqrt(greatest(vv - (a*v2 + b*v1 + c*v0), 0) / n), 4) AS rmse, round(1 - (vv - (a*v2 + b*v1 + c*v0)) / (vv - v0*v0/n), 4) AS r2 FROM f",
    "linear_fit": f"""WITH {TRAJ_SQL}, s AS (SELECT *, frame / 24.0::DOUBLE AS s FROM traj)
        SELECT object, view, count(*) AS n, round(regr_slope(x, s), 4) AS slope, round(regr_intercept(x, s), 4) AS intercept, round(sqrt(greatest(regr_syy(x, s) - regr_slope(x, s) * regr_sxy(x, s), 0) / count(*)), 4) AS rmse
        FROM s GROUP BY object, view HAVING count(*) >= 3""",
    "param_errors": f"WITH {PRED_SQL}, a AS (SELECT object, -2 * {_A.format(least=5)} AS g FROM {_quad('SELECT object, frame / 24.0::DOUBLE AS t, z AS v FROM traj')}), b AS (SELECT object, -2 * {_A.format(least=5)} AS g FROM {_quad('SELECT object, frame / 24.0::DOUBLE AS t, z AS v FROM pred')}) "
    "SELECT a.object, round(a.g, 4) AS g, round(b.g, 4) AS g_hat, round(abs(b.g - a.g), 4) AS g_abs, round(CASE WHEN abs(a.g) > 1e-12 THEN abs(b.g - a.g) / abs(a.g) END, 3) AS g_rel FROM a JOIN b ON a.object = b.object",
    "zone_fit": f"WITH {TRAJ_SQL}, e AS (SELECT *, max(x) OVER (PARTITION BY object) AS far FROM traj), o AS (SELECT DISTINCT object FROM traj), "
    f"a AS (SELECT object, greatest(0, -2 * {_A.format(least=5)} / 9.81) AS mu, {_A.format(least=5)} AS raw FROM {_quad('SELECT object, frame / 24.0::DOUBLE AS t, x AS v FROM e WHERE x <= 50')}), "
    f"b AS (SELECT object, greatest(0, -2 * {_A.format(least=5)} / 9.81) AS mu, {_A.format(least=5)} AS raw FROM {_quad('SELECT object, frame / 24.0::DOUBLE AS t, x AS v FROM e WHERE x >= 50 AND x < far - 1e-5')}) "
    "SELECT o.object, round(CASE WHEN a.raw IS NOT NULL THEN a.mu END, 4) AS mu_1, round(CASE WHEN b.raw IS NOT NULL THEN b.mu END, 4) AS mu_2 FROM o LEFT JOIN a ON o.object = a.object LEFT JOIN b ON o.object = b.object",
}
