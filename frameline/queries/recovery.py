"""Parameters recovered from the trajectory view, by the methods documented for each experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.operators import fits, recovery, sequences
from frameline.queries.motion import _A, _quad
from frameline.views import TRAJ_SQL, r6, trajectory

KEYS = ["object"]
MIDDLE, FLOOR = 75.0, 100.0  # what positions swing about, and the height below which a fall is over


def _swing(spark: SparkSession, d: str) -> DataFrame:
    return trajectory(spark, d).select("object", (F.col("frame") / 24.0).alias("t"), (F.col("z") - MIDDLE).alias("u"), "x", "z")


def peak_restitution(spark: SparkSession, d: str) -> DataFrame:
    return recovery.restitution(_swing(spark, d), KEYS, "t", "z").select("object", "n_ratios", r6("e").alias("e"))


def amplitude_decay(spark: SparkSession, d: str) -> DataFrame:
    return recovery.amplitude_decay(_swing(spark, d), KEYS, "t", "u").select("object", "n_peaks", r6("gamma").alias("gamma"))


def crossing_period(spark: SparkSession, d: str) -> DataFrame:
    return recovery.crossing_period(_swing(spark, d), KEYS, "t", "u").select("object", "n_crossings", r6("period").alias("period"))


def spring_recovery(spark: SparkSession, d: str) -> DataFrame:
    return recovery.spring(_swing(spark, d), KEYS, "t", "u").select("object", r6("gamma").alias("gamma"), r6("omega0").alias("omega0"))


def phase_friction(spark: SparkSession, d: str) -> DataFrame:
    """Before and from the first crossing of the middle."""
    rows = _swing(spark, d)
    hit = rows.filter("u > 0").groupBy("object").agg(F.min("t").alias("hit"))
    both = rows.join(hit, "object", "left")
    later = F.col("hit").isNotNull() & (F.col("t") >= F.col("hit"))
    out = recovery.friction_of_phases(both, KEYS, "t", "x", {"mu_1": ~later, "mu_2": later})
    return out.select("object", r6("mu_1").alias("mu_1"), r6("mu_2").alias("mu_2"))


def speed_ratio(spark: SparkSession, d: str) -> DataFrame:
    return recovery.speed_ratio(_swing(spark, d), KEYS, "t", "x").select("object", r6("hit_at").alias("hit_at"), r6("e").alias("e"))


def gravity_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Gravity from the rows before the contact, with its error relative to 9.81."""
    rows = sequences.precontact_mask(_swing(spark, d).withColumn("frame", F.col("t") * 24), KEYS, _contact(spark, d)).filter("used_for_fit")
    g = -2 * F.col("a")
    return fits.quadratic_fit(rows, KEYS, "t", "z").select("object", r6(g).alias("g"), r6(fits.relative_error(g, F.lit(9.81))).alias("relative_error"))


def _contact(spark: SparkSession, d: str) -> DataFrame:
    return trajectory(spark, d).groupBy("object").agg(F.min(F.when(F.col("z") >= FLOOR, F.col("frame"))).alias("contact_frame"))


QUERIES = {f.__name__: f for f in (peak_restitution, amplitude_decay, crossing_period, spring_recovery, phase_friction, speed_ratio, gravity_recovery)}
_U = f"{TRAJ_SQL}, u AS (SELECT object, frame / 24.0::DOUBLE AS t, z - {MIDDLE}::DOUBLE AS u, x, z FROM traj)"
_PEAKS = "(SELECT object, t, a FROM (SELECT object, t, {a} AS a, lag({a}) OVER w AS p, lead({a}) OVER w AS n FROM u WINDOW w AS (PARTITION BY object ORDER BY t)) WHERE a > p AND a >= n)"
_DECAY = f"dec AS (SELECT object, count(*) AS n_peaks, CASE WHEN count(*) >= 3 THEN -regr_slope(ln(a), t) END AS gamma FROM {_PEAKS.format(a='abs(u)')} WHERE a > 0 GROUP BY object)"
_CROSS = """cr AS (SELECT object, count(*) AS n_crossings, CASE WHEN count(*) >= 2 THEN (max(c) - min(c)) / (count(*) - 1) END AS period FROM (
    SELECT object, pt + (t - pt) * -p / (u - p) AS c FROM (SELECT object, t, u, lag(u) OVER w AS p, lag(t) OVER w AS pt FROM u WINDOW w AS (PARTITION BY object ORDER BY t)) WHERE p < 0 AND u >= 0) GROUP BY object)"""
_SPEED = "s AS (SELECT object, t, z, (x - lag(x) OVER w) / (t - lag(t) OVER w) AS v FROM u WINDOW w AS (PARTITION BY object ORDER BY t))"
ORACLE_SQL = {
    "peak_restitution": f"WITH {_U}, r AS (SELECT object, a, lag(a) OVER (PARTITION BY object ORDER BY t) AS b FROM {_PEAKS.format(a='z')}) SELECT object, count(*) AS n_ratios, round(CASE WHEN count(*) >= 2 THEN exp(avg(ln(a / b) / 2)) END, 6) AS e FROM r WHERE a > 0 AND b > 0 GROUP BY object",
    "amplitude_decay": f"WITH {_U}, {_DECAY} SELECT object, n_peaks, round(gamma, 6) + 0.0 AS gamma FROM dec",
    "crossing_period": f"WITH {_U}, {_CROSS} SELECT object, n_crossings, round(period, 6) AS period FROM cr",
    "spring_recovery": f"WITH {_U}, {_DECAY}, {_CROSS} SELECT dec.object, round(gamma, 6) + 0.0 AS gamma, round(sqrt((2 * pi() / period) ** 2 + gamma ** 2), 6) AS omega0 FROM dec JOIN cr ON dec.object = cr.object",
    "phase_friction": f"""WITH {_U}, {_SPEED}, h AS (SELECT object, min(CASE WHEN u > 0 THEN t END) AS hit FROM u GROUP BY object), k AS (SELECT s.object, t, v, coalesce(t >= hit, FALSE) AS later FROM s JOIN h ON s.object = h.object WHERE v IS NOT NULL)
        SELECT h.object, round(CASE WHEN count(CASE WHEN NOT later THEN 1 END) >= 3 THEN greatest(0, -regr_slope(CASE WHEN NOT later THEN v END, CASE WHEN NOT later THEN t END) / 9.81::DOUBLE) END, 6) AS mu_1,
            round(CASE WHEN count(CASE WHEN later THEN 1 END) >= 3 THEN greatest(0, -regr_slope(CASE WHEN later THEN v END, CASE WHEN later THEN t END) / 9.81::DOUBLE) END, 6) AS mu_2 FROM h LEFT JOIN k ON h.object = k.object GROUP BY h.object""",
    "speed_ratio": f"WITH {_U}, {_SPEED}, q AS (SELECT object, t, v, lag(v) OVER (PARTITION BY object ORDER BY t) AS p FROM s) SELECT object, round(min(t), 6) AS hit_at, round(arg_min(-v / p, t), 6) AS e FROM q WHERE p > 0 AND v < 0 GROUP BY object",
    "gravity_recovery": f"""WITH {TRAJ_SQL}, c AS (SELECT object, min(CASE WHEN z >= {FLOOR} THEN frame END) AS contact_frame FROM traj GROUP BY object), b AS (SELECT t.object, t.frame, t.z, contact_frame IS NULL OR t.frame < contact_frame AS before, count(CASE WHEN contact_frame IS NULL OR t.frame < contact_frame THEN 1 END) OVER (PARTITION BY t.object) AS kept FROM traj t JOIN c ON t.object = c.object)
        SELECT object, round(-2 * a, 6) + 0.0 AS g, round(abs(-2 * a - 9.81::DOUBLE) / 9.81::DOUBLE, 6) AS relative_error FROM (SELECT object, {_A.format(least=3)} AS a FROM {_quad("SELECT object, frame / 24.0::DOUBLE AS t, z AS v FROM b WHERE before OR kept < 5")})""",
}
