"""Gap filling, contact, rates and scores over the detection view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.operators import fits, scores, sequences, summaries, tracking
from frameline.queries.motion import _A, _B, _C, _quad
from frameline.views import DET_SQL, TRAJ_SQL, detections, r6, trajectory

KEYS = ["object"]
GROUND, WIDTH, HEIGHT = 140.0, 200.0, 160.0
LONGEST_GAP = 5  # detections missed in a row that are filled, as in the reference


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return detections(trajectory(spark, d))


def _contacts(rows: DataFrame) -> DataFrame:
    return sequences.first_contact(rows, KEYS, F.col("cy") + F.col("radius"), GROUND)


def _measures(rows: DataFrame) -> DataFrame:
    """All measures of a track in one row."""
    fitted = rows.withColumn("s", F.col("frame") / 24.0)
    quad = fits.quadratic_fit(fitted, KEYS, "s", "cy").select("object", "r2", (-2 * F.col("a")).alias("g_hat"), F.col("b").alias("v0_hat"), F.col("c").alias("h0_hat"))
    side = fits.linear_fit(fitted, KEYS, "s", "cx").select("object", F.col("rmse").alias("rmse_x"))
    out = tracking.detection_rates(rows, KEYS, WIDTH, HEIGHT)
    for part in (tracking.motion_spans(rows, KEYS), tracking.downward_rate(rows, KEYS), tracking.penetration(rows, KEYS, GROUND), tracking.bounce_height(rows, KEYS, _contacts(rows)), quad, side):
        out = out.join(part, KEYS)
    return out


def _judged(rows: DataFrame) -> DataFrame:
    """``_measures`` with the errors of the recovered parameters; objects of number 4 in 5 have no known ones."""
    n, known = F.col("object"), F.col("object") % 5 != 4
    true = {"g": (n % 7 - 3).cast("double") * 4, "v0": (n % 11).cast("double"), "h0": (n % 13 + 25).cast("double")}
    off = {k: F.when(known, F.abs(F.col(f"{k}_hat") - v)) for k, v in true.items()}
    rel = {k: F.when(F.abs(true[k]) > 1e-12, off[k] / F.abs(true[k])) for k in ("g", "h0")}
    return _measures(rows).withColumns({"g_rel": rel["g"], "v0_abs": off["v0"], "h0_rel": rel["h0"]})


def gap_interpolation(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences.fill_gaps(_rows(spark, d), KEYS, "cx", "cx_filled", most=LONGEST_GAP)
    return rows.select("object", "frame", "found", r6("cx_filled").alias("cx_filled"))


def interpolated_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences.fill_gaps(sequences.fill_gaps(_rows(spark, d), KEYS, "cx", "fx", LONGEST_GAP), KEYS, "cy", "fy", LONGEST_GAP)
    filled = ~F.col("found") & F.col("fx").isNotNull() & F.col("fy").isNotNull()
    return rows.groupBy("object").agg(F.count_if("found").alias("n_found"), F.count_if(filled).alias("n_interpolated"))


def first_contact(spark: SparkSession, d: str) -> DataFrame:
    return _contacts(_rows(spark, d))


def precontact_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return sequences.precontact_mask(rows, KEYS, _contacts(rows)).groupBy("object").agg(F.count_if("used_for_fit").alias("n_used"), F.count(F.lit(1)).alias("n_frames"))


def plateau_cut(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d).withColumn("time_s", F.col("frame") / 24.0)
    return sequences.plateau_cut(rows, KEYS, 20.0)


def contact_freeze(spark: SparkSession, d: str) -> DataFrame:
    rows = sequences.freeze_after(trajectory(spark, d), KEYS, F.col("z") >= 100, "z", "z_held")
    return rows.select("object", "frame", r6("z_held").alias("z_held"))


def swept_crossing(spark: SparkSession, d: str) -> DataFrame:
    return sequences.swept_crossings(trajectory(spark, d), KEYS, "z", 60.0).select("object", "frame", r6("crossed_at").alias("crossed_at"))


def rolling_angle(spark: SparkSession, d: str) -> DataFrame:
    return sequences.rolling_angle(trajectory(spark, d), KEYS, "x", 0.5).select("object", "frame", r6("angle").alias("angle"))


def detection_rates(spark: SparkSession, d: str) -> DataFrame:
    out = tracking.detection_rates(_rows(spark, d), KEYS, WIDTH, HEIGHT)
    return out.select("object", *[r6(c).alias(c) for c in out.columns[1:]])


def motion_spans(spark: SparkSession, d: str) -> DataFrame:
    out = tracking.motion_spans(_rows(spark, d), KEYS)
    return out.select("object", *[r6(c).alias(c) for c in out.columns[1:]])


def monotonic_rate(spark: SparkSession, d: str) -> DataFrame:
    return tracking.downward_rate(_rows(spark, d), KEYS).withColumn("monotonic_rate", r6("monotonic_rate"))


def penetration(spark: SparkSession, d: str) -> DataFrame:
    out = tracking.penetration(_rows(spark, d), KEYS, GROUND)
    return out.select("object", *[r6(c).alias(c) for c in out.columns[1:]])


def bounce_height(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    return tracking.bounce_height(rows, KEYS, _contacts(rows)).withColumn("bounce_norm", r6("bounce_norm"))


def scale_median(spark: SparkSession, d: str) -> DataFrame:
    return tracking.metric_scale(_rows(spark, d), KEYS, 0.2).withColumn("metres_per_px", F.round("metres_per_px", 8))


def pixel_to_physical(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    out = tracking.to_physical(rows, KEYS, tracking.metric_scale(rows, KEYS, 0.2), GROUND)
    return out.select("object", "frame", r6("x_m").alias("x_m"), r6("y_m").alias("y_m"))


def pixel_to_diameters(spark: SparkSession, d: str) -> DataFrame:
    out = tracking.to_diameters(_rows(spark, d), KEYS)
    return out.select("object", "frame", r6("x_d").alias("x_d"), r6("y_d").alias("y_d"))


def deduction_score(spark: SparkSession, d: str) -> DataFrame:
    measures = ["g_rel", "v0_abs", "h0_rel", "r2", "verticality", "monotonic_rate", "detection_rate", "single_object_rate", "in_frame_rate", "bounce_norm"]
    return _judged(_rows(spark, d)).select("object", scores.deduction_score(measures).alias("score"))


def weighted_score(spark: SparkSession, d: str) -> DataFrame:
    return _measures(_rows(spark, d)).select("object", F.round(scores.weighted_score(), 4).alias("score"))


def sweep_video_score(spark: SparkSession, d: str) -> DataFrame:
    return _measures(_rows(spark, d)).select("object", F.round(scores.sweep_video_score(), 4).alias("score"))


def hard_constraints(spark: SparkSession, d: str) -> DataFrame:
    checks = scores.hard_constraints()
    rows = _judged(_rows(spark, d)).select("object", *[c.alias(n) for n, c in checks.items()])
    return rows.withColumn("strict_pass", scores.strict_pass(checks))


def scaled_constraints(spark: SparkSession, d: str) -> DataFrame:
    """The same checks with a limit of the first speed that grows with the one asked for."""
    checks = scores.hard_constraints(scaled_v0=True)
    rows = _judged(_rows(spark, d)).withColumn("v0", F.col("object") % 9 / 2.0)
    rows = rows.select("object", *[c.alias(n) for n, c in checks.items()])
    return rows.select("object", "ok_v0", scores.strict_pass(checks).alias("strict_pass"))


AXES = ("g", "v0", "h0")


def axis_score(spark: SparkSession, d: str) -> DataFrame:
    """Each (axis, style) group of a sweep: the axis says which recovered parameter stands against the prompted value."""
    n = F.col("object")
    axis = F.element_at(F.array(*map(F.lit, AXES)), (n % 3 + 1).cast("int"))
    clean = (F.col("penetration_norm") <= 0.1) & (F.col("bounce_norm") <= 0.05)
    videos = _measures(_rows(spark, d)).select(
        "object", axis.alias("axis"), (F.floor(n / 3) % 2).cast("int").alias("style"), (n % 10).cast("double").alias("target"),
        F.when(n % 3 == 0, F.col("g_hat")).when(n % 3 == 1, F.col("v0_hat")).otherwise(F.col("h0_hat")).alias("estimate"),
        F.col("r2").alias("video_r2"), "detection_rate", "verticality", F.coalesce(clean, F.lit(False)).cast("double").alias("clean"), scores.sweep_video_score().alias("video_score"),
    )
    keys = ["axis", "style"]
    means = videos.groupBy(*keys).agg(
        F.avg("video_score").alias("mean_video_score"), F.avg("video_r2").alias("mean_r2"), F.avg("detection_rate").alias("mean_detection"),
        F.avg("verticality").alias("mean_verticality"), F.avg("clean").alias("clean_share"),
    )
    both = summaries.axis_regression(videos, keys, "target", "estimate", "object").join(means, keys)
    return both.select(*keys, F.col("n").alias("n_videos"), F.round("slope", 6).alias("slope"), F.round("mean_video_score", 4).alias("mean_video_score"), F.round(scores.axis_score(), 4).alias("score"))


_MEASURES = f"""{DET_SQL}, c AS (SELECT object, min(CASE WHEN cy + radius >= {GROUND} - 2 THEN frame END) AS contact_frame FROM det GROUP BY object),
    rates AS (SELECT object, avg(CAST(found AS DOUBLE)) AS detection_rate, avg(CASE WHEN found THEN CASE WHEN contours <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS single_object_rate,
        avg(CASE WHEN found THEN CASE WHEN cx - radius >= 1 AND cx + radius <= {WIDTH} - 2 AND cy - radius >= 1 AND cy + radius <= {HEIGHT} - 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS in_frame_rate,
        max(cx) - min(cx) AS x_span, max(cy) - min(cy) AS y_span, greatest(0, max(cy + radius) - {GROUND}) AS penetration_px, median(radius) AS med_r, median(2 * radius) AS med_d
        FROM det GROUP BY object),
    steps AS (SELECT object, cy - lag(cy) OVER (PARTITION BY object ORDER BY frame, event_id) AS dy, max(cy) OVER (PARTITION BY object) - min(cy) OVER (PARTITION BY object) AS span FROM det WHERE cy IS NOT NULL),
    mono AS (SELECT object, avg(CASE WHEN dy <= 0.01::DOUBLE * greatest(span, 1e-8) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS monotonic_rate FROM steps WHERE dy IS NOT NULL GROUP BY object),
    aft AS (SELECT d.object, count(CASE WHEN frame >= contact_frame THEN 1 END) AS n, max(CASE WHEN frame >= contact_frame THEN cy END) AS top, arg_min(cy, CASE WHEN frame >= contact_frame THEN frame END) AS first_cy, max(cy) - min(cy) AS span
        FROM det d LEFT JOIN c ON d.object = c.object WHERE cy IS NOT NULL GROUP BY d.object),
    bounce AS (SELECT object, CASE WHEN n >= 2 THEN (top - first_cy) / greatest(span, 1e-8) ELSE 0.0::DOUBLE END AS bounce_norm FROM aft)"""
_ALL = f"""{_MEASURES}, qf AS (SELECT object, n, m, {_A.format(least=3)} AS a, {_B} AS b, {_C} AS c, v0, v1, v2, vv FROM {_quad("SELECT object, frame / 24.0::DOUBLE AS t, cy AS v FROM det WHERE cy IS NOT NULL")}),
    q AS (SELECT object, 1 - (vv - (a*v2 + b*v1 + c*v0)) / (vv - v0*v0/n) AS r2, -2 * a AS g_hat, b - 2 * a * m AS v0_hat, c - b * m + a * m * m AS h0_hat FROM qf),
    l AS (SELECT object, sqrt(greatest(regr_syy(cx, frame / 24.0::DOUBLE) - regr_slope(cx, frame / 24.0::DOUBLE) * regr_sxy(cx, frame / 24.0::DOUBLE), 0) / count(*)) AS rmse_x FROM det WHERE cx IS NOT NULL GROUP BY object),
    every AS (SELECT r.object, detection_rate, single_object_rate, in_frame_rate, y_span, x_span / greatest(y_span, 1e-8) AS verticality, monotonic_rate, penetration_px, penetration_px / med_r AS penetration_norm, bounce_norm, r2, g_hat, v0_hat, h0_hat, rmse_x
        FROM rates r JOIN mono ON r.object = mono.object JOIN bounce ON r.object = bounce.object JOIN q ON r.object = q.object JOIN l ON r.object = l.object)"""
_JUDGED = f"""{_ALL}, known AS (SELECT object, (object % 7 - 3) * 4.0::DOUBLE AS g, CAST(object % 11 AS DOUBLE) AS v0, object % 13 + 25.0::DOUBLE AS h0 FROM every WHERE object % 5 <> 4),
    judged AS (SELECT e.*, CASE WHEN g <> 0 THEN abs(g_hat - g) / abs(g) END AS g_rel, abs(v0_hat - v0) AS v0_abs, CASE WHEN h0 <> 0 THEN abs(h0_hat - h0) / abs(h0) END AS h0_rel FROM every e LEFT JOIN known k ON e.object = k.object)"""


def _clip(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _steps(name: str) -> str:
    """The steps of a deduction, as SQL."""
    steps, sign = (scores.UPPER_STEPS[name], "<=") if name in scores.UPPER_STEPS else (scores.LOWER_STEPS[name], ">=")
    return f"CASE WHEN {name} IS NULL THEN 0 " + " ".join(f"WHEN {name} {sign} {limit} AND NOT isnan({name}) THEN {points}" for limit, points in steps[:-1]) + f" ELSE {steps[-1]} END"


_SUNK = "CASE WHEN penetration_px IS NULL OR penetration_px <= 2 THEN 0 WHEN penetration_norm <= 0.10 THEN 2 WHEN penetration_norm <= 0.25 THEN 4 ELSE 6 END"
_TAKEN = " + ".join(_steps(n) for n in ("g_rel", "v0_abs", "h0_rel", "r2", "verticality", "monotonic_rate", "detection_rate", "single_object_rate", "in_frame_rate", "bounce_norm"))
_QUALITY = _clip("(r2 - 0.90::DOUBLE) / 0.09::DOUBLE")
_WEIGHTED = (
    "0.20::DOUBLE * (0.5::DOUBLE * detection_rate + 0.25::DOUBLE * single_object_rate + 0.25::DOUBLE * in_frame_rate)"
    f" + 0.20::DOUBLE * (0.6::DOUBLE * {_clip('1 - verticality / 0.15::DOUBLE')} + 0.4::DOUBLE * {_clip('1 - rmse_x / greatest(0.05::DOUBLE * y_span, 1e-8)')})"
    f" + 0.10::DOUBLE * (0.5::DOUBLE * monotonic_rate + CASE WHEN g_hat > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) + 0.20::DOUBLE * {_QUALITY}"
    f" + 0.15::DOUBLE * CASE WHEN penetration_px <= 2 THEN 1.0::DOUBLE ELSE {_clip('1 - penetration_norm / 0.5::DOUBLE')} END"
    f" + 0.10::DOUBLE * CASE WHEN bounce_norm <= 0.02 THEN 1.0::DOUBLE ELSE {_clip('1 - bounce_norm / 0.2::DOUBLE')} END"
)
_SWEEP = (
    f"0.25::DOUBLE * (0.5::DOUBLE * detection_rate + 0.25::DOUBLE * single_object_rate + 0.25::DOUBLE * in_frame_rate) + 0.25::DOUBLE * {_QUALITY} + 0.20::DOUBLE * {_clip('1 - verticality / 0.15::DOUBLE')}"
    f" + 0.15::DOUBLE * CASE WHEN penetration_px <= 2 THEN 1.0::DOUBLE ELSE {_clip('1 - penetration_norm / 0.5::DOUBLE')} END"
    f" + 0.15::DOUBLE * CASE WHEN bounce_norm <= 0.02 THEN 1.0::DOUBLE ELSE {_clip('1 - bounce_norm / 0.2::DOUBLE')} END"
)
_CHECKS = {
    "ok_detection": "coalesce(detection_rate >= 0.90, FALSE)", "ok_single": "coalesce(single_object_rate >= 0.90, FALSE)", "ok_in_frame": "coalesce(in_frame_rate >= 0.95, FALSE)",
    "ok_vertical": "coalesce(verticality <= 0.10, FALSE)", "ok_downward": "coalesce(monotonic_rate >= 0.90, FALSE)", "ok_fit": "coalesce(r2 >= 0.98 AND NOT isnan(r2), FALSE)",
    "ok_penetration": "coalesce(penetration_px <= 2, FALSE)", "ok_bounce": "coalesce(bounce_norm <= 0.05, FALSE)", "ok_g": "g_rel <= 0.30", "ok_v0": "v0_abs <= 1.0", "ok_h0": "h0_rel <= 0.30",
}
_AXIS_SCORE = f"""{_ALL}, ax AS (SELECT object, CASE object % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'v0' ELSE 'h0' END AS axis, CAST(object // 3 % 2 AS INTEGER) AS style, CAST(object % 10 AS DOUBLE) AS target,
        CASE object % 3 WHEN 0 THEN g_hat WHEN 1 THEN v0_hat ELSE h0_hat END AS estimate, r2 AS video_r2, detection_rate, verticality,
        CASE WHEN penetration_norm <= 0.1 AND bounce_norm <= 0.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS clean, 100 * ({_SWEEP}) AS video_score FROM every),
    reg AS (SELECT axis, style, count(*) AS n_videos, regr_slope(estimate, target) AS slope, covar_pop(estimate, target) / nullif(stddev_pop(estimate) * stddev_pop(target), 0) AS pearson,
        avg(video_score) AS mean_video_score, avg(video_r2) AS mean_r2, avg(detection_rate) AS mean_detection, avg(verticality) AS mean_verticality, avg(clean) AS clean_share FROM ax GROUP BY axis, style),
    steps2 AS (SELECT axis, style, estimate - lag(estimate) OVER (PARTITION BY axis, style ORDER BY target, object) AS d FROM ax),
    mon AS (SELECT axis, style, greatest(avg(CASE WHEN d >= -1e-8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), avg(CASE WHEN d <= 1e-8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS monotonic FROM steps2 WHERE d IS NOT NULL GROUP BY axis, style)
    SELECT reg.axis, reg.style, n_videos, round(slope, 6) AS slope, round(mean_video_score, 4) AS mean_video_score,
        round(100 * (0.40::DOUBLE * {_clip("coalesce(pearson * pearson, 0)")} + 0.20::DOUBLE * abs(coalesce(pearson, 0)) + 0.15::DOUBLE * coalesce(monotonic, 0) + 0.15::DOUBLE * {_clip("(coalesce(mean_r2, 0) - 0.90::DOUBLE) / 0.09::DOUBLE")}
            + 0.10::DOUBLE * (0.4::DOUBLE * mean_detection + 0.3::DOUBLE * {_clip("1 - mean_verticality / 0.15::DOUBLE")} + 0.3::DOUBLE * clean_share)), 4) AS score
    FROM reg LEFT JOIN mon ON reg.axis = mon.axis AND reg.style = mon.style"""

QUERIES = {
    f.__name__: f
    for f in (
        gap_interpolation, interpolated_counts, first_contact, precontact_mask, plateau_cut, contact_freeze, swept_crossing, rolling_angle, detection_rates, motion_spans, monotonic_rate, penetration,
        bounce_height, scale_median, pixel_to_physical, pixel_to_diameters, deduction_score, weighted_score, sweep_video_score, hard_constraints, scaled_constraints, axis_score,
    )
}
_FILL = """SELECT object, frame, found, event_id, coalesce({v}, CASE WHEN nf - pf - 1 <= 5 THEN pv + (nv - pv) * (i - pf) / (nf - pf) END) AS {v}_filled FROM (
    SELECT *, max(CASE WHEN {v} IS NOT NULL THEN i END) OVER (PARTITION BY object ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf,
        min(CASE WHEN {v} IS NOT NULL THEN i END) OVER (PARTITION BY object ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nf,
        last_value({v} IGNORE NULLS) OVER (PARTITION BY object ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv,
        first_value({v} IGNORE NULLS) OVER (PARTITION BY object ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nv
    FROM (SELECT *, row_number() OVER (PARTITION BY object ORDER BY frame, event_id) AS i FROM det))"""
ORACLE_SQL = {
    "gap_interpolation": f"WITH {DET_SQL} SELECT object, frame, found, round(cx_filled, 6) AS cx_filled FROM ({_FILL.format(v='cx')})",
    "interpolated_counts": f"WITH {DET_SQL}, a AS ({_FILL.format(v='cx')}), b AS ({_FILL.format(v='cy')}) SELECT a.object, count(CASE WHEN a.found THEN 1 END) AS n_found, count(CASE WHEN NOT a.found AND cx_filled IS NOT NULL AND cy_filled IS NOT NULL THEN 1 END) AS n_interpolated FROM a JOIN b ON a.event_id = b.event_id GROUP BY a.object",
    "first_contact": f"WITH {_MEASURES} SELECT object, contact_frame FROM c",
    "precontact_mask": f"WITH {_MEASURES}, m AS (SELECT d.object, (contact_frame IS NULL OR frame < contact_frame) AS b FROM det d LEFT JOIN c ON d.object = c.object), k AS (SELECT object, count(*) AS n, count(CASE WHEN b THEN 1 END) AS kept FROM m GROUP BY object) SELECT object, CASE WHEN kept < 5 THEN n ELSE kept END AS n_used, n AS n_frames FROM k",
    "plateau_cut": f"""WITH {DET_SQL}, u AS (SELECT object, cy, row_number() OVER w - 1 AS place, abs(lead(cy, 1) OVER w - cy) AS d1, abs(lead(cy, 2) OVER w - lead(cy, 1) OVER w) AS d2, abs(lead(cy, 3) OVER w - lead(cy, 2) OVER w) AS d3,
            abs(cy - first_value(cy) OVER w) AS dropped FROM det WHERE frame / 24.0::DOUBLE <= 2.5 AND cy IS NOT NULL WINDOW w AS (PARTITION BY object ORDER BY frame, event_id))
        SELECT object, CAST(min(CASE WHEN d1 < 1 AND d2 < 1 AND d3 < 1 AND dropped > 16 AND place >= 8 THEN place END) AS BIGINT) AS cut FROM u GROUP BY object""",
    "contact_freeze": f"WITH {TRAJ_SQL}, h AS (SELECT *, min(CASE WHEN z >= 100 THEN frame END) OVER (PARTITION BY object) AS hit FROM traj), v AS (SELECT object, z FROM h WHERE frame = hit) SELECT h.object, h.frame, round(CASE WHEN h.frame >= h.hit THEN v.z ELSE h.z END, 6) AS z_held FROM h LEFT JOIN v ON h.object = v.object",
    "swept_crossing": f"WITH {TRAJ_SQL}, l AS (SELECT *, lag(z) OVER w AS v, lag(time_s) OVER w AS t FROM traj WINDOW w AS (PARTITION BY object ORDER BY frame)) SELECT object, frame, round(t + (v - 60) / (v - z) * (time_s - t), 6) AS crossed_at FROM l WHERE v > 60 AND z <= 60",
    "rolling_angle": f"WITH {TRAJ_SQL}, l AS (SELECT object, frame, coalesce(abs(x - lag(x) OVER (PARTITION BY object ORDER BY frame)), 0) AS s FROM traj) SELECT object, frame, round(-sum(s) OVER (PARTITION BY object ORDER BY frame ROWS UNBOUNDED PRECEDING) / 0.5, 6) + 0.0 AS angle FROM l",
    "detection_rates": f"WITH {_MEASURES} SELECT object, round(detection_rate, 6) AS detection_rate, round(single_object_rate, 6) AS single_object_rate, round(in_frame_rate, 6) AS in_frame_rate FROM rates",
    "motion_spans": f"WITH {_MEASURES} SELECT object, round(x_span, 6) AS x_span, round(y_span, 6) AS y_span, round(x_span / greatest(y_span, 1e-8), 6) AS verticality FROM rates",
    "monotonic_rate": f"WITH {_MEASURES} SELECT object, round(monotonic_rate, 6) AS monotonic_rate FROM mono",
    "penetration": f"WITH {_MEASURES} SELECT object, round(penetration_px, 6) AS penetration_px, round(penetration_px / med_r, 6) AS penetration_norm FROM rates",
    "bounce_height": f"WITH {_MEASURES} SELECT object, round(bounce_norm, 6) AS bounce_norm FROM bounce",
    "scale_median": f"WITH {_MEASURES} SELECT object, round(0.2::DOUBLE / med_d, 8) AS metres_per_px FROM rates",
    "pixel_to_physical": f"WITH {_MEASURES}, f AS (SELECT object, arg_min(cx, CASE WHEN cx IS NOT NULL THEN frame END) AS x0 FROM det GROUP BY object) SELECT d.object, d.frame, round((cx - x0) * (0.2::DOUBLE / med_d), 6) AS x_m, round(({GROUND} - cy) * (0.2::DOUBLE / med_d), 6) AS y_m FROM det d JOIN rates r ON d.object = r.object JOIN f ON d.object = f.object",
    "pixel_to_diameters": f"WITH {DET_SQL}, f AS (SELECT object, arg_min(radius, CASE WHEN radius IS NOT NULL THEN frame END) AS r FROM det GROUP BY object) SELECT d.object, d.frame, round(cx / (2 * r), 6) AS x_d, round(cy / (2 * r), 6) AS y_d FROM det d JOIN f ON d.object = f.object",
    "deduction_score": f"WITH {_JUDGED} SELECT object, CAST(greatest(0, 100 - ({_TAKEN} + {_SUNK})) AS DOUBLE) AS score FROM judged",
    "weighted_score": f"WITH {_ALL} SELECT object, round(100 * ({_WEIGHTED}) / 0.95::DOUBLE, 4) AS score FROM every",
    "sweep_video_score": f"WITH {_ALL} SELECT object, round(100 * ({_SWEEP}), 4) AS score FROM every",
    "hard_constraints": f"WITH {_JUDGED}, k AS (SELECT object, " + ", ".join(f"({c}) AS {n}" for n, c in _CHECKS.items()) + " FROM judged) SELECT *, " + " AND ".join(f"coalesce({n}, TRUE)" for n in _CHECKS) + " AS strict_pass FROM k",
    "scaled_constraints": f"WITH {_JUDGED}, k AS (SELECT object, " + ", ".join(f"({c}) AS {n}" for n, c in (_CHECKS | {"ok_v0": "v0_abs <= greatest(0.5::DOUBLE, 0.3::DOUBLE * abs(object % 9 / 2.0::DOUBLE) + 0.2::DOUBLE)"}).items()) + " FROM judged) SELECT object, ok_v0, " + " AND ".join(f"coalesce({n}, TRUE)" for n in _CHECKS) + " AS strict_pass FROM k",
    "axis_score": f"WITH {_AXIS_SCORE}",
}
