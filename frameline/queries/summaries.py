"""Cross-view statistics, styles, rankings, regressions and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameline.operators import align, fits, outcomes, summaries
from frameline.queries.motion import _A, _quad
from frameline.views import PRED_SQL, TRAJ_SQL, prediction, r6, table, trajectory


def _view_errors(spark: SparkSession, d: str) -> DataFrame:
    t = trajectory(spark, d)
    return align.position_error(align.align_by_frame(t, prediction(t), ["object", "view"]), ["object", "view"])


def cross_view_consistency(spark: SparkSession, d: str) -> DataFrame:
    rows = trajectory(spark, d).withColumn("parameter", F.concat(F.lit("p"), F.col("object") % 3))
    means = rows.groupBy("object", "parameter", "view").agg(F.avg("z").alias("estimate"))
    out = summaries.cross_view(means, ["object"], "parameter", "estimate")
    return out.select("object", "parameter", "n_views", *[r6(c).alias(c) for c in ("mean", "variance", "range")])


def cross_view_map(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.cross_view_map(trajectory(spark, d), ["object"], "view", "z")
    return out.select("object", F.array_join(F.transform(F.map_entries("by_name"), lambda e: F.format_string("%s=%.9f", e["key"], e["value"])), ";").alias("by_name"))


def coverage_antijoin(spark: SparkSession, d: str) -> DataFrame:
    t = trajectory(spark, d)
    return summaries.coverage(t.select("object", "view").distinct(), t.filter("event_id % 4 = 0"), ["object", "view"])


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    """A row for each view: the metrics of its first object, how many objects it has, and how many parameters and events of that object have errors."""
    t = trajectory(spark, d)
    p = prediction(t)
    params = fits.recovered_parameters(t, ["object"]).join(fits.recovered_parameters(p, ["object"]).toDF("object", "g_hat", "mu_hat"), "object")
    counts = params.select("object", sum((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("long") for a, b in (("g", "g_hat"), ("mu", "mu_hat"))).alias("param_error_count"))
    events = align.event_time_errors(t, p, ["object"]).groupBy("object").agg(F.count("abs_error_s").alias("event_error_count"))
    rows = _view_errors(spark, d).groupBy("view").agg(F.min("object").alias("object"), r6(F.min_by("mse", "object")).alias("mse"), F.count(F.lit(1)).alias("n_objects"))
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("param_error_count", "event_error_count")}
    return rows.join(counts, "object", "left").join(events, "object", "left").select("view", "object", "mse", "n_objects", *[c.alias(n) for n, c in none.items()])


def view_errors(spark: SparkSession, d: str) -> DataFrame:
    return _view_errors(spark, d).withColumn("mse", r6("mse"))


def style_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", "value", (F.get_json_object("props", "$.k").cast("double")).alias("k"), (F.col("value") > 50).alias("ok"))
    out = summaries.style_summary(rows, "event_type", ["value", "k"], "ok")
    return out.select("event_type", "n", *[r6(c).alias(c) for c in ("mean_value", "mean_k", "pass_rate")])


def ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("score"))
    return summaries.ranked(rows, "score", "user_id").select("rank", "user_id", "score")


def ranking_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return summaries.ranking_lines(rows, "user_id", "score")


def topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)


def largest_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The row of the largest area (here value) of each frame's group, the first on ties."""
    rows = table(spark, d, "events")
    return rows.groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))


def seed_frames(spark: SparkSession, d: str) -> DataFrame:
    return trajectory(spark, d).filter("frame <= 10").select("object", "frame", "event_id")


def render_inventory(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("l_quantity").cast("long")).alias("total_bytes"))


def render_inventory_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.col("l_quantity").cast("long")).alias("total_bytes"))


def _axis(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return rows.select("o_orderkey", F.col("o_orderpriority").alias("axis"), (F.col("o_custkey") % 50).cast("double").alias("target"), (F.col("o_totalprice") / 1000).alias("estimate"))


def axis_regression(spark: SparkSession, d: str) -> DataFrame:
    out = summaries.axis_regression(_axis(spark, d), ["axis"], "target", "estimate", "o_orderkey")
    return out.select("axis", "n", *[r6(c).alias(c) for c in ("slope", "intercept", "r2", "pearson", "monotonic")])


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return summaries.spearman(_axis(spark, d), ["axis"], "target", "estimate").select("axis", r6("spearman").alias("spearman"))


def monotonic_score(spark: SparkSession, d: str) -> DataFrame:
    from frameline.operators.sequences import monotonic_share

    return monotonic_share(trajectory(spark, d), ["object"], "z", "frame").withColumn("monotonic", r6("monotonic"))


def phase_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts, mean and correlations over all results that are finite."""
    rows = _axis(spark, d).filter(F.col("estimate").isNotNull() & ~F.isnan("estimate") & (F.abs("estimate") < float("inf")))
    whole = rows.withColumn("everything", F.lit(1))
    from frameline.operators.fits import guarded_corr

    return whole.groupBy("everything").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("estimate")).alias("mean_estimate"), r6(guarded_corr("target", "estimate")).alias("pearson"), r6(F.regr_slope("estimate", "target")).alias("slope"), r6(F.regr_intercept("estimate", "target")).alias("intercept")).drop("everything")


LEAST_FRAMES = 8


def _fitted(spark: SparkSession, d: str) -> DataFrame:
    """The fall of each view's track as an outcome: too short a track, one without extent, and one whose rows have no number are errors."""
    rows = outcomes.parsed(table(spark, d, "events"), "props", "k double", "read", "why")
    tracks = rows.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("why").alias("unread"), F.min("why").alias("why"), F.count("read.k").alias("known"), (F.max("value") - F.min("value")).alias("extent"), F.regr_slope("value", "read.k").alias("slope")
    )
    said = F.concat(F.lit(f"ValueError: {LEAST_FRAMES} frames needed, "), F.col("n").cast("string"), F.lit(" found"))
    checks = [(F.col("unread") == 0, F.col("why")), (F.col("n") >= LEAST_FRAMES, said), (F.col("known") == F.col("n"), "KeyError: k"), (F.col("extent") > 1e-8, "ValueError: no extent"), (F.col("slope").isNotNull(), "ValueError: one value of k")]
    return outcomes.outcomes(tracks, ["user_id", "event_type"], checks, {"n": F.col("n"), "slope": r6("slope")})


def error_channel(spark: SparkSession, d: str) -> DataFrame:
    """Tracks that can't be fitted become rows with an error instead of ending the batch."""
    return _fitted(spark, d)


def error_counts(spark: SparkSession, d: str) -> DataFrame:
    """Results and errors of each view, from one run of the batch."""
    good, bad = outcomes.split_outcomes(_fitted(spark, d))
    counts = bad.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_errors"), F.count_distinct("error").alias("n_messages"))
    return good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_results")).join(counts, "event_type", "full").select("event_type", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_results", "n_errors", "n_messages")])


def run_log_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "skip").otherwise("error").alias("status"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that have no finished output yet."""
    jobs = table(spark, d, "orders").select("o_orderkey")
    done = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return jobs.join(done, "o_orderkey", "left_anti")


def view_priority(spark: SparkSession, d: str) -> DataFrame:
    """Of each object's candidates, the first by a fixed order of preference."""
    order = F.when(F.col("view") == "purchase", 0).when(F.col("view") == "click", 1).otherwise(2)
    w = Window.partitionBy("object").orderBy(order, "view", "event_id")
    return trajectory(spark, d).withColumn("r", F.row_number().over(w)).filter("r = 1").select("object", "view", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        cross_view_consistency, cross_view_map, coverage_antijoin, batch_summary, view_errors, style_summary, ranking, ranking_lines, topk, largest_per_group, seed_frames, render_inventory,
        render_inventory_rollup, axis_regression, spearman, monotonic_score, phase_report, error_channel, error_counts, run_log_counts, resume_pending, view_priority,
    )
}
_AXIS = "ax AS (SELECT o_orderkey, o_orderpriority AS axis, CAST(o_custkey % 50 AS DOUBLE) AS target, o_totalprice / 1000 AS estimate FROM orders)"
_ERR = "e AS (SELECT t.object, t.view, count(*) AS n_frames, avg((t.x-p.x)**2 + (t.y-p.y)**2 + (t.z-p.z)**2) AS mse FROM traj t JOIN pred p ON t.object = p.object AND t.view = p.view AND t.frame = p.frame GROUP BY t.object, t.view)"
_CORR = "covar_pop(estimate, target) / nullif(stddev_pop(estimate) * stddev_pop(target), 0)"
_MONO = "m AS (SELECT axis, avg(CASE WHEN d >= -1e-8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS up, avg(CASE WHEN d <= 1e-8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS down FROM (SELECT axis, estimate - lag(estimate) OVER (PARTITION BY axis ORDER BY target, o_orderkey) AS d FROM ax) WHERE d IS NOT NULL GROUP BY axis)"
_REG = f"r AS (SELECT axis, count(*) AS n, regr_slope(estimate, target) AS slope, regr_intercept(estimate, target) AS intercept, {_CORR} AS pearson FROM ax GROUP BY axis)"
_OUTCOMES = f"""r AS (SELECT user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), s AS (SELECT user_id, event_type, count(*) AS n, count(k) AS known, max(value) - min(value) AS extent, regr_slope(value, k) AS slope FROM r GROUP BY user_id, event_type),
    w AS (SELECT *, CASE WHEN n < {LEAST_FRAMES} THEN 'ValueError: {LEAST_FRAMES} frames needed, ' || CAST(n AS VARCHAR) || ' found' WHEN known < n THEN 'KeyError: k' WHEN extent <= 1e-8 THEN 'ValueError: no extent' WHEN slope IS NULL THEN 'ValueError: one value of k' END AS error FROM s),
    o AS (SELECT user_id, event_type, CASE WHEN error IS NULL THEN n END AS n, CASE WHEN error IS NULL THEN round(slope, 6) + 0.0 END AS slope, error FROM w)"""
ORACLE_SQL = {
    "cross_view_consistency": f"WITH {TRAJ_SQL}, m AS (SELECT object, 'p' || CAST(object % 3 AS VARCHAR) AS parameter, view, avg(z) AS e FROM traj GROUP BY 1, 2, 3) SELECT object, parameter, count(*) AS n_views, round(avg(e), 6) AS mean, round(var_pop(e), 6) AS variance, round(max(e) - min(e), 6) AS range FROM m GROUP BY object, parameter HAVING count(*) >= 2",
    "cross_view_map": f"WITH {TRAJ_SQL}, m AS (SELECT object, view, avg(z) AS e FROM traj GROUP BY 1, 2) SELECT object, string_agg(view || '=' || printf('%.9f', e), ';' ORDER BY view) AS by_name FROM m GROUP BY object",
    "coverage_antijoin": f"WITH {TRAJ_SQL} SELECT DISTINCT object, view FROM traj t WHERE NOT EXISTS (SELECT 1 FROM traj u WHERE u.object = t.object AND u.view = t.view AND u.event_id % 4 = 0)",
    "batch_summary": f"""WITH {PRED_SQL}, {_ERR}, {", ".join(f"{n} AS (SELECT object, {_A.format(least=5)} AS a FROM {_quad(f'SELECT object, time_s AS t, {c} AS v FROM {t}')})" for n, c, t in (("zt", "z", "traj"), ("zp", "z", "pred"), ("xt", "x", "traj"), ("xp", "x", "pred")))}
        , c AS (SELECT zt.object, CASE WHEN zt.a + zp.a IS NULL THEN 0 ELSE 1 END + CASE WHEN xt.a + xp.a IS NULL THEN 0 ELSE 1 END AS k FROM zt JOIN zp ON zt.object = zp.object JOIN xt ON zt.object = xt.object JOIN xp ON zt.object = xp.object)
        , g AS (SELECT view, min(object) AS object, round(arg_min(mse, object), 6) AS mse, count(*) AS n_objects FROM e GROUP BY view)
        SELECT g.*, CAST(coalesce(k, 0) AS BIGINT) AS param_error_count, CAST(1 AS BIGINT) AS event_error_count FROM g LEFT JOIN c ON g.object = c.object""",
    "view_errors": f"WITH {PRED_SQL}, {_ERR} SELECT object, view, n_frames, round(mse, 6) AS mse FROM e",
    "style_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pass_rate FROM events GROUP BY event_type",
    "ranking": "SELECT row_number() OVER (ORDER BY score DESC, user_id) AS rank, user_id, score FROM (SELECT user_id, round(sum(value), 4) AS score FROM events GROUP BY user_id)",
    "ranking_lines": "WITH s AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS score FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, user_id) AS rank FROM s) SELECT rank, printf('%d. %s: %.2f', rank, CAST(user_id AS VARCHAR), score) AS line FROM r",
    "topk": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "largest_per_group": "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1",
    "seed_frames": f"WITH {TRAJ_SQL} SELECT object, frame, event_id FROM traj WHERE frame <= 10",
    "render_inventory": "SELECT l_returnflag, l_linestatus, count(*) AS n_files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_bytes FROM lineitem GROUP BY 1, 2",
    "render_inventory_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n_files, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_bytes FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "axis_regression": f"WITH {_AXIS}, {_REG}, {_MONO} SELECT r.axis, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(pearson * pearson, 6) AS r2, round(pearson, 6) AS pearson, round(greatest(up, down), 6) AS monotonic FROM r LEFT JOIN m ON r.axis = m.axis",
    "spearman": f"WITH {_AXIS}, k AS (SELECT axis, rank() OVER (PARTITION BY axis ORDER BY target) + (count(*) OVER (PARTITION BY axis, target) - 1) / 2.0::DOUBLE AS target, rank() OVER (PARTITION BY axis ORDER BY estimate) + (count(*) OVER (PARTITION BY axis, estimate) - 1) / 2.0::DOUBLE AS estimate FROM ax) SELECT axis, round({_CORR}, 6) AS spearman FROM k GROUP BY axis",
    "monotonic_score": f"WITH {TRAJ_SQL}, s AS (SELECT object, z - lag(z) OVER (PARTITION BY object ORDER BY frame) AS d FROM traj) SELECT object, round(greatest(avg(CASE WHEN d >= -1e-8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), avg(CASE WHEN d <= 1e-8 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS monotonic FROM s WHERE d IS NOT NULL GROUP BY object",
    "phase_report": f"WITH {_AXIS} SELECT count(*) AS n, round(avg(estimate), 6) AS mean_estimate, round({_CORR}, 6) AS pearson, round(regr_slope(estimate, target), 6) AS slope, round(regr_intercept(estimate, target), 6) AS intercept FROM ax",
    "error_channel": f"WITH {_OUTCOMES} SELECT * FROM o",
    "error_counts": f"WITH {_OUTCOMES} SELECT event_type, count(*) - count(error) AS n_results, count(error) AS n_errors, count(DISTINCT error) AS n_messages FROM o GROUP BY event_type",
    "run_log_counts": "SELECT CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'skip' ELSE 'error' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "resume_pending": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')",
    "view_priority": f"WITH {TRAJ_SQL} SELECT object, view, event_id FROM traj QUALIFY row_number() OVER (PARTITION BY object ORDER BY CASE view WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, view, event_id) = 1",
}
