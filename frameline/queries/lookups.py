"""Filters, paths, lookups of truths, segments and files, and manifests with lists of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.functions import text as T
from frameline.operators import lookups, summaries, tracking
from frameline.plans import manifests
from frameline.sources import readers, writers
from frameline.views import DET_SQL, TRAJ_SQL, detections, r6, table, trajectory

ROOT = "/data/runs"


def _text(*parts: Column | str) -> Column:
    """Texts that start with a quote mark are taken literally; others are columns."""
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p[0] == "'" else F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, path): files as the runs leave them, of four layouts."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    size = (F.col("p_size") % 5).cast("string")
    layouts = (
        _text("'short/m1/clip_v2_B_", "p_partkey", "'.mp4"), _text("'m1/long/m1/x_m2_", "p_partkey", "'.mp4"),
        _text("'variants/v1/v1_C/low_", size, "'/baseline_", "p_partkey", "'.blend"), _text("'videos/freefall_g9p8_h", "p_size", "'_v0_m1p", size, "'_raw_m1.mp4"),
    )
    return part.select("p_partkey", F.element_at(F.array(*layouts), (F.col("p_partkey") % 4 + 1).cast("int")).alias("path"))


def path_labels(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, d).select(
        "p_partkey", T.path_style(path, "m1").alias("style"), T.experiment_of_path(path).alias("experiment"), T.variant_of_path(path).alias("variant"),
        T.of_model(path, "m2").alias("of_m2"), T.of_model(path, "m2", in_stem=True).alias("named_m2"),
    )


def expected_from_stem(spark: SparkSession, d: str) -> DataFrame:
    found = T.expected_of_stem(T.stem(F.col("path")))
    return _paths(spark, d).select("p_partkey", *[c.alias(n) for n, c in found.items()])


def path_roots(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(f"{ROOT}/"), "path")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/other/"), "path")).otherwise(F.col("path"))
    whole = T.resolved(given, ROOT)
    return _paths(spark, d).select("p_partkey", whole.alias("whole"), T.below(whole, ROOT).alias("relative"))


def first_present(spark: SparkSession, d: str) -> DataFrame:
    """The first key that is there counts, even where its value is null."""
    null = F.lit(None).cast("double")
    a, b, c = (F.create_map(F.lit(k), v) for k, v in (("v0", F.col("p_size") / 2.0), ("speed", F.col("p_size") * 1.0), ("v0", null)))
    values = F.element_at(F.array(a, b, F.map_concat(b, c), F.create_map(F.lit("g"), F.lit(9.81))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.first_present(values, ["v0", "speed"], -1.0).alias("value"))


def kernel_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.odd(F.col("p_size")).alias("kernel"))


def cycle_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.cycles_text(F.col("p_size") / 8.0, (F.col("p_partkey") % 9 - 1).cast("double")).alias("cycles"))


def coerced_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means over what can be read as a number; a group without any has null."""
    shown = F.when((F.col("p_partkey") % 3 == 0) | (F.col("p_size") <= 5), "n/a").otherwise(F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_size", shown.alias("shown")).groupBy("p_size").agg(summaries.numeric_mean("shown").alias("mean"))


def included_rows(spark: SparkSession, d: str) -> DataFrame:
    return lookups.included(trajectory(spark, d), {"view": ["click", "purchase"], "object": []}).select("object", "view", "event_id")


def scene_files(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 4).alias("k"), (F.col("p_partkey") % 3 + 1).alias("v"), "p_size")
    letter = F.element_at(F.split(F.lit("A,B,C,D"), ","), (F.col("p_size") % 4 + 1).cast("int"))
    varied = _text(f"'{ROOT}/variants/v", "v", "'/v", "v", "'_", letter, "'/low_", F.col("k").cast("string"), "'/baseline_", "p_partkey", "'.blend")
    base = _text(f"'{ROOT}/v", "v", "'/baseline_v", "v", "'_", letter, "'_", "p_partkey", "'.blend")
    files = part.select(F.when(F.col("k") == 0, base).when(F.col("k") == 1, F.replace(varied, F.lit("baseline_"), F.lit("draft_"))).otherwise(varied).alias("path"))
    return readers.scene_files(files, ROOT, ["v1", "v2"], experiments=["v1_A", "v2_B", "v2_C"], variants=["baseline", "low_2"])


def newest_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "part").select(_text("'d", "p_size", "'/f", "p_partkey", "'.mp4").alias("path"), (F.col("p_partkey") % 17).alias("modified"))
    return readers.newest_file(files)


def located_videos(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey")
    named = lambda folder, n: part.filter(F.col("p_partkey") % n == 0).select(_text(f"'{ROOT}/{folder}", "p_partkey", "'.mp4").alias("path"))
    files = named("videos/", 4).unionByName(named("", 6)).unionByName(named("a/b/", 5)).unionByName(named("a/a/", 10))
    return lookups.video_of_job(part, "p_partkey", files, ROOT)


def model_sources(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("org/"), F.when(F.col("n_nationkey") == 7, "runs").otherwise(F.lower("n_name"))).alias("model"))
    there = table(spark, d, "nation").filter("n_regionkey = 2").select(F.concat(F.lit(f"{ROOT}/"), F.lower("n_name")).alias("path"))
    return lookups.model_source(jobs, "model", there.unionByName(there.select(F.lit(ROOT).alias("path"))), ROOT)


def truth_lookup(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    hidden = F.create_map(F.lit("g"), size / 2, F.lit("e"), F.when(F.col("p_partkey") % 3 != 0, F.lit(0.0)))
    fitted = F.create_map(F.lit("g"), size / 4 + 1, F.lit("e"), F.lit(0.5), F.lit("mu"), F.lit(0.1))
    rows = table(spark, d, "part").select("p_partkey", hidden.alias("hidden"), fitted.alias("fitted"))
    return lookups.truth_errors(rows, ["p_partkey"], "fitted", "hidden").withColumn("rel_error", r6("rel_error"))


def segment_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Frames in one of four phases of their object's time, with gaps between the phases."""
    t = trajectory(spark, d).select("object", "frame", "time_s")
    whole = t.groupBy("object").agg(F.max("time_s").alias("last"))
    phases = whole.select("object", "last", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    start = F.col("last") * F.col("place") / 4.0
    phases = phases.select("object", "place", start.alias("t0"), (start + F.col("last") / 8.0).alias("t1"))
    return lookups.segment_of(t, phases, ["object"], "time_s").select("object", "frame", "place")


def motion_extents(spark: SparkSession, d: str) -> DataFrame:
    """Extents of the detected motion in object diameters, of the median radius of the first rows."""
    rows = tracking.to_diameters(detections(trajectory(spark, d)), ["object"], robust=True).filter("found")
    return summaries.motion_extents(rows, ["object"], "x_d", "y_d").select("object", *[r6(c).alias(c) for c in ("vertical", "horizontal")], F.round("ratio", 4).alias("ratio"))


def phase_summary(spark: SparkSession, d: str) -> DataFrame:
    """Every order is a job: a third have no target, some an estimate that is not finite, some ended with an error."""
    orders = table(spark, d, "orders")
    failed = orders.filter("o_orderkey % 11 = 0")
    results = orders.filter("o_orderkey % 11 <> 0").select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 50).alias("target"),
        F.when(F.col("o_orderkey") % 13 == 0, float("nan")).otherwise(F.col("o_totalprice") / 1000).alias("estimate"), (F.col("o_custkey") % 7 / 7.0).alias("detection"),
    )
    out = summaries.phase_summary(results, failed, "target", "estimate", ["detection"])
    return out.select("num_results", "num_errors", "num_valid", *[r6(c).alias(c) for c in ("mean_detection", "pearson", "spearman", "slope", "intercept", "r2")])


def manifest_allow_lists(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    lists = lambda *values: F.array(*[F.lit(v) for v in values])
    exps = table(spark, d, "nation").select(
        F.col("n_name").alias("exp"), n.alias("place"), F.when(n % 3 == 0, lists("m2", "m9")).when(n % 3 == 2, lists("m2", "m1")).alias("models"),
        F.when(n % 4 == 0, lists("short")).when(n == 6, lists("none")).alias("styles"), F.when(n % 5 == 2, n * 20).alias("seed"),
    )
    return manifests.allowed_jobs(exps, ["m1", "m2"], ["explicit", "short"], 2, 100)


def image_manifest(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    variants = nation.select(F.lit("v1_A").alias("exp"), F.col("n_name").alias("variant"), (F.col("n_nationkey") / 2.0).alias("target"))
    folder = F.concat(F.lit("seeds/v1/v1_A/"), "variant", F.lit("/side"))
    at = lambda n, file: nation.filter(F.col("n_nationkey") % n != 1).select(F.concat(F.lit("seeds/v1/v1_A/"), "n_name", F.lit(f"/side/{file}")).alias("path"))
    files = at(4, "last.png").unionByName(at(3, "seed_10frames.mp4")).unionByName(at(2, "prompt.md"))
    return manifests.image_manifest(variants, files, folder, "last.png", "m1", 42, 2)


def build_plan(spark: SparkSession, d: str) -> DataFrame:
    own = F.create_map(F.lit("low"), F.lit(1.0), F.lit("high"), F.lit(2.0))
    more = F.create_map(F.lit("mid"), F.lit(1.5))
    scripts = table(spark, d, "nation").select(
        F.col("n_name").alias("exp"), F.concat(F.lit("v"), F.col("n_regionkey")).alias("version"), F.lit("scene.py").alias("script"), F.lower("n_name").alias("stem"),
        F.when(F.col("n_nationkey") % 2 == 0, own).otherwise(F.map_concat(own, more)).alias("variants"),
    )
    return manifests.build_commands(scripts, "render", "out")


def params_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("experiment_id"), F.lit(24).alias("fps"), F.col("p_size").alias("frame_end"), F.create_map(F.lit("g"), F.col("p_size") / 2.0, F.lit("e"), F.lit(0.5)).alias("all_physics")
    )
    return writers.params_documents(rows, ["g", "absent"], ["e"])


QUERIES = {
    f.__name__: f
    for f in (
        path_labels, expected_from_stem, path_roots, first_present, kernel_sizes, cycle_words, coerced_mean, included_rows, scene_files, newest_files, located_videos, model_sources, truth_lookup,
        segment_lookup, motion_extents, phase_summary, manifest_allow_lists, image_manifest, build_plan, params_documents,
    )
}
_PATHS = """paths AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 'short/m1/clip_v2_B_' || p_partkey || '.mp4' WHEN 1 THEN 'm1/long/m1/x_m2_' || p_partkey || '.mp4'
    WHEN 2 THEN 'variants/v1/v1_C/low_' || (p_size % 5) || '/baseline_' || p_partkey || '.blend' ELSE 'videos/freefall_g9p8_h' || p_size || '_v0_m1p' || (p_size % 5) || '_raw_m1.mp4' END AS path FROM part)"""
_PAIRS = "ok AS (SELECT CAST(o_custkey % 50 AS DOUBLE) AS x, o_totalprice / 1000 AS y FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 13 <> 0)"
_RANKS = "rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM ok)"
ORACLE_SQL = {
    "path_labels": f"WITH {_PATHS} SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'unknown' END AS style, CASE p_partkey % 4 WHEN 0 THEN 'v2_B' WHEN 2 THEN 'v1_C' ELSE 'unknown' END AS experiment, CASE WHEN starts_with(path, 'variants/') THEN string_split(path, '/')[4] ELSE 'baseline' END AS variant, list_contains(string_split(path, '/'), 'm2') AS of_m2, contains(path, 'm2') AS named_m2 FROM paths",
    "expected_from_stem": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 9.8::DOUBLE END AS g, CASE WHEN p_partkey % 4 = 3 THEN CAST(p_size AS DOUBLE) END AS h0, CASE WHEN p_partkey % 4 = 3 THEN CAST('-1.' || (p_size % 5) AS DOUBLE) END AS v0 FROM part",
    "path_roots": f"WITH {_PATHS} SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN '/other/' ELSE '{ROOT}/' END || path AS whole, CASE WHEN p_partkey % 3 <> 1 THEN path END AS relative FROM paths",
    "first_present": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size / 2.0::DOUBLE WHEN 1 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN NULL ELSE -1.0::DOUBLE END AS value FROM part",
    "kernel_sizes": "SELECT p_partkey, p_size + 1 - p_size % 2 AS kernel FROM part",
    "cycle_words": "WITH c AS (SELECT p_partkey, p_partkey % 9 - 1 AS s, p_size / 8.0::DOUBLE * (p_partkey % 9 - 1) / (2 * pi()) AS c FROM part) SELECT p_partkey, CASE WHEN s <= 0 THEN 'several' WHEN c < 1.5 THEN 'about 1' WHEN c < 2.5 THEN 'about 2' WHEN c < 3.5 THEN 'about 3' ELSE 'about ' || CAST(round_even(c, 0) AS BIGINT) END AS cycles FROM c",
    "coerced_mean": "SELECT p_size, avg(CASE WHEN p_partkey % 3 <> 0 AND p_size > 5 THEN CAST(p_size AS DOUBLE) END) AS mean FROM part GROUP BY p_size",
    "included_rows": "SELECT user_id AS object, event_type AS view, event_id FROM events WHERE event_type IN ('click', 'purchase')",
    "scene_files": f"WITH p AS (SELECT p_partkey, p_partkey % 4 AS k, 'v' || (p_partkey % 3 + 1) AS v, 'v' || (p_partkey % 3 + 1) || '_' || substr('ABCD', p_size % 4 + 1, 1) AS e FROM part) SELECT CASE k WHEN 0 THEN '{ROOT}/' || v || '/baseline_' || e || '_' || p_partkey || '.blend' ELSE '{ROOT}/variants/' || v || '/' || e || '/low_' || k || '/baseline_' || p_partkey || '.blend' END AS path, v AS version, e AS experiment, CASE k WHEN 0 THEN 'baseline' ELSE 'low_2' END AS variant FROM p WHERE k IN (0, 2) AND e IN ('v1_A', 'v2_B', 'v2_C')",
    "newest_files": "SELECT 'd' || p_size AS folder, 'd' || p_size || '/f' || p_partkey || '.mp4' AS path FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 17 DESC, 'd' || p_size || '/f' || p_partkey || '.mp4' DESC) = 1",
    "located_videos": f"WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'videos/' WHEN p_partkey % 6 = 0 THEN '' WHEN p_partkey % 10 = 0 THEN 'a/a/' WHEN p_partkey % 5 = 0 THEN 'a/b/' END AS f FROM part) SELECT p_partkey, '{ROOT}/' || f || p_partkey || '.mp4' AS path, CASE WHEN f IS NULL THEN 'FileNotFoundError: missing video for job id: ' || p_partkey END AS error FROM p",
    "model_sources": f"SELECT n_nationkey, 'org/' || CASE n_nationkey WHEN 7 THEN 'runs' ELSE lower(n_name) END AS model, CASE WHEN n_nationkey = 7 THEN '{ROOT}' WHEN n_regionkey = 2 THEN '{ROOT}/' || lower(n_name) ELSE 'org/' || lower(n_name) END AS source FROM nation",
    "truth_lookup": "SELECT p_partkey, 'g' AS parameter, p_size / 4.0::DOUBLE + 1 AS estimate, p_size / 2.0::DOUBLE AS truth, abs(p_size / 4.0::DOUBLE + 1 - p_size / 2.0::DOUBLE) AS abs_error, round(abs(p_size / 4.0::DOUBLE + 1 - p_size / 2.0::DOUBLE) / (p_size / 2.0::DOUBLE), 6) AS rel_error FROM part UNION ALL SELECT p_partkey, 'e', 0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, NULL FROM part WHERE p_partkey % 3 <> 0",
    "segment_lookup": f"WITH {TRAJ_SQL}, w AS (SELECT object, max(time_s) AS last FROM traj GROUP BY object) SELECT t.object, t.frame, CASE WHEN time_s <= last / 8 THEN 0 WHEN time_s >= last * 1 / 4 AND time_s <= last * 1 / 4 + last / 8 THEN 1 WHEN time_s >= last * 2 / 4 AND time_s <= last * 2 / 4 + last / 8 THEN 2 ELSE 3 END AS place FROM traj t JOIN w ON t.object = w.object",
    "motion_extents": f"WITH {DET_SQL}, s AS (SELECT object, 2 * coalesce(median(CASE WHEN frame <= 12 THEN radius END), median(radius)) AS d FROM det GROUP BY object), e AS (SELECT det.object, coalesce(max(cy / d) - min(cy / d), 0) AS v, coalesce(max(cx / d) - min(cx / d), 0) AS h FROM det JOIN s ON det.object = s.object WHERE found GROUP BY det.object) SELECT object, round(v, 6) AS vertical, round(h, 6) AS horizontal, round(h / greatest(v, 1e-8), 4) AS ratio FROM e",
    "phase_summary": f"WITH {_PAIRS}, {_RANKS}, r AS (SELECT count(*) AS num_results, avg(o_custkey % 7 / 7.0::DOUBLE) AS det FROM orders WHERE o_orderkey % 11 <> 0), l AS (SELECT count(*) AS num_valid, corr(y, x) AS p, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM ok) SELECT num_results, (SELECT count(*) FROM orders WHERE o_orderkey % 11 = 0) AS num_errors, num_valid, round(det, 6) AS mean_detection, round(p, 6) AS pearson, round((SELECT corr(rx, ry) FROM rk), 6) AS spearman, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(p * p, 6) AS r2 FROM r, l",
    "manifest_allow_lists": "WITH e AS (SELECT n_name AS exp, n_nationkey AS n, CASE n_nationkey % 3 WHEN 0 THEN ['m2'] WHEN 1 THEN ['m1', 'm2'] ELSE ['m2', 'm1'] END AS ms, CASE WHEN n_nationkey % 4 = 0 THEN ['short'] WHEN n_nationkey = 6 THEN [] ELSE ['explicit', 'short'] END AS ss, CASE WHEN n_nationkey % 5 = 2 THEN n_nationkey * 20 END AS own FROM nation), m AS (SELECT exp, n, own, ss, unnest(ms) AS model, generate_subscripts(ms, 1) AS a FROM e), s AS (SELECT exp, n, own, model, a, unnest(ss) AS style, generate_subscripts(ss, 1) AS b FROM m), k AS (SELECT *, row_number() OVER (ORDER BY n, a, b, r) - 1 AS k FROM s, (VALUES (0), (1)) t(r)), u AS (SELECT *, coalesce(own, k + greatest(100, coalesce(max(own - k) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100))) AS seed FROM k) SELECT exp || '__' || style || '__' || model || '__s' || seed AS id, exp, model, style, CAST(seed AS BIGINT) AS seed FROM u",
    "image_manifest": "WITH v AS (SELECT n_nationkey AS n, n_name AS v, 'seeds/v1/v1_A/' || n_name || '/side' AS f FROM nation), s AS (SELECT v.*, t.s AS seed FROM v, (VALUES (42), (43)) t(s) WHERE n % 4 <> 1 UNION ALL SELECT v.*, NULL FROM v WHERE n % 4 = 1) SELECT 'v1_A' AS exp, v AS variant, n / 2.0::DOUBLE AS target, 'v1_A_' || v || '_m1_s' || seed AS job_id, seed, CASE WHEN n % 4 <> 1 THEN f || '/last.png' END AS image, CASE WHEN n % 3 <> 1 THEN f || '/seed_10frames.mp4' END AS video, CASE WHEN n % 2 <> 1 THEN f || '/prompt.md' END AS prompt, CASE WHEN n % 4 = 1 THEN 'FileNotFoundError: ' || f || '/last.png' END AS error FROM s",
    "build_plan": "WITH v AS (SELECT n_name AS e, 'v' || n_regionkey AS ver, lower(n_name) AS stem, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['low', 'high'] ELSE ['low', 'high', 'mid'] END) AS v FROM nation), f AS (SELECT *, 'out/' || ver || '/' || e || '/' || v || '/' || stem || '_' || v || '.blend' AS file FROM v) SELECT e AS exp, v AS variant, 'render -b --python ' || ver || '/scene.py -- --variant-id ' || v || ' --output-file ' || CASE WHEN contains(file, ' ') THEN '\"' || file || '\"' ELSE file END AS command FROM f",
    "params_documents": """SELECT CAST(p_partkey AS VARCHAR) AS experiment_id, '{"experiment_id":"' || p_partkey || '","fps":24,"frame_end":' || p_size || ',"hidden_params":{"g":' || CAST(p_size / 2.0::DOUBLE AS VARCHAR) || '},"known_params":{"e":0.5},"all_physics":{"g":' || CAST(p_size / 2.0::DOUBLE AS VARCHAR) || ',"e":0.5}}' AS document FROM part""",
}
