"""Job manifests and render plans: products of small lists by explode and counters by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameline.plans import manifests
from frameline.views import r2, r6, table, trajectory

STYLES, SEEDS = ("explicit", "short"), (1, 2, 3)


def manifest_cross_product(spark: SparkSession, d: str) -> DataFrame:
    exps = table(spark, d, "nation").select(F.col("n_name").alias("exp"), F.col("n_nationkey").alias("place"))
    return manifests.job_manifest(exps, "exp", "place", ["m1", "m2"], list(STYLES), list(SEEDS)).select("id", "exp", "model", "style", "seed")


def seed_counter(spark: SparkSession, d: str) -> DataFrame:
    exps = table(spark, d, "nation").select(F.col("n_name").alias("exp"), F.col("n_nationkey").alias("place"))
    jobs = manifests.job_manifest(exps, "exp", "place", ["m1", "m2"], list(STYLES), list(SEEDS))
    return manifests.with_counter(jobs, ["place", "model_at", "style_at", "seed_at"], "counter", 1000).select("id", "counter")


def sweep_manifest(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "region").select(F.col("r_name").alias("id"), F.create_map(F.lit("g"), F.lit(9.81), F.lit("v0"), F.lit(0.0), F.lit("h0"), F.lit(2.0)).alias("base"))
    out = manifests.sweep_manifest(base, {"g": [1.5, 9.81], "v0": [0.0, 3.0], "colour": [1.0]})
    return out.select("job", "axis", "value", *[F.element_at("parameters", k).alias(k) for k in ("g", "v0", "h0")])


def render_plan(spark: SparkSession, d: str) -> DataFrame:
    t = trajectory(spark, d)
    done = t.filter("event_id % 4 = 0").select("object", F.col("view").alias("camera")).distinct()
    return manifests.render_plan(t.select("object").distinct(), ["click", "view", "signup"], done, "object")


def frame_generator(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(48))).alias("frame"))
    return rows.select("s_suppkey", "frame", r6((F.col("frame") - 1) / 24.0).alias("time_s"))


def _offered(spark: SparkSession, d: str) -> DataFrame:
    """The market segments of each nation's customers as variants, in the order of their first customer."""
    rows = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("place"))
    return rows.select(F.col("c_nationkey").alias("exp"), "place", F.col("c_mktsegment").alias("variant"))


def requested_variants(spark: SparkSession, d: str) -> DataFrame:
    """Each nation asks for the segments of its customers in debt, in their order and as often; one without any gets all."""
    debts = table(spark, d, "customer").filter("c_acctbal < 0").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("in_debt"))
    requests = table(spark, d, "nation").join(debts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_nationkey").alias("exp"), F.col("in_debt.c_mktsegment").alias("variants"))
    return manifests.requested_variants(_offered(spark, d), requests)


def variant_parameters(spark: SparkSession, d: str) -> DataFrame:
    """A part's job takes the mean price of its brand and size over its own, unless it is the default one."""
    part = table(spark, d, "part")
    means = part.groupBy(F.col("p_brand").alias("exp"), F.col("p_size").cast("string").alias("variant")).agg(F.create_map(F.lit("price"), r2(F.avg("p_retailprice"))).alias("values"))
    job = F.when(F.col("p_partkey") % 3 == 0, "default").otherwise(F.col("p_size").cast("string"))
    jobs = part.select("p_partkey", F.col("p_brand").alias("exp"), job.alias("job"), F.create_map(F.lit("price"), "p_retailprice", F.lit("size"), F.col("p_size").cast("double")).alias("base"))
    out = manifests.with_variant(jobs, means, "base", "job")
    return out.select("p_partkey", "job", *[F.element_at("parameters", k).alias(k) for k in ("price", "size")])


def prompt_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A brand's prompt is named after its first part, and there only if that part is large."""
    part = table(spark, d, "part").withColumn("file", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".md")))
    names = part.groupBy(F.col("p_brand").alias("exp")).agg(F.min_by("file", "p_partkey").alias("file"))
    files = part.filter("p_size > 25").select(F.concat(F.lit("prompts/"), "file").alias("path"))
    return manifests.prompt_files(part.select("p_partkey", F.col("p_brand").alias("exp")), names, files, "prompts").select("p_partkey", "prompt_file")


QUERIES = {f.__name__: f for f in (manifest_cross_product, seed_counter, sweep_manifest, render_plan, frame_generator, requested_variants, variant_parameters, prompt_lookup)}
_JOBS = """jobs AS (SELECT n_name || '__' || m.model || '__' || s.style || '__s' || CAST(k.seed AS VARCHAR) AS id, n_name AS exp, n_nationkey AS place, m.model, s.style, k.seed
    FROM nation, (VALUES ('m1'), ('m2')) m(model), (VALUES ('explicit'), ('short')) s(style), (VALUES (1), (2), (3)) k(seed))"""
ORACLE_SQL = {
    "manifest_cross_product": f"WITH {_JOBS} SELECT id, exp, model, style, seed FROM jobs",
    "seed_counter": f"WITH {_JOBS} SELECT id, 1000 + row_number() OVER (ORDER BY place, model, style, seed) - 1 AS counter FROM jobs",
    "sweep_manifest": "WITH v AS (SELECT * FROM (VALUES ('g', 1.5::DOUBLE), ('g', 9.81::DOUBLE), ('v0', 0.0::DOUBLE), ('v0', 3.0::DOUBLE)) t(axis, value)) SELECT r_name || '__' || axis || '__' || replace(replace(CAST(value AS VARCHAR), '-', 'm'), '.', 'p') AS job, axis, value, CASE WHEN axis = 'g' THEN value ELSE 9.81::DOUBLE END AS g, CASE WHEN axis = 'v0' THEN value ELSE 0.0::DOUBLE END AS v0, 2.0::DOUBLE AS h0 FROM region, v",
    "render_plan": "SELECT DISTINCT e.user_id AS object, c.camera FROM events e, (VALUES ('click'), ('view'), ('signup')) c(camera) WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = c.camera AND f.event_id % 4 = 0)",
    "frame_generator": "SELECT s_suppkey, CAST(f.frame AS INTEGER) AS frame, round((f.frame - 1) / 24.0::DOUBLE, 6) AS time_s FROM supplier, (SELECT unnest(range(1, 49)) AS frame) f",
    "requested_variants": """WITH r AS (SELECT c_nationkey AS exp, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, c_mktsegment AS variant FROM customer WHERE c_acctbal < 0)
        SELECT * FROM r UNION ALL SELECT c_nationkey AS exp, min(c_custkey) AS place, c_mktsegment AS variant FROM customer WHERE c_nationkey NOT IN (SELECT exp FROM r) GROUP BY c_nationkey, c_mktsegment""",
    "variant_parameters": """WITH m AS (SELECT p_brand, p_size, round(avg(p_retailprice), 2) AS price FROM part GROUP BY p_brand, p_size)
        SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'default' ELSE CAST(p.p_size AS VARCHAR) END AS job, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE price END AS price, CAST(p.p_size AS DOUBLE) AS size FROM part p JOIN m ON p.p_brand = m.p_brand AND p.p_size = m.p_size""",
    "prompt_lookup": """WITH f AS (SELECT *, 'prompts/' || replace(p_name, ' ', '_') || '.md' AS path FROM part), n AS (SELECT p_brand, arg_min(path, p_partkey) AS path FROM f GROUP BY p_brand)
        SELECT p_partkey, CASE WHEN n.path IN (SELECT path FROM f WHERE p_size > 25) THEN n.path END AS prompt_file FROM f JOIN n ON f.p_brand = n.p_brand""",
}
