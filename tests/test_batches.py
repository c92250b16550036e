"""Failures as rows, requests and variants that are checked, prompts from templates, filters of ground truth, warping in space."""

from __future__ import annotations

import math

import oracle
import pytest
from pyspark.sql import functions as F

from frameline import registry
from frameline.functions import prompts
from frameline.operators import outcomes
from frameline.operators.sequences import dtw_distance
from frameline.plans import manifests
from frameline.sources.readers import truth_files
from frameline.views import r2


def test_unreadable_short_and_null_items_stay_in_the_batch(spark):
    rows = [(1, '{"g": 9.8, "xs": [1.0, 2.0, 3.0]}'), (2, '{"g": 9.8, "xs": [1.0'), (3, None), (4, " "), (5, '{"g": 9.8, "xs": [1.0]}'), (6, '{"g": null, "xs": null}'), (7, '{"g": "ten", "xs": [1.0, 2.0]}'), (8, "[1, 2]"), (9, '{"xs": [1.0, null, 3.0], "g": 1}')]
    read = outcomes.parsed(spark.createDataFrame(rows, "k int, doc string"), "doc", "g double, xs array<double>")
    xs = F.col("value.xs")
    checks = [(F.col("error").isNull(), F.col("error")), (F.size(xs) >= 2, F.concat(F.lit("ValueError: points "), F.coalesce(F.size(xs).cast("string"), F.lit("none")))), (~F.exists(xs, lambda x: x.isNull()), "ValueError: null point"), (F.col("value.g").isNotNull(), "KeyError: g")]
    found = outcomes.outcomes(read, ["k"], checks, {"mean": F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)})
    good, bad = outcomes.split_outcomes(found)
    assert [(r["k"], r["mean"]) for r in good.collect()] == [(1, 2.0)] and good.columns == ["k", "mean"]
    errors = {r["k"]: r["error"] for r in bad.collect()}
    assert sorted(errors) == [2, 3, 4, 5, 6, 7, 8, 9]
    assert errors[2].startswith("JSONDecodeError: {") and errors[3] == "TypeError: no text" and errors[4] == "JSONDecodeError: empty text" and errors[5] == "ValueError: points 1"
    assert errors[6].startswith("ValueError: points") and errors[7].startswith("JSONDecodeError") and errors[8].startswith("JSONDecodeError") and errors[9] == "ValueError: null point"
    assert all(r["mean"] is None for r in bad.collect())


def test_requests_keep_their_order_and_unknown_names_end_the_query(spark):
    offered = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "exp string, place int, variant string")
    asked = lambda rows: manifests.requested_variants(offered, spark.createDataFrame(rows, "exp string, variants array<string>"))
    got = sorted((r["exp"], r["place"], r["variant"]) for r in asked([("a", ["y", "x", "y"]), ("b", None), ("c", [])]).collect())
    assert got == [("a", 0, "y"), ("a", 1, "x"), ("a", 2, "y"), ("b", 0, "z")]
    for bad in ([("a", ["z"])], [("c", ["x"])], [("a", [None])]):
        with pytest.raises(Exception, match="unknown variant"):
            asked(bad).collect()


def test_variants_go_over_the_base_and_unknown_ones_end_the_query(spark):
    variants = spark.createDataFrame([("a", "low", {"g": 2.0}), ("a", "other", {"e": 0.5})], "exp string, variant string, values map<string,double>")
    jobs = lambda rows: manifests.with_variant(spark.createDataFrame([(e, v, {"g": 9.8, "mu": 0.1}) for e, v in rows], "exp string, v string, base map<string,double>"), variants, "base", "v")
    got = {r["v"]: r["parameters"] for r in jobs([("a", "low"), ("a", "other"), ("a", "default"), ("b", "default")]).collect()}
    assert got == {"low": {"g": 2.0, "mu": 0.1}, "other": {"g": 9.8, "mu": 0.1, "e": 0.5}, "default": {"g": 9.8, "mu": 0.1}}
    with pytest.raises(Exception, match="unknown variant: low"):
        jobs([("b", "low")]).collect()


def test_means_at_half_a_cent_are_those_of_the_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert oracle.difference(registry.QUERIES["variant_parameters"](spark, sf), oracle.connect(sf), registry.ORACLE_SQL["variant_parameters"]) == ""
    half = spark.createDataFrame([(980.4749999999999,), (980.475,), (-0.125,), (None,)], "v double").select(r2(F.col("v")).alias("v"))
    assert [r["v"] for r in half.collect()] == [980.47, 980.48, -0.13, None]


def test_prompt_files_that_are_there(spark):
    names = spark.createDataFrame([("a", "a.md"), ("b", "b.md")], "exp string, file string")
    files = spark.createDataFrame([("p/a.md",), ("p/a.md",), ("q/b.md",)], "path string")
    got = {r["exp"]: r["prompt_file"] for r in manifests.prompt_files(spark.createDataFrame([("a",), ("b",), ("c",)], "exp string"), names, files, "p").collect()}
    assert got == {"a": "p/a.md", "b": None, "c": None}


def built(spark, rows, texts=None, frames=None):
    jobs = spark.createDataFrame(rows, "id int, task string, style string, params map<string,double>, words map<string,string>")
    tables = prompts.template_tables(spark)
    return {r["id"]: r for r in prompts.build_prompts(jobs, texts or tables[0], frames or tables[1]).collect()}


def test_prompts_of_all_tasks_and_styles(spark):
    tasks, styles = list(prompts.LOOKS), [s for s, _ in prompts.FRAMES]
    got = built(spark, [(k * 10 + n, t, s, {}, {}) for k, t in enumerate(tasks) for n, s in enumerate(styles)])
    assert len({r["prompt"] for r in got.values()}) == 15 and not any("{" in r["prompt"] for r in got.values())
    assert [got[k * 10]["case"] for k in range(5)] == ["rest", "level", "any", "any", "steady"]
    cases = [
        (1, "free_fall", "short_raw", {"v0": 2.5, "h0": 1.25}, {"color": "green"}), (2, "projectile", "structured_raw", {"v0x": 3.0, "v0y": 4.0, "g": 1.62}, {}), (3, "projectile", "short_raw", {"v0": 2.0, "theta": 60.0}, {}),
        (4, "projectile", "short_raw", {"v0y": 0.0}, {}), (5, "spring", "short_raw", {"k": 16.0, "m": 4.0, "duration_s": 3.2}, {}), (6, "pendulum", "short_raw", {"L": 2.45, "duration_s": 20.0}, {"object_name": "cube"}),
        (7, "rotation", "structured_raw", {"alpha": -3.0, "omega0": 45.0}, {}), (8, "rotation", "short_raw", {"alpha_deg_s2": 1e-3}, {}), (9, "pendulum", "short_raw", {"duration_s": 0.0}, {}),
    ]
    got = built(spark, cases)
    says = {1: ["one green matte ball", "1.25 m above", "vertically at 2.5 m/s"], 2: ["5 m/s, 53.13 degrees", "3 m/s along and 4 m/s up", "Gravity is 1.62"], 3: ["1 m/s sideways all the way and 1.732 m/s upwards"], 4: ["level at 2 m/s"], 5: ["at 2 rad/s", "about 1 times"], 6: ["The cube swings", "about 6 times"], 7: ["slower all the time", "acceleration -3 degrees"], 8: ["faster all the time"], 9: ["several times"]}
    for k, parts in says.items():
        assert all(p in got[k]["prompt"] for p in parts), got[k]["prompt"]


def test_prompts_that_cannot_be_built_end_the_query(spark):
    for task, style, said in (("orbit", "short_raw", "unsupported task: orbit"), (None, "short_raw", "unsupported task: null"), ("spring", "sonnet", "unsupported style: sonnet")):
        with pytest.raises(Exception, match=said):
            built(spark, [(1, task, style, {}, {})])
    with pytest.raises(Exception, match="unfilled prompt"):
        built(spark, [(1, "spring", "own", {}, {})], frames=spark.createDataFrame([("own", "{subject} {price}")], "style string, frame string"))
    image = lambda exp, hidden: spark.createDataFrame([(exp, hidden)], "e string, h map<string,double>").select(prompts.image_prompt(F.col("e"), F.col("h"), F.lit(True)).alias("p")).first()["p"]
    assert "Gravity is 4.9 m/s^2" in image("v1_A", {"g_hidden": 4.9})
    for exp, hidden in (("v2_A", {"g_hidden": 4.9}), ("v1_A", {"e_hidden": 0.5}), (None, {"g_hidden": 1.0})):
        with pytest.raises(Exception, match="unsupported experiment"):
            image(exp, hidden)


def test_prompts_of_one_file_are_made_by_many_tasks_and_each_value_once(spark):
    jobs = spark.range(0, 400, 1, 1).selectExpr("id", "'projectile' AS task", "'short_raw' AS style", "map('v0', id / 8D, 'theta', 30D) AS params", "map('color', 'pink') AS words")
    made = prompts.build_prompts(jobs, *prompts.template_tables(spark)).withColumn("task_at", F.spark_partition_id())
    assert len({r["task_at"] for r in made.collect()}) > 1
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") <= 2  # in the one lambda over all numbers
    assert made.filter("prompt LIKE 'one pink matte ball%' AND prompt LIKE '% at % m/s, 30 degrees above level%'").count() == 399


def test_truth_files_by_version_experiment_and_variant(spark):
    there = [f"root/{v}/{e}/{a}/x_{k}" for v in ("v1", "v2") for e in ("v1_A", "v1_B") for a in ("g2", "g4") for k in ("trajectory.csv", "params.json") if (e, a, k) != ("v1_B", "g4", "params.json")]
    files = spark.createDataFrame([(p,) for p in [*there, "root/v1/v1_A/g2/a_trajectory.csv", "root/v1/v1_A/z_trajectory.csv", "elsewhere/v1/v1_A/g2/x_trajectory.csv"]], "path string")
    all_of = sorted((r["version"], r["experiment"], r["variant"]) for r in truth_files(files, "root", ["v1", "v2"]).collect())
    assert all_of == [(v, e, a) for v in ("v1", "v2") for e, a in (("v1_A", "g2"), ("v1_A", "g4"), ("v1_B", "g2"))]
    one = truth_files(files, "root", ["v1"], ["v1_A"], ["g2"]).collect()
    assert [(r["trajectory"], r["params"]) for r in one] == [("root/v1/v1_A/g2/a_trajectory.csv", "root/v1/v1_A/g2/x_params.json")]


def test_dtw_of_points_in_space(spark):
    cases = [(1, [[0, 0, 0], [1, 2, 2], [3, 3, 3]], [[0, 0, 1], [1, 2, 2]]), (2, [[5, 1, 0]], [[1, 1, 3], [2, 2, 2], [0, 0, 0]]), (3, [[1, 1, 1]] * 4, [[1, 1, 1]] * 7)]
    rows = [(k, [float(v) for p in a for v in p], [float(v) for p in b for v in p]) for k, a, b in cases]
    got = {r["k"]: r["dtw"] for r in dtw_distance(spark.createDataFrame(rows, "k int, a array<double>, b array<double>"), ["k"], "a", "b", axes=3).collect()}
    for k, a, b in cases:
        table = {(-1, -1): 0.0}
        for i in range(len(a)):
            for j in range(len(b)):
                table[i, j] = math.dist(a[i], b[j]) + min(table.get(q, math.inf) for q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
        assert got[k] == pytest.approx(table[len(a) - 1, len(b) - 1] / (len(a) + len(b)))


def test_sizes_of_an_area(spark):
    from frameline.functions.text import resized

    rows = [(a, r, m) for a in (480 * 832, 720 * 1280, 1000) for r in (0.5, 0.5625, 1.0, 1.7) for m in (8, 16)]
    for m in (8, 16):
        got = spark.createDataFrame([(a, r) for a, r, k in rows if k == m], "a long, r double").select("a", "r", *[c.alias(n) for c, n in zip(resized(F.col("a"), F.col("r"), m), ("h", "w"), strict=True)]).collect()
        for r in got:
            assert (r["h"], r["w"]) == (round(math.sqrt(r["a"] * r["r"])) // m * m, round(math.sqrt(r["a"] / r["r"])) // m * m)


def test_tables_without_rows(spark, tmp_path):
    from frameline.sources.writers import write_table

    rows, path = spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "table")
    write_table(rows, path)
    write_table(rows.limit(0), path)
    assert spark.read.csv(path, header=True).count() == 1
    write_table(rows.limit(0), path, empty=True)
    assert spark.read.schema("k int, v string").csv(path, header=True).count() == 0
