"""Every registered query outside of the training-data subpackage against its SQL, and those without SQL against plain Python."""

from __future__ import annotations

import math

import oracle
import pytest

from frameline import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert oracle.difference(registry.QUERIES[name](spark, SF), con, registry.ORACLE_SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def warped(a, b):
    table = {(-1, -1): 0.0}
    for i in range(len(a)):
        for j in range(len(b)):
            table[i, j] = abs(a[i] - b[j]) + min(table.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return table[len(a) - 1, len(b) - 1] / (len(a) + len(b))


def test_dtw_of_unequal_lengths_and_empty_series(spark):
    from frameline.operators.sequences import dtw_distance

    cases = [(1, [1.0, 2.0, 3.0], [1.0, 3.0]), (2, [0.0], [5.0, 5.0, 1.0]), (3, [], [1.0]), (4, None, [1.0]), (5, [1.0, 4.0, 2.0], [1.0, 4.0, 2.0])]
    got = {r["k"]: r["dtw"] for r in dtw_distance(spark.createDataFrame(cases, "k int, a array<double>, b array<double>"), ["k"], "a", "b").collect()}
    for k, a, b in cases:
        assert got[k] == (pytest.approx(warped(a, b)) if a and b else None)


def test_parameters_of_known_motions_are_recovered(spark):
    from pyspark.sql import functions as F

    from frameline.operators import recovery

    def bounce(t, e=0.8, v=6.0):
        while t > 2 * v / 9.81:
            t, v = t - 2 * v / 9.81, v * e
        return v * t - 0.5 * 9.81 * t * t

    rows = [(1, k / 96, bounce(k / 96), math.exp(-0.3 * k / 96) * math.sin(5 * k / 96), 4 * k / 96 - 0.5 * 0.2 * 9.81 * (k / 96) ** 2) for k in range(350)]
    rows += [(2, k / 96, 1.0, 1.0, 0.0) for k in range(9)] + [(3, 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "k int, t double, z double, u double, x double")
    one = lambda out: {r["k"]: r for r in out.collect()}
    assert one(recovery.restitution(df, ["k"], "t", "z"))[1]["e"] == pytest.approx(0.8, abs=2e-3)
    assert one(recovery.amplitude_decay(df, ["k"], "t", "u"))[1]["gamma"] == pytest.approx(0.3, abs=5e-3)
    assert one(recovery.crossing_period(df, ["k"], "t", "u"))[1]["period"] == pytest.approx(2 * math.pi / 5, abs=1e-3)
    assert one(recovery.spring(df, ["k"], "t", "u"))[1]["omega0"] == pytest.approx(math.hypot(5, 0.3), abs=1e-2)
    mu = one(recovery.friction_of_phases(df, ["k"], "t", "x", {"mu": F.col("t") < 1.5, "none": F.col("t") > 9}))
    assert mu[1]["mu"] == pytest.approx(0.2, abs=1e-6) and mu[1]["none"] is None and mu[2]["mu"] == 0 and mu[3]["mu"] is None if 3 in mu else True
    walls = spark.createDataFrame([(1, k / 10, k * 0.5 if k <= 10 else 5 - (k - 10) * 0.2) for k in range(20)], "k int, t double, x double")
    hit = one(recovery.speed_ratio(walls, ["k"], "t", "x"))[1]
    assert (hit["hit_at"], round(hit["e"], 9)) == (1.1, 0.4)
    assert recovery.restitution(df.limit(0), ["k"], "t", "z").count() == 0


def test_scores_at_every_threshold(spark):
    from pyspark.sql import functions as F

    from frameline.operators import scores

    best = {"detection_rate": 1.0, "single_object_rate": 1.0, "in_frame_rate": 1.0, "verticality": 0.0, "monotonic_rate": 1.0, "r2": 1.0, "penetration_px": 0.0, "penetration_norm": 0.0, "bounce_norm": 0.0, "g_rel": 0.0, "v0_abs": 0.0, "h0_rel": 0.0}
    limits = {"detection_rate": 0.90, "single_object_rate": 0.90, "in_frame_rate": 0.95, "verticality": 0.10, "monotonic_rate": 0.90, "r2": 0.98, "penetration_px": 2.0, "bounce_norm": 0.05, "g_rel": 0.30, "v0_abs": 1.0, "h0_rel": 0.30}
    rows, passes = [best, best | {"g_rel": None, "v0_abs": None, "h0_rel": None}, best | {"r2": float("nan")}, best | {"single_object_rate": None}, best | {"penetration_px": 2.1, "penetration_norm": 0.05}], [True, True, False, False, False]
    for name, limit in limits.items():
        worse = -1e-6 if name.endswith("_rate") or name == "r2" else 1e-6
        rows += [best | {name: limit}, best | {name: limit + worse}]
        passes += [True, False]
    df = spark.createDataFrame([tuple([k, *r.values()]) for k, r in enumerate(rows)], "k int, " + ", ".join(f"{n} double" for n in best))
    checks = scores.hard_constraints()
    got = df.select("k", *[c.alias(n) for n, c in checks.items()]).withColumn("passed", scores.strict_pass(checks)).orderBy("k").collect()
    assert [r["passed"] for r in got] == passes
    cases = [({}, 100.0), ({"detection_rate": 0.8}, 97.5), ({"single_object_rate": 0.8}, 98.75), ({"in_frame_rate": 0.8}, 98.75), ({"r2": 0.945}, 87.5), ({"r2": 0.5}, 75.0), ({"verticality": 0.075}, 90.0), ({"penetration_px": 2.0, "penetration_norm": 9.0}, 100.0), ({"penetration_px": 3.0, "penetration_norm": 0.25}, 92.5), ({"bounce_norm": 0.02}, 100.0), ({"bounce_norm": 0.1}, 92.5)]
    df = spark.createDataFrame([tuple([k, *(best | c).values()]) for k, (c, _) in enumerate(cases)], "k int, " + ", ".join(f"{n} double" for n in best))
    assert [r[0] for r in df.orderBy("k").select(scores.sweep_video_score()).collect()] == pytest.approx([want for _, want in cases])
    axis = {"r2": 0.5, "pearson": -0.8, "monotonic": 0.9, "mean_r2": 0.945, "mean_detection": 0.75, "mean_verticality": 0.075, "clean_share": 0.4}
    wants = [100 * (0.2 + 0.16 + 0.135 + 0.075 + 0.1 * (0.3 + 0.15 + 0.12)), 100 * (0.075 + 0.1 * (0.3 + 0.15 + 0.12))]
    df = spark.createDataFrame([tuple(axis.values()), (None, None, float("nan"), *list(axis.values())[3:])], ", ".join(f"{n} double" for n in axis))
    assert [r[0] for r in df.withColumn("s", scores.axis_score()).orderBy(F.desc("s")).select("s").collect()] == pytest.approx(wants)


def test_truth_as_its_own_prediction(spark):
    from frameline.operators import align
    from frameline.views import trajectory

    t = trajectory(spark, SF)
    assert align.position_error(align.align_by_frame(t, t, ["object"]), ["object"]).filter("mse <> 0").count() == 0
    assert align.velocity_error(t, t, ["object"]).filter("mse <> 0").count() == 0
    assert align.event_time_errors(t, t, ["object"]).filter("abs_error_s <> 0").count() == 0


def test_gap_filling_edges(spark):
    from frameline.operators.sequences import fill_gaps

    values = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    rows = spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], "object int, frame int, event_id int, v double")
    got = [r["f"] for r in fill_gaps(rows, ["object"], "v", "f", most=2).orderBy("frame").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]


def test_fit_of_degenerate_series(spark):
    from frameline.operators.fits import linear_fit, quadratic_fit

    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.0, 2.0), (2, 1.0, 5.0), (2, 1.0, 5.0), (2, 1.0, 5.0), (3, 0.0, None), (4, 0.0, 1.0), (4, 1.0, 0.0), (4, 2.0, 1.0)], "k int, t double, v double")
    got = {r["k"]: r["a"] for r in quadratic_fit(rows, ["k"], "t", "v").collect()}
    assert got[1] is None and got[2] is None and 3 not in got and got[4] == pytest.approx(1.0)
    assert {r["k"]: r["slope"] for r in linear_fit(rows, ["k"], "t", "v").collect()}[2] is None


def test_files_there_and_back(spark, tmp_path):
    from pyspark.sql import functions as F

    from frameline.sources import readers, writers

    rows = spark.createDataFrame([(2, 1 / 24, "A", 1.0, 2.0, 3.0), (1, 0.0, "A", 0.123456789, 2.0, 3.0)], "frame int, time_s double, object string, x double, y double, z double")
    folder = f"{tmp_path}/run/one"
    writers.write_trajectories(rows, folder)
    back = readers.trajectories(spark, folder).orderBy("frame").collect()
    assert [r["x"] for r in back] == [0.12345679, 1.0] and back[0]["path"].endswith(".csv")
    (tmp_path / "c.json").write_text('[{"id": "a", "task": "fall", "parameters": {"g": "1"}}, {"id": "a", "task": "fall", "parameters": {"g": "2"}}, {"id": "b", "task": "slide"}]')
    got = readers.configs(spark, f"{tmp_path}/c.json", "fall").collect()
    assert [(r["id"], r["parameters"]["g"]) for r in got] == [("a", "2")]
    for name in ("x_trajectory.csv", "x_params.json", "prompt.csv", "b.csv"):
        (tmp_path / "pairs").mkdir(exist_ok=True)
        (tmp_path / "pairs" / name).write_text("a\n1\n")
    files = readers.listing(spark, f"{tmp_path}/pairs", "*")
    assert readers.paired_files(files).count() == 1
    assert readers.preferred_file(files).collect()[0]["path"].endswith("/b.csv")
    writers.append_log(rows.select(F.lit("ok").alias("status")), f"{tmp_path}/log")
    writers.append_log(rows.select(F.lit("skip").alias("status")), f"{tmp_path}/log")
    assert readers.manifest(spark, f"{tmp_path}/log", "status string").count() == 4
    writers.write_ranking(rows.select("object", F.col("frame").alias("f"), F.col("x").alias("score")).withColumn("object", F.col("f").cast("string")), "object", "score", f"{tmp_path}/ranking")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/ranking").collect()] == ["1. 2: 1.00", "2. 1: 0.12"]


def test_stream_equals_table(spark, tmp_path):
    from frameline.streaming.tracker import contact_rates, event_stream

    stream = contact_rates(event_stream(spark, SF), 90.0)
    q = stream.writeStream.format("memory").queryName("contacts").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"], r["n"], r["n_contacts"]) for r in spark.table("contacts").collect()}
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert got == {(r["start"], r["event_type"], r["n"], r["n_contacts"]) for r in contact_rates(table, 90.0).collect()}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_registered_gaps_are_filled_up_to_five(spark):
    """Both gap queries against a walk over each object's detections."""
    from collections import defaultdict

    from frameline.queries import tracks

    seen = defaultdict(list)
    for r in tracks._rows(spark, SF).select("object", "frame", "cx").orderBy("object", "frame").collect():
        seen[r["object"]].append((r["frame"], r["cx"]))
    want, longest = {}, 0
    for k, row in seen.items():
        known = [i for i, (_, v) in enumerate(row) if v is not None]
        want.update({(k, frame): v for frame, v in row})
        for a, b in zip(known, known[1:]):
            if 1 < b - a <= 6:
                longest = max(longest, b - a - 1)
                want.update({(k, row[i][0]): row[a][1] + (row[b][1] - row[a][1]) * (i - a) / (b - a) for i in range(a + 1, b)})
    assert longest > 1
    got = {(r["object"], r["frame"]): r["cx_filled"] for r in tracks.gap_interpolation(spark, SF).collect()}
    assert got.keys() == want.keys() and all(v is None and got[i] is None or got[i] == pytest.approx(v, abs=1e-6) for i, v in want.items())
    filled = {k: sum(v is None and want[k, frame] is not None for frame, v in row) for k, row in seen.items()}
    assert {r["object"]: r["n_interpolated"] for r in tracks.interpolated_counts(spark, SF).collect()} == filled


def test_manifest_keeps_the_first_jobs_in_file_order(spark, tmp_path):
    from frameline.sources.readers import manifest

    lines = [f'{{"id": {i}}}' for i in range(5000)]
    (tmp_path / "jobs.jsonl").write_text("\n\n".join(lines))
    assert [r.id for r in manifest(spark, str(tmp_path / "jobs.jsonl"), "id int", 700).collect()] == list(range(700))


def test_segments_that_overlap_touch_or_lack(spark):
    from frameline.operators.lookups import segment_of

    segments = spark.createDataFrame([("a", 1, 2.0, 5.0), ("a", 0, 0.0, 3.0), ("a", 2, 8.0, 9.0)], "k string, place int, t0 double, t1 double")
    rows = spark.createDataFrame([("a", 2.5), ("a", 3.0), ("a", 5.0), ("a", 6.0), ("a", 99.0), ("a", None), ("b", 1.0)], "k string, t double")
    found = {(r.k, r.t): r.place for r in segment_of(rows, segments, ["k"], "t").collect()}
    assert found == {("a", 2.5): 0, ("a", 3.0): 0, ("a", 5.0): 1, ("a", 6.0): 2, ("a", 99.0): 2, ("a", None): 2, ("b", 1.0): None}


def test_jobs_are_numbered_as_one_after_another(spark):
    import random

    from frameline.plans.manifests import allowed_jobs

    rng = random.Random(5)
    exps = [(f"e{i}", i, rng.choice([None, ["m1"], ["m9"], ["m2", "m1", "m9"]]), rng.choice([None, [], ["b"]]), rng.choice([None, None, rng.randrange(300)])) for i in range(40)]
    seed, want = 50, []
    for exp, _, models, styles, own in exps:
        for m in ["m1", "m2"] if models is None else models:
            for s in ["a", "b"] if styles is None else styles:
                for _ in range(3 if m in ("m1", "m2") else 0):
                    this = seed if own is None else own
                    want.append((exp, m, s, this))
                    seed = max(seed + 1, this + 1)
    table = spark.createDataFrame(exps, "exp string, place int, models array<string>, styles array<string>, seed int")
    got = allowed_jobs(table, ["m1", "m2"], ["a", "b"], 3, 50)
    assert sorted((r.exp, r.model, r.style, r.seed) for r in got.collect()) == sorted(want)


def test_average_ranks_of_ties_over_many_ranges(spark):
    from frameline.operators.summaries import average_ranks

    rows = [(k, float(i % 7)) for i in range(200) for k in ("hot", "cold") if k == "hot" or i < 3]
    got = {(r.k, r.v): r.rank for r in average_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "rank").collect()}
    for k, v in set(rows):
        mine = [b for a, b in rows if a == k]
        assert got[k, v] == sum(b < v for b in mine) + (sum(b == v for b in mine) + 1) / 2


def test_phase_summary_without_results(spark):
    from frameline.operators.summaries import phase_summary

    none = spark.createDataFrame([], "target double, estimate double, detection double")
    row = phase_summary(none, none, "target", "estimate", ["detection"]).collect()
    assert [tuple(r) for r in row] == [(0, 0, 0, 0.0, None, None, None, None, None)]
