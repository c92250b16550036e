"""Numbers over all rows in order: unique and whole on many rows, partitions and payload columns, and as a walk in plain Python gives them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from frameline.operators.ordering import in_order
from frameline.operators.sequences import fill_gaps
from frameline.operators.summaries import average_ranks, ranked
from frameline.plans.manifests import with_counter

MANY = 1_000_000


@pytest.mark.parametrize("parts", [8, 211])
def test_ranks_and_counters_of_a_million_rows_with_a_payload(spark, parts):
    rows = spark.range(MANY).select(F.xxhash64("id").alias("job"), (F.col("id") % 1000).cast("double").alias("score"), F.concat(F.lit("payload "), "id").alias("payload"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for out, name, first in ((ranked(rows, "score", "job"), "rank", 1), (with_counter(rows, ["score", "job"], "counter", 1000), "counter", 1000)):
            found = out.agg(F.count_distinct(name).alias("n"), F.min(name).alias("low"), F.max(name).alias("high"), F.count_distinct("payload").alias("p")).first()
            assert (found["n"], found["low"], found["high"], found["p"]) == (MANY, first, MANY + first - 1, MANY)
        assert ranked(rows, "score", "job").groupBy("score").agg(F.min("rank").alias("r")).filter("r <> 1 + (999 - score) * 1000").count() == 0
        averages = average_ranks(rows.withColumn("k", F.lit("one")), ["k"], "score", "rank").collect()
        assert len(averages) == 1000 and all(r["rank"] == 1000 * r["score"] + 500.5 for r in averages)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_groups_that_span_ranges(spark, parts):
    chance = random.Random(parts)
    rows = [(chance.choice([None, "a", "b", "b", "b", "ü"]), k, chance.choice([None, 1, 2, 5])) for k in range(700)] + [(None, None, 3)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["g"], r["k"]): (r["group_at"], r["row_at"], r["x_before"]) for r in in_order(spark.createDataFrame(rows, "g string, k int, x int"), ["g"], ["k"], ["x"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted, groups, last = {}, -1, 0
    for g, k, x in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0)):
        if last != g:
            groups, place, total, last = groups + 1, 0, 0, g
        wanted[g, k] = (groups, place, total)
        place, total = place + 1, total + (x or 0)
    assert got == wanted


def test_empty_tables_and_nan_groups(spark):
    assert in_order(spark.createDataFrame([], "g string, k int"), ["g"], ["k"]).count() == 0
    rows = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (1.0, 3), (None, 4)], "g double, k int")
    assert sorted((r["k"], r["group_at"], r["row_at"]) for r in in_order(rows, ["g"], ["k"]).collect()) == [(1, 2, 0), (2, 2, 1), (3, 1, 0), (4, 0, 0)]


def test_gaps_of_a_long_track(spark):
    n = 160_000
    rows = spark.range(n).select(F.lit(1).alias("object"), F.col("id").alias("frame"), F.col("id").alias("event_id"), F.when(F.col("id") % 7 < 4, F.col("id") * 2.0).alias("v"))
    out = fill_gaps(rows, ["object"], "v", "filled", most=3)
    assert out.filter("filled IS NULL").count() == len([k for k in range(n - n % 7 + 4, n)]) and out.filter("filled <> 2 * frame").count() == 0


def test_numbers_in_order_are_read_without_a_broadcast(spark):
    """A query that numbers rows many times would else hold a small table in the driver for each job that reads them."""
    out = in_order(spark.range(500).withColumn("g", F.col("id") % 7), ["g"], ["id"], ["id"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("row_at <> id div 7 OR group_at <> g").count() == 0 and out.filter("id = 20").first()["id_before"] == 6 + 13
