"""Joins of observed and predicted motion, and errors over aligned frames.

Keys name the columns that identify a series. Null positions leave a frame out of an average; no common frame gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def align_by_frame(truth: DataFrame, pred: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """Inner join on keys and frame; of several predicted rows of a frame, the last by ``order`` counts. Predictions get ``p_`` names."""
    last = pred.groupBy(*keys, "frame").agg(F.max_by(F.struct(*AXES, "time_s"), order).alias("p"))
    return truth.join(last, [*keys, "frame"]).select(*[truth[c] for c in truth.columns], *[F.col("p")[a].alias(f"p_{a}") for a in AXES], F.col("p.time_s").alias("p_time_s"))


def squared_distance(a: str = "", b: str = "p_", axes: tuple[str, ...] = AXES) -> Column:
    return sum((F.col(a + c) - F.col(b + c)) ** 2 for c in axes)


def position_error(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_frames, mse): mean squared distance."""
    return aligned.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), F.avg(squared_distance()).alias("mse"))


def velocities(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step, time_s, vx, vy, vz): forward differences at mid times; steps of no time are left out and not counted."""
    w = Window.partitionBy(*keys).orderBy("frame", "event_id")
    dt = F.lead("time_s").over(w) - F.col("time_s")
    rows = series.select(*keys, "frame", "event_id", (F.col("time_s") + dt / 2).alias("mid"), dt.alias("dt"), *[(F.lead(a).over(w) - F.col(a)).alias(f"d{a}") for a in AXES])
    rows = rows.filter(F.col("dt") > 1e-9)
    return rows.select(*keys, F.row_number().over(w).alias("step"), F.col("mid").alias("time_s"), *[(F.col(f"d{a}") / F.col("dt")).alias(f"v{a}") for a in AXES])


def velocity_error(truth: DataFrame, pred: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """(keys, n_steps, mse) of velocities joined by their number; ``strict`` takes differences over common frames only."""
    if strict:
        both = align_by_frame(truth, pred, keys)
        truth = both.select(*truth.columns)
        pred = both.select(*keys, "frame", "event_id", F.col("p_time_s").alias("time_s"), *[F.col(f"p_{a}").alias(a) for a in AXES])
    a, b = velocities(truth, keys), velocities(pred, keys)
    b = b.select(*keys, "step", *[F.col(f"v{x}").alias(f"p_v{x}") for x in AXES])
    both = a.join(b, [*keys, "step"])
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_steps"), F.avg(squared_distance("v", "p_v")).alias("mse"))


def common_objects(truth: DataFrame, pred: DataFrame, key: str = "object") -> DataFrame:
    return truth.select(key).intersect(pred.select(key))


def min_height_times(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_time): time of the least z, the first frame on ties."""
    return series.filter(F.col("z").isNotNull()).groupBy(*keys).agg(F.min_by("time_s", F.struct("z", "frame")).alias("event_time"))


def event_time_errors(truth: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, abs_error_s) of events that both sides have."""
    a, b = min_height_times(truth, keys), min_height_times(pred, keys).withColumnRenamed("event_time", "p_time")
    return a.join(b, keys).select(*keys, F.abs(F.col("event_time") - F.col("p_time")).alias("abs_error_s"))


def closest_approach(series: DataFrame, group: list[str]) -> DataFrame:
    """(group, first, second, time_s, distance) for groups of exactly two objects: the frame at which they are nearest, the first on ties."""
    two = series.groupBy(*group).agg(F.min("object").alias("first"), F.max("object").alias("second"), F.count_distinct("object").alias("n")).filter("n = 2").drop("n")
    rows = series.select(*group, "object", "frame", "time_s", *AXES)
    a = rows.join(two, group).filter("object = first")
    b = rows.join(two, group).filter("object = second").select(*group, "frame", *[F.col(x).alias(f"p_{x}") for x in AXES])
    met = a.join(b, [*group, "frame"]).withColumn("d2", squared_distance())
    return met.groupBy(*group, "first", "second").agg(F.min_by("time_s", F.struct("d2", "frame")).alias("time_s"), F.sqrt(F.min("d2")).alias("distance"))
