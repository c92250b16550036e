"""Canonical frame-indexed views over the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Six decimals, which absorb the order of floating-point sums."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def r2(c: Column) -> Column:
    """Two decimals, rounded after scaling as the SQL does. Spark rounds the shortest decimal text, which differs for means of prices that end next to half a cent."""
    return F.round(c * 100.0) / 100.0


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(object, view, event_id, frame, time_s, x, y, z): each user's events in order are one object's frames."""
    k = F.get_json_object("props", "$.k").cast("double")
    by_time = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type", k.alias("k"), us.alias("us"))
    return rows.select(
        F.col("user_id").alias("object"), F.col("event_type").alias("view"), "event_id",
        F.row_number().over(by_time).alias("frame"),
        ((F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / 1e6).alias("time_s"),
        F.col("value").alias("x"), F.col("k").alias("y"), (F.col("value") * 0.5 + F.col("k")).alias("z"),
    )


def prediction(truth: DataFrame) -> DataFrame:
    """The trajectory with a fixed disturbance, without every eleventh event."""

    def off(factor: int, n: int) -> Column:
        return (F.col("event_id") * factor % n - n // 2) / 100.0

    return truth.filter(F.col("event_id") % 11 != 0).withColumns({"x": F.col("x") + off(7919, 101), "y": F.col("y") + off(104729, 97), "z": F.col("z") + off(1299709, 89)})


def detections(truth: DataFrame) -> DataFrame:
    """Image-space detections: every fifth event is not found; radius and contour count follow the event's number."""
    found = F.col("event_id") % 5 != 0
    return truth.select(
        "object", "view", "event_id", "frame", "time_s", found.alias("found"),
        F.when(found, F.col("x")).alias("cx"), F.when(found, F.col("z")).alias("cy"),
        F.when(found, 4.0 + F.col("event_id") % 7 * 0.25).alias("radius"),
        F.when(found, 1 + F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)).alias("contours"),
    )


TRAJ_SQL = """
traj AS (
    SELECT user_id AS object, event_type AS view, event_id,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
        (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS time_s,
        value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y,
        value * 0.5::DOUBLE + CAST(json_extract_string(props, '$.k') AS DOUBLE) AS z
    FROM events
)"""
PRED_SQL = (
    TRAJ_SQL
    + """, pred AS (
    SELECT object, view, event_id, frame, time_s,
        x + (event_id * 7919 % 101 - 50) / 100.0::DOUBLE AS x,
        y + (event_id * 104729 % 97 - 48) / 100.0::DOUBLE AS y,
        z + (event_id * 1299709 % 89 - 44) / 100.0::DOUBLE AS z
    FROM traj WHERE event_id % 11 <> 0
)"""
)
DET_SQL = (
    TRAJ_SQL
    + """, det AS (
    SELECT object, view, event_id, frame, time_s, event_id % 5 <> 0 AS found,
        CASE WHEN event_id % 5 <> 0 THEN x END AS cx, CASE WHEN event_id % 5 <> 0 THEN z END AS cy,
        CASE WHEN event_id % 5 <> 0 THEN 4.0::DOUBLE + event_id % 7 * 0.25::DOUBLE END AS radius,
        CASE WHEN event_id % 5 <> 0 THEN 1 + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END END AS contours
    FROM traj
)"""
)
