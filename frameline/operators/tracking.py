"""Rates and spans of a detection track. ``rows`` have found, cx, cy, radius, contours, frame; keys name a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameline.operators.sequences import ordered

TINY = 1e-8


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def detection_rates(rows: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """(keys, detection_rate, single_object_rate, in_frame_rate); the last two are of detected frames."""
    r = F.col("radius")
    inside = (F.col("cx") - r >= 1) & (F.col("cx") + r <= width - 2) & (F.col("cy") - r >= 1) & (F.col("cy") + r <= height - 2)
    return rows.groupBy(*keys).agg(
        share(F.col("found")).alias("detection_rate"),
        share(F.when(F.col("found"), F.col("contours") <= 1)).alias("single_object_rate"),
        share(F.when(F.col("found"), inside)).alias("in_frame_rate"),
    )


def motion_spans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x_span, y_span, verticality)."""
    spans = rows.groupBy(*keys).agg((F.max("cx") - F.min("cx")).alias("x_span"), (F.max("cy") - F.min("cy")).alias("y_span"))
    return spans.withColumn("verticality", F.col("x_span") / F.greatest("y_span", F.lit(TINY)))


def downward_rate(rows: DataFrame, keys: list[str], value: str = "cy") -> DataFrame:
    """(keys, monotonic_rate): share of steps between detected frames that rise by no more than a hundredth of the span."""
    used = rows.filter(F.col(value).isNotNull())
    span = F.max(value).over(Window.partitionBy(*keys)) - F.min(value).over(Window.partitionBy(*keys))
    steps = used.select(*keys, (F.col(value) - F.lag(value).over(ordered(keys))).alias("dy"), span.alias("span")).filter("dy IS NOT NULL")
    return steps.groupBy(*keys).agg(share(F.col("dy") <= 0.01 * F.greatest("span", F.lit(TINY))).alias("monotonic_rate"))


def penetration(rows: DataFrame, keys: list[str], ground: float) -> DataFrame:
    """(keys, penetration_px, penetration_norm): how far the lower edge sinks below the ground, also over the median radius."""
    agg = rows.groupBy(*keys).agg(F.max(F.col("cy") + F.col("radius")).alias("low"), F.median("radius").alias("r"))
    px = F.greatest(F.lit(0.0), F.col("low") - ground)
    return agg.select(*keys, px.alias("penetration_px"), F.try_divide(px, F.col("r")).alias("penetration_norm"))


def bounce_height(rows: DataFrame, keys: list[str], contacts: DataFrame) -> DataFrame:
    """(keys, bounce_norm): rise after contact over the vertical span; 0 with fewer than two detected frames after contact."""
    rows = rows.join(contacts, keys, "left").filter(F.col("cy").isNotNull())
    after = F.col("frame") >= F.col("contact_frame")
    agg = rows.groupBy(*keys).agg(
        F.count_if(after).alias("n"), F.max(F.when(after, F.col("cy"))).alias("top"), F.min_by("cy", F.when(after, F.col("frame"))).alias("first"),
        (F.max("cy") - F.min("cy")).alias("span"),
    )
    height = (F.col("top") - F.col("first")) / F.greatest("span", F.lit(TINY))
    return agg.select(*keys, F.when(F.col("n") >= 2, height).otherwise(0.0).alias("bounce_norm"))


def metric_scale(rows: DataFrame, keys: list[str], diameter: float) -> DataFrame:
    """(keys, metres_per_px): known diameter over the median detected diameter."""
    return rows.groupBy(*keys).agg(F.try_divide(F.lit(diameter), F.median(2 * F.col("radius"))).alias("metres_per_px"))


def to_physical(rows: DataFrame, keys: list[str], scale: DataFrame, ground: float) -> DataFrame:
    """Adds x_m and y_m: from the first detected column and up from the ground, in metres."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x0 = F.first("cx", ignorenulls=True).over(w)
    rows = rows.join(scale, keys, "left").withColumn("__x0", x0)
    return rows.withColumns({"x_m": (F.col("cx") - F.col("__x0")) * F.col("metres_per_px"), "y_m": (ground - F.col("cy")) * F.col("metres_per_px")}).drop("__x0")


def to_diameters(rows: DataFrame, keys: list[str], robust: bool = False) -> DataFrame:
    """Adds x_d and y_d in object diameters: of the first detected radius, or (robust) of the median over the first twelve rows."""
    if robust:
        size = rows.groupBy(*keys).agg(F.coalesce(F.median(F.when(F.col("frame") <= 12, F.col("radius"))), F.median("radius")).alias("__r"))
    else:
        size = rows.groupBy(*keys).agg(F.min_by("radius", F.when(F.col("radius").isNotNull(), F.col("frame"))).alias("__r"))
    return rows.join(size, keys, "left").withColumns({"x_d": F.try_divide(F.col("cx"), 2 * F.col("__r")), "y_d": F.try_divide(F.col("cy"), 2 * F.col("__r"))}).drop("__r")
