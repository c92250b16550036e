"""Window operators over frames: gap filling, contact, fit windows and crossings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("frame", "event_id")


def fill_gaps(rows: DataFrame, keys: list[str], value: str, out: str, most: int = 5) -> DataFrame:
    """Adds ``out``: ``value`` with inner runs of at most ``most`` nulls filled on a line by row number; edges and longer runs stay null."""
    w = ordered(keys)
    known = F.when(F.col(value).isNotNull(), F.struct("__i", F.col(value).alias("v")))
    rows = rows.withColumn("__i", F.row_number().over(w))
    rows = rows.withColumn("__p", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    back = Window.partitionBy(*keys).orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, -1)  # runs on, where a frame to the end would be read anew for each row
    rows = rows.withColumn("__n", F.last(known, ignorenulls=True).over(back))
    gap = F.col("__n.__i") - F.col("__p.__i")
    line = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (F.col("__i") - F.col("__p.__i")) / gap
    return rows.withColumn(out, F.coalesce(F.col(value), F.when(gap - 1 <= most, line))).drop("__i", "__p", "__n")


def first_contact(rows: DataFrame, keys: list[str], reach: Column, ground: float, margin: float = 2.0) -> DataFrame:
    """(keys, contact_frame): the first frame at which ``reach`` comes within ``margin`` of the ground."""
    return rows.groupBy(*keys).agg(F.min(F.when(reach >= ground - margin, F.col("frame"))).alias("contact_frame"))


def precontact_mask(rows: DataFrame, keys: list[str], contacts: DataFrame, least: int = 5) -> DataFrame:
    """Adds ``used_for_fit``: frames before contact, or all frames if fewer than ``least`` remain."""
    rows = rows.join(contacts, keys, "left")
    before = F.col("contact_frame").isNull() | (F.col("frame") < F.col("contact_frame"))
    kept = F.count_if(before).over(Window.partitionBy(*keys))
    return rows.withColumn("used_for_fit", before | (kept < least))


def plateau_cut(rows: DataFrame, keys: list[str], diameter: float, latest: float = 2.5, start: int = 8) -> DataFrame:
    """(keys, cut): the first place, from ``start``, at which four frames in a row hardly move after a drop; null if there is none."""
    w = ordered(keys)
    used = rows.filter((F.col("time_s") <= latest) & F.col("cy").isNotNull()).withColumn("place", F.row_number().over(w) - 1)
    still = [F.abs(F.lead("cy", k + 1).over(w) - F.lead("cy", k).over(w)) < max(1.0, 0.035 * diameter) for k in range(3)]
    dropped = F.abs(F.col("cy") - F.first("cy").over(w)) > 0.8 * diameter
    marked = used.withColumn("flat", still[0] & still[1] & still[2] & dropped & (F.col("place") >= start))
    return marked.groupBy(*keys).agg(F.min(F.when(F.col("flat"), F.col("place"))).cast("long").alias("cut"))


def freeze_after(rows: DataFrame, keys: list[str], hit: Column, value: str, out: str) -> DataFrame:
    """Adds ``out``: from the first row where ``hit`` holds on, the value of that row."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.coalesce(F.first(F.when(hit, F.col(value)), ignorenulls=True).over(w), F.col(value)))


def swept_crossings(rows: DataFrame, keys: list[str], value: str, level: float) -> DataFrame:
    """(keys, frame, crossed_at): times between frames at which the value sinks to the level."""
    w = ordered(keys)
    rows = rows.withColumns({"__v": F.lag(value).over(w), "__t": F.lag("time_s").over(w)})
    down = rows.filter((F.col("__v") > level) & (F.col(value) <= level))
    share = (F.col("__v") - level) / (F.col("__v") - F.col(value))
    return down.select(*keys, "frame", (F.col("__t") + share * (F.col("time_s") - F.col("__t"))).alias("crossed_at"))


def rolling_angle(rows: DataFrame, keys: list[str], value: str, radius: float) -> DataFrame:
    """(keys, frame, angle): minus the way travelled so far over the radius."""
    w = ordered(keys)
    step = F.abs(F.col(value) - F.lag(value).over(w))
    rows = rows.withColumn("__s", F.coalesce(step, F.lit(0.0)))
    return rows.select(*keys, "frame", (-F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)) / radius).alias("angle"))


def monotonic_share(rows: DataFrame, keys: list[str], value: str, order: str, tolerance: float = 1e-8) -> DataFrame:
    """(keys, monotonic): the larger of the shares of steps that don't fall and that don't rise; null without a step."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = rows.select(*keys, (F.col(value) - F.lag(value).over(w)).alias("d")).filter("d IS NOT NULL")
    up, down = (F.avg((c).cast("double")) for c in (F.col("d") >= -tolerance, F.col("d") <= tolerance))
    return step.groupBy(*keys).agg(F.greatest(up, down).alias("monotonic"))


def _warped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Warping cost of each pair of series (pairs x points x axes), over the sum of both lengths; one row of the table is kept."""
    n, m = a.shape[1], b.shape[1]
    before = np.full((m + 1, a.shape[0]), np.inf)
    before[0] = 0.0
    for i in range(n):
        step = np.sqrt(((a[:, i, None, :] - b) ** 2).sum(axis=2)).T
        cheapest = np.minimum(before[1:], before[:-1])
        row = np.full_like(before, np.inf)
        for j in range(m):
            row[j + 1] = step[j] + np.minimum(cheapest[j], row[j])
        before = row
    return before[m] / (n + m)


def dtw_distance(pairs: DataFrame, keys: list[str], left: str, right: str, axes: int = 1) -> DataFrame:
    """(keys, dtw): dynamic time warping of two series, given as flat arrays of ``axes`` numbers for each point; null if either is empty.

    The recurrence has no declarative form of bounded size, so pairs of equal lengths of an Arrow batch are warped together; no cell is left out.
    """
    chosen = pairs.select(*keys, F.col(left).cast("array<double>").alias("__a"), F.col(right).cast("array<double>").alias("__b"))
    schema = T.StructType([*(chosen.schema[k] for k in keys), T.StructField("dtw", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("__a", "__b"))
            alike: dict[tuple[int, int], list[int]] = {}
            for k in range(batch.num_rows):
                if a[k] and b[k]:
                    alike.setdefault((len(a[k]), len(b[k])), []).append(k)
            out: list[float | None] = [None] * batch.num_rows
            for (n, m), rows in alike.items():
                found = _warped(np.array([a[k] for k in rows], float).reshape(len(rows), n // axes, axes), np.array([b[k] for k in rows], float).reshape(len(rows), m // axes, axes))
                for k, v in zip(rows, found.tolist(), strict=True):
                    out[k] = v
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.float64())], names=[*keys, "dtw"])

    return chosen.mapInArrow(run, schema)
